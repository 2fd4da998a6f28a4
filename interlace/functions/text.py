"""Name and text functions as column expressions; one Arrow function where no built-in exists."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spelling rules for one token, in order; each is a pattern and its replacement.
TOKEN_RULES = (
    ("aou", "au"),
    ("eou", "eu"),
    ("ou", "u"),
    ("aw", "au"),
    ("ow", "u"),
    ("w", "u"),
    ("ch", "sh"),
    ("ph", "f"),
    ("q", "k"),
    ("c(?=[eiy])", "s"),
    ("c", "k"),
    ("y", "i"),
    (r"(.)\1+", "$1"),
    ("(?<=[aeiou])h(?=[aeiou])", ""),
    ("j", "g"),
    ("e$", ""),
    (r"(.)\1+", "$1"),
)
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Letters that a scan confuses, class by class, after the letter that stands for the class.
SKELETON_CLASSES = {"i": "iltj1|!¡íìîïĺf", "c": "ceoa0œéèêëàâäôöòó", "n": "numh", "s": "s58$§", "b": "bk", "g": "g9q", "v": "vwy"}
# Pairs of letters whose exchange is cheap.
CHEAP_PAIRS = (
    "il it lt l1 i1 ij jl if fl ft ce co eo ea ao nu nm mu hn hb sf s5 s8 b6 bh g9 gq "
    "vy vw uv rn cd pd db e1 el 0o 0c 8b"
).split()
CHEAP = {frozenset(p) for p in CHEAP_PAIRS}
# Words of names that carry no signal, legal forms, and words that tell no firm from another.
PARTICLES = "de di da del della van von el al abu abou ibn ben".split()
LEGAL_FORMS = ("societe anonyme egyptienne", "compagnie egyptienne", "societe egyptienne", "company limited", "societe anonyme", "company ltd", "compagnie", "limited", "societe", "the", "ltd")
COMPANY_ARTICLES = "de des du d la le les l et of and for pour en a au aux".split()
COMPANY_STOPWORDS = "co cy cie ltd limited sae sa ste the of and et de du des la le les l d en pour company societe compagnie egypt egypte".split()


def fold(text: Column) -> Column:
    """Accents off, length kept, so offsets stay valid."""
    return F.translate(text, ACCENTED, PLAIN)


def token_key(token: Column) -> Column:
    start = F.regexp_replace(F.lower(fold(token)), "[^a-z]", "")
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), TOKEN_RULES, start)


def name_key(name: Column, particles: tuple[str, ...] = tuple(PARTICLES)) -> Column:
    """Keys of a name's tokens; particles and single letters are dropped."""
    parts = F.filter(F.split(F.lower(fold(name)), r"[\s'’.-]+"), lambda t: ~t.isin(*particles) & (F.length(t) > 1))
    return F.array_join(F.transform(parts, token_key), " ")


def company_key(name: Column) -> Column:
    """A firm's name without accents, punctuation, legal forms and articles."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    plain = squeeze(F.regexp_replace(F.lower(fold(name)), "[^a-z0-9 ]", " "))
    plain = F.regexp_replace(plain, r"\b(?:" + "|".join(LEGAL_FORMS) + r")\b", " ")
    return squeeze(F.regexp_replace(plain, r"\b(?:" + "|".join(COMPANY_ARTICLES) + r")\b", " "))


def company_tokens(name: Column) -> Column:
    """Words that tell a firm from others: two letters at least, no stopword."""
    return F.filter(F.split(company_key(name), " "), lambda t: (F.length(t) > 1) & ~t.isin(COMPANY_STOPWORDS))


def company_letters(name: Column) -> Column:
    return F.array_join(company_tokens(name), "")


def skeleton(name: Column) -> Column:
    """A firm's letters in classes that a scan confuses; of a name of stopwords only, all its letters."""
    key = company_key(name)
    kept = F.array_join(F.filter(F.split(key, " "), lambda t: ~t.isin(COMPANY_STOPWORDS)), "")
    letters = F.when(kept != "", kept).otherwise(F.replace(key, F.lit(" "), F.lit("")))
    return F.translate(letters, "".join(SKELETON_CLASSES.values()), "".join(k * len(v) for k, v in SKELETON_CLASSES.items()))


def is_header(line: Column) -> Column:
    """A short line, mostly capitals."""
    letters, upper = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return F.length(line).between(6, 120) & (letters >= 4) & (upper > 0.85 * letters)


def blocks(docs: DataFrame) -> DataFrame:
    """Lines of each document cut into blocks at header lines: doc_id, block, lines, chars."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("block", F.sum(is_header(F.col("line")).cast("long")).over(w))
    return rows.groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The label of the first rule whose pattern occurs."""
    head, *rest = rules
    c = F.when(text.rlike(head[1]), head[0])
    for label, pattern in rest:
        c = c.when(text.rlike(pattern), label)
    return c.otherwise(otherwise)


def lexicon_class(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Ordered lexicon classification: lexicon(term, pass, prio, label); by pass, then token place, then priority."""
    tokens = df.select(key, F.posexplode(F.split(F.lower(text), " ")).alias("place", "term"))
    best = tokens.join(lexicon, "term").groupBy(key).agg(F.min_by("label", F.struct("pass", "place", "prio")).alias("label"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("label", F.lit("unknown")).alias("label"))


def distance(a: str, b: str) -> float:
    """Edit distance in which confused letters cost 0.3, over the longer length."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    row = np.arange(len(b) + 1.0)
    steps = np.arange(len(b) + 1.0)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        cost = np.array([0.0 if x == y else 0.3 if frozenset((x, y)) in CHEAP else 1.0 for y in b])
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + cost)
        # insertions run along the row: the least of what stands before, plus the steps from there
        row = np.minimum.accumulate(new - steps) + steps
    return float(row[-1]) / max(len(a), len(b))


def extra_word(a: list[str], b: list[str], most: float = 0.50, least: int = 4) -> bool:
    """Whether a word of four letters or more has no counterpart within that distance in the other name."""
    a, b = ([t for t in side if len(t) >= least] for side in (a, b))
    return bool(a and b) and any(min(distance(t, o) for o in other) > most for side, other in ((a, b), (b, a)) for t in side)


def scan_distance(a: str, b: str) -> Column:
    """distance() of two columns, by Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distance(i, j) for i, j in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over the sum of lengths.

    A row of the subsequence's table is one integer, in which bits that are 0 mark the letters of b where it grows.
    """
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & whole
    common = len(b) - row.bit_count()
    return 200 * common / (len(a) + len(b)) if a or b else 100.0
