"""Words that a scan has damaged, restored from a vocabulary by their nearest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.functions.text import SKELETON_CLASSES, fold

# The words of an entry's grammar, which are worth restoring.
STRUCTURAL = (
    "administration administrateur administrateurs conseil conseils membre membres president presidents vice-president "
    "directeur delegue commissaire commissaires secretaire comite gerant censeur liquidateur conseiller"
).split()
WORD = "[A-Za-zÀ-ÿ]+"


def word_skeleton(word: Column) -> Column:
    """A word's letters in classes that a scan confuses."""
    plain = F.regexp_replace(F.lower(fold(word)), "[^a-zÀ-ÿ]", "")
    return F.translate(plain, "".join(SKELETON_CLASSES.values()), "".join(k * len(v) for k, v in SKELETON_CLASSES.items()))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row over the letters of both."""

    def row(old: Column, x: Column) -> Column:
        cell = lambda new, y, j: F.when(x == y, F.get(old, j) + 1).otherwise(F.greatest(F.get(old, j + 1), F.element_at(new, -1)))
        places = F.transform(F.split(b, ""), lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(places, F.array(F.lit(0)), lambda new, p: F.concat(new, F.array(cell(new, p["y"], p["j"]))))

    last = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(last, -1))


def ratio(a: Column, b: Column) -> Column:
    """200 times the common subsequence over the sum of lengths; 100 for two empty words."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * common(a, b) / both)


def rare_letters(skeleton: Column, least: float) -> Column:
    """So many of a word's letters, numbered by occurrence and in one order for all, that any word with
    the ratio ``least`` to it has one of them among its own."""
    share = least / 100
    letters = F.split(skeleton, "")
    numbered = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    first = F.length(skeleton) - F.ceil(F.length(skeleton) * (share / (2 - share)) - 1e-9) + 1
    return F.slice(F.sort_array(numbered, asc=False), F.lit(1), first.cast("int"))


def nearest(words: DataFrame, vocabulary: DataFrame, least: float = 85.0, gap: int = 2, letters: int = 6) -> DataFrame:
    """word, found, score: for each of words(word) the word of vocabulary(place, term) whose skeleton is most like its own.

    Only words of ``letters`` letters at least, with a term that is no more than ``gap`` longer or shorter and has
    the ratio ``least`` or more; of equal ones the term of the smallest place. Words are joined to terms that
    share one of a few letters and are of a like length, so the whole vocabulary is met by none. Null words
    find nothing; repeated words count once.
    """
    sides = words.select("word").distinct().where(F.length("word") >= letters).withColumn("s", word_skeleton(F.col("word"))).where("s <> ''")
    terms = vocabulary.select("place", "term").withColumn("t", word_skeleton(F.col("term"))).where("t <> ''")
    keyed = sides.select("word", "s", F.explode(rare_letters(F.col("s"), least)).alias("g"))
    by_letter = terms.select("place", "term", "t", F.explode(rare_letters(F.col("t"), least)).alias("g"))
    close = F.abs(F.length("word") - F.length("term")) <= gap
    # an edit changes a letter, which an insertion and a deletion do as well
    possible = F.levenshtein("s", "t") <= (F.length("s") + F.length("t")) * (1 - least / 100) + 1e-9
    pairs = keyed.join(by_letter, "g").where(close & possible).select("word", "s", "place", "term", "t").distinct()
    scored = pairs.withColumn("score", ratio(F.col("s"), F.col("t"))).where(F.col("score") >= least)
    best = scored.groupBy("word").agg(F.max(F.struct("score", -F.col("place"), "term")).alias("b"))
    return best.select("word", F.col("b.term").alias("found"), F.col("b.score").alias("score"))


def in_case_of(term: Column, printed: Column) -> Column:
    """A term in capitals, with a capital, or as it is, as the printed word is."""
    return F.when(printed.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"), F.upper(term)).when(printed.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(term, F.lit(1))), F.substring(term, 2, 1000))).otherwise(term)


def repaired(rows: DataFrame, text: str, vocabulary: DataFrame, least: float = 85.0) -> DataFrame:
    """rows with the words of their text that resemble one of the vocabulary put right, in the case as printed.

    Each distinct word is looked up once; rows with none to mend aren't touched, and none is lost.
    """
    pieces = F.array_distinct(F.filter(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 6))
    words = rows.select(F.explode(pieces).alias("word"))
    fixes = nearest(words, vocabulary, least).select("word", in_case_of(F.col("found"), F.col("word")).alias("found")).where("word <> found")
    own = [c for c in rows.columns if c != text]
    found = rows.select(F.col(text).alias("text_")).distinct().select("text_", F.explode(F.array_distinct(F.regexp_extract_all("text_", F.lit(WORD), F.lit(0)))).alias("word")).join(fixes, "word")
    maps = found.groupBy("text_").agg(F.map_from_entries(F.collect_list(F.struct("word", "found"))).alias("fix_"))
    joined = rows.join(maps, rows[text] == maps["text_"], "left")
    # words and what parts them alternate; a text begins with a gap
    gaps, found_words = F.split(F.col(text), WORD, -1), F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    mended = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), found_words.alias("w")), lambda x: F.concat(x["g"], F.coalesce(F.col("fix_")[x["w"]], x["w"], F.lit("")))), "")
    return joined.select(*own, F.when(F.col("fix_").isNull(), F.col(text)).otherwise(mended).alias(text)).select(*rows.columns)
