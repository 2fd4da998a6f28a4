"""Candidates of names made of few letters, which are all somewhat alike, and words mended only where they are held."""

import random
import time

from pyspark.sql import functions as F

from interlace.functions import entries
from interlace.functions.text import indel_ratio
from interlace.operators import linkage


def test_thousands_of_names_of_one_spelling_rule(spark):
    rng = random.Random(9)
    syllables = "ta na sa ba ga va ra da pa za".split()
    names = sorted({"".join(rng.choices(syllables, k=12)) for _ in range(2500)} | {"", "é" * 90, "é" * 80 + "x", "z"})
    names += [names[5] + "ta", names[9][2:]]
    start = time.time()
    got = {tuple(r) for r in linkage.scan_candidates(spark.createDataFrame([(n,) for n in names], "k string"), block=700).collect()}
    assert time.time() - start < 40  # three million pairs, of which any two share letters
    some = set(rng.sample(names, 60)) | {names[5], names[9], names[-1], names[-2], "é" * 90}
    want = {(min(a, b), max(a, b)) for a in some for b in names if a and b and a != b and indel_ratio(a, b) >= 80}
    assert {p for p in got if some & set(p)} == want and ("é" * 80 + "x", "é" * 90) in want
    assert linkage.scan_candidates(spark.createDataFrame([], "k string")).count() == 0


def test_words_are_mended_in_any_case(spark):
    texts = ["Soc iété et BAN QUE", "ADMİNISTRATION", "Compagnıe", "aſsurance", "Admi\nnistrateur Con\tseil", "rien", "", "Ban que Soc iété Com pagnie", "des I1a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")

    def each(text):  # every word is looked for in every text
        text = F.regexp_replace(text, r"(?i)\b(de|du|des)\s+[I1l\]|]([ae])\b", "$1 l$2")
        text = F.regexp_replace(text, r"\b[I1](['’])", "l$1")
        for w in entries.BREAKABLE:
            rest = "|".join([w[1:], *[rf"{w[1:i]}\s{w[i:]}" for i in range(2, len(w) - 1)]])
            for first in (w[0].upper(), w[0]):
                text = F.regexp_replace(text, rf"{first}(?iu:{rest})", first + w[1:])
        return text

    got = {r.i: r.m for r in df.select("i", entries.mend_words(F.col("t")).alias("m")).collect()}
    assert got == {r.i: r.m for r in df.select("i", each(F.col("t")).alias("m")).collect()}
    assert got[1] == "Administration" and got[9] is None
