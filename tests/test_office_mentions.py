"""Offices named in texts against a scan in Python, and how often a text is read."""

import random
import re

from interlace.functions import registers
from interlace.plans.queries import QUERIES

RULES, EXCLUDED, PAST = (("cabinet", "minister"), ("court", "judge|bailiff")), "ministerial|prejudge", "(?:ex|late) "


def test_same_as_a_scan(spark):
    rng = random.Random(6)
    words = ["minister", "ministerial", "judge", "bailiff", "prejudge", "ex", "late", "and", "x"]
    texts = [None, "", "ex minister", "ex minister, minister", "ministerial ex judge", *(" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(300))]
    want = set()
    for k, t in enumerate(texts):
        for office, pattern in RULES:
            found = [m for m in re.finditer(f"({EXCLUDED})|({PAST})?({pattern})", t or "") if m[3]]
            if found:
                want.add((k, office, all(m[2] for m in found)))
    got = registers.offices(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", RULES, EXCLUDED, PAST).collect()
    assert len(got) == len(want) > 200 and {tuple(r) for r in got} == want


def test_a_text_is_read_twice_for_an_office_at_most(spark):
    plan = QUERIES["offices_named"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 * 3
