"""Fingerprints don't depend on partitions or on what stands beside a text; likeness is that of brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import fingerprints  # noqa: E402
from interlace.llm.common import ODD, utf8  # noqa: E402

MASK = (1 << 64) - 1


def mix(h, odd):
    h = h * odd & MASK
    return h ^ h >> 32


def brute(text):
    """A text's signature, gram by gram."""
    raw = text.encode()
    if not raw:
        return [0] * 64
    grams = [raw[i : i + 8] for i in range(len(raw) - 7)] or [raw]
    seen, bins = Counter(), {}
    for place, g in enumerate(grams):
        name = mix(int.from_bytes(g.ljust(8, b"\0"), "little") ^ ODD[1], ODD[0])
        v = mix(mix(name + seen[g] * ODD[2] & MASK, ODD[4]), ODD[0])
        seen[g] += 1
        bins.setdefault(v >> 58, []).append((v, place))
    out = {}
    for b, found in bins.items():
        two = sorted(found)[:2]
        first, last = sorted([two[0], two[-1]], key=lambda x: x[1])
        t = first[0] * ODD[3] & MASK
        t = (t ^ t >> 31) + last[0] & MASK
        out[b] = (mix(t, ODD[2]) >> 40 & 0xFFFF) | 1
    signature = []
    for b in range(64):
        near = next(k for k in range(b, b + 64) if k % 64 in out)
        signature.append((out[near % 64] + 2 * 7919 * (near - b) & 0xFFFF) | 1 if near != b else out[b])
    return signature


def of(texts):
    return fingerprints.signatures(*utf8(pa.array(texts, pa.large_string())))


def test_signatures_are_those_of_brute_force():
    rng = random.Random(1)
    texts = ["", "a", "abcdefg", "ab" * 300, "é" * 40, *["".join(rng.choice("abc dé") for _ in range(rng.randrange(400))) for _ in range(60)]]
    assert of(texts).tolist() == [brute(t) for t in texts]


def test_equal_texts_have_equal_fingerprints_in_any_company():
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (60_000, 30_000, 9_000, 500, 20) for _ in range(12)]
    alone = [of([t])[0].tolist() for t in texts]
    for size in (2, 5, len(texts)):
        shuffled = list(rng.permutation(len(texts)))
        for first in range(0, len(texts), size):
            part = shuffled[first : first + size]
            assert of([texts[i] for i in part]).tolist() == [alone[i] for i in part]


def test_one_partition_empty_tables_and_repeated_rows(spark):
    rows = [(2, "two words here and there", "x"), (1, None, "x"), (1, "one", "x"), (2, "two words here and there", "x"), (None, "none", "x"), (9, "z" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    one = sorted(map(repr, fingerprints.fingerprint(docs, 1).collect()))
    assert one == sorted(map(repr, fingerprints.fingerprint(docs, 5).collect())) and len(one) == len(rows)
    for parts in (1, 4):
        assert fingerprints.fingerprint(docs.limit(0), parts).count() == 0
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs.where("doc_id = 9"), 1).collect()}
    assert got[9].near_next == got[9].near_edited == 1.0  # the only document follows itself


def test_likeness_is_that_of_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(200)))) for i in range(25)]
    rows += [(30, rows[3][1]), (31, rows[3][1])]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(brute(a), brute(b), strict=True)) / 64
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (got[d].near_edited, got[d].near_next) == (alike(t, edited), alike(t, after))
    assert got[30].near_next == 1.0 and got[30].fingerprint == got[31].fingerprint == got[3].fingerprint
