"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import runs  # noqa: E402


def brute(w):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            part = w[i : j + p]
            least = next(q for q in range(1, p + 1) if part[q:] == part[:-q])
            if least == p and len(part) >= max(6, 4 * p):
                out.append((i, len(part), p))
            i = j + 1
    return sorted(out)


def with_runs(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 5 else 0):
        a, p = rng.randrange(n), rng.randrange(1, 12)
        for i in range(a, min(n, a + p * rng.randrange(3, 9) + rng.randrange(p + 1))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = with_runs(rng, rng.randrange(150), rng.choice([1, 2, 2, 3, 5, 30]))
        assert runs.find_runs(np.array(w, np.int32)) == brute(w), w


def test_long_texts_of_few_words():
    assert runs.find_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    assert runs.find_runs((np.arange(100_001) % 3).astype(np.int32)) == [(0, 100_001, 3)]
    nested = np.tile(np.repeat(np.arange(40), 9), 30).astype(np.int32)
    got = runs.find_runs(nested)
    assert (0, len(nested), 360) in got and len(got) == 1 + 40 * 30


def digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_digests(spark):
    rng = random.Random(6)
    texts = [rng.choice([" ", "\n", "\t\x0b"]).join(f"é{x}" for x in with_runs(rng, rng.randrange(90), rng.choice([2, 4, 40]))) for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (4, texts[9]), (None, texts[5]), (None, None), (900, None), (901, ""), (902, " \n "), (903, "a a a a a a"), (904, "a a a a a"), (905, "a a " * 12)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, runs int, start int")
    got = [tuple(r) for r in runs.digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr(digest(*r)) for r in rows)
    assert any(g[1] for g in got) and sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5
    assert runs.digests(docs.limit(0)).count() == 0


def test_runs_and_shorter_texts_of_whole_rows(spark):
    rows = [(1, "go on and on and on and on and on", 7), (1, "go on and on and on and on and on", 7), (None, None, 8), (2, "plain  text", 9), (3, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs int")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "Runs"]
    assert [[tuple(x) for x in r["Runs"]] for r in found.collect()] == [[(1, 9, 2)], [(1, 9, 2)], [], [], []]
    assert [r.text for r in runs.collapsed(docs).collect()] == ["go on and", "go on and", None, "plain  text", ""]
    assert runs.collapsed(docs.limit(0)).count() == runs.periodic_runs(docs.limit(0)).count() == 0
