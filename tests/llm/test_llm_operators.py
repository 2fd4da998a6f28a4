"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import chat, embeddings, fingerprints, language, lines, minhash, packing, quality, sentencepieces, suffixes  # noqa: E402
from interlace.llm.queries import vocabulary  # noqa: E402

WORDS = "the of and river stone light cloud garden yellow mountain paper".split()


def fixture(seed=3, n=40):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = rng.choice(texts)
        if rng.random() < 0.5:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i * 3, t + ("\n" + rng.choice(texts)[:60] if rng.random() < 0.3 else "")))
    return [*rows, (500, None), (501, ""), (502, "é" * 400), (503, "a" * 900), (504, "a" * 300)]


def docs(spark, rows=None):
    return spark.createDataFrame([(a, b, "x") for a, b in (fixture() if rows is None else rows)], "doc_id long, text string, key string")


def removed(rows, n=50):
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first.setdefault(b[p : p + n], d) < d:
                cover[p : p + n] = True
        out[d] = (len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())
    return out


def test_suffixes(spark):
    assert {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs(spark)).collect()} == removed(fixture())
    twice = [*fixture(), (500, "again " * 30), (3, fixture()[1][1]), (None, "x" * 80)]
    assert suffixes.remove_repeats(docs(spark, twice)).count() == len(twice)
    assert suffixes.without_repeats(docs(spark)).columns == ["doc_id", "text", "key"]
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_lines(spark):
    seen, want = [], {}
    for d, t in sorted(fixture()):
        keep = []
        for line in (t or "").split("\n"):
            s = {w for w in line.lower().split(" ") if w}
            if not s or not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                keep.append(line)
            if s:
                seen.append(s)
        want[d] = hashlib.sha256("\n".join(keep).encode()).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in lines.digests(docs(spark)).collect()} == want
    assert lines.digests(docs(spark, [])).count() == 0


def test_minhash(spark):
    rows = fixture()
    sets = {d: minhash.weighted(*_utf8([t or ""]))[1:] for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] > label[b] and len(sets[a][0]) and minhash.similarity(sets[a], sets[b]) >= 0.8:
                    label[a] = label[b]
                    changed = True
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark)).collect()} == label
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.one_of_each(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f")])).count() == 1


def test_tiles_find_what_pairs_find():
    rng = np.random.default_rng(0)
    for most in (1, 3, 9):
        sets = [(np.sort(rng.choice(30, 20, replace=False)).astype(np.uint64), rng.integers(1, most + 1, 20) if i % 3 else np.ones(20, int)) for i in range(40)]
        sets += [(e[:18], w[:18]) for e, w in sets[:10]]
        left, right = np.arange(30), np.arange(20, 50)
        wanted = rng.random((30, 30)) < 0.8
        good = minhash.similarities(sets, 0.5, left, right, wanted)
        want = [[bool(wanted[i, j]) and minhash.similarity(sets[left[i]], sets[right[j]]) >= 0.5 - 1e-9 for j in range(30)] for i in range(30)]
        assert good.tolist() == want and 0 < good.sum() < wanted.sum()


def _utf8(texts):
    import pyarrow as pa

    from interlace.llm.common import utf8

    return utf8(pa.array(texts, pa.large_string()))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[20:40] = x[:20] + rng.normal(size=(20, 8)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [None] * 8)]
    unit = np.vstack([x, x[:1]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), unit=16).collect()}
    assert [got[i].n_links for i in range(61)] == links.tolist() and got[60].component_id == 0
    assert all(got[i].n_links == 0 and got[i].kept for i in range(61, 65))


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*fixture(), (600, "long words " * 3000)]
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = packing.pack(docs(spark, rows), vocabulary("word_bpe_49k.json")).collect()
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in out)
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([7, 6, 4, 3], 10) == ([0, 1, 1, 0], [0, 0, 6, 7])


def test_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(5)
    odd = ["a", " ", "  ", "\n", "▁", "é", "the", "\t", "<s>", "😀", "12", "日本", "\x00"]
    rows = [*fixture(), *((700 + i, "".join(rng.choice(odd) for _ in range(12))) for i in range(200))]
    got = {r.doc_id: r for r in sentencepieces.digests(docs(spark, rows), vocabulary("piece_bpe_32k.model")).collect()}
    for d, t in rows:
        ids = lib.encode(t or "")
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()
    first = {r.doc_id: r for r in sentencepieces.encode(docs(spark, [(1, "Hello wide world")]), vocabulary("piece_bpe_32k.model")).collect()}[1]
    assert first.ids == lib.encode("Hello wide world") and list(first.begins) == [0, 5, 10]


def test_chat(spark):
    part = lambda kind, text=None, ref=None, n=0: (kind, text, ref, n)
    turns = [(1, 0, "user", [part("text", "a <|end|>\n & &lt; b"), part("image", ref="i.png", n=7)]), (1, 1, "assistant", [part("text", "<|turn|>x\n")]), (2, 0, None, [part("text")])]
    out = chat.format_chats(spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [t.content for t in back[1].turns] == ["a <|end|>\n & &lt; b<|image:1|>", "<|turn|>x\n"]
    assert back[1].attachment_tokens == 7 and back[1].attachments[0].ref == "i.png" and len(back[2].turns) == 1
    assert chat.digests(out).where("conv_id = 1").first().loss_chars == len("<|turn|>x\n")


def test_fingerprints(spark):
    rows = fixture()
    out = {r.doc_id: r for r in fingerprints.fingerprint(docs(spark, rows)).collect()}
    order = sorted(rows)
    for (d, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        assert out[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    same = {}
    for d, t in rows:
        same.setdefault(t or "", set()).add(out[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) if i % 4 else "BUY!! NOW!! " * rng.randrange(5, 30)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    out = quality.classify(docs(spark, [*rows, (900, None), (901, "")]), labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(out) == 402 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert quality.classify(docs(spark), labels.where("false")).count() == len(fixture())


def test_language(spark):
    d = spark.createDataFrame([("the river and the stone of light " * 9, "en"), ("der fluss und die steine des lichts " * 9, "de")], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.example.com/de/1", "<html lang='de'><p>der fluss und die steine</p></html>"), (2, "http://b.example.com/en/1", "<html><p>the stone of light</p></html>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(pages, d).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and len(got) == 3


def test_pages_without_a_host_are_no_neighbours(spark):
    d = spark.createDataFrame([("the river and the stone of light " * 9, "en"), ("der fluss und die steine des lichts " * 9, "de")], "text string, lang string")
    german = "<p>der fluss und die steine des lichts</p>"
    answer = lambda urls: {r.page_id: r.probability for r in language.identify(spark.createDataFrame([(i, u, german) for i, u in enumerate(urls)] + [(99, None, "")], "page_id long, url string, html string"), d).collect()}[99]
    assert abs(answer([None] * 12) - answer([f"http://h{i}.org/" for i in range(12)])) < 0.02
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), d).count() == 0
