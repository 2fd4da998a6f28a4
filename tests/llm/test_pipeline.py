"""Each stage of the pipeline on what the one before kept, against brute force where that is short."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from interlace.llm import minhash  # noqa: E402
from interlace.llm.common import table, utf8  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from interlace.llm.queries import vocabulary

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r.text or "" for r in docs.collect()})
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= set(seen[-1])
    _, _, before, kept, last = seen  # before: what near-dedup reads
    # near-dedup: one document of each group that brute force links, the smallest
    sets = {d: minhash.weighted(*utf8(pa.array([t], pa.large_string())))[1:] for d, t in before.items()}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a][0]) and minhash.similarity(sets[a], sets[b]) >= 0.8]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert set(kept) == {d for d in label if label[d] == d}
    # byte strings: every document stays, none gets longer
    assert set(last) == set(kept) and all(len(last[d]) <= len(kept[d]) for d in last)
    # packing: each document's ids lie in its pieces, once
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in last.items()}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
