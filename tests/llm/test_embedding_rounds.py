"""What is dealt out at once is a few times the table, however many units a vector meets, and no link is lost between rounds."""

import numpy as np
import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import embeddings  # noqa: E402
from tests.llm.test_embedding_cells import brute  # noqa: E402


def written(spark):
    """Rows that each stage so far has dealt out."""
    java = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(java.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), java.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(embeddings, "VISITS", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 3).astype(np.float32)
    x[200:] = x[:200] + np.float32(0.25) * np.round(rng.normal(size=(200, 4)), 3).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    links, label = brute(rows)
    before = written(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), unit=16).collect()}
    assert got == {i: (links[i], label[i]) for i in range(400)}
    # all units at once would be some thousands of rows
    assert max(n for stage, n in written(spark).items() if stage not in before) < 400 * 3 * 2
