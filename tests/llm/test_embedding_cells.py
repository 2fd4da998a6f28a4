"""Near-duplicate vectors where cells are unlike, lengths differ, ids repeat and components are extreme."""

import numpy as np
import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import embeddings  # noqa: E402


def brute(rows, threshold=0.9):
    """(n_links, component's smallest row) of each row, vectors of one length against each other."""
    unit = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    links = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    label = list(range(len(rows)))
    while any(label[j] < label[i] for i in range(len(rows)) for j in links[i]):
        for i in range(len(rows)):
            label[i] = min([label[i], *(label[j] for j in links[i])])
    return [len(x) for x in links], label


def found(spark, rows, **more):
    return embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **more).collect()


def test_tight_clusters_beside_wide_cells(spark):
    """In each of eight planes 30 vectors in one direction, 25 a radian away, and five far from both."""
    angles = np.concatenate([np.linspace(0, 0.01, 30), np.linspace(1, 1.01, 25), np.linspace(1.9, 1.91, 5)])
    x = np.zeros((8 * 60, 16))
    for plane in range(8):
        x[plane * 60 : plane * 60 + 60, 2 * plane : 2 * plane + 2] = np.stack([np.cos(angles), np.sin(angles)], 1)
    rows = [(6000 + i, v.tolist()) for i, v in enumerate(x)]
    links, label = brute(rows)
    got = {r.vec_id - 6000: r for r in found(spark, rows, unit=32)}
    assert (sum(r.n_links for r in got.values()), [got[i].n_links for i in range(len(rows))]) == (sum(links), links)
    assert [got[i].component_id - 6000 for i in range(len(rows))] == label


def test_a_tile_of_two_units_with_rows_of_one():
    x = np.array([[1.0, 0.0], [1.0, 0.01]])
    args = np.arange(2), x, np.ones(2, int), np.zeros(2, int)
    assert embeddings.tile(*args, False, 0.9).empty and embeddings.tile(*args, True, 0.9).n.tolist() == [1, 1]


def test_each_length_within_itself(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [3.0])]
    assert {r.vec_id: (r.n_links, r.component_id) for r in found(spark, rows)} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_extreme_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, 1.0]), (3, [1.0, -1.0]), (4, [1.0, float("inf")])]
    assert {r.vec_id: (r.n_links, r.component_id) for r in found(spark, rows)} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4)}


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.1]), (None, [-1.0, 0.0]), (None, [-1.0, 0.1]), (None, [0.0, -1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found(spark, rows)), key=str)
    assert got == sorted([(5, 1, 5), (5, 0, 5), (6, 1, 5), (None, 1, None), (None, 1, None), (None, 0, None)], key=str)
