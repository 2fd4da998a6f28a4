"""Distances, eigenvectors, fits and nulls against brute force, numpy and exact enumeration."""

import itertools
import random
from collections import deque

import numpy as np
import pytest

from interlace.operators import distances, dyadic, nulls


def frame(spark, rows, schema="year long, person long, firm long"):
    return spark.createDataFrame(rows, schema)


def brute_distance(rows, year, person, firm):
    near = {}
    for y, p, f in rows:
        if y == year:
            near.setdefault(("p", p), set()).add(("f", f))
            near.setdefault(("f", f), set()).add(("p", p))
    far, queue = {("p", person): 0}, deque([("p", person)])
    while queue:
        v = queue.popleft()
        for w in near.get(v, ()):
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
    return far.get(("f", firm), -1)


def test_geodesics(spark):
    rng = random.Random(8)
    rows = {(y, rng.randrange(14), rng.randrange(12)) for y in (1, 2) for _ in range(17)} | {(3, i, i) for i in range(6)} | {(3, i + 1, i) for i in range(6)}
    wanted = [(y, p, f) for y in (1, 2, 3, 4) for p in range(15) for f in range(13)]
    got = {tuple(r)[:3]: r.distance for r in distances.geodesics(frame(spark, [*rows, *rows]), frame(spark, wanted + wanted[:9])).collect()}
    assert got == {w: brute_distance(rows, *w) for w in wanted}
    assert {got[3, 0, 0], got[3, 0, 5], got[3, 0, 9], got[4, 0, 0]} == {1, 11, -1}
    assert distances.geodesics(frame(spark, list(rows)), frame(spark, [])).count() == 0


def test_ties_by_the_distance_before(spark):
    ties = frame(spark, [(1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 1, 3), (2, 2, 2), (2, 3, 3), (2, 4, 1)])
    got = {tuple(r) for r in distances.formed_at_distance(ties).collect()}
    assert got == {(2, 1, 2, 3), (2, 1, 3, -1), (2, 2, 2, 1), (2, 3, 3, 1)}


def test_leading_eigenvectors_are_numpys(spark):
    rng = random.Random(3)
    rows = [(y, p, f) for y in (1, 2) for p in range(20) for f in rng.sample(range(12), rng.randrange(1, 4))] + [(3, 1, 1)]
    got = {}
    for r in distances.eigenvectors(frame(spark, rows)).collect():
        got.setdefault(r.year, {})[r.person] = r.eigenvector
    for year in (1, 2):
        b = np.zeros((20, 12))
        for y, p, f in rows:
            if y == year:
                b[p, f] = 1
        a = b @ b.T
        np.fill_diagonal(a, 0)
        want = np.abs(np.linalg.eigh(a)[1][:, -1])
        assert np.array([got[year][p] for p in range(20)]) == pytest.approx(want, abs=2e-5)
    assert got[3] == {1: 1.0}
    frame_ = {r.person: tuple(r) for r in distances.wave_frame(frame(spark, [(1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 1, 2), (1, 3, 3)])).collect()}
    assert frame_[1][2:5] == (2, 1, 2) and frame_[3][2:5] == (1, 0, 0)


def newton(x, y, w, link):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        eta = x @ beta
        mu = np.exp(eta) if link == "poisson" else 1 / (1 + np.exp(-eta))
        c = mu if link == "poisson" else mu * (1 - mu)
        beta += np.linalg.solve((x * (w * c)[:, None]).T @ x, x.T @ (w * (y - mu)))
    return beta


@pytest.mark.parametrize("link", ["logit", "poisson"])
def test_every_replicate_is_its_weighted_fit(spark, link):
    rng = np.random.default_rng(1)
    unit, a = rng.integers(0, 40, 600), rng.integers(0, 3, 600)
    y = rng.poisson(1, 600) if link == "poisson" else (rng.random(600) < 0.3 + 0.1 * a).astype(int)
    df = frame(spark, [(int(u), 1, int(v), int(o)) for u, v, o in zip(unit, a, y, strict=True)], "person long, edges int, a int, tie int")
    found = dyadic.fit(df, ["edges", "a"], "tie", "person", 20, 5, link)
    weights = dyadic.unit_weights(unit, 20, 5)
    assert found["settled"].all() and found["rows"] == 600 and found["ties"] == y.sum() and (weights[:, 0] == 1).all()
    x = np.stack([np.ones(600), a], 1)
    for b in range(21):
        assert found["beta"][b] == pytest.approx(newton(x, y, weights[:, b], link), abs=1e-6)
    draws = found["beta"][1:]
    rows = {r.term: r for r in dyadic.mple(df, ["edges", "a"], replicates=20, seed=5, link=link).collect()}
    assert rows["a"].boot_se == pytest.approx(draws[:, 1].std(ddof=1), abs=2e-6) and rows["a"].lo == pytest.approx(np.percentile(draws[:, 1], 2.5), abs=2e-6) and rows["a"].n_boot == 20


def test_weights_are_poisson():
    w = dyadic.unit_weights(np.arange(20_000), 20, 9)[:, 1:]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() > 6 and 1 - dyadic.poisson_cdf()[-1] < 2**-32
    assert (w == dyadic.unit_weights(np.arange(20_000), 20, 9)[:, 1:]).all() and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_a_term_without_variation_leaves_replicates_out(spark):
    df = frame(spark, [(i, 1, 0, i % 2) for i in range(30)], "person long, edges int, a int, tie int")
    assert {r.n_boot for r in dyadic.mple(df, ["edges", "a"], replicates=10).collect()} == {0}


def test_processes_and_forms(spark):
    rng = random.Random(2)
    rows = [(i % 25, 1, rng.randrange(3), rng.randrange(2), rng.randrange(4), rng.randrange(5), int(rng.random() < 0.4)) for i in range(500)]
    df = frame(spark, rows, "person long, edges int, a int, memory int, closure long, cycles long, tie int")
    got = dyadic.by_process(df, ["edges", "memory", "a"], replicates=5).collect()
    assert {(r.process, r.term) for r in got} == {(p, t) for p in ("formation", "retention") for t in ("edges", "a")}
    assert {r.process: r.n_dyads for r in got} == {"formation": sum(r[3] == 0 for r in rows), "retention": sum(r[3] == 1 for r in rows)}
    forms = dyadic.closure_forms(df, ["edges"], replicates=5).collect()
    assert [r.form for r in forms if r.term != "edges"] == ["closure", "closure_any", "closure_log", "closure4"] and sum(r.form == "none" for r in forms) == 1


def exact(cells, stat):
    """All deals of labels within cells, equally likely: the statistic of each."""
    choices = [list(itertools.combinations(range(len(v)), k)) for v, k in cells]
    return [stat([(sum(v[i] for i in pick), sum(v), k, len(v) - k) for pick, (v, k) in zip(picks, cells, strict=True)]) for picks in itertools.product(*choices)]


def test_nulls_are_those_of_all_deals(spark):
    cells = [([0, 1, 1, 2, 5], 2), ([3, 3, 4, 8], 2)]
    rows = [(c, i < k, v) for c, (vs, k) in enumerate(cells) for i, v in enumerate(vs)]
    df = frame(spark, [(c, g, float(v)) for c, g, v in rows] + [(0, None, 4.0), (1, True, None)], "year int, g boolean, y double")
    gap = lambda s1, s, n1, n0: s1 / n1 - (s - s1) / n0

    def pooled(x):
        w = [n1 * n0 / (n1 + n0) for *_, n1, n0 in x]
        return sum(gap(*c) * v for c, v in zip(x, w, strict=True)) / sum(w)

    def all_waves(x):
        s1, s, n1, n0 = map(sum, zip(*x, strict=True))
        return gap(s1, s, n1, n0)

    for stat, run in ((pooled, lambda: nulls.stratified_null(df, ["year"], "g", "y", 20000, 2)), (all_waves, lambda: nulls.redrawn_gap(df, "g", "y", draws=20000))):
        every = exact(cells, stat)
        seen = stat([(sum(v[:k]), sum(v), k, len(v) - k) for v, k in cells])
        got = run().first()
        assert got.observed == round(seen, 6) and got.draws == 20000
        assert got.p == pytest.approx(np.mean(np.abs(every) >= abs(seen) - 1e-12), abs=0.015)
        assert got.lo == pytest.approx(np.quantile(every, 0.025), abs=0.6) and got.hi == pytest.approx(np.quantile(every, 0.975), abs=0.6)
    one = {r.year: r for r in nulls.wave_null(df, "g", "y", draws=4000, least=2).collect()}
    every = exact(cells[:1], lambda x: gap(*x[0]))
    assert one[0].p == pytest.approx(np.mean(np.abs(every) >= abs(gap(1, 9, 2, 3)) - 1e-12), abs=0.03) and one[0].d == pytest.approx(one[0].observed / np.std([0, 1, 1, 2, 5], ddof=1), abs=1e-5)
    again = nulls.stratified_null(df.repartition(3), ["year"], "g", "y", 500, 2).first()
    assert again == nulls.stratified_null(df.coalesce(1), ["year"], "g", "y", 500, 2).first()
    assert nulls.wave_null(df.limit(0), "g", "y").count() == 0


def test_mixing_is_that_of_all_deals(spark):
    boards = [["a", "a"], ["a", "b", "c"], ["b", "c"], ["z"]]
    rows = [(1, i, x) for i, b in enumerate(boards) for x in b] + [(1, 1, None), (2, 1, "a"), (2, 1, "b")]
    got = {r.year: r for r in nulls.mixing_null(frame(spark, rows, "year int, firm int, origin string"), "year", "firm", "origin", 3000, 3).collect()}
    pool = [x for b in boards[:3] for x in b]

    def share(labels):
        at, same = 0, 0
        for b in boards[:3]:
            part = labels[at : at + len(b)]
            at += len(b)
            same += sum(x == y for x, y in itertools.combinations(part, 2))
        return same / 5

    every = [share(p) for p in itertools.permutations(pool)]
    assert got[1].observed == 0.2 and got[1].pairs == 5 and got[2].observed == 0.0 and got[2].p == 1.0
    assert got[1].expected == pytest.approx(np.mean(every), abs=0.015) and got[1].p == pytest.approx(np.mean(np.array(every) >= 0.2), abs=0.03)
