"""Measures on the whole graph, against brute force and against the SQL of the thinned one read on all ties."""

import duckdb
import pytest

from interlace.operators import network
from interlace.plans.queries import ORACLES, QUERIES
from interlace.sources.affiliations import seats

SF = "/root/testdata/sf0.001"
THIN = "FROM aff WHERE role = '1-URGENT' AND status = 'F' AND month = 3)"


@pytest.mark.parametrize("name", ["waves_histogram", "risk_set", "life_table", "square_clustering", "burt_and_effective_size", "open_share"])
def test_same_as_sql_on_all_ties(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert ORACLES[name].count(THIN) == 1
    want = db.execute(ORACLES[name].replace(THIN, "FROM dense)")).df()
    got = QUERIES[f"{name}_whole"](spark, SF).toPandas()[list(want.columns)]
    key = [c for c in ("year", "node", "firm", "tenure", "waves") if c in want.columns]
    got, want = (x.sort_values(key).astype(float).to_numpy() for x in (got, want))
    assert got.shape == want.shape and got == pytest.approx(want, abs=2e-6, nan_ok=True)


def distances(near, s):
    """Distance and number of shortest paths from s to each node it reaches."""
    far, count, front = {s: 0}, {s: 1}, [s]
    while front:
        new = {}
        for v in front:
            for w in near[v]:
                if w not in far:
                    new[w] = new.get(w, 0) + count[v]
        far |= dict.fromkeys(new, far[front[0]] + 1)
        count |= new
        front = list(new)
    return far, count


def test_paths_and_components_of_all_ties(spark):
    graphs, want, parts = {}, {}, {}
    for r in seats(spark, SF).collect():
        for a, b in ((r.person * 2, r.firm * 2 + 1), (r.firm * 2 + 1, r.person * 2)):
            graphs.setdefault(r.year, {}).setdefault(a, []).append(b)
    for y, near in graphs.items():
        n, d = len(near), {v: distances(near, v) for v in near}
        for v in near:
            far, count = d[v]
            parts[y, v] = min(far)
            through = sum(count[s] * count[t] / d[s][1][t] for s in far for t in far if s != v != t != s and far[s] + far[t] == d[s][0][t])
            want[y, v] = through / ((n - 1) * (n - 2)), (len(far) - 1) ** 2 / sum(far.values()) / (n - 1)
    assert {(r.year, r.node): r.component for r in QUERIES["link_components_whole"](spark, SF).collect()} == parts
    for got in (QUERIES["path_centralities"](spark, SF).collect(), network.centralities(seats(spark, SF), 16).collect()):
        assert {(r.year, r.node) for r in got} == set(want)
        assert all((r.betweenness, r.closeness) == pytest.approx(want[r.year, r.node], abs=2e-6) for r in got)
