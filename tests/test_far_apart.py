"""Distances of persons and firms without reaching all persons from each."""

import random

from interlace.operators import distances, measures


def written(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_persons_reach_no_persons(spark):
    rng = random.Random(4)
    ties = {(1, p, f) for p in range(1600) for f in rng.sample(range(200), 2)}
    wanted = [(1, p, rng.randrange(200)) for p in range(1600)]
    frame = lambda rows: spark.createDataFrame(rows, "year long, person long, firm long")
    near = {}
    for _, p, f in ties:
        near.setdefault(("p", p), set()).add(("f", f))
        near.setdefault(("f", f), set()).add(("p", p))
    before = written(spark)
    got = {(r.person, r.firm): r.distance for r in distances.geodesics(frame(list(ties)), frame(wanted)).collect()}
    # each person that reaches every other is 2.6 million rows; ties are 3,200
    assert written(spark) - before < 5_000_000
    for p in range(0, 1600, 40):
        far, front = {("p", p): 0}, [("p", p)]
        while front:
            front = [w for v in front for w in near[v] if w not in far and far.setdefault(w, far[v] + 1)]
        for f in (f for q, f in got if q == p):
            assert got[p, f] == far["f", f]


def test_bands_are_counted_in_the_persons_row(spark):
    rng = random.Random(5)
    ties = [(y, p, f) for y in (1, 2) for p in range(2000) for f in rng.sample(range(250), 2)]
    before = written(spark)
    got = {r.band: (r.dyads, r.formed) for r in measures.geodesic_bands(spark.createDataFrame(ties, "year long, person long, firm long")).collect()}
    # most of the 500,000 dyads are at distance 5
    assert written(spark) - before < 6_000_000
    now, seat, board = {t[1:] for t in ties if t[0] == 2}, {}, {}
    for y, p, f in ties:
        if y == 1:
            seat.setdefault(p, set()).add(f)
            board.setdefault(f, set()).add(p)
    near = {f: set().union(*(seat[p] for p in board[f])) for f in board}
    want = {}
    for p, own in seat.items():
        three = set().union(*(near[f] for f in own))
        five = set().union(*(near[f] for f in three))
        for f in range(250):
            if f not in own:
                band = "3" if f in three else "5" if f in five else "7+"
                n, k = want.get(band, (0, 0))
                want[band] = n + 1, k + ((p, f) in now)
    assert got == want
