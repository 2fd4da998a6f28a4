"""Leading eigenvectors where the second eigenvalue is close to the first."""

import numpy as np
import pytest

from interlace.operators import distances


def test_a_chain_settles(spark):
    n = 60
    ties = [(1, p, f) for p in range(n) for f in (p, p + 1)] + [(2, 1, 1), (2, 2, 2)]
    got = {}
    for r in distances.wave_frame(spark.createDataFrame(ties, "year long, person long, firm long")).collect():
        got.setdefault(r.year, {})[r.person] = r.eigenvector
    a = np.eye(n, k=1) + np.eye(n, k=-1)
    assert np.array([got[1][p] for p in range(n)]) == pytest.approx(np.abs(np.linalg.eigh(a)[1][:, -1]), abs=3e-6)
    assert got[2] == {1: pytest.approx(2**-0.5, abs=1e-6), 2: pytest.approx(2**-0.5, abs=1e-6)}
