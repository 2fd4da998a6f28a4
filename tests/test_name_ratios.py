"""The ratio of names by bits is that of the table, and is quick on long names."""

import random
import time

from interlace.functions.text import indel_ratio


def by_table(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return 200 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_same_as_the_table():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdé", k=rng.randrange(n)))
    for a, b in [("", ""), ("", "a"), *((word(40), word(40)) for _ in range(3000))]:
        assert indel_ratio(a, b) == by_table(a, b)
    long = [("".join(rng.choices("abgd", k=300)), "".join(rng.choices("abgd", k=300))) for _ in range(1000)]
    start = time.process_time()
    for a, b in long:
        indel_ratio(a, b)
    assert time.process_time() - start < 2
