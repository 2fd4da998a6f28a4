"""What filters remove in every order, against a count that applies them one after another."""

from itertools import permutations

import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import audit  # noqa: E402

SCHEMA = "doc_id long, text string, source string, part string, n string, key string"
LONG = " ".join(f"w{i}" for i in range(250))


def brute(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    docs = []
    for d, text, source in rows:
        text = text or ""
        words = text.split(" ") if text else []
        words = [w for w in words if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in rows)}
        docs.append((source or "", {f for f in "ABCDE" if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                hit = [x for x in left if f in x[0]]
                kept = [x for x in left if f not in x[0]]
                fail = sum(f in x[0] for x in own)
                out[part, order, k + 1] = [len(kept), len(hit), fail - len(hit), sum(x[0] == {f} for x in own), sum(x[1] for x in hit), sum(x[2] for x in hit)]
                gone[f] += len(hit)
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(gone[order[step - 1]])
    return out


def test_against_brute_force(spark):
    rows = [
        (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, "Loud TEXT #", "a"), (4, None, None), (5, "", ""), (None, LONG, "a"), (None, "", "b"), (6, "x y " * 150, "a"), (7, "x y " * 150, "b"), (8, "x y " * 150, None),
        (1, LONG, "a"), (9, LONG + " $", "c"), (10, LONG.upper(), "c"), (11, "é|", "c"), (3, "other", "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, 1), (77, 1, 1), (9, 1, None)]
    docs = spark.createDataFrame([(d, t, s, "p", "n", "k") for d, t, s in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in audit.audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, marks).count() == 0
    one = spark.createDataFrame([(1, "a", "s", "p", "n", "k")], SCHEMA)
    got = audit.audit(one, marks).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in got] == [("s", 1, 0, 0), ("s", 0, 1, 120), ("s", 0, 0, 0), ("s", 0, 0, 0), ("s", 0, 0, 0)]


def test_any_number_of_filters(spark):
    counted = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", False, True, 2, 0, 2), ("p", False, False, 5, 5, 0)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.toxic_lost, r.shapley) for r in audit.interactions(counted, "XY").collect()}
    assert got == {("XY", 1): (7, 3, 1, 0, 6), ("XY", 2): (5, 2, 0, 2, 4), ("YX", 1): (8, 2, 0, 2, 4), ("YX", 2): (5, 3, 1, 0, 6)}


def test_words_and_characters():
    assert audit.text_flags("a b\x1c " + "x " * 199)[1] is False  # these two are no blanks
    assert audit.text_flags("\t\x0b\x0c\r\n ")[1:] == (True, False, False, False)
    assert audit.text_flags("É" * 10 + "A")[3] is True and audit.text_flags("😀" * 50 + "A")[3] is False
