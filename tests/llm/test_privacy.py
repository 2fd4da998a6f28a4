"""Personal data by pattern, and the terms that disclose it, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import privacy  # noqa: E402

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PIECES = ["a@b.c", "x.y%z@q-r.com", ".", "@", " ", "-", "+1", "+44 20 7946-0958", "4111 1111 1111 1111", "4111111111111111", "192.168.0.1", "1.2.3.4", "300.1.1.1", "é", "😀", "\n", "(", "12", "7", "_", "word", "Zoë", "+1 (743) 555-3824", ",", "0000255.1.1.1", "%"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for i, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: max(map(int, m[0].split("."))) <= 255, "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]  # noqa: B023
            if good():
                name = m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits
                out.append((m.start(), i, m.end(), f"{kind}:{name}"))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, base int")


def test_base_spans(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(600)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None), (800, None), (801, ""), (802, "a@b.c " * 2000), (803, "1.2.3.4 " * 900 + "😀a@b.c")]
    got = privacy.digests(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        found = base(t or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)
        want.append((d, *[sum(x[1] == i for x in found) for i in range(4)], hashlib.sha256(line.encode()).hexdigest()))
    assert sorted(map(repr, [tuple(r)[:6] for r in got])) == sorted(map(repr, want))
    assert privacy.digests(frame(spark, []).limit(0)).count() == 0


def test_texts_without_blanks_take_no_longer(spark):
    rows = [(1, "x" * 1_000_000), (2, "9" * 1_000_000), (3, "9." * 500_000), (4, "+1" * 500_000), (5, "a@" * 500_000)]
    got = {r.doc_id: r for r in privacy.digests(frame(spark, rows)).collect()}
    assert [got[d].spans for d in (1, 2, 4, 5)] == [""] * 4 and got[3].n_ip == 125_000


def terms(rows, threshold=privacy.DISCLOSES, near=privacy.NEAR):
    """(entity, term, start, end) of each text, and what the corpus says of each (entity, term)."""
    links, n = {}, len(rows)
    has, both, texts, of = Counter(), Counter(), {}, Counter()
    cut = lambda t: t[:4] + "…" if len(t) > 4 else None
    for _, text in rows:
        text = text or ""
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], lambda m: " " * len(m[0]), text))]
        every = {w for *_, w in words}
        has.update(every | {cut(w) for w in every} - {None})
        found = base(text)
        of.update({x[3] for x in found})
        # what lies near a mention, up to the next match of the same kind
        mine = {(x[3], w, s, e) for x in found for s, e, w in words if (x[0] - near < s and e <= x[0] or x[2] <= s and e <= x[2] + near - 1) and not any(o[1] == x[1] and min(x[0], s) < o[0] < max(x[0], s) for o in found)}
        links[text] = mine
        pairs = {(c, w) for c, w, *_ in mine} | {(c, cut(w)) for c, w, *_ in mine if cut(w)}
        both.update(pairs)
        for p in pairs:
            texts.setdefault(p, set()).add(text)
    share = {(c, w): math.log(n * k / of[c] / has[w]) / math.log(n / of[c]) for (c, w), k in both.items() if len(texts[c, w]) > 1 and n > of[c]}
    told = {p for p, x in share.items() if x >= threshold}
    return links, {(c, w): "removed" if not cut(w) or (c, cut(w)) in told else "generalised" for c, w in told if not w.endswith("…")}


def corpus():
    rng = random.Random(2)
    words = "river stone light cloud garden yellow mountain paper window silver basket marker".split()
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, line(40)) for i in range(60)]
    # Zebulon stands by one address only; marketplace shares its first letters with marker
    for i in range(4):
        rows.append((100 + i, f"{line(30)} ask Zebulon marketplace jane.doe@corp.org about {line(3)} {i} {line(30)}"))
    copies = f"{line(12)} quixotic 10.0.0.7 {line(12)}"
    rows += [(200 + i, copies) for i in range(5)]
    rows += [(300, f"{line(9)} call +44 20 7946 0958 for Wolfgang {line(9)}"), (301, f"{line(9)} Wolfgang +44 (20) 7946-0958 {line(9)}"), (302, f"jane Zebulon {line(20)}"), (303, None), (303, f"quixotic {line(9)}")]
    return rows


def test_terms_that_disclose(spark):
    rows = corpus()
    links, told = terms(rows)
    assert told["email:jane.doe@corp.org", "marketplace"] == "generalised" and told["phone:442079460958", "wolfgang"] == "removed"
    assert not any(t == "quixotic" for _, t in told)  # seen in copies of one text only
    got = {(r.doc_id, tuple(map(tuple, r["all"]))) for r in privacy.spans(frame(spark, rows)).collect()}
    want = set()
    for d, text in rows:
        text = text or ""
        more = {}
        for c, w, s, e in links[text]:
            if (c, w) in told:
                more[s, e] = max(more.get((s, e), 0), privacy.KINDS.index(told[c, w]))
        want.add((d, tuple(sorted([x[:3] for x in base(text)] + [(s, k, e) for (s, e), k in more.items()]))))
    assert got == want
    # a text without an entity keeps its terms
    assert dict(got)[302] == ()


def test_sanitised_texts(spark):
    rows = corpus()
    got = {r.doc_id: r for r in privacy.sanitised(frame(spark, rows)).collect()}
    assert " [...] [...] mark… [email] [...] " in got[100].text and got[100].key == "k" and got[100].base == 1
    assert "[phone]" in got[300].text and "Wolfgang" not in got[300].text and got[302].text == dict(rows)[302]
    assert {r.text for r in privacy.sanitised(frame(spark, [(1, None), (1, "x 1.2.3.4 😀"), (None, "a@b.c")])).collect()} == {None, "x [ip] 😀", "[email]"}


def test_a_long_list_of_terms_is_shuffled(spark, monkeypatch):
    docs = frame(spark, corpus())
    few = {tuple(map(repr, r)) for r in privacy.digests(docs).collect()}
    monkeypatch.setattr(privacy, "SMALL", 0)
    assert {tuple(map(repr, r)) for r in privacy.digests(docs).collect()} == few
