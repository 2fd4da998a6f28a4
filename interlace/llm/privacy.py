"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Addresses, numbers and cards are found by patterns. Each distinct one is an entity to protect. A term
near a mention of it gives it away as far as knowing the term tells of the entity: with documents as
the events, pointwise mutual information PMI(entity; term) = log(N n(e, t) / (n(e) n(t))) out of the
entity's information content IC(entity) = log(N / n(e)). A term whose share PMI / IC reaches a threshold
discloses the entity, and in texts that mention the entity the term goes as well: it is generalised to
its first letters if these, counted in the same way over the corpus, stay below the threshold, and
removed otherwise. A link seen in one text only, however often that is copied, is no evidence. Texts
that mention no entity lose nothing.

All is DataFrame functions. Spans are within a row; what is counted over the corpus are pairs of entity
and nearby term, added up before they are shuffled, and documents with one of the few terms that are
linked to an entity at all. The same text gives the same spans, so spans are joined back by text, and
only to documents that mention an entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.llm.common import checkpoint, fresh

# Patterns of the kinds, in the order in which they are listed. Parts that can't give back are possessive, and a
# match may only begin where no longer one could have begun, so that a text without blanks costs no more than others.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "generalised", "removed"]
WORD = r"[\p{L}\p{M}]{3,}"
OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters on either side of a mention whose words are held to be near it.
NEAR = 60
#: The share of an entity's information from which on a term discloses it, and how many letters a generalised term keeps.
DISCLOSES, LETTERS = 0.9, 4
#: Up to so many terms a list of terms is sent to all executors (some 5 MB); a longer one is joined by shuffling.
SMALL = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, over blocks of about the root of their number."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    side = F.ceil(F.sqrt(F.size(sizes))).cast("int")

    def within(x: Column) -> Column:
        block, n = x["side"], F.size(x["sizes"])
        heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(x["sizes"], F.lit(1), b * block)))
        at = lambda i: F.floor(i / block).cast("int")
        return let(heads, lambda h: F.transform(x["sizes"], lambda _, i: F.get(h, at(i)) + total(F.slice(x["sizes"], at(i) * block + 1, i % block))))

    return F.when(F.size(sizes) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(F.struct(sizes.alias("sizes"), side.alias("side")), within))


MATCHES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str, near: int = 0) -> Column:
    """Array of (start, end, value, before, after) of all matches, leftmost first: where they are, in code points
    with the end exclusive, and up to ``near`` characters on either side that belong to no match."""

    def placed(x: Column) -> Column:
        sizes = F.transform(x["values"], lambda v, i: F.length(F.get(x["gaps"], i)) + F.length(v))

        def one(v: Column, i: Column, sums: Column) -> Column:
            start = F.get(sums, i) + F.length(F.get(x["gaps"], i))
            sides = [F.right(F.get(x["gaps"], i), F.lit(near)), F.left(F.get(x["gaps"], i + 1), F.lit(near))] if near else [F.lit(""), F.lit("")]
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), sides[0].alias("before"), sides[1].alias("after"))

        return let(sizes, lambda s: let(sums_before(s), lambda sums: F.transform(x["values"], lambda v, i: one(v, i, sums))))

    def some(values: Column) -> Column:
        both = F.struct(values.alias("values"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(values) == 0, F.expr(f"cast(array() as {MATCHES})")).otherwise(let(both, placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(twice, d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is one of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """One name for the spellings of an entity."""
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), plain)


def valid(text: Column, kind: str, near: int = 0) -> Column:
    return F.filter(matches(text, PATTERNS[kind], near), lambda m: holds(kind, m["value"]))


def without_emails(text: Column) -> Column:
    """A text of the same length, with a control character for each character of an address."""
    pattern = PATTERNS["email"]
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    hidden = let(pieces, lambda x: F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, F.repeat(F.lit("\x01"), F.coalesce(F.length(F.get(x["values"], i)), F.lit(0))))), ""))
    return F.when(F.contains(text, F.lit("@")), hidden).otherwise(text)


LINKS = "array<struct<entity:string,term:string,start:int,end:int>>"


def near_terms(text: Column, kind: str, near: int) -> Column:
    """Array of (entity, term, start, end): words near the entities of a kind, cut ones and other matches left out."""

    def one(m: Column) -> Column:
        def side(piece: Column, at: Column, cut: Callable[[Column], Column]) -> Column:
            kept = F.filter(matches(piece, WORD), lambda w: ~cut(w))
            return F.transform(kept, lambda w: F.struct(entity(kind, m["value"]).alias("entity"), F.lower(w["value"]).alias("term"), (at + w["start"]).alias("start"), (at + w["end"]).alias("end")))

        # a word at the far end of a full side may go on beyond it
        first = side(m["before"], m["start"] - F.length(m["before"]), lambda w: (F.length(m["before"]) == near) & (w["start"] == 0))
        return F.concat(first, side(m["after"], m["end"], lambda w: w["end"] == near))

    return F.flatten(F.transform(valid(text, kind, near), one))


def mentions(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, key (of the text), n_<kind>, base: array of (start, kind number, end), entities, links: see near_terms()."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("key"), text.alias("text"))
    # found as a column of its own, so that the positions of a row's spans are worked out once
    spans = F.struct(*[F.transform(valid(F.col("text"), kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))).alias(kind) for kind in PATTERNS])
    rows = rows.select("doc_id", "key", "text", spans.alias("found"))
    list_of = lambda kind, i: F.transform(F.col(f"found.{kind}"), lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))
    named = F.flatten(F.array(*[F.transform(F.col(f"found.{kind}"), lambda m: entity(kind, m["value"])) for kind in PATTERNS]))  # noqa: B023
    some = F.greatest(*[F.size(F.col(f"found.{kind}")) for kind in PATTERNS]) > 0
    masked = lambda x: F.flatten(F.array(*[near_terms(x["text"] if kind == "email" else x["plain"], kind, near) for kind in PATTERNS]))
    links = F.when(some, let(F.struct(F.col("text").alias("text"), without_emails(F.col("text")).alias("plain")), masked)).otherwise(F.expr(f"cast(array() as {LINKS})"))
    base = F.sort_array(F.flatten(F.array(*[list_of(kind, i) for i, kind in enumerate(PATTERNS)])))
    return rows.select("doc_id", "key", *[F.size(F.col(f"found.{kind}")).cast("long").alias(f"n_{kind}") for kind in PATTERNS], base.alias("base"), F.array_distinct(named).alias("entities"), links.alias("links"))


def short(term: Column, letters: int = LETTERS) -> Column:
    """What a term is generalised to; null for terms that are no longer than that."""
    return F.when(F.length(term) > letters, F.concat(F.left(term, F.lit(letters)), F.lit("…")))


def disclosing(docs: DataFrame, found: DataFrame, threshold: float = DISCLOSES, near: int = NEAR) -> DataFrame:
    """entity, term, share, action: terms that disclose an entity near which they stand, and whether they are
    'generalised' or 'removed'. ``found`` is mentions(docs)."""
    terms = lambda: F.array_distinct(F.flatten(F.transform("links", lambda x: F.array_compact(F.array(F.struct(x["entity"].alias("entity"), x["term"].alias("term")), F.when(short(x["term"]).isNotNull(), F.struct(x["entity"].alias("entity"), short(x["term"]).alias("term"))))))))
    pairs = found.where(F.size("links") > 0).select("key", F.explode(terms()).alias("x")).groupBy("x.entity", "x.term")
    # two texts at least, told from copies by their key
    pairs = checkpoint(pairs.agg(F.count("*").alias("n_both"), F.min("key").alias("one"), F.max("key").alias("other")).where("one < other").drop("one", "other"))
    asked = pairs.select("term").distinct()
    few = pairs.limit(SMALL + 1).count() <= SMALL
    text = F.lower(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), PATTERNS["email"], " "))
    words = docs.select(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))
    every = words.select(F.explode(F.array_distinct(F.concat("words", F.array_compact(F.transform("words", lambda w: short(w)))))).alias("term"))
    in_docs = every.join(F.broadcast(asked) if few else asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    of_entity = found.where(F.size("entities") > 0).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = docs.count()
    both = pairs.join(in_docs, "term").join(of_entity, "entity")
    content = F.log(F.lit(float(n)) / F.col("n_entity"))
    told = F.log(F.lit(float(n)) * F.col("n_both") / F.col("n_entity") / F.col("n_term"))
    shares = both.select("entity", "term", F.when(content > 0, told / content).otherwise(0.0).alias("share"))
    shares = checkpoint(shares.where(F.col("share") >= threshold))
    general = shares.where(F.col("term").endswith("…")).select("entity", F.col("term").alias("general"), F.lit(True).alias("tells"))
    plain = shares.where(~F.col("term").endswith("…")).withColumn("general", short(F.col("term")))
    marked = plain.join(general, ["entity", "general"], "left")
    return marked.select("entity", "term", "share", F.when(F.col("general").isNull() | F.col("tells"), "removed").otherwise("generalised").alias("action"))


def spans(docs: DataFrame, threshold: float = DISCLOSES, near: int = NEAR) -> DataFrame:
    """doc_id, key, n_<kind>, base and all: arrays of (start, kind number, end) by start, then kind; a row for each of docs.

    kind numbers are places in KINDS. A null text is empty. Repeated rows, and rows with null ids, each
    get the spans of their text. An empty table gives an empty one. Only doc_id and text are read.
    """
    found = checkpoint(mentions(docs, near))
    marked = disclosing(docs, found, threshold, near)
    texts = found.where(F.size("links") > 0).select("key", F.explode("links").alias("x")).select("key", "x.*").distinct()
    kind = F.when(F.col("action") == "removed", KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    # near several entities a term counts once; removal outdoes generalising
    told = texts.join(marked, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max(kind).alias("kind"))
    told = told.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    some = found.where(F.size("links") > 0).join(told, "key", "left")
    every = some.withColumn("all", F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))))
    names = ["doc_id", "key", *[f"n_{kind}" for kind in PATTERNS], "base"]
    return every.select(*names, "all").union(found.where(F.size("links") == 0).select(*names, F.col("base").alias("all")))


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; see spans() for nulls and repeated rows."""
    return spans(docs.select("doc_id", "text")).select("doc_id", *[f"n_{kind}" for kind in PATTERNS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def sanitised(docs: DataFrame, threshold: float = DISCLOSES, near: int = NEAR) -> DataFrame:
    """All columns of docs, the text with [kind] for personal data, generalised terms cut to their first letters, and
    removed ones gone (as [...]). Where spans overlap, the earlier one counts; null texts stay null."""
    own, text = fresh(docs.columns, "key", "text")
    places = spans(docs, threshold, near).groupBy("key").agg(F.first("all").alias("all")).where(F.size("all") > 0).select(F.col("key").alias(own), "all")
    every = docs.withColumn(own, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).join(places.withColumnRenamed("all", text), own, "left")
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def put(done: Column, x: Column) -> Column:
        cut = F.col("text").substr(x["start"] + 1, F.lit(LETTERS))
        word = F.when(x["kind"] < len(PATTERNS), F.concat(F.lit("["), F.get(kinds, x["kind"]), F.lit("]"))).when(x["kind"] == KINDS.index("removed"), "[...]").otherwise(F.concat(cut, F.lit("…")))
        more = F.concat(done["out"], F.col("text").substr(done["at"] + 1, x["start"] - done["at"]), word)
        return F.when(x["start"] >= done["at"], F.struct(more.alias("out"), x["end"].alias("at"))).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], x["end"]).alias("at")))

    full = lambda d: F.concat(d["out"], F.col("text").substr(d["at"] + 1, F.length("text")))
    made = F.when(F.col(text).isNull(), F.col("text")).otherwise(F.aggregate(F.col(text), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put, full))
    return every.select(*[made.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
