"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

Text likelihoods come from byte trigrams counted over all documents of known language; the
declared markup language and the address suffix get likelihood tables, and hosts get priors
smoothed from all pages over the registered domain to the host, each estimated by grouped sums
of the pages' text posteriors. A page's own posterior is left out of its host's prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.llm.common import checkpoint, slices, utf8

#: Hashed trigram kinds; weight of text evidence in trigrams at most; strength of the smoothing towards the wider level.
GRAMS, TRUST, STRENGTH = 1 << 13, 60.0, 4.0


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed kind of each lower-case byte trigram within a row."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
    low[(low >= 33) & (low <= 64)] = 32
    code = ((low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 40503 >> 4) % GRAMS
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[:-2] == row[2:]
    return row[:-2][whole], code[whole]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(trigram | language) by add-one smoothing over all documents with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            raw, at = utf8(b["text"])
            for lo, hi in slices(at):
                row, code = grams(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                own = langs[lo:hi]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + np.bincount(code[(own == lang)[row]], minlength=GRAMS)
        for lang, c in sums.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())], ["lang", "gram", "n"])

    counted = docs.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, gram int, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # at most GRAMS rows for each language
    langs = sorted({r["lang"] for r in rows})
    table = np.ones((len(langs), GRAMS))
    for r in rows:
        table[langs.index(r["lang"]), r["gram"]] += r["n"]
    return langs, np.log(table / table.sum(1, keepdims=True))


def body(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags become blanks."""
    gone = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(gone, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared (two letters or 'none'), host, domain, suffix (country code or first path part of two letters, else 'none')."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})\b", 1))
    either = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit("none"))
    return pages.select("page_id", body(F.col("html")).alias("text"), either(declared).alias("declared"), host.alias("host"), F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".").alias("domain"), either(country, path).alias("suffix")).withColumn("domain", F.when(F.instr("host", ".") > 0, F.col("domain")).otherwise(F.col("host")))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix for every row of pages.

    Null html or url give no evidence of their kind; a page without a host has the prior of all
    pages; with no evidence at all the answer follows the priors. An empty table gives none. Ties go to the language that is first in the alphabet. Without documents of known
    language lang is null and probability 0. Other columns are ignored; repeated rows stay.
    """
    langs, log_p = learn(docs)
    facts = evidence(pages)
    if not langs:
        nothing = F.lit(None).cast("string")
        return facts.select("page_id", nothing.alias("lang"), F.lit(0.0).alias("probability"), nothing.alias("text_lang"), "declared", "suffix")
    n, by_gram = len(langs), np.ascontiguousarray(log_p.T)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b["text"])
            out = np.zeros((b.num_rows, n))
            for lo, hi in slices(at):
                row, code = grams(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows, seen = hi - lo, np.bincount(row, minlength=hi - lo)
                for k in range(n):
                    out[lo:hi, k] = np.bincount(row, by_gram[code, k], rows)
                out[lo:hi] /= np.maximum(seen, 1)[:, None] * (1 / TRUST + 1 / np.maximum(seen, 1)[:, None])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("page_id", "declared", "host", "domain", "suffix")), pa.array(list(out), pa.list_(pa.float64()))], ["page_id", "declared", "host", "domain", "suffix", "likelihood"])

    scored = facts.mapInArrow(texts, "page_id long, declared string, host string, domain string, suffix string, likelihood array<double>")
    scored = checkpoint(scored)  # read five times below; a few numbers a page

    def normal(logs: Column) -> Column:
        e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    scored = scored.withColumn("q", normal(F.col("likelihood")))
    sums = [F.sum(F.col("q")[k]).alias(f"s{k}") for k in range(n)]
    totals = lambda *keys: scored.groupBy(*keys).agg(*sums) if keys else scored.agg(*sums)
    world = [(x or 0.0) + 1.0 for x in totals().first()]
    world = [x / sum(world) for x in world]

    # P(value | language), values being two letters or 'none': at most 677 of them
    def given(key: str) -> DataFrame:
        rows = totals(key).collect()
        weight = [sum(r[f"s{k}"] for r in rows) + 0.1 * (len(rows) + 1) for k in range(n)]
        made = [(r[key], [float(np.log((r[f"s{k}"] + 0.1) / weight[k])) for k in range(n)]) for r in rows]
        return F.broadcast(scored.sparkSession.createDataFrame(made, f"{key} string, {key}_log array<double>"))

    array = lambda name, of: F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(n)]).alias(name)
    domains = totals("domain").select("domain", array("domain_sum", "domain"))
    hosts = totals("host", "domain").select("host", "domain", array("host_sum", "host")).join(domains, "domain").drop("domain")
    joined = scored.join(hosts, "host").join(given("declared"), "declared").join(given("suffix"), "suffix")
    flat = F.array(*[F.lit(x) for x in world])

    def prior(sums: Column, wider: Column) -> Column:
        rest = F.zip_with(sums, "q", lambda s, q: F.greatest(s - q, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, wider, lambda s, w: (s + STRENGTH * w) / (total + STRENGTH))

    joined = joined.withColumn("domain_prior", prior(F.col("domain_sum"), flat)).withColumn("prior", F.when(F.col("host") == "", flat).otherwise(prior(F.col("host_sum"), F.col("domain_prior"))))
    logs = F.zip_with(F.zip_with("likelihood", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with("declared_log", "suffix_log", lambda a, b: a + b), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return joined.withColumn("posterior", normal(logs)).select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("q")).alias("text_lang"), "declared", "suffix")
