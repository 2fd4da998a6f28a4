"""Periodic runs of words: stretches that repeat a block of words four times or more.

For each period p, words at the grid points 0, p, 2p, ... are compared with the next one. A run of four
periods covers three such pairs in a row, whatever its place, so only stretches where three neighbouring
tests succeed are looked at; all tests together are n (1 + 1/2 + 1/3 + ...). Periods up to the root of n
are probed one by one along the text; longer ones are probed together, grid place by grid place. What
survives is extended to both sides by comparing chunks of growing size. Grid points inside a run whose
period divides p are passed over: the stretch there is that run, and p isn't its smallest period.

Documents are independent rows, so Spark deals them as it read them and nothing is shuffled; a document
is the unit of memory.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Stretches:
    """Runs found so far, by period; each period's are in order of place."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.by, self.spans, self.period, self.until = ids, {}, set(), 0, 0

    def agree(self, at: int, p: int) -> int:
        """The first place from ``at`` on whose word isn't the one p further on."""
        step, last = 32, len(self.ids) - p
        while at < last:
            differ = self.ids[at : min(at + step, last)] != self.ids[at + p : min(at + step, last) + p]
            if differ.any():
                return at + int(differ.argmax())
            at, step = min(at + step, last), 2 * step
        return last

    def agree_back(self, at: int, p: int) -> int:
        """The first of the places before ``at`` from which on words are those p further on."""
        step = 32
        while at > 0:
            low = max(0, at - step)
            differ = self.ids[low:at] != self.ids[low + p : at + p]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = low, 2 * step
        return 0

    def inside(self, at: int, p: int) -> bool:
        """Whether a known run of a period that divides p holds the words from ``at`` to ``at + p``."""
        for q, (starts, ends) in self.by.items():
            if p % q == 0:
                k = bisect_right(starts, at) - 1
                if k >= 0 and ends[k] >= at + p:
                    return True
        return False

    def open(self, at: np.ndarray, p: np.ndarray | int) -> np.ndarray:
        """inside() of many places at once, negated."""
        left = np.ones(len(at), bool)
        for q, (starts, ends) in self.by.items():
            k = np.searchsorted(starts, at, "right") - 1
            left &= (np.asarray(p) % q != 0) | (k < 0) | (np.asarray(ends)[k] < at + p)
        return left

    def probe(self, at: int, p: int) -> None:
        """Extend from a grid point; periods come in ascending order, places too."""
        if p == self.period and at < self.until or self.inside(at, p):
            return
        start, stop = self.agree_back(at, p), self.agree(at, p)
        self.period, self.until = p, stop
        end = stop + p
        if end - start >= max(6, 4 * p) and (start, end) not in self.spans:
            self.spans.add((start, end))
            starts, ends = self.by.setdefault(p, ([], []))
            starts.append(start)
            ends.append(end)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs with length >= max(6, 4 * period), by start, then period.

    ``ids`` are words as numbers. A run has its period throughout and no neighbouring word extends it.
    """
    n, found = len(ids), Stretches(ids)
    most = n // 4
    root = min(most, int(n**0.5))
    for p in range(1, root + 1):
        grid = ids[::p]
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
        if len(hits):
            for at in hits[found.open(hits, p)].tolist():
                found.probe(at, p)
    later = []
    for j in range((n - 1) // (root + 1) - 2 if most > root else 0):
        # at grid place j, of all periods that have four grid points from there on
        periods = np.arange(root + 1, min(most, (n - 1) // (j + 3)) + 1)
        first = ids[periods * j]
        same = first == ids[periods * (j + 1)]
        for k in (2, 3):
            same[same] = first[same] == ids[periods[same] * (j + k)]
        if same.any():
            p = periods[same]
            p = p[found.open(p * j, p)]
            later += zip(p.tolist(), (p * j).tolist(), strict=True)
    for p, at in sorted(later):
        found.probe(at, p)
    return sorted((s, e - s, p) for p, both in found.by.items() for s, e in zip(*both, strict=True))


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten: the original word that stands at each place once its end repeats a block."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % period])


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All columns of docs, with ``runs``, an array of (start, length, period) by start, then period.

    Words are what stands between blanks and control characters 0x09 to 0x0D, numbered from 0. A null text
    has no words and no runs. Rows are looked at one by one, so repeated rows give repeated results, null
    ids count like others, and an empty table gives an empty one. If the input has a column runs, the new one
    replaces it.
    """
    return _with(docs, "runs", RUN, lambda text: [dict(zip(("start", "length", "period"), r, strict=True)) for r in find_runs(numbered((text or "").encode().split()))], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))


def collapsed(docs: DataFrame) -> DataFrame:
    """All columns of docs; of each run in a text only its first period stays.

    Texts with a run become their remaining words, joined by one blank; others, null ones too, stay as
    they are.
    """

    def shorter(text: str | None) -> str | None:
        words = (text or "").encode().split()
        runs = find_runs(numbered(words))
        return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))]).decode() if runs else text

    return _with(docs, "text", "string", shorter, pa.string())


def _with(docs: DataFrame, name: str, kind: str, function, arrow: pa.DataType) -> DataFrame:
    """docs with a column made from each text, in the place of one of that name if there is one."""
    old = next((c for c in docs.columns if c.lower() == name), None)
    text = next(c for c in docs.columns if c.lower() == "text")

    def run(batches):
        for batch in batches:
            made = pa.array([function(x) for x in batch.column(text).to_pylist()], arrow)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[old or name] = made
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"`{c}` {kind if c == old else docs.schema[c].dataType.simpleString()}" for c in docs.columns) + ("" if old else f", {name} {kind}")
    return docs.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    ids, places = numbered(words), planted(doc_id, len(words))
    if places is not None:
        ids = ids[places]
    runs = find_runs(ids)
    best = greatest(runs)
    kept = np.flatnonzero(kept_words(len(ids), runs))
    kept = (kept if places is None else places[kept]).tolist()
    exponent = 1000 * best[1] // best[2] if best else None
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return doc_id, len(runs), *(best or (None,) * 3), exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run and digests of all runs and of the text without their repeats.

    One document in ten, by the checksum of its doc_id, first has its end replaced by repeats of a block,
    which plants a run; null ids plant none. Each row gives a row; see periodic_runs for nulls.
    """

    def run(batches):
        for batch in batches:
            found = [digest(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], field.type) for i, field in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)
