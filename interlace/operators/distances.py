"""Geodesics of persons and firms by spheres of firms that meet, and leading eigenvectors over the two-mode ties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from interlace.operators import network
from interlace.operators.lineage import cut
from interlace.operators.panel import waves


def boards(ties: DataFrame) -> DataFrame:
    """year, firm, near: the other firms that share a person with a firm; firms without any have no row."""
    t = ties.select("year", "person", "firm")
    pairs = t.join(t.withColumnRenamed("firm", "other"), ["year", "person"]).where("firm <> other")
    return pairs.groupBy("year", "firm").agg(F.sort_array(F.collect_set("other")).alias("near"))


def beyond(spheres: DataFrame, near: DataFrame) -> DataFrame:
    """year, firm, inner, far of spheres(year, firm, inner, far): the firms one step over near(year, firm, near) outside of far, and
    what is now within; ``inner`` holds those of one step less, or the firm itself."""
    out = spheres.select("year", "firm", F.explode("far").alias("via")).join(near.select("year", F.col("firm").alias("via"), "near"), ["year", "via"])
    out = out.groupBy("year", "firm").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("reached"))
    # what is one step from a sphere lies on it, on the one within or on the one beyond
    return spheres.join(out, ["year", "firm"]).select("year", "firm", F.col("far").alias("inner"), F.array_except(F.array_except("reached", "far"), "inner").alias("far"))


def geodesics(ties: DataFrame, wanted: DataFrame, rounds: int = 60) -> DataFrame:
    """year, person, firm, distance for each of wanted(year, person, firm): steps over ties of that year, 1 for a tie, -1 if
    no path leads there.

    Pairs in different components, or of nodes that have no tie, are settled first. A person is one step from its own
    firms, so for the rest those and the firm asked about are looked up in spheres of the firms' graph, which grow by turns
    on either side until they meet: a path of 2 (i + j) + 1 steps needs spheres of i and j, and persons reach no persons.
    Spheres are held for firms of pairs not yet settled only. Repeated wanted pairs count once.
    """
    ties, asked = cut(ties.select("year", "person", "firm").distinct()), cut(wanted.select("year", "person", "firm").distinct())
    placed = network.components(ties)
    side = lambda who, code, name: placed.withColumn("odd", F.col("node") % 2).where(f"odd = {code}").select("year", F.floor(F.col("node") / 2).cast("long").alias(who), F.col("component").alias(name))
    both = asked.join(side("person", 0, "cp"), ["year", "person"], "left").join(side("firm", 1, "cf"), ["year", "firm"], "left")
    pair = ["year", "person", "firm"]
    found = lambda df, steps: df.select(*pair, F.lit(steps).cast("long").alias("distance"))
    tied = asked.join(ties, pair, "left_semi")
    settled = [found(both.where("not coalesce(cp = cf, false)"), -1), found(tied, 1)]
    still = both.where("cp = cf").select(*pair).join(ties, pair, "left_anti")
    still = cut(still.join(ties.select("year", "person", F.col("firm").alias("own")), ["year", "person"]))
    near = cut(boards(ties))
    spheres = [None, near.select("year", "firm", F.array("firm").alias("inner"), F.col("near").alias("far"))]
    for step in range(1, rounds + 1):
        if not still.limit(1).count():
            break
        wide, narrow = (step + 1) // 2, step // 2
        if wide == len(spheres):
            active = still.select("year", F.explode(F.array("own", "firm")).alias("firm")).distinct()
            spheres.append(cut(beyond(spheres[-1].join(active, ["year", "firm"], "left_semi"), near)))
        met = still.join(spheres[wide].select("year", F.col("firm").alias("own"), F.col("far").alias("out")), ["year", "own"])
        if narrow:
            met = met.join(spheres[narrow].select("year", "firm", "far"), ["year", "firm"]).where(F.arrays_overlap("out", "far"))
        else:
            met = met.where(F.array_contains("out", F.col("firm")))
        met = cut(met.select(*pair).distinct())
        settled.append(found(met, 2 * step + 1))
        still = cut(still.join(met, pair, "left_anti"))
    else:
        if still.limit(1).count():
            raise RuntimeError("some paths are longer than the rounds")
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out


def formed_at_distance(ties: DataFrame) -> DataFrame:
    """year, person, firm, distance: each tie of a wave between two that were in the wave before, and how far apart they were then."""
    w = F.broadcast(waves(ties).where("next_year is not null").select(F.col("year").alias("before"), F.col("next_year").alias("year")))
    now, old = ties.join(w, "year"), ties.select(F.col("year").alias("before"), "person", "firm")
    for who in ("person", "firm"):
        now = now.join(old.select("before", who).distinct(), ["before", who], "left_semi")
    found = geodesics(ties, now.select(F.col("before").alias("year"), "person", "firm"))
    return found.withColumnRenamed("year", "before").join(w, "before").select("year", "person", "firm", "distance")


def eigenvectors(ties: DataFrame, node: str = "person", over: str = "firm", rounds: int = 1000, close: float = 1e-8) -> DataFrame:
    """year, node, eigenvector: the leading eigenvector of each wave's weighted projection, of length 1.

    Conjugate gradients on the Rayleigh quotient, from equal entries, for all waves at once: each round takes the best vector
    in the plane of the vector, its residual and its last move, so two close eigenvalues cost the root of the rounds that power
    iteration needs. A wave stops when its residual, over its eigenvalue, is below ``close``. The projection A is never made:
    its product is a sum over each node's ``over`` of their nodes' entries, less its own. In a wave of several
    components the one with the largest eigenvalue holds the vector. Raises if a wave doesn't settle.
    """
    ties = cut(ties.select("year", F.col(node).alias("node"), F.col(over).alias("via")).distinct())
    own = ties.groupBy("year", "node").agg(F.count("*").alias("n"))
    size = own.groupBy("year").agg(F.count("*").alias("nodes"))

    def times(vector: DataFrame, x: str, y: str) -> DataFrame:
        """vector with y, the product of A and its column x."""
        sums = ties.join(vector.select("year", "node", x), ["year", "node"]).groupBy("year", "via").agg(F.sum(x).alias("s"))
        moved = ties.join(sums, ["year", "via"]).groupBy("year", "node").agg(F.sum("s").alias("s"))
        return vector.join(moved, ["year", "node"]).withColumn(y, F.col("s") - (F.col("n") - 1) * F.col(x)).drop("s")

    start = own.join(F.broadcast(size), "year").select("year", "node", "n", (1 / F.sqrt("nodes")).alias("x"))
    zero = F.lit(0.0)
    state = cut(times(start, "x", "ax").select("*", zero.alias("p"), zero.alias("ap")))
    value = {r.year: r.value for r in state.groupBy("year").agg(F.sum(F.col("x") * F.col("ax")).alias("value")).collect()}  # a row for each wave
    done, left = [], list(value)
    for _ in range(rounds):
        of = lambda years, numbers: F.coalesce(*[F.when(F.col("year") == y, F.lit(float(n))) for y, n in zip(years, numbers, strict=True)])
        with_r = state.withColumn("r", F.col("ax") - of(left, [value[y] for y in left]) * F.col("x"))
        with_r = cut(times(with_r, "r", "ar"))
        base = ("x", "r", "p")
        dots = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in base for b in (*base, *(f"a{c}" for c in base))]
        sums = {r.year: r for r in with_r.groupBy("year").agg(*dots).collect()}  # a row for each wave
        settled = [y for y in left if np.sqrt(sums[y].r_r) <= close * max(abs(value[y]), 1.0)]
        if settled:
            done.append(with_r.where(F.col("year").isin(settled)).select("year", "node", "x"))
        left = [y for y in left if y not in settled]
        if not left:
            break
        best = {y: _best_in_plane(sums[y], base) for y in left}
        value = {y: best[y][1] for y in left}
        c = [of(left, [best[y][0][i] for y in left]) for i in range(3)]
        rows = with_r.where(F.col("year").isin(left)).select(
            "year", "node", "n", *[(c[0] * F.col(f"{a}x") + c[1] * F.col(f"{a}r") + c[2] * F.col(f"{a}p")).alias(f"{a}x") for a in ("", "a")],
            *[(c[1] * F.col(f"{a}r") + c[2] * F.col(f"{a}p")).alias(f"{a}p") for a in ("", "a")],
        )
        state = rows
        ties = ties.where(F.col("year").isin(left)) if settled else ties
    else:
        raise RuntimeError("the iteration did not settle")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("year", F.col("node").alias(node), F.round(F.abs("x"), 6).alias("eigenvector"))


def _best_in_plane(sums: Row, base: tuple[str, ...]) -> tuple[np.ndarray, float]:
    """What of each base vector makes the unit vector with the largest Rayleigh quotient in their span, and that quotient."""
    gram = np.array([[sums[f"{a}_{b}"] for b in base] for a in base])
    form = np.array([[sums[f"{a}_a{b}"] for b in base] for a in base])
    length = np.sqrt(np.diag(gram))
    scale = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0)
    gram, form = gram * np.outer(scale, scale), (form + form.T) / 2 * np.outer(scale, scale)
    lengths, axes = np.linalg.eigh(gram)
    # base vectors that hardly differ from the others' span are left out
    plane = axes[:, lengths > 1e-10] / np.sqrt(lengths[lengths > 1e-10])
    values, vectors = np.linalg.eigh(plane.T @ form @ plane)
    best = plane @ vectors[:, -1] * scale
    return best * (1.0 if best[0] >= 0 else -1.0), float(values[-1])


def wave_frame(ties: DataFrame) -> DataFrame:
    """year, person, seats, degree, strength, eigenvector: each person's place in the wave's two-mode graph and in its
    projection; persons without mates have degree and strength 0."""
    seats = ties.groupBy("year", "person").agg(F.count("*").alias("seats"))
    mates = network.board_degrees(ties, "person", "firm").withColumnRenamed("node", "person")
    out = seats.join(mates, ["year", "person"], "left").join(eigenvectors(ties), ["year", "person"])
    return out.select("year", "person", "seats", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0)).alias("strength"), "eigenvector")
