"""Cyclic temporal walks, exact and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions.rules import inverse, uniform, unit


def _backtracks(prev_rel: Column, prev_sub: Column, prev_ts: Column, rel: Column, obj: Column, ts: Column, n_relations: int) -> Column:
    """The edge is the inverse of the one just walked."""
    return (rel == inverse(prev_rel, n_relations)) & (obj == prev_sub) & (ts == prev_ts)


def cyclic_walks(edges: DataFrame, length: int, n_relations: int, no_backtrack: bool = True) -> DataFrame:
    """(rels, ents, tss) of all walks of ``length`` edges that go back in time and end where they began.

    The first step is strictly earlier, later ones not later; a walk does not go straight back over its last edge.  The
    closing step joins on both ends, so that no open walk of full length is ever built.
    """
    if length < 2:
        raise ValueError("a cyclic walk has two edges at least")
    w = edges.select(F.array("rel").alias("rels"), F.array("sub", "obj").alias("ents"), F.array("ts").alias("tss"), F.col("sub").alias("first"), F.col("obj").alias("at"))
    for k in range(1, length):
        e = edges.select(F.col("sub").alias("s"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"))
        now = F.element_at("tss", -1)
        on = (F.col("at") == F.col("s")) & (F.col("t") < now if k == 1 else F.col("t") <= now)
        if k > 1 and no_backtrack:
            on &= ~_backtracks(F.element_at("rels", -1), F.element_at("ents", -2), now, F.col("r"), F.col("o"), F.col("t"), n_relations)
        if k == length - 1:
            on &= F.col("first") == F.col("o")
        w = w.join(e, on).select(F.concat("rels", F.array("r")).alias("rels"), F.concat("ents", F.array("o")).alias("ents"), F.concat("tss", F.array("t")).alias("tss"), "first", F.col("o").alias("at"))
    return w.select("rels", "ents", "tss")


def numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``i``, their number within the relation from 0 by eid; (rel, n): how many each relation has).

    Rows are numbered within (relation, range of eids) and the ranges within their relation, so that no task sorts the
    rows of a whole relation.
    """
    e = edges.withColumn("part", F.floor(F.col("eid") / 65536))
    before = W.partitionBy("rel").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = e.groupBy("rel", "part").agg(F.count("*").alias("m"))
    parts = counts.select("rel", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    rn = F.row_number().over(W.partitionBy("rel", "part").orderBy("eid")) - 1
    rows = e.withColumn("rn", rn).join(parts, ["rel", "part"]).withColumn("i", F.col("before") + F.col("rn"))
    return rows.drop("part", "before", "rn"), counts.groupBy("rel").agg(F.sum("m").alias("n"))


def start_edges(edges: DataFrame, n_walks: int, seed: int) -> DataFrame:
    """(rel, walk_no, eid): a uniform edge row of each relation for each walk, by a hash of (relation, walk number)."""
    rows, sizes = numbered_edges(edges.select("rel", "eid"))
    walks = sizes.withColumn("walk_no", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))))
    pick = walks.select("rel", "walk_no", F.pmod(uniform(seed, "rel", "walk_no"), F.col("n")).alias("i"))
    return pick.join(rows, ["rel", "i"]).select("rel", F.col("walk_no").cast("long").alias("walk_no"), "eid")


def next_edges(edges: DataFrame, walks: DataFrame, first_step: bool, distribution: str, seed: int, n_relations: int, closing: bool = False) -> DataFrame:
    """One sampled step: for each walk (walk, prev_sub, prev_rel, at, now, start) the edge that it takes, if any.

    ``unif`` takes the edge of the least hash.  ``exp`` weighs an edge by exp(ts - now) (Gumbel maximum); where all
    weights underflow, the choice is uniform.
    """
    if distribution not in ("unif", "exp"):
        raise ValueError("the transition distribution is unif or exp")
    e = edges.select("eid", F.col("sub").alias("s"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"))
    on = (F.col("at") == F.col("s")) & (F.col("t") < F.col("now") if first_step else F.col("t") <= F.col("now"))
    if not first_step:
        on &= ~_backtracks(F.col("prev_rel"), F.col("prev_sub"), F.col("now"), F.col("r"), F.col("o"), F.col("t"), n_relations)
    if closing:
        on &= F.col("start") == F.col("o")
    found = walks.join(e, on)
    u = unit(seed, "walk", "eid")
    if distribution == "unif":
        best = F.min_by(F.struct("eid", "s", "r", "o", "t"), F.struct(u.alias("u"), "eid"))
        got = found.groupBy("walk").agg(best.alias("e"))
    else:
        gap = F.col("t") - F.col("now")
        by = found.groupBy("walk").agg(
            F.max_by(F.struct("eid", "s", "r", "o", "t"), F.struct((gap - F.log(-F.log(u))).alias("g"), -F.col("eid"))).alias("e"),
            F.min_by(F.struct("eid", "s", "r", "o", "t"), F.struct(u.alias("u"), "eid")).alias("any"),
            F.max(gap).alias("gap"),
        )
        got = by.select("walk", F.when(F.col("gap") <= -746, F.col("any")).otherwise(F.col("e")).alias("e"))
    return got.select("walk", "e.*")


def sample_walks(edges: DataFrame, length: int, n_walks: int, n_relations: int, distribution: str = "exp", seed: int = 12) -> DataFrame:
    """(rel, walk_no, rels, ents, tss): sampled cyclic walks; those that cannot go on or close have no row."""
    w = start_edges(edges, n_walks, seed).join(edges.select("eid", "sub", "obj", "ts"), "eid")
    w = w.select(F.concat_ws("-", F.lit(str(length)), "rel", "walk_no").alias("walk"), "rel", "walk_no", F.array("rel").alias("rels"), F.array("sub", "obj").alias("ents"), F.array("ts").alias("tss"))
    for k in range(1, length):
        state = w.select("walk", F.element_at("ents", -2).alias("prev_sub"), F.element_at("rels", -1).alias("prev_rel"), F.element_at("ents", -1).alias("at"), F.element_at("tss", -1).alias("now"), F.get("ents", F.lit(0)).alias("start"))
        step = next_edges(edges, state, k == 1, distribution, seed + k, n_relations, closing=k == length - 1)
        w = w.join(step, "walk").select("walk", "rel", "walk_no", F.concat("rels", F.array("r")).alias("rels"), F.concat("ents", F.array("o")).alias("ents"), F.concat("tss", F.array("t")).alias("tss"))
    return w.drop("walk")
