"""Edges: inverses, splits, windows, indexes and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions.rules import inverse


def with_inverses(facts: DataFrame, n_relations: int) -> DataFrame:
    """Facts (eid even, sub, rel, obj, ts) and, for each, (obj, inverse relation, sub, ts) with eid + 1."""
    forward = facts.select("eid", "sub", "rel", "obj", "ts", F.lit(False).alias("is_inverse"))
    back = facts.select((F.col("eid") + 1).alias("eid"), F.col("obj").alias("sub"), inverse("rel", n_relations).alias("rel"), F.col("sub").alias("obj"), "ts", F.lit(True).alias("is_inverse"))
    return forward.unionByName(back)


def in_split(edges: DataFrame, name: str) -> DataFrame:
    """``test``, or else the validation edges; ``train`` and ``all`` as they say."""
    if name == "all":
        return edges
    return edges.filter(F.col("split") == (name if name in ("train", "test") else "valid"))


def in_window(query_ts: Column, edge_ts: Column, edge_split: Column, window: int) -> Column:
    """The edges that a query may use: w > 0: the last w steps; 0: all of the past; -1: training edges, of any time."""
    if window < -1:
        raise ValueError("window is -1, 0 or positive")
    if window == -1:
        return edge_split == "train"
    past = edge_ts < query_ts
    return past & (edge_ts >= query_ts - window) if window else past


def window_sizes(edges: DataFrame, window: int, query_split: str = "test") -> DataFrame:
    """(query_ts, rel, n): usable edges at each query time.  Counts a day and relation come first, so that the inequality
    join is between days, not edges."""
    days = in_split(edges, query_split).select(F.col("ts").alias("query_ts")).distinct()
    per_day = edges.groupBy("rel", "ts", "split").agg(F.count("*").alias("m"))
    joined = per_day.join(F.broadcast(days), in_window(F.col("query_ts"), F.col("ts"), F.col("split"), window))
    return joined.groupBy("query_ts", "rel").agg(F.sum("m").alias("n"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("sub", "rel", "obj", "ts").distinct()


def split_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("split").agg(F.count("*").alias("n_edges"), F.count_distinct("sub").alias("n_sub"), F.count_distinct("rel").alias("n_rel"), F.count_distinct("ts").alias("n_ts"))


def new_entities(edges: DataFrame) -> DataFrame:
    """(split, n_new): how many entities of each later split training does not have."""
    known = in_split(edges, "train").select("sub").distinct().withColumn("known", F.lit(True))
    later = edges.filter("split <> 'train'").select("split", "sub").distinct().join(known, "sub", "left")
    return later.groupBy("split").agg(F.count_if(F.col("known").isNull()).alias("n_new"))


def queries_of(edges: DataFrame, split: str = "test") -> DataFrame:
    """(qid, sub, rel, obj, ts): qid is the position, facts first, then inverses, each by eid.

    Positions come in two steps: rows in a range of eids, then the ranges' totals; no task holds all rows.
    """
    q = in_split(edges, split).withColumn("part", F.floor(F.col("eid") / 65536))
    before = W.partitionBy(F.lit(0)).orderBy("is_inverse", "part").rowsBetween(W.unboundedPreceding, -1)
    parts = q.groupBy("is_inverse", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rn = F.row_number().over(W.partitionBy("is_inverse", "part").orderBy("eid"))
    return q.withColumn("rn", rn).join(parts, ["is_inverse", "part"]).select((F.col("before") + F.col("rn") - 1).cast("long").alias("qid"), "sub", "rel", "obj", "ts")


def contexts_of(queries: DataFrame) -> DataFrame:
    """(qid, sub, rel, ts): each (subject, relation, time) that is asked once, with the least qid of its queries.  Rules
    give all queries of a context the same."""
    return queries.groupBy("sub", "rel", "ts").agg(F.min("qid").alias("qid")).select("qid", "sub", "rel", "ts")


def in_contexts(queries: DataFrame) -> DataFrame:
    """(context, qid, obj): the queries with the qid that stands for their context in ``contexts_of``."""
    return queries.select(F.min("qid").over(W.partitionBy("sub", "rel", "ts")).alias("context"), "qid", "obj")


def for_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``rows`` of contexts (their qid) once for each query of the context.  A context's queries come as a list that each
    row is met with once and spread from in place: the rows are not joined query by query.  (Merged: the hash of a hash join, or of a broadcast, cannot spill.)"""
    columns = ["qid", *(c for c in rows.columns if c != "qid")]
    asked = queries.groupBy("sub", "rel", "ts").agg(F.min("qid").alias("context"), F.collect_list("qid").alias("qids")).select("context", "qids")
    met = rows.withColumnRenamed("qid", "context").join(asked.hint("merge"), "context")
    return met.select(F.explode("qids").alias("qid"), *columns[1:])
