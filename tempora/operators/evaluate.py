"""Baselines, filtered candidates, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def object_distribution(edges: DataFrame) -> DataFrame:
    """(obj, p): share of each object in the training edges, half-even at six digits."""
    total = edges.agg(F.count("*").alias("total"))
    return edges.groupBy("obj").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("obj", F.bround(F.col("n") / F.col("total"), 6).alias("p"))  # total: one row


def relation_object_distribution(edges: DataFrame) -> DataFrame:
    """(rel, obj, p) within each relation."""
    n = edges.groupBy("rel", "obj").agg(F.count("*").alias("n"))
    totals = n.groupBy("rel").agg(F.sum("n").alias("total"))
    return n.join(totals, "rel").select("rel", "obj", F.bround(F.col("n") / F.col("total"), 6).alias("p"))


def with_baseline(queries: DataFrame, candidates: DataFrame, rel_dist: DataFrame, dist: DataFrame) -> DataFrame:
    """(qid, cand, score): candidates (qid, cand, score), and for queries without any the distribution of their relation
    or, if training lacks it, that of all objects."""
    c = candidates.select("qid", "cand", "score")
    rest = queries.join(c.select("qid").distinct(), "qid", "left_anti")
    known = rest.drop("obj").join(rel_dist, "rel").select("qid", F.col("obj").alias("cand"), F.col("p").alias("score"))
    unknown = rest.join(rel_dist.select("rel").distinct(), "rel", "left_anti").select("qid", F.lit(1).alias("one"))
    other = unknown.join(dist.withColumn("one", F.lit(1)), "one").select("qid", F.col("obj").alias("cand"), F.col("p").alias("score"))
    return c.unionByName(known).unionByName(other)


def filter_other_answers(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Drops candidates that are another true answer of the same (subject, relation, time) among the queries.  Candidates
    are read once: the true answers of each query come first."""
    q = queries.select("qid", "sub", "rel", "obj", "ts")
    truths = q.select("sub", "rel", "ts", F.col("obj").alias("cand")).distinct()
    others = q.join(truths, ["sub", "rel", "ts"]).filter("cand <> obj").select("qid", "cand")
    return candidates.join(others, ["qid", "cand"], "left_anti").select("qid", "cand", "score")


def ranks(queries: DataFrame, candidates: DataFrame, n_entities: int | Column, setting: str = "best") -> DataFrame:
    """(qid, rank) of each query's answer by score: best and worst of its ties, or average (by places from 0:
    (first + last) // 2 + 1); an answer that is no candidate ranks ``n_entities``."""
    if setting not in ("best", "average", "worst"):
        raise ValueError("the rank setting is best, average or worst")
    # one pass over the candidates: the answer's score beside each, then counts, all by query
    own = F.max(F.when(F.col("cand") == F.col("obj"), F.col("score"))).over(W.partitionBy("qid"))
    beside = queries.select("qid", "obj").join(candidates, "qid").withColumn("own", own).filter("own is not null")
    counted = beside.groupBy("qid").agg(F.count_if(F.col("score") > F.col("own")).alias("above"), F.count_if(F.col("score") >= F.col("own")).alias("upto"))
    place = {"best": F.col("above") + 1, "worst": F.col("upto"), "average": F.floor((F.col("above") + F.col("upto") - 1) / 2) + 1}[setting]
    absent = n_entities if isinstance(n_entities, Column) else F.lit(n_entities)
    return queries.select("qid").join(counted, "qid", "left").select("qid", F.coalesce(place, absent).cast("long").alias("rank"))


def _beside_truths(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(context, cand, score, true): a context's candidates (qid: the context) and whether one of its queries has it as answer."""
    truths = asked.select("context", F.col("obj").alias("cand"), F.lit(True).alias("true")).distinct()
    c = candidates.select(F.col("qid").alias("context"), "cand", "score")
    return c.join(truths, ["context", "cand"], "left").withColumn("true", F.col("true").isNotNull())


def filtered_by_context(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """``filter_other_answers`` for candidates that stand once a context: ``asked`` is ``graph.in_contexts``."""
    rows = _beside_truths(asked, candidates).join(asked, "context").filter(~F.col("true") | (F.col("cand") == F.col("obj")))
    return rows.select("qid", "cand", "score")


def ranks_by_context(asked: DataFrame, candidates: DataFrame, n_entities: int, setting: str = "best") -> DataFrame:
    """``ranks`` of the filtered candidates, from candidates that stand once a context: ``asked`` is ``graph.in_contexts``.

    Within a context, those that are no query's answer are counted by score; an answer's rank follows from how many of
    them are above it and beside it, so no candidate is listed by query.
    """
    if setting not in ("best", "average", "worst"):
        raise ValueError("the rank setting is best, average or worst")
    rows = _beside_truths(asked, candidates).groupBy("context", "score", F.when(F.col("true"), F.col("cand")).alias("obj")).agg(F.count("*").alias("n"))
    n = F.when(F.col("obj").isNull(), F.col("n")).otherwise(0)
    upto = F.sum(n).over(W.partitionBy("context").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("upto", upto).withColumn("tie", F.sum(n).over(W.partitionBy("context", "score"))).filter("obj is not null")
    rows = rows.select("context", "obj", (F.col("upto") - F.col("tie")).alias("above"), (F.col("upto") + 1).alias("upto"))
    place = {"best": F.col("above") + 1, "worst": F.col("upto"), "average": F.floor((F.col("above") + F.col("upto") - 1) / 2) + 1}[setting]
    return asked.join(rows, ["context", "obj"], "left").select("qid", F.coalesce(place, F.lit(n_entities)).cast("long").alias("rank"))


def metrics(ranked: DataFrame) -> DataFrame:
    """hits1, hits3, hits10, mrr over all queries, at six digits."""
    hit = lambda k: F.bround(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hits{k}")
    return ranked.agg(hit(1), hit(3), hit(10), F.bround(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def metrics_text(m: DataFrame) -> DataFrame:
    return m.select(F.explode(F.array(*[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in (("Hits@1", "hits1"), ("Hits@3", "hits3"), ("Hits@10", "hits10"), ("MRR", "mrr"))])).alias("value"))
