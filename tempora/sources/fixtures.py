"""A temporal knowledge graph over the ``events`` table: who did what with which key on which day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.graph import with_inverses

RELATIONS = ("click", "error", "purchase", "signup", "view")
N_RELATIONS = len(RELATIONS)
N_SPLIT = (21, 26)


def split_of(ts) -> F.Column:
    return F.when(ts < N_SPLIT[0], "train").when(ts < N_SPLIT[1], "valid").otherwise("test")


def events_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (eid, sub, rel, obj, ts, split, is_inverse), inverses included."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rel = F.coalesce(*[F.when(F.col("event_type") == r, i) for i, r in enumerate(RELATIONS)]).cast("long")
    day = F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long")
    facts = e.select((F.col("event_id") * 2).alias("eid"), F.col("user_id").alias("sub"), rel.alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("obj"), day.alias("ts"))
    return with_inverses(facts, N_RELATIONS).withColumn("split", split_of(F.col("ts")))


def commerce_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges: a customer and the suppliers of the items ordered, by return flag and line status, a month."""
    o, li = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kinds = F.array(*[F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")])
    rel = (F.array_position(kinds, F.concat("l_returnflag", "l_linestatus")) - 1).cast("long")
    month = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("long")
    facts = li.join(o, li.l_orderkey == o.o_orderkey).select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2).alias("eid"), F.col("o_custkey").alias("sub"), rel.alias("rel"), (F.col("l_suppkey") + 1000000).alias("obj"), month.alias("ts"))
    return with_inverses(facts, 6)
