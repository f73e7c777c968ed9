"""Files of a temporal knowledge graph: facts, dictionaries, rules, candidates, rule counts, path samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = "struct<head_rel:int,body_rels:array<int>,var_constraints:array<array<int>>,conf:double,rule_supp:bigint,body_supp:bigint>"
QUADS = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "relation", "object", "timestamp")])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) from a JSON object; a bad file has no rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "id"))


def read_quads(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """Tab-separated subject, relation, object, timestamp (further fields are ignored), with ``positions`` also ``pos``,
    which grows with the position in the file."""
    quads = spark.read.csv(path, sep="\t", schema=QUADS, quote="", enforceSchema=True)
    return quads.withColumn("pos", F.monotonically_increasing_id()) if positions else quads


def encode_quads(quads: DataFrame, entities: DataFrame, relations: DataFrame, times: DataFrame) -> DataFrame:
    """(sub, rel, obj, ts), and ``pos`` where there is one: names to ids.  A name that a dictionary lacks fails the job when it runs.

    The relation and time dictionaries are small by nature; the entities' is left to the optimizer, which knows its size.
    """
    def lookup(df: DataFrame, words: DataFrame, name: str, out: str) -> DataFrame:
        words = words.select(F.col("name").alias(f"_{out}"), F.col("id").alias(out))
        found = df.join(words, df[name] == words[f"_{out}"], "left").drop(f"_{out}")
        return found.withColumn(out, F.coalesce(out, F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(name, F.lit("null")))).cast("int")))

    df = lookup(lookup(lookup(lookup(quads, entities, "subject", "sub"), relations, "relation", "rel"), entities, "object", "obj"), times, "timestamp", "ts")
    return df.select("sub", "rel", "obj", "ts", *(["pos"] if "pos" in quads.columns else []))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Flat rules with rule_rank, the position in their head's list."""
    text = spark.read.text(path, wholetext=True)
    heads = text.select(F.explode(F.from_json("value", f"map<string,array<{RULE}>>")).alias("head", "rules"))
    return heads.select(F.posexplode("rules").alias("rule_rank", "r")).select("rule_rank", "r.*")


def rules_json(rules: DataFrame) -> DataFrame:
    """One row: all rules as the JSON object from head to list, each list by rule_rank."""
    fields = ["head_rel", "body_rels", "var_constraints", "conf", "rule_supp", "body_supp"]
    lists = rules.groupBy("head_rel").agg(F.array_sort(F.collect_list(F.struct("rule_rank", *[F.col(f).alias(f"{f}_") for f in fields]))).alias("l"))
    lists = lists.select(F.col("head_rel").cast("string").alias("h"), F.transform("l", lambda r: F.struct(*[r[f"{f}_"].alias(f) for f in fields])).alias("rules"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "rules"))))).alias("value"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    per = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("qid", "cands"))
    return per.select(F.col("qid").cast("long").alias("qid"), F.explode("cands").alias("cand", "score")).select("qid", F.col("cand").cast("long").alias("cand"), "score")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """A line a query, each a JSON object from the query to its candidates' scores, best first."""
    scored = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("cand").alias("c"), "score")))
    lists = candidates.groupBy("qid").agg(scored.alias("l"))
    entries = F.map_from_entries(F.transform("l", lambda x: F.struct(x["c"].cast("string"), x["score"])))
    lists.select(F.to_json(F.create_map(F.col("qid").cast("string"), entries)).alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A few lines (column ``value``) in their order, in one file of the folder."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def stat_json(counts: DataFrame, statistics: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """One row: counts of rules by relation, their statistics and the first relations as a JSON object.  Relations are few."""
    by = lambda df: df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), "n"))))
    every, first = by(counts).toDF("relation_rule_counts"), by(top).toDF("top_10_relations")
    one = statistics.select(F.struct(*statistics.columns).alias("statistics"))
    return every.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(first)).select(F.to_json(F.struct("relation_rule_counts", "statistics", "top_10_relations")).alias("value"))  # a row each


def read_rule_counts(spark: SparkSession, path: str) -> DataFrame:
    """(relation, n) from a rules file that may be cut off: what follows the last brace is ignored; a value that is not a
    list counts zero."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    text = text.select(F.when(F.col("v").endswith("}"), F.col("v")).otherwise(F.expr("substring(v, 1, length(v) - locate('}', reverse(v)) + 1)")).alias("v"))
    whole = F.when(F.json_object_keys("v").isNotNull(), F.col("v")).otherwise(F.concat("v", F.lit("]}")))
    keys = text.select(whole.alias("v")).select("v", F.explode(F.json_object_keys("v")).alias("relation"), F.from_json("v", "map<string,string>").alias("m"))
    return keys.select("relation", F.coalesce(F.json_array_length(F.get(F.map_values(F.map_filter("m", lambda k, _: k == F.col("relation"))), F.lit(0))), F.lit(0)).cast("long").alias("n"))


def read_path_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="head string, paths array<string>")


def rules_file_name(stamp: str, lengths: list[int], walks: int, distribution: str, seed: int | None, kind: str = "rules.json") -> str:
    """``{stamp}_r[1,2]_n100_exp_s12_rules.json``: blanks go."""
    return f"{stamp}_r{lengths}_n{walks}_{distribution}_s{seed}_{kind}".replace(" ", "")


def candidates_file_name(rules_file: str, lengths: list[int], window: int, score: str) -> str:
    return f"{rules_file.removesuffix('_rules.json')}_cands_r{lengths}_w{window}_{score}.json".replace(" ", "")
