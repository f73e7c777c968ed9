"""Mine rules, apply them, evaluate and describe, over a folder of facts and dictionaries.

    python -m tempora.cli learn    --data DIR --rules OUT [-l 1 2] [--mode exact|sampled] [-n 100] [--distribution exp] [--seed 12] [--keep-zero]
    python -m tempora.cli apply    --data DIR --rules IN --candidates OUT [-l 1] [-w 0] [--split test] [--stop-k 20] [--lmbda 0.1] [--weight 0.5]
    python -m tempora.cli evaluate --data DIR --candidates IN [--out OUT] [--split test] [--setting best]
    python -m tempora.cli stat     --rules FILE.json [--out OUT]
    python -m tempora.cli prompt   --data DIR --rules RULES.txt --out OUT [-k 50] [--shots N]
    python -m tempora.cli demo     --data DIR --rules IN --query N [-w 0] [--split test]

``learn`` writes OUT/rules.json and OUT/rules.txt (folders of text), ``apply`` a line of JSON a query.  ``prompt`` writes a
folder a head and skips those that are there; there is no model here, so the responses are empty.  ``demo`` shows a
query's candidates in the order of the rules and the walks behind them.

The folder has train.txt, valid.txt, test.txt (tab-separated names), entity2id.json, relation2id.json and ts2id.json.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.rules import safe_name
from tempora.operators import apply as A
from tempora.operators import evaluate as V
from tempora.operators import graph as G
from tempora.operators import prompts as P
from tempora.operators import rules as R
from tempora.operators import walks as K
from tempora.sources import files as S


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, int, DataFrame]:
    """(edges, number of relations, entities): what the steps below take.  Edges are read again and again, so they are kept."""
    names = {n: S.read_dictionary(spark, f"{folder}/{n}2id.json") for n in ("entity", "relation", "ts")}
    n = names["relation"].count()
    parts = []
    for k, split in enumerate(("train", "valid", "test")):
        quads = S.encode_quads(S.read_quads(spark, f"{folder}/{split}.txt", positions=True), names["entity"], names["relation"], names["ts"])
        # numbered by the position in the file, before any join, so that every session numbers alike
        facts = quads.select(((F.col("pos") * 3 + k) * 2).alias("eid"), *[F.col(c).cast("long").alias(c) for c in ("sub", "rel", "obj", "ts")])
        parts.append(G.with_inverses(facts, n).withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, parts).persist(), n, names["entity"]


def learn(graph: tuple, lengths: list[int], mode: str = "exact", n_walks: int = 100, distribution: str = "exp", seed: int = 12, keep_zero: bool = False) -> DataFrame:
    edges, n, _ = graph
    train = G.in_split(edges, "train")
    if mode == "exact":
        walks = [K.cyclic_walks(train, k + 1, n) for k in lengths]
    else:
        walks = [K.sample_walks(train, k + 1, n_walks, n, distribution, seed).select("rels", "ents", "tss") for k in lengths]
    rules = reduce(DataFrame.unionByName, [R.rules_from_walks(w, n) for w in walks]).persist()
    found = R.support(rules, train, longest=max(lengths)) if mode == "exact" else R.sampled_support(rules, train, seed=seed, longest=max(lengths))
    return R.rank_rules(R.positive(found, keep_zero))


def apply(graph: tuple, rules: DataFrame, lengths: list[int], window: int = 0, split: str = "test", stop_k: int | None = 20, lmbda: float = 0.1, a: float = 0.5) -> DataFrame:
    """(qid, cand, score)"""
    edges, _, _ = graph
    kept = R.filter_rules(rules, lengths=tuple(lengths)).persist()
    scored = A.score_candidates(A.apply_rules(G.queries_of(edges, split), kept, edges, window), lmbda=lmbda, a=a)
    scored = A.stopped(scored, stop_k) if stop_k else scored
    return A.candidate_lists(scored).select("qid", "cand", "score")


def evaluate(graph: tuple, candidates: DataFrame, split: str = "test", setting: str = "best") -> DataFrame:
    edges, _, entities = graph
    q, train = G.queries_of(edges, split), G.in_split(edges, "train")
    every = V.with_baseline(q, candidates, V.relation_object_distribution(train), V.object_distribution(train))
    return V.metrics(V.ranks(q, V.filter_other_answers(q, every), entities.count(), setting))


def read_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Rules as ``learn`` wrote them: the position in the list is the rank."""
    return S.read_rules(spark, f"{folder}/rules.json").persist()


def write_rules(spark: SparkSession, rules: DataFrame, folder: str, names: list[str]) -> None:
    rules = rules.persist()
    S.write_lines(S.rules_json(rules), f"{folder}/rules.json")
    text = R.verbalize(rules, R.relation_names(names)).orderBy("head_rel", "rule_rank")
    S.write_lines(text.select(F.col("rule_text").alias("value")), f"{folder}/rules.txt")


def relation_names(spark: SparkSession, folder: str) -> list[str]:
    """Names by id.  A rule's text needs them all, and they are few."""
    return [r.name for r in S.read_dictionary(spark, f"{folder}/relation2id.json").orderBy("id").collect()]


def prompt(spark: SparkSession, data: str, rules: str, out: str, k: int = 50, shots: int | None = None, completion=None) -> None:
    """Ask for rules of each head that has no folder in ``out`` yet, by a sample of its rules; write a folder a head."""
    parsed = P.sampled_rules(P.parse_rule_lines(spark.read.text(rules)))
    asked = P.prompts(parsed, relation_names(spark, data), k, shots=shots)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f.getPath().getName().removeprefix("file_name=") for f in files.listStatus(path) if f.isDirectory()] if files.exists(path) else []
    asked = asked.filter(~safe_name(F.col("head")).isin(there)) if there else asked
    P.complete(asked, completion).select("file_name", "response").write.mode("append").partitionBy("file_name").text(out)


def demo(graph: tuple, rules: DataFrame, qid: int, window: int = 0, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """(candidates in the order of the rules, walks) of one query."""
    edges, _, _ = graph
    q = G.queries_of(edges, split).filter(F.col("qid") == qid)
    scored = A.score_candidates(A.apply_rules(q, rules, edges, window))
    lengths = [r[0] for r in rules.select(F.size("body_rels")).distinct().collect()]
    walks = reduce(DataFrame.unionByName, [A.explained_walks(q, rules, edges, window, n) for n in lengths])
    return A.ranked_by_rules(A.stopped(scored)), walks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("learn", "apply", "evaluate", "stat", "prompt", "demo"))
    for name in ("--data", "--rules", "--candidates", "--out"):
        p.add_argument(name)
    p.add_argument("-l", "--lengths", type=int, nargs="+", default=[1])
    p.add_argument("--mode", choices=("exact", "sampled"), default="exact")
    p.add_argument("-n", "--walks", type=int, default=100)
    p.add_argument("--distribution", choices=("exp", "unif"), default="exp")
    p.add_argument("--seed", type=int, default=12)
    p.add_argument("--keep-zero", action="store_true")
    p.add_argument("-w", "--window", type=int, default=0)
    p.add_argument("--split", default="test")
    p.add_argument("--stop-k", type=int, default=20)
    p.add_argument("--lmbda", type=float, default=0.1)
    p.add_argument("--weight", type=float, default=0.5)
    p.add_argument("--setting", choices=("best", "average", "worst"), default="best")
    p.add_argument("-k", type=int, default=50)
    p.add_argument("--shots", type=int)
    p.add_argument("--query", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tempora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "learn":
        rules = learn(load(spark, a.data), a.lengths, a.mode, a.walks, a.distribution, a.seed, a.keep_zero)
        write_rules(spark, rules, a.rules, relation_names(spark, a.data))
    elif a.command == "apply":
        found = apply(load(spark, a.data), read_ranked(spark, a.rules), a.lengths, a.window, a.split, a.stop_k, a.lmbda, a.weight)
        S.write_candidates(found, a.candidates)
    elif a.command == "evaluate":
        text = V.metrics_text(evaluate(load(spark, a.data), S.read_candidates(spark, a.candidates), a.split, a.setting)).persist()
        text.show(truncate=False)
        if a.out:
            S.write_lines(text, a.out)
    elif a.command == "stat":
        counts = S.read_rule_counts(spark, a.rules).persist()
        statistics, top = R.describe_counts(counts), R.top_relations(counts, "relation")
        statistics.show()
        top.show()
        if a.out:
            S.write_lines(S.stat_json(counts, statistics, top, "relation"), a.out)
    elif a.command == "prompt":
        prompt(spark, a.data, a.rules, a.out, a.k, a.shots)
    else:
        ordered, walks = demo(load(spark, a.data), read_ranked(spark, a.rules), a.query, a.window, a.split)
        ordered.orderBy("place").show(truncate=False)
        walks.show(truncate=False)


if __name__ == "__main__":
    main()
