"""Rule application: matching bodies to windowed edges, scores, candidates, early stop."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions.rules import holds
from tempora.functions.scores import combined, noisy_or
from tempora.operators.graph import in_window


def _instances(contexts: DataFrame, rules: DataFrame, edges: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(q_sub, q_ts, body_rels, var_constraints, cand, start, n) of rules of these lengths.

    Only the latest start matters to a score, and later hops depend on the node and time reached and on the entity of each
    group of constraints that a later position must equal.  States are reduced to their latest start by these after
    each hop; equal positions are checked as soon as they are reached.
    """
    rule = ["q_sub", "q_ts", "prefix", "var_constraints"]
    # read at every hop: what each subject and time asks for
    wanted = contexts.join(rules.select("head_rel", "body_rels", "var_constraints").distinct(), "head_rel").select("q_sub", "q_ts", "body_rels", "var_constraints").distinct().persist()
    e = edges.select(F.col("sub").alias("s"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"), F.col("split").alias("sp"))
    out = state = None
    for k in range(1, lengths[-1] + 1):
        here = wanted.filter(F.size("body_rels") >= k).select("q_sub", "q_ts", F.slice("body_rels", 1, k).alias("prefix"), "var_constraints").distinct().withColumn("rk", F.element_at("prefix", -1))
        usable = in_window(F.col("q_ts"), F.col("t"), F.col("sp"), window)
        if state is None:
            marks = F.transform("var_constraints", lambda g: F.when(F.array_min(g) == 0, F.col("q_sub")))
            step = here.withColumn("marks", marks).join(e, (F.col("q_sub") == F.col("s")) & (F.col("rk") == F.col("r")) & usable)
            step = step.withColumn("start", F.col("t")).withColumn("n", F.lit(1).cast("long"))
        else:
            here = here.withColumn("was", F.slice("prefix", 1, k - 1))
            step = state.withColumnRenamed("prefix", "was").join(here, ["q_sub", "q_ts", "was", "var_constraints"])
            step = step.join(e, (F.col("node") == F.col("s")) & (F.col("rk") == F.col("r")) & (F.col("t") >= F.col("last")) & usable)
        step = step.filter(F.forall(F.arrays_zip("var_constraints", "marks"), lambda x: ~F.array_contains(x["var_constraints"], k) | (F.array_min(x["var_constraints"]) >= k) | (x["marks"] == F.col("o"))))
        kept = F.zip_with("var_constraints", "marks", lambda g, m: F.when(F.array_max(g) > k, F.when(F.array_min(g) == k, F.col("o")).otherwise(m)))
        step = step.select(*rule, kept.alias("marks"), F.col("o").alias("node"), F.col("t").alias("last"), "start", "n")
        state = step.groupBy(*rule, "node", *(["marks", "last"] if k < lengths[-1] else [])).agg(F.max("start").alias("start"), F.sum("n").alias("n"))
        if k not in lengths:
            continue
        done = wanted.filter(F.size("body_rels") == k).withColumnRenamed("body_rels", "prefix")
        ended = state if k == lengths[-1] else state.join(done, rule, "left_semi")
        full = ended.select("q_sub", "q_ts", F.col("prefix").alias("body_rels"), "var_constraints", F.col("node").alias("cand"), "start", "n")
        out = full if out is None else out.unionByName(full)
    if len(lengths) == 1:
        return out
    return out.groupBy("q_sub", "q_ts", "body_rels", "var_constraints", "cand").agg(F.max("start").alias("start"), F.sum("n").alias("n"))


def apply_rules(queries: DataFrame, rules: DataFrame, edges: DataFrame, window: int = 0) -> DataFrame:
    """(qid, q_ts, head_rel, rule_rank, cand, start, n_walks, rule_supp, body_supp): what each rule with the query's
    relation as head gives, the latest start of its walks and their number.  Rules have rule_rank (see rank_rules);
    which lengths they have is asked of them first, so they had better be persisted."""
    q = queries.select("qid", F.col("sub").alias("q_sub"), F.col("rel").alias("head_rel"), F.col("ts").alias("q_ts"))
    contexts = q.select("q_sub", "q_ts", "head_rel").distinct()
    # a position that a body does not reach equals none
    rules = rules.filter(F.forall("var_constraints", lambda g: F.coalesce(F.array_max(g), F.lit(0)) <= F.size("body_rels")))
    lengths = sorted(r.n for r in rules.select(F.size("body_rels").alias("n")).distinct().collect())
    both = q.join(rules, "head_rel").join(_instances(contexts, rules, edges, window, lengths or [1]), ["q_sub", "q_ts", "body_rels", "var_constraints"])
    return both.groupBy("qid", "q_ts", "head_rel", "rule_rank", "cand", "rule_supp", "body_supp").agg(F.max("start").alias("start"), F.sum("n").alias("n_walks"))


def _length_one(rules: DataFrame) -> DataFrame:
    """Rules of length 1 by what they ask of an edge: (rel, body, tied, rule_rank, rule_supp, body_supp)."""
    return rules.filter(F.size("body_rels") == 1).select(F.col("head_rel").alias("rel"), F.get("body_rels", F.lit(0)).alias("body"), (F.size("var_constraints") > 0).alias("tied"), "rule_rank", "rule_supp", "body_supp")


def apply_rules_of_one(queries: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """``apply_rules`` over all of the past for rules of length 1: what a subject has reached by each time it is asked at is
    counted before rules come in, so each match is made once and none is grouped again."""
    asked = queries.select("qid", "sub", "rel", F.col("ts").alias("q_ts")).join(F.broadcast(_length_one(rules)), "rel")  # rules are few
    days = queries.groupBy("sub").agg(F.collect_set("ts").alias("days"))
    e = edges.select("sub", F.col("rel").alias("body"), F.col("obj").alias("cand"), F.col("ts").alias("t")).join(days, "sub")
    e = e.select("sub", "body", "cand", "t", F.explode(F.filter("days", lambda d: d > F.col("t"))).alias("q_ts"))
    reached = e.groupBy("sub", "q_ts", "body", "cand").agg(F.max("t").alias("start"), F.count("*").alias("n_walks"))
    both = reached.join(asked, ["sub", "q_ts", "body"]).filter(~F.col("tied") | (F.col("sub") == F.col("cand")))
    return both.select("qid", "q_ts", F.col("rel").alias("head_rel"), "rule_rank", "cand", "rule_supp", "body_supp", "start", "n_walks")


def answered_contexts(contexts: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(sub, rel, ts) of the contexts for which rules of length 1 give some candidate over all of the past: the first edge
    of each subject and relation tells, so no candidate is listed."""
    first = edges.groupBy("sub", F.col("rel").alias("body")).agg(F.min("ts").alias("loose"), F.min(F.when(F.col("sub") == F.col("obj"), F.col("ts"))).alias("own"))
    asked = contexts.select("sub", "rel", "ts").distinct().join(F.broadcast(_length_one(rules).select("rel", "body", "tied").distinct()), "rel")  # a row a rule
    return asked.join(first, ["sub", "body"]).filter(F.when(F.col("tied"), F.col("own")).otherwise(F.col("loose")) < F.col("ts")).select("sub", "rel", "ts").distinct()


def counted_starts(queries: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_ts, rule_rank, head_rel, rule_supp, body_supp, start, m): in how many matches of rules of length 1 over all of the
    past each latest start comes; queries and candidates are counted, not listed."""
    rules = _length_one(rules)
    asked = queries.groupBy("sub", "rel", F.col("ts").alias("q_ts")).agg(F.count("*").alias("k"))
    days = asked.groupBy("sub").agg(F.array_sort(F.collect_set("q_ts")).alias("days"))
    e = edges.select("sub", F.col("rel").alias("body"), "obj", "ts").distinct()
    e = e.withColumn("until", F.lead("ts").over(W.partitionBy("sub", "body", "obj").orderBy("ts")))  # it is the latest up to there
    e = e.join(days, "sub").select("sub", "body", (F.col("sub") == F.col("obj")).alias("own"), F.col("ts").alias("start"), F.explode(F.filter("days", lambda d: (d > F.col("ts")) & (F.col("until").isNull() | (d <= F.col("until"))))).alias("q_ts"))
    c = e.groupBy("sub", "body", "q_ts", "start").agg(F.count("*").alias("all"), F.count_if("own").alias("own"))
    # (sub, q_ts) with what its edges give, by what its queries ask: rules are few
    by = asked.join(F.broadcast(rules), "rel").join(c, ["sub", "body", "q_ts"])
    by = by.withColumn("m", F.col("k") * F.when(F.col("tied"), F.col("own")).otherwise(F.col("all")))
    return by.groupBy("q_ts", F.col("rel").alias("head_rel"), "rule_rank", "rule_supp", "body_supp", "start").agg(F.sum("m").alias("m")).filter("m > 0")


def explained_walks(queries: DataFrame, rules: DataFrame, edges: DataFrame, window: int, length: int) -> DataFrame:
    """(qid, rule_rank, ents, rels, tss): every walk in full, for rules of one length."""
    q = queries.select("qid", F.col("sub").alias("at"), F.col("rel").alias("head_rel"), F.col("ts").alias("q_ts"))
    w = q.join(rules.filter(F.size("body_rels") == length), "head_rel").select("qid", "q_ts", "rule_rank", "body_rels", "var_constraints", "at", F.array("at").alias("ents"), F.array().cast("array<bigint>").alias("tss"))
    e = edges.select(F.col("sub").alias("s"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"), F.col("split").alias("sp"))
    for k in range(length):
        on = (F.col("at") == F.col("s")) & (F.get("body_rels", F.lit(k)) == F.col("r")) & in_window(F.col("q_ts"), F.col("t"), F.col("sp"), window)
        if k:
            on &= F.col("t") >= F.element_at("tss", -1)
        w = w.join(e, on).select("qid", "q_ts", "rule_rank", "body_rels", "var_constraints", F.col("o").alias("at"), F.concat("ents", F.array("o")).alias("ents"), F.concat("tss", F.array("t")).alias("tss"))
    return w.filter(holds(F.col("var_constraints"), F.col("ents"))).select("qid", "rule_rank", "ents", F.col("body_rels").alias("rels"), "tss")


Score = Callable[[Column, Column, Column, Column], Column]


def score_candidates(matches: DataFrame, score: Score | None = None, lmbda: float = 0.1, a: float = 0.5) -> DataFrame:
    """Adds ``score``; a function of (rule_supp, body_supp, start, query time) may replace the combined one."""
    args = F.col("rule_supp"), F.col("body_supp"), F.col("start"), F.col("q_ts")
    return matches.withColumn("score", score(*args) if score else combined(*args, lmbda, a))


def score_grid(matches: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Scores under each (lambda, a) of a short list, in one pass."""
    params = F.array(*[F.struct(F.lit(x).alias("lmbda"), F.lit(y).alias("a")) for x, y in grid])
    m = matches.select("*", F.inline(params))
    return m.withColumn("score", combined(F.col("rule_supp"), F.col("body_supp"), F.col("start"), F.col("q_ts"), F.col("lmbda"), F.col("a")))


def final_order(lists: DataFrame) -> DataFrame:
    """``candidate_lists`` with ``place``, from 1 within the query: by the noisy-or, then by the list of scores, then by
    the candidate."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("scores"), "cand")
    return lists.withColumn("place", F.row_number().over(order))


def ranked_by_rules(scored: DataFrame) -> DataFrame:
    """(qid, cand, scores, place): candidates by their scores in the order of the rules that gave them, without combining
    them: what a single query is shown with."""
    by_rule = F.array_sort(F.collect_list(F.struct("rule_rank", (-F.col("score")).alias("s"))))
    lists = scored.groupBy("qid", "cand").agg(F.transform(by_rule, lambda x: -x["s"]).alias("scores"))
    return lists.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("scores"), "cand")))


def candidate_lists(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, cand, scores, score): a candidate's scores, best first, and their noisy-or."""
    s = F.col("score") if digits is None else F.round("score", digits)
    return scored.groupBy("qid", "cand").agg(F.sort_array(F.collect_list(s), False).alias("scores"), noisy_or(F.col("score")).alias("score"))


def early_stop(scored: DataFrame, stop_k: int = 20) -> DataFrame:
    """(qid, last_rank): the rule after which a query has enough.

    After each rule candidates are ordered by their score lists; if the first ``stop_k`` lists are all different, the
    query takes no more rules.  Lists are compared in single precision.  A query's rows are those of its own rules.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import insort
        from heapq import nlargest

        import numpy as np

        pdf = pdf.sort_values("rule_rank", kind="stable")
        ranks, cands = pdf.rule_rank.to_numpy(), pdf["cand"].tolist()
        scores = pdf["score"].to_numpy(np.float32).tolist()
        ends = np.append(np.flatnonzero(np.diff(ranks)) + 1, len(ranks)).tolist()
        lists: dict[int, list[float]] = {}
        top: list[int] = []
        last, begin = int(ranks[-1]), 0
        for end in ends:
            touched = set(cands[begin:end])
            for c, s in zip(cands[begin:end], scores[begin:end], strict=True):
                insort(lists.setdefault(c, []), s, key=lambda x: -x)
            begin = end
            # a list never falls when it grows, so that only those touched can join the first ones
            top = nlargest(stop_k, touched.union(top), key=lists.__getitem__)
            if len(top) == stop_k and all(lists[x] != lists[y] for x, y in zip(top, top[1:], strict=False)):
                last = int(ranks[end - 1])
                break
        return pd.DataFrame({"qid": [pdf.qid.iloc[0]], "last_rank": [last]})

    return scored.select("qid", "rule_rank", "cand", "score").groupBy("qid").applyInPandas(run, "qid long, last_rank long")


def stopped(scored: DataFrame, stop_k: int = 20) -> DataFrame:
    """The scores that count under early stop."""
    return scored.join(early_stop(scored, stop_k), "qid").filter("rule_rank <= last_rank").drop("last_rank")
