"""Rules from walks, their support and confidence, order, statistics and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions.rules import inverse, uniform, var_constraints, verbalized
from tempora.operators.walks import numbered_edges

KEY = ["head_rel", "body_rels", "var_constraints"]


def rules_from_walks(walks: DataFrame, n_relations: int) -> DataFrame:
    """Distinct (head_rel, body_rels, var_constraints): the head is the first edge, the body the others turned round."""
    n = F.size("rels") - 1
    body = F.transform(F.reverse(F.slice("rels", F.lit(2), n)), lambda r: inverse(r, n_relations))
    ents = F.reverse(F.slice("ents", F.lit(2), n + 1))
    return walks.select(F.get("rels", F.lit(0)).alias("head_rel"), body.alias("body_rels"), var_constraints(ents).alias("var_constraints")).distinct()


def body_instances(edges: DataFrame, bodies: DataFrame, longest: int | None = None, patterns: bool = True) -> DataFrame:
    """(body_rels, pattern, e0, en, last, n): distinct instances of each body, counted by both ends, the last time and the
    pattern of equal entities; without ``patterns`` that is null, and no entity between the ends is kept.  ``edges`` has
    distinct rows.  Bodies are expanded hop by hop, prefix by prefix: what two bodies have in common is joined once, and
    instances that only differ in what no later step asks go on as one."""
    longest = longest or bodies.select(F.max(F.size("body_rels"))).first()[0] or 1
    out = state = None
    ents = "ents" if patterns else "e0"
    e = edges.select(F.col("sub").alias("s"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"))
    for k in range(1, longest + 1):
        here = bodies.filter(F.size("body_rels") >= k).select(F.slice("body_rels", 1, k).alias("prefix")).distinct()
        if state is None:
            first = here.withColumn("r0", F.get("prefix", F.lit(0))).join(e, F.col("r0") == F.col("r"))
            kept = F.array("s", "o") if patterns else F.col("s")
            step = first.select("prefix", kept.alias(ents), F.col("o").alias("en"), F.col("t").alias("last"), F.lit(1).cast("long").alias("n"))
        else:
            here = here.select(F.slice("prefix", 1, k - 1).alias("was"), F.element_at("prefix", -1).alias("rk"), "prefix")
            step = state.withColumnRenamed("prefix", "was").join(here, "was")
            step = step.join(e, (F.col("en") == F.col("s")) & (F.col("rk") == F.col("r")) & (F.col("t") >= F.col("last")))
            kept = F.concat("ents", F.array("o")) if patterns else F.col("e0")
            step = step.select("prefix", kept.alias(ents), F.col("o").alias("en"), F.col("t").alias("last"), "n")
        state = step.groupBy("prefix", ents, "en", "last").agg(F.sum("n").alias("n"))
        done = bodies.filter(F.size("body_rels") == k).select("body_rels").distinct()
        full = state.join(done, state.prefix == done.body_rels, "left_semi")
        pattern = var_constraints(F.col("ents")) if patterns else F.lit(None).cast("array<array<int>>")
        e0 = F.get("ents", F.lit(0)) if patterns else F.col("e0")
        full = full.select(F.col("prefix").alias("body_rels"), pattern.alias("pattern"), e0.alias("e0"), "en", "last", "n")
        if patterns:
            full = full.groupBy("body_rels", "pattern", "e0", "en", "last").agg(F.sum("n").alias("n"))
        out = full if out is None else out.unionByName(full)
    return out


def support(rules: DataFrame, edges: DataFrame, longest: int | None = None) -> DataFrame:
    """``rules`` with rule_supp, body_supp and conf, exactly.

    body_supp counts the distinct instances of the body; a rule with constraints takes those with just its pattern of
    equal entities, one without takes all.  rule_supp counts those followed by a head edge between the same ends at a
    strictly later time: only the latest such edge matters.  conf is their ratio, half-even at six digits.
    """
    e = edges.select("sub", "rel", "obj", "ts").distinct()
    latest = e.groupBy(F.col("sub").alias("e0"), F.col("obj").alias("en"), F.col("rel").alias("head_rel")).agg(F.max("ts").alias("latest"))

    def counted(tied: bool) -> DataFrame:
        own = rules.filter(F.size("var_constraints") > 0 if tied else F.size("var_constraints") == 0)
        found = body_instances(e, own.select("body_rels"), longest, patterns=tied)
        by = ["body_rels", "pattern"] if tied else ["body_rels"]
        if tied:
            found = found.filter(F.size("pattern") > 0)
        bs = found.groupBy(*by).agg(F.sum("n").alias("body_supp"))
        rs = found.join(latest, ["e0", "en"]).filter("latest > last").groupBy("head_rel", *by).agg(F.sum("n").alias("rule_supp"))
        keyed = own.withColumn("pattern", F.col("var_constraints"))
        return keyed.join(bs, by, "left").join(rs, ["head_rel", *by], "left").select(*KEY, "rule_supp", "body_supp")

    out = counted(False).unionByName(counted(True))
    return out.select(*KEY, *supports())


def supports() -> list[Column]:
    rs, bs = F.coalesce("rule_supp", F.lit(0)).cast("long"), F.coalesce("body_supp", F.lit(0)).cast("long")
    return [rs.alias("rule_supp"), bs.alias("body_supp"), F.when(bs > 0, F.bround(rs / bs, 6)).otherwise(0.0).alias("conf")]


def _later_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, sub, i, obj, ts): edges numbered from 0 within (relation, subject), latest first, then by object; and (r, sub,
    ts, upto): how many are not earlier than each of their times.  Numbers come by time first, so that a subject with
    very many edges takes no more rows than there are times."""
    e = edges.select(F.col("rel").alias("r"), "sub", "ts", "obj")
    later = W.partitionBy("r", "sub").orderBy(F.desc("ts"))
    times = e.groupBy("r", "sub", "ts").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(later.rowsBetween(W.unboundedPreceding, 0)))
    rn = F.row_number().over(W.partitionBy("r", "sub", "ts").orderBy("obj")) - 1
    rows = e.withColumn("rn", rn).join(times, ["r", "sub", "ts"]).select("r", "sub", (F.col("upto") - F.col("m") + F.col("rn")).alias("i"), "obj", "ts")
    return rows, times.select("r", "sub", "ts", "upto")


def sampled_support(rules: DataFrame, edges: DataFrame, n_samples: int = 500, seed: int = 7, longest: int | None = None) -> DataFrame:
    """``support`` by sampled body instances (distinct ones count): each sample starts at a uniform edge of the first
    relation and goes on to a uniform edge that is not earlier; a rule with constraints takes exact patterns only.

    Edges are numbered, so that each pick is an equi-join; how many edges a hop has to pick from is looked up once for
    each (relation, subject, time) that samples have, by a running count over the times of both.
    """
    e = edges.select("eid", "sub", "rel", "obj", "ts")
    rules = rules.withColumn("rule", F.concat_ws(";", F.col("head_rel").cast("string"), F.col("body_rels").cast("string"), F.col("var_constraints").cast("string")))
    longest = longest or rules.select(F.max(F.size("body_rels"))).first()[0] or 1
    numbered, sizes = numbered_edges(e)
    s = rules.select("rule", "body_rels", F.get("body_rels", F.lit(0)).alias("rel"), F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("k"))
    s = s.join(sizes, "rel").withColumn("i", F.pmod(uniform(seed, "rule", "k"), F.col("n"))).join(numbered.select("rel", "i", "sub", "obj", "ts"), ["rel", "i"])
    s = s.select("rule", "body_rels", "k", F.array("sub", "obj").alias("ents"), F.array("ts").alias("tss"))
    if longest > 1:
        rows, times = _later_edges(e)
    for hop in range(1, longest):
        more = s.filter(F.size("body_rels") > hop).withColumn("r", F.get("body_rels", F.lit(hop))).withColumn("sub", F.element_at("ents", -1)).withColumn("now", F.element_at("tss", -1))
        asked = more.select("r", "sub", "now").distinct()
        both = times.select("r", "sub", "ts", "upto", F.lit(0).alias("asks")).unionByName(asked.select("r", "sub", F.col("now").alias("ts"), F.lit(None).cast("long").alias("upto"), F.lit(1).alias("asks")))
        running = W.partitionBy("r", "sub").orderBy(F.desc("ts"), "asks").rowsBetween(W.unboundedPreceding, 0)
        known = both.withColumn("upto", F.max("upto").over(running)).filter("asks = 1 and upto is not null").select("r", "sub", F.col("ts").alias("now"), "upto")
        more = more.join(known, ["r", "sub", "now"]).withColumn("i", F.pmod(uniform(seed + hop, "rule", "k"), F.col("upto"))).join(rows, ["r", "sub", "i"])
        more = more.select("rule", "body_rels", "k", F.concat("ents", F.array("obj")).alias("ents"), F.concat("tss", F.array("ts")).alias("tss"))
        s = s.filter(F.size("body_rels") <= hop).unionByName(more)
    s = s.join(rules.select("rule", "head_rel", "var_constraints"), "rule").filter((F.size("var_constraints") == 0) | (var_constraints(F.col("ents")) == F.col("var_constraints")))
    s = s.select("rule", "head_rel", "ents", "tss").distinct()
    latest = e.groupBy(F.col("sub").alias("e0"), F.col("obj").alias("en"), F.col("rel").alias("head_rel")).agg(F.max("ts").alias("latest"))
    s = s.withColumn("e0", F.get("ents", F.lit(0))).withColumn("en", F.element_at("ents", -1)).join(latest, ["e0", "en", "head_rel"], "left")
    got = s.groupBy("rule").agg(F.count("*").alias("body_supp"), F.count_if(F.coalesce(F.col("latest") > F.element_at("tss", -1), F.lit(False))).alias("rule_supp"))
    return rules.join(got, "rule", "left").select(*KEY, *supports())


def positive(rules: DataFrame, keep_zero_conf: bool = False) -> DataFrame:
    return rules if keep_zero_conf else rules.filter("conf > 0")


def filter_rules(rules: DataFrame, min_conf: float = 0.01, min_body_supp: int = 2, lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return rules.filter((F.col("conf") >= min_conf) & (F.col("body_supp") >= min_body_supp) & F.size("body_rels").isin(*lengths))


def rank_rules(rules: DataFrame) -> DataFrame:
    """Adds rule_rank within the head, from 1: by conf, then length, body, constraints."""
    return rules.withColumn("rule_rank", F.row_number().over(W.partitionBy("head_rel").orderBy(F.desc("conf"), F.size("body_rels"), "body_rels", "var_constraints")))


def rules_statistics(rules: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(length, n_rules, n_relations, n_all): by length; relations count from ``heads`` too, which a filter may have
    left without rules."""
    heads = (heads if heads is not None else rules).select("head_rel").distinct().agg(F.count("*").alias("n_relations"))
    by_length = rules.groupBy(F.size("body_rels").cast("long").alias("length")).agg(F.count("*").alias("n_rules"))
    every = rules.agg(F.count("*").alias("n_all"))
    return by_length.crossJoin(F.broadcast(heads)).crossJoin(F.broadcast(every))  # a row each


def relation_names(names: list[str] | tuple[str, ...]) -> Column:
    """Array of the names by id, inverses (with an underscore) after them."""
    return F.array(*[F.lit(n) for n in names], *[F.lit(f"_{n}") for n in names])


def verbalize(rules: DataFrame, names: Column) -> DataFrame:
    at = lambda r: F.get(names, r.cast("int"))
    text = verbalized(F.col("conf"), F.col("rule_supp"), F.col("body_supp"), at(F.col("head_rel")), F.transform("body_rels", at), F.col("var_constraints"))
    return rules.withColumn("rule_text", text)


def weighted_sample(rows: DataFrame, group: str, weight: str, key: str, seed: int, above: int = 10) -> DataFrame:
    """Groups of more than ``above`` rows keep half (rounded up), drawn by weight without replacement: the least
    -ln(u) / weight.  Weightless rows come last, uniformly among themselves."""
    u = F.log(unit_of(seed, group, key))
    order = F.when(F.col(weight) > 0, -u / F.col(weight)).otherwise(F.lit(float("inf")))
    w = W.partitionBy(group).orderBy(order, -u, key)
    sized = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(group)))
    return sized.filter((F.col("_n") <= above) | (F.col("_rn") <= F.ceil(F.col("_n") / 2))).drop("_rn", "_n")


def unit_of(seed: int, *keys: str) -> Column:
    return (uniform(seed, *keys) + 0.5) / float(1 << 52)


def uniform_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    w = W.partitionBy(group).orderBy(uniform(seed, group, key), key)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def describe_counts(counts: DataFrame, value: str = "n") -> DataFrame:
    """One row of descriptive statistics; of several modes the least value counts, deviations are of a sample."""
    modes = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")).agg(F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("mode"))
    v = F.col(value)
    out = counts.agg(F.count("*").alias("relations"), F.sum(v).alias("rules"), F.round(F.avg(v), 2).alias("mean"), F.median(v).alias("median"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.coalesce(F.var_samp(v), F.lit(0.0)), 2).alias("variance"))
    return out.crossJoin(F.broadcast(modes))  # a row each


def top_relations(counts: DataFrame, key: str, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(n)
