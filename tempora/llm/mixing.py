"""Mix sources to target weights by a low-discrepancy schedule (DataFrame functions only).

1. Every document gets a place in its source's shuffled stream of words; equal-token blocks cut that stream.
2. A Weyl sequence (multiples of the golden ratio modulo 2**32) is mapped through the cumulative targets, which
   gives each slot its source; the slot's rank within its source names the block it takes, wrapping at the end.  A
   source that its slots leave short of its target takes its next blocks too.
3. Blocks are joined to the slots that take them; what a document gives is the difference of the taken words
   before its two ends.

Empty tables give no rows.  A null source is a source of its own (last), a null text has no words and is taken zero
times, repeated rows are documents in their own right, and a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, null_safe_join, word_count

#: floor(2**32 / golden ratio), odd: its multiples modulo 2**32 visit every 32-bit integer once.
GOLDEN = 2654435769
BITS = 32
#: Streams are cut into so many ranges of the shuffle key, slots into so many chunks, points into so many cells.
RANGES, CHUNK, CELL_BITS = 4096, 1024, 20


def shuffle_key(seed: int, key: Column) -> Column:
    """52 uniform bits of an MD5, the same in any engine and for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, n_slots: int = 1 << 18) -> DataFrame:
    """A row a source: source, source_size, target, block (words a block), lo and hi (its part of the points).

    Sources in code point order (null last) weigh ``weights``, repeating.  They share ``ratio`` times all words; no
    target passes ``cap`` times its source's size, and what is above goes to the others by weight (water level).
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, ranked = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    src = (
        src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("budget", F.lit(ratio) * F.sum("source_size").over(every))
        .withColumn("cap", F.lit(cap) * F.col("source_size"))
        .withColumn("all_w", F.sum("w").over(every))
    )
    by_level = W.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    poured = F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)) + F.col("cap") / F.col("w") * (F.col("all_w") - F.coalesce(F.sum("w").over(by_level), F.lit(0.0)))
    src = src.withColumn("capped", poured <= F.col("budget"))
    over_cap = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("budget") - over_cap) * F.col("w") / free_w))
    up_to = F.sum("target").over(ranked.rowsBetween(W.unboundedPreceding, 0))
    point = lambda x: F.floor(x / F.sum("target").over(every) * float(1 << BITS))
    return src.select(
        "source",
        "source_size",
        "target",
        F.greatest(F.lit(1), F.ceil(F.col("budget") / n_slots)).cast("long").alias("block"),
        F.coalesce(point(up_to - F.col("target")), F.lit(0)).alias("lo"),
        F.coalesce(point(up_to), F.lit(0)).alias("hi"),
    )


def schedule(src: DataFrame, n_slots: int = 1 << 18) -> DataFrame:
    """A row a slot: slot, source and rank (from 0, its number among its source's slots in slot order)."""
    spark = src.sparkSession
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % F.lit(1 << BITS)).alias("u"))
    cells = src.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))))
    hit = slots.withColumn("cell", F.shiftright("u", CELL_BITS)).join(cells, "cell").filter("u >= lo and u < hi")
    hit = hit.select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = hit.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = hit.withColumn("rn", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")))
    return null_safe_join(ranked, chunks, ["source", "chunk"]).select("slot", "source", (F.col("rn") - 1 + F.col("before")).alias("rank"))


def block_takes(src: DataFrame, n_slots: int = 1 << 18) -> DataFrame:
    """A row a block of a source: source, blk, n_full (slots that take it whole), part (words of one more, cut at the
    target) and before (words that the mix takes of all earlier blocks)."""
    scheduled = schedule(src, n_slots).select("source", "rank")
    n_blocks = F.ceil(F.col("source_size") / F.col("block"))
    # blocks of a whole number of turns, and of the rest, up to the target
    given = null_safe_join(src.filter("source_size > 0"), scheduled.groupBy("source").agg(F.count("*").alias("given")), ["source"], "left").withColumn("given", F.coalesce("given", F.lit(0)))
    turns = F.floor(F.floor("target") / F.col("source_size"))
    wanted = (turns * n_blocks + F.ceil((F.floor("target") - turns * F.col("source_size")) / F.col("block"))).cast("long")
    rest = given.withColumn("wanted", wanted).filter("wanted > given").select("source", F.explode(F.sequence(F.col("given"), F.col("wanted") - 1)).alias("rank"))
    picked = null_safe_join(scheduled.unionByName(rest), src, ["source"]).filter("source_size > 0")
    picked = picked.withColumn("blk", F.col("rank") % n_blocks).withColumn("turn", F.floor(F.col("rank") / n_blocks))
    whole = F.least(F.col("block"), F.col("source_size") - F.col("blk") * F.col("block"))
    room = F.floor("target") - (F.col("turn") * F.col("source_size") + F.col("blk") * F.col("block"))
    picked = picked.withColumn("whole", whole).withColumn("got", F.greatest(F.lit(0), F.least(whole, room)))
    taken = picked.groupBy("source", "blk").agg(F.sum((F.col("got") == F.col("whole")).cast("long")).alias("n_full"), F.max(F.when(F.col("got") < F.col("whole"), F.col("got")).otherwise(0)).alias("part"), F.sum("got").alias("got"))
    # every block of a source, also those without a slot, so that the words before a block are known
    blocks = src.filter("source_size > 0").select("source", "block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("long"))).alias("blk"))
    full = null_safe_join(blocks, taken, ["source", "blk"], "left").select("source", "blk", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_full", "part", "got")])
    # words before a block: of the chunks of blocks before its own, then within that, so that no task has a whole source
    full = full.withColumn("chunk", F.floor(F.col("blk") / CHUNK))
    chunks = full.groupBy("source", "chunk").agg(F.sum("got").alias("n"))
    earlier = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    order = W.partitionBy("source", "chunk").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("own", F.coalesce(F.sum("got").over(order), F.lit(0)))
    return null_safe_join(full, chunks, ["source", "chunk"]).withColumn("before", F.col("base") + F.col("own")).drop("got", "own", "base", "chunk")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, n_slots: int = 1 << 18, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of ``docs``."""
    text = F.col(text_col)
    named = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))  # rows without ids by their texts
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), shuffle_key(seed, named).alias("h"))
    sizes = materialize(sizes, "sizes")
    src = materialize(targets(sizes, weights, ratio, cap, n_slots), "sources")
    takes = materialize(block_takes(src, n_slots), "takes")

    # place in the source's stream: words in earlier ranges of the key, then those before it in its own range
    placed = sizes.withColumn("range", F.floor(F.col("h") / F.lit((1 << 52) // RANGES)))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = null_safe_join(placed, ranges, ["source", "range"]).withColumn("at", F.col("base") + F.col("own"))
    placed = null_safe_join(placed, src.drop("lo", "hi"), ["source"])

    def taken_before(df: DataFrame, at: Column, name: str) -> DataFrame:
        """Adds the words that the mix takes of the source's words before ``at``."""
        last = F.greatest(F.lit(0), F.ceil(F.col("source_size") / F.col("block")) - 1)
        df = df.withColumn("blk", F.least(F.floor(at / F.col("block")), last))
        inside = at - F.col("blk") * F.col("block")
        value = F.col("before") + F.col("n_full") * inside + F.least(inside, F.col("part"))
        return null_safe_join(df, takes, ["source", "blk"], "left").withColumn(name, F.coalesce(value, F.lit(0))).drop("n_full", "part", "before", "blk")

    placed = taken_before(placed, F.col("at"), "t0")
    placed = taken_before(placed, F.col("at") + F.col("size"), "t1")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("t1") - F.col("t0")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them: each row as often as its taken words say (rounded; never more than the cap).

    Rows that repeat in id, source and size share their number evenly.  Columns as in ``docs``.
    """
    plan = mix(docs, id_col, text_col, source_col, **options).filter("size > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("copies"))
    row = F.col("row")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of theirs clashes
    rows = rows.select("row", row[id_col].alias("doc_id"), row[source_col].alias("source"), word_count(row[text_col]).alias("size"))
    out = null_safe_join(rows, plan, ["doc_id", "source", "size"]).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT AS h
  FROM documents
), src0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), src1 AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, 2.0::DOUBLE * source_size AS cap
  FROM src0
), src2 AS (
  SELECT *, coalesce(sum(cap) OVER lv, 0.0) + cap / w * (sum(w) OVER () - coalesce(sum(w) OVER lv, 0.0)) <= budget AS capped
  FROM src1 WINDOW lv AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), src3 AS (
  SELECT source, source_size, budget,
         CASE WHEN capped THEN cap ELSE (budget - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) * w
              / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () END AS target
  FROM src2
), src AS (
  SELECT source, source_size, target, greatest(1, ceil(budget / 262144))::BIGINT AS block,
         floor((sum(target) OVER o - target) / sum(target) OVER () * 4294967296.0)::BIGINT AS lo,
         floor(sum(target) OVER o / sum(target) OVER () * 4294967296.0)::BIGINT AS hi
  FROM src3 WINDOW o AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), slots AS (
  SELECT (i + 1) * 2654435769 % 4294967296 AS u FROM range(262144) r(i)
), given AS (
  SELECT source, count(*) AS n FROM slots JOIN src ON u >= lo AND u < hi GROUP BY source
), reach AS (
  SELECT src.source, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target)::BIGINT,
           (coalesce(n, 0) // nb) * source_size + least(source_size, (coalesce(n, 0) % nb) * block)) END AS got
  FROM (SELECT *, greatest(1, ceil(source_size / block))::BIGINT AS nb FROM src) src LEFT JOIN given ON src.source IS NOT DISTINCT FROM given.source
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sizes
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(pos + size, got) - least(pos, got))
        + greatest(0, least(pos + size, greatest(0, got - source_size)) - least(pos, greatest(0, got - source_size))))::BIGINT AS taken
FROM placed JOIN reach ON placed.source IS NOT DISTINCT FROM reach.source
"""
