"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring.

Fingerprints are cut into a ring of M segments.  Two within TAU bits agree, from some segment on, in every chain of l
consecutive segments up to l * TAU / M differing bits; so they agree in full on the first CHAIN segments, which is the
candidate key, and the longer chains prune a candidate pair before the full distance is taken.

Buckets with more than ``BUCKET`` distinct fingerprints (groups of near copies) give no pairs.  There the full check
goes through the one-bit neighbourhood: two fingerprints are within two bits exactly if they share one of the 65
values that differ from each in at most one bit, and no such value has more than 65 fingerprints around it.

Near copies at a Jaccard similarity of 0.8 differ in about ten of 64 bits, where every key of pigeonring is a few bits
long and prunes nothing.  With ``similarity`` set, ``similar_links`` adds those links by exact prefix filtering of the
same shingles, verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import ceil
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free, mark, materialize, null_safe_join, slices
from .graph import components

TAU, M, SHINGLE, BUCKET = 2, 7, 3, 32
#: Of ``keep_one``: words a shingle and the least Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: Shingles known as frequent, at most: what tasks are sent is bounded by 8 bytes each.
FREQUENT = 1 << 16
#: Buckets of a shingle in which all pairs are judged; bits of the parities of a set, at least.
GROUP, PARITY = 4, 256
EPS = 1e-9
#: The longest chain whose budget is below one bit.
CHAIN = (M - 1) // TAU
EDGES = [64 * i // M for i in range(M + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_mask(start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments on the ring, from segment ``start`` on."""
    bits = 0
    for k in range(start, start + length):
        lo, hi = EDGES[k % M], EDGES[k % M + 1]
        bits |= ((1 << hi - lo) - 1) << lo
    return signed(bits)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; none for a text without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and the ASCII blanks only
    if not words:
        return np.empty(0, "<u8")
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.dtype("<u8"), n)


def majority(h: np.ndarray) -> int:
    """The 64 bits set in more than half of the hashes; zero for none."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the shingles' hashes; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): the text's key and the signed 64-bit fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    return rows.mapInArrow(run, "doc_id long, key string, fp long")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``nodes.fp``; their components are those of all links.

    In buckets of at most ``bucket`` members every link is an edge; in larger ones each fingerprint is linked to the
    least around every shared one-bit neighbour.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(ring_mask(i, CHAIN))).alias("key")) for i in range(M)])
    rows = nodes.select("fp", F.inline(keys))
    shared = rows.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = materialize(rows.join(shared, ["i", "key"]), "candidates")

    few = rows.filter(F.col("n") <= bucket)
    pairs = few.select("i", "key", F.col("fp").alias("a")).join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"]).filter("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    for i in range(M):
        for length in range(CHAIN + 1, M):
            pairs = pairs.filter((F.col("i") != i) | (F.bit_count(differ.bitwiseAND(F.lit(ring_mask(i, length)))) <= length * TAU // M))
    pairs = pairs.filter(F.bit_count(differ) <= TAU).select("a", "b")

    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    many = rows.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(near).alias("near"))
    around = many.groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def frequent(texts: DataFrame, shingle: int, limit: int = FREQUENT) -> np.ndarray:
    """At most ``limit`` of the most frequent shingles, the most frequent first, by what repeats within Arrow slices.

    They only set the order in which shingles are taken, so links do not depend on them; the cost does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 2].view(np.int64)), pa.array(n[n > 2])], ["h", "n"])

    counts = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(limit).select("h").collect()
    return np.array([r.h for r in top], np.int64).view("<u8")


def prefixes(texts: DataFrame, shingle: int, similarity: float, often: np.ndarray) -> DataFrame:
    """(k, fp, n, rare, prefix, parity, wide) of each distinct text with words: its hash, fingerprint, number of distinct
    shingles, those not frequent, the first of them in one order of all (rare ones by hash, then from less to more
    frequent), and whether odd or even numbers of them fall on each of ``PARITY`` places, as bits; ``wide`` has them for as
    many places as the next power of two from ``n``, where that is more.

    Two sets of that similarity or more share a shingle of both prefixes.
    """
    order = np.argsort(often)
    known, rank = often[order], (len(often) - order).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            out = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist(), strict=True):
                h = shingle_hashes(t, shingle)
                if not len(h):
                    continue
                fp, h = majority(h), np.unique(h)
                place = (h >> np.uint64(2)).astype(np.int64)  # below 2**62
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    place = np.where(known[at] == h, (1 << 62) + rank[at], place)
                place = np.unique(place)
                n = len(place)
                places = max(PARITY, 1 << (n - 1).bit_length())
                wide = np.packbits((np.bincount(place % places, minlength=places) & 1).astype(np.uint8)).view(np.int64)
                odd = np.bitwise_xor.reduce(wide.reshape(-1, PARITY // 64), axis=0)
                out.append((k, fp, n, int((place < 1 << 62).sum()), place[: n - ceil(similarity * n - EPS) + 1], odd, wide if places > PARITY else None))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "fp", "n", "rare", "prefix", "parity", "wide"])

    found = texts.select("text", "k").mapInArrow(run, "k long, fp long, n long, rare long, prefix array<long>, parity array<long>, wide array<long>")
    return found.dropDuplicates(["k", "fp"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Of the pairs (a, b, least) of text hashes those of a similarity ``s`` of ``least`` or more, with fingerprints fa, fb.

    Where both prefixes reach, a shingle of one that is not in the other's is in no shingle of the other; pairs that
    this leaves too little to share go first.  The others are judged on the whole texts.
    """
    pre = nodes.select("k", "n", "prefix")
    both = pairs.join(pre.toDF("a", "na", "pa"), "a").join(pre.toDF("b", "nb", "pb"), "b")
    end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    both = both.withColumn("end", end).withColumn("need", (F.col("na") + F.col("nb")) * (F.col("least") / (1 + F.col("least"))) - EPS)
    both = both.filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.col("least") - EPS)
    for one, other in (("a", "b"), ("b", "a")):
        alone = F.size(F.array_except(F.filter(f"p{one}", lambda x: x <= F.col("end")), f"p{other}"))
        both = both.filter(F.col(f"n{one}") - alone >= F.col("need"))
    left = materialize(both.select("a", "b", "least").distinct(), "pairs")
    wanted = left.select(F.col("a").alias("k")).unionByName(left.select(F.col("b").alias("k"))).distinct()
    whole = materialize(texts.join(wanted, "k", "left_semi").dropDuplicates(["k", "text"]), "texts")
    whole = whole.select("k", "text")
    judged = left.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b").select("a", "b", "ta", "tb", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = []
            a, b, least = (batch.column(i).to_pylist() for i in (0, 1, 4))
            ta, tb = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            for x, y, s, t, limit in zip(a, b, ta, tb, least, strict=True):
                hs, ht = shingle_hashes(s, shingle), shingle_hashes(t, shingle)
                us, ut = np.unique(hs), np.unique(ht)
                shared = len(np.intersect1d(us, ut, assume_unique=True))
                every = len(us) + len(ut) - shared
                if shared >= limit * every - EPS:
                    out.append((x, y, majority(hs), majority(ht), shared / every))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "fa", "fb", "s"])

    return judged.mapInArrow(run, "a long, b long, fa long, fb long, s double")


def unlike_buckets(rows: DataFrame) -> DataFrame:
    """(h, k, at, size) of the buckets of ``rows`` (h, k, at) with several members that are not among those of another bucket.

    A pair that is linked passes the filters of ``met`` in each bucket that it shares, so that one of them is enough.  Near
    copies share a fifth of their shingles, and with them hundreds of buckets.  Of buckets with the same members (by
    number and 128 bits) one stays; then those go of which all members have the same largest bucket.
    """
    low, high = F.sum(F.col("k").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright("k", 32))
    members = rows.groupBy("h").agg(F.count("*").alias("size"), low.alias("low"), high.alias("high"), F.bit_xor(F.xxhash64("k")).alias("all"))
    kept = members.filter("size > 1").groupBy("size", "low", "high", "all").agg(F.min("h").alias("h")).select("h", "size")
    rows = materialize(rows.join(kept, "h").select("h", "k", "at", "size"), "postings")
    largest = rows.groupBy("k").agg(F.max(F.struct("size", "h"))["h"].alias("of"))
    inside = rows.select("h", "k").join(largest, "k").groupBy("h").agg(F.min("of").alias("a"), F.max("of").alias("b")).filter("a = b and a <> h")
    return rows.join(inside.select("h"), "h", "left_anti")


def similar_links(texts: DataFrame, shingle: int, similarity: float, bucket: int = GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints of texts (columns text, k) whose sets of shingles are that similar; their
    components are those of all such links.

    Texts meet in buckets, one a shingle of their prefixes (see ``unlike_buckets``).  In buckets of at most ``bucket`` members each pair is judged.
    In larger ones pivots are judged against all members: first the member with the fewest rare shingles (a group's
    original has none of its own), then ever more of those that no pivot is linked to, until none is left.  So a
    group of copies costs a few checks a member, and members that are linked to no pivot are judged against all.  What
    is left are pairs of members of which each is linked to a pivot, to different ones: see ``crossing``.
    """
    nodes = materialize(prefixes(texts, shingle, similarity, frequent(texts.select("text"), shingle)), "prefixes")
    parts = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY // 64)]
    rows = unlike_buckets(nodes.select("k", F.posexplode("prefix").alias("at", "h")))
    of = nodes.select("k", "n", "rare", *parts, "wide")  # wide rows: not before few postings are left
    rows = materialize(rows.join(of, "k").select("h", "k", F.struct(*of.columns[1:], "at").alias("of"), "size"), "members")

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return materialize(verified(pairs.withColumn("least", F.lit(similarity)), nodes, texts, shingle), "linked")

    few = rows.filter(F.col("size") <= bucket)
    found = [judged(met(few, few, ["h"], similarity).filter("a < b"))]
    many = rows.filter(F.col("size") > bucket).select("h", "k", "of")
    still, count = materialize(many, "open"), 0
    done, near = [], []
    while not still.isEmpty():
        of = still.groupBy("h").agg(F.count("*").alias("left"), F.min(F.struct("of.rare", "k"))["k"].alias("least"))
        drawn = F.pmod(F.xxhash64("k", "h", F.lit(count)), F.col("left")) < count
        pivots = still.join(of, "h").filter((F.col("k") == F.col("least")) | drawn).select("h", "k", "of")
        pairs = materialize(met(pivots, many, ["h"], similarity).select("h", "a", "b"), "met")
        found.append(judged(pairs))
        links_ = found[-1].select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("s")).alias("far"))
        linked = pairs.join(links_, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")))
        near.append(materialize(linked.select("h", F.col("b").alias("k"), F.col("a").alias("pivot"), "far"), "near"))
        done.append(materialize(pivots.select("h", "k"), "pivots"))
        still = materialize(still.join(near[-1].select("h", "k").unionByName(done[-1]).distinct(), ["h", "k"], "left_anti"), "open")
        count = max(8, 8 * count)
    if near:
        pivots, near = (reduce(DataFrame.unionByName, x) for x in (done, near))
        linked = reduce(DataFrame.unionByName, found)
        left = crossing(near, pivots, many, linked, nodes, texts, shingle, similarity)
        if left is not None:
            found.append(judged(left))
    return reduce(DataFrame.unionByName, found).select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter("a <> b").distinct()


def met(one: DataFrame, other: DataFrame, on: list[str], similarity: float) -> DataFrame:
    """Pairs (a, b) of (h, k, of) in one bucket that size, place and parities leave able to be that similar: places of which
    one set has an odd number and the other an even one are no more than the shingles that only one of them has.  Sets of
    many shingles have one on most of few places, so that theirs are told apart by ``wide``; of twice as many
    places the halves are added up."""
    x = one.withColumnsRenamed({"k": "a", "of": "x"})
    y = other.withColumnsRenamed({"k": "b", "of": "y"})
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # what can be shared from here on
    need = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - EPS
    sizes = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - EPS
    bits = [c for c in one.schema["of"].dataType.names if c.startswith("p")]
    apart = reduce(add, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in bits], F.lit(0))
    most = (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + EPS
    alike = apart <= most
    if "wide" in one.schema["of"].dataType.names:
        size = F.least(F.size("x.wide"), F.size("y.wide"))
        half = lambda w: F.when(F.size(w) == size, F.col(w)).otherwise(F.zip_with(F.slice(w, F.lit(1), size), F.slice(w, size + 1, size), lambda p, q: p.bitwiseXOR(q)))
        differ = F.aggregate(F.zip_with(half("x.wide"), half("y.wide"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), add)
        alike &= F.col("x.wide").isNull() | F.col("y.wide").isNull() | (differ <= most)
    return x.join(y, on).filter((F.col("a") != F.col("b")) & sizes & (left + F.least("x.at", "y.at") >= need) & alike)


def crossing(near: DataFrame, pivots: DataFrame, many: DataFrame, linked: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """Pairs (a, b) of one bucket's members of which neither was a pivot, and that may be linked: their pivots are in
    different components of ``linked``, and near enough.

    One minus the Jaccard similarity is a metric, so a pair that is linked has pivots no farther from each other than
    its own distance and those of both members to their pivots.  ``near`` has (h, k, pivot, far).
    """
    members = near.groupBy("h", "k").agg(F.min(F.struct("far", "pivot")).alias("m")).select("h", "k", "m.pivot", "m.far")
    members = materialize(members.join(pivots, ["h", "k"], "left_anti").join(many, ["h", "k"]), "members")
    leaders = members.groupBy("h", "pivot").agg(F.max("far").alias("far"))
    several = leaders.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    leaders = materialize(leaders.join(several, "h"), "leaders")
    if leaders.isEmpty():
        return None
    comp = components(linked.select("a", "b"))
    leaders = leaders.join(comp.select(F.col("node").alias("pivot"), F.col("component").alias("c")), "pivot")
    one, other = leaders.toDF("p", "h", "fp", "cp"), leaders.toDF("q", "h", "fq", "cq")
    both = one.join(other, "h").filter("p < q and cp <> cq").groupBy("p", "q").agg(F.max(F.col("fp") + F.col("fq")).alias("far"))
    both = both.select(F.col("p").alias("a"), F.col("q").alias("b"), (similarity - F.col("far") - EPS).alias("least"))
    close = verified(both, nodes, texts, shingle).select(F.col("a").alias("p"), F.col("b").alias("q"), (1 - F.col("s")).alias("d"))
    one = members.withColumnsRenamed({"pivot": "p", "far": "fp"}).join(materialize(close, "close"), "p")
    other = members.withColumnsRenamed({"pivot": "q", "far": "fq"})
    return met(one, other, ["h", "q"], similarity).filter(F.col("fp") + F.col("fq") + (1 - similarity) >= F.col("d") - 2 * EPS).select("a", "b")


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET, similarity: float | None = None
) -> DataFrame:
    """(doc_id, key, fp, component, component_id): component is the least fingerprint reachable over links."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = links(nodes, bucket)
    if similarity is not None:
        texts = docs.select(F.col(text_col).alias("text")).filter("text is not null").withColumn("k", F.xxhash64("text"))
        edges = edges.unionByName(similar_links(texts, shingle, similarity, min(bucket, GROUP)))
    comp = components(edges).select(F.col("node").alias("fp"), "component")
    named = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return fps.join(named, "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET, similarity: float | None = None
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, its own included.

    Links are fingerprints within two bits and, if ``similarity`` is set, texts whose sets of shingles have that Jaccard
    similarity or more.  A null text has no words; texts without words share fingerprint zero and are linked like any
    others.  Rows that repeat are linked to each other.  A null doc_id never is a component_id unless its whole
    component has none.
    """
    return grouped(docs, id_col, text_col, shingle, bucket, similarity).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float | None = SIMILARITY) -> DataFrame:
    """One document of each group: that with the smallest id (null last), then the smallest key of its text.  Columns as
    in ``docs``.

    Rows of different groups stay also where they share an id or have none.
    """
    begun = mark()
    found = grouped(docs, id_col, text_col, shingle, similarity=similarity)
    members = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    kept = members.select(F.col("m.doc_id").alias("id"), F.col("m.key").alias("key"))  # equal texts are of one group
    copies = found.groupBy(F.col("doc_id").alias("id"), "key").agg(F.count("*").alias("copies"))
    kept = materialize(null_safe_join(kept, copies, ["id", "key"]), "kept")
    drop_written(docs.sparkSession, begun, kept)
    free(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of theirs clashes
    rows = rows.select("row", F.col("row")[id_col].cast("long").alias("id"), text_key(F.col("row")[text_col]).alias("key"))
    rows = null_safe_join(rows, kept, ["id", "key"])
    again = rows.filter("copies > 1").dropDuplicates(["id", "key"])  # only rows that repeat are dealt a second time
    return rows.filter("copies = 1").unionByName(again).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
