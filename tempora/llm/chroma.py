"""Chroma audio fingerprints: packed integers of filtered pitch-class frames, aligned at every offset.

A recording (16-bit PCM WAV) becomes frames of twelve pitch classes.  Sixteen box filters over an integral image of the
frames compare regions of time and pitch; each gives two bits, and the sixteen a 32-bit integer for every frame.

A search looks up keys: sixteen bits of a frame and of those ``APART`` and twice that later, those that err least when a
recording begins between two frames of another: on which side of zero the filters are that do not compare times, and
how far those that compare the middle with the sides.  All recordings are indexed by every key, the queries ask for
each of theirs and for those that differ from it in one bit.  What agrees votes
for an offset; at every offset with ``VOTES`` (and beside it) the share of differing bits over the overlap decides.  This
is an index with a recall, not a proof: an alignment of which no two keys agree within a bit is missed (see the tests).
Recordings with the same fingerprint form a class; classes are searched and matched, never all pairs of their members.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Seconds of a frame and between frames, frames that a filter spans, pitch range, and what aligns.
WINDOW, HOP, SPAN, LOW, HIGH = 0.256, 0.05, 8, 60.0, 1900.0
MAX_ERROR, MIN_OVERLAP = 0.15, 16
#: The bits of a key (of every four filters, two of each: none, first, first, both), frames between the three of a key, and
#: votes that an offset needs.
KEY_BITS, APART, VOTES = 0x2B2B2B2B, 5, 2
#: Copies of each query's fingerprint, so that one with very many candidates is checked in as many tasks.
SALTS = 16


def pitch_classes(rate: int) -> tuple[int, np.ndarray]:
    """(samples of a frame, matrix from its spectrum to twelve pitch classes)."""
    n = int(WINDOW * rate)
    f = np.fft.rfftfreq(n, 1 / rate)
    m = np.zeros((len(f), 12), np.float32)
    ok = np.flatnonzero((f >= LOW) & (f <= HIGH))
    m[ok, np.round(12 * np.log2(f[ok] / 440.0)).astype(int) % 12] = 1
    return n, m


def filters() -> tuple[tuple[int, int, int, int], ...]:
    """(kind, first class, classes, frames): the bank of sixteen, by rule over kinds, places and sizes."""
    return tuple((i % 4, (5 * i) % 9, 3 + i % 2, (4, 8, 6, 8)[i % 4]) for i in range(16))


def samples(blob: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples); a blob that is no 16-bit PCM WAV has none."""
    try:
        with wave.open(io.BytesIO(blob)) as w:
            if w.getsampwidth() != 2:
                return 0, np.zeros(0, np.float32)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32)
            return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(axis=1)
    except (wave.Error, EOFError, ValueError):
        return 0, np.zeros(0, np.float32)


def chroma(rate: int, x: np.ndarray) -> np.ndarray:
    """Frames x 12, each of unit length (silence: zeros)."""
    if not rate:
        return np.zeros((0, 12), np.float32)
    n, classes = pitch_classes(rate)
    if len(x) < n:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, int(HOP * rate))]
    energy = np.abs(np.fft.rfft(frames * np.hanning(n).astype(np.float32), axis=1)) ** 2 @ classes
    norm = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, energy / np.maximum(norm, 1e-9), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has SPAN frames from it on."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([frames, frames], axis=1), axis=0), axis=1)  # classes are a circle
    at = np.arange(n)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, k, t in filters():
        if kind == 0:  # earlier against later
            a, b = box(0, t // 2, c, c + k), box(t // 2, t, c, c + k)
        elif kind == 1:  # lower against higher
            a, b = box(0, t, c, c + k), box(0, t, c + k, c + 2 * k)
        elif kind == 2:  # crosswise
            a = box(0, t // 2, c, c + k) + box(t // 2, t, c + k, c + 2 * k)
            b = box(0, t // 2, c + k, c + 2 * k) + box(t // 2, t, c, c + k)
        else:  # middle against sides
            a, b = box(0, t, c + 1, c + 1 + k), box(0, t, c, c + 1) + box(0, t, c + 1 + k, c + 2 + k)
        r = np.log((1 + a) / (1 + b))
        level = (r > -0.25).astype(np.uint32) + (r > 0) + (r > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbouring levels differ in a bit
    return out


def fingerprints(recordings: DataFrame, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """(id, fp array<long>): a row for each row; null, empty or unreadable audio has no integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = [fingerprint(chroma(*samples(b or b""))).astype(np.int64) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], ["id", "fp"])

    return recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, "id long, fp array<long>")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap, share of differing bits) with b's position = a's position + offset."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 1.0
    x = a[lo:hi].astype(np.uint32) ^ b[lo + offset : hi + offset].astype(np.uint32)
    return hi - lo, float(np.unpackbits(x.view(np.uint8)).sum() / (32 * (hi - lo)))


def classes(fps: DataFrame) -> DataFrame:
    """(class_id, fp): a row for each distinct fingerprint with integers; class_id is its least id."""
    return fps.filter(F.size("fp") > 0).groupBy("fp").agg(F.min("id").alias("class_id")).select("class_id", "fp")


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys, whether of a run of several): of the frames at which a run of equal keys begins or ends, so that
    a held tone has two."""
    n = len(fp) - 2 * APART
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    own = np.zeros(len(fp), np.int64)
    for bit in range(32):
        if KEY_BITS >> bit & 1:
            own = own << np.int64(1) | fp >> np.int64(bit) & np.int64(1)
    k = own[:n] << np.int64(32) | own[APART : n + APART] << np.int64(16) | own[2 * APART :]
    change = k[1:] != k[:-1]
    begins, ends = np.concatenate([[True], change]), np.concatenate([change, [True]])
    at = np.flatnonzero(begins | ends)
    return at, k[at], ~(begins & ends)[at]


def keys(reps: DataFrame, min_overlap: int, probes: bool) -> DataFrame:
    """(class_id, at, key) of the keys of each class; with ``probes`` also of those that differ in one bit.  ``at`` is
    twice the position, and one more if the key is of a run of several.

    Classes shorter than any overlap align with nothing, and a class of rows without ids only is no other of any.
    """
    flips = np.array([0, *[1 << i for i in range(48)]], np.int64) if probes else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids, at, found = [], [], []
                for c, fp in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    p, k, run_of = keys_of(fp.values.to_numpy())
                    ids.append(np.full(len(p) * len(flips), c))
                    at.append(np.repeat(2 * p + run_of, len(flips)))
                    found.append((k[:, None] ^ flips).ravel())
                cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, at, found)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["class_id", "at", "key"])

    return reps.filter((F.size("fp") >= min_overlap) & F.col("class_id").isNotNull()).select("class_id", "fp").mapInArrow(run, "class_id long, at int, key long")


def best_of(a: np.ndarray, b: np.ndarray, offsets: list[int], max_error: float, min_overlap: int) -> tuple[int, int, float] | None:
    """(offset, overlap, error) of the least error, then the longest overlap, then the nearest; None if none passes."""
    tried = [(e, -n, abs(o), o) for o in offsets for n, e in [bit_errors(a, b, o)] if n >= min_overlap and e <= max_error]
    if not tried:
        return None
    e, n, _, o = min(tried)
    return o, -n, e


def search(queries: DataFrame, reps: DataFrame, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(query, other, offset, overlap, error): the best alignment of query classes with the other classes that align
    (columns class_id, fp), of the offsets that have votes and those beside them."""
    asked = keys(queries, min_overlap, True).select(F.col("class_id").alias("query"), F.col("at").alias("q_at"), "key")
    index = keys(reps, min_overlap, False).select(F.col("class_id").alias("other"), F.col("at").alias("o_at"), "key")
    hits = asked.join(index, "key").filter("query <> other")
    offset = F.shiftright("o_at", 1) - F.shiftright("q_at", 1)
    weight = F.when(F.col("o_at").bitwiseAND(F.col("q_at")).bitwiseAND(F.lit(1)) == 1, VOTES).otherwise(1)  # runs have frames enough
    votes = hits.groupBy("query", "other", offset.alias("offset")).agg(F.sum(weight).alias("n")).filter(F.col("n") >= VOTES)
    pairs = votes.groupBy("query", "other").agg(F.collect_list("offset").alias("offsets"))  # at most one a frame
    salted = queries.select(F.col("class_id").alias("query"), F.col("fp").alias("q_fp"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int")).join(salted, ["query", "salt"])
    pairs = pairs.join(reps.select(F.col("class_id").alias("other"), F.col("fp").alias("o_fp")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, o, offsets, x, y in zip(*(batch.column(c) for c in range(5)), strict=True):
                near = sorted({int(v) + d for v in offsets.values.to_numpy() for d in (-1, 0, 1)})
                if best := best_of(x.values.to_numpy(), y.values.to_numpy(), near, max_error, min_overlap):
                    rows.append((q.as_py(), o.as_py(), *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["query", "other", "offset", "overlap", "error"])

    return pairs.select("query", "other", "offsets", "q_fp", "o_fp").mapInArrow(run, "query long, other long, offset int, overlap int, error double")


def identify(recordings: DataFrame, id_col: str = "id", audio_col: str = "audio", every: int = 50) -> DataFrame:
    """(id, n_ints, class_id, is_query, n_links, best_class, best_offset, best_error): a row for each recording.

    Queries are the rows whose id is divisible by ``every``; n_links counts the other classes that their class aligns
    with, best_* is the alignment of the least error (then the least class).  A recording without integers (null, empty,
    unreadable or too short) is in no class and has no links; a null id is no query.  Repeated rows share their class, an
    empty table gives an empty one, and no other column is read.  Whole recordings are compared, however long.
    """
    fps = materialize(fingerprints(recordings, id_col, audio_col), "fingerprints")
    reps = materialize(classes(fps), "classes")
    known = fps.select("id", "fp", (F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("is_query")).join(reps, "fp", "left").select("id", F.size("fp").alias("n_ints"), "class_id", "is_query")
    known = materialize(known, "members")
    asked = reps.join(known.filter("is_query").select("class_id").distinct(), "class_id", "left_semi")
    found = search(asked, reps)
    best = found.groupBy("query").agg(F.count("*").alias("n_links"), F.min(F.struct("error", "other", "offset")).alias("b"))
    best = best.select(F.col("query").alias("class_id"), "n_links", F.col("b.other").alias("best_class"), F.col("b.offset").alias("best_offset"), F.round("b.error", 6).alias("best_error"))
    out = known.filter("is_query").join(best, "class_id", "left").select("id", "n_ints", "class_id", "is_query", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best_class", "best_offset", "best_error")
    rest = known.filter("not is_query").select("id", "n_ints", "class_id", "is_query", *[F.lit(None).cast(t).alias(c) for c, t in (("n_links", "long"), ("best_class", "long"), ("best_offset", "int"), ("best_error", "double"))])
    return out.unionByName(rest)


def render(values: np.ndarray, rate: int = 4000, note: float = 0.1) -> bytes:
    """A WAV of one note a value: there is no audio among the tables, so the query plays the vectors."""
    out = io.BytesIO()
    pitch = np.round(np.clip(np.nan_to_num(np.asarray(values, np.float64)), -1, 1) * 48)
    t = np.arange(int(note * rate)) / rate
    x = np.sin(2 * np.pi * 300.0 * 2 ** (pitch[:, None] / 12) * t) * np.hanning(len(t)) * 12000
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes(x.astype("<i2").tobytes())
    return out.getvalue()


def covered(own: np.ndarray, vec_id: int) -> bytes:
    """A part of what the notes ``own`` sound like, as a recording has it: begun between two frames, and with noise."""
    rng = np.random.default_rng(abs(vec_id))
    first = int(rng.integers(0, max(1, len(own) // 4)))
    notes = own[first : first + max(1, 3 * len(own) // 4)]
    blob = render(notes)
    x = np.frombuffer(blob[44:], "<i2")[int(rng.integers(0, 200)) :]
    x = np.clip(x + rng.normal(0, rng.uniform(0, 600), len(x)), -32000, 32000).astype("<i2").tobytes()
    return blob[:40] + np.uint32(len(x)).tobytes() + x


def rendered(vectors: DataFrame) -> DataFrame:
    """(id, audio): each vector is played.  Recordings must share material to be found, so a row with vec_id % 5 = 1 is a
    noisy excerpt of the row at the last full fifty before it, where there is one."""
    excerpt = F.coalesce(F.pmod(F.col("vec_id"), F.lit(5)) == 1, F.lit(False))
    wholes = vectors.filter("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("whole")).agg(F.min("embedding").alias("source"))
    parts = vectors.filter(excerpt).select("vec_id", "embedding", (F.col("vec_id") - F.pmod(F.col("vec_id"), F.lit(50))).alias("whole"))
    rows = vectors.filter(~excerpt).select("vec_id", "embedding", F.lit(None).cast(vectors.schema["embedding"].dataType).alias("source"))
    rows = rows.unionByName(parts.join(wholes, "whole", "left").select("vec_id", "embedding", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = lambda v: np.array([0.0 if x is None else x for x in v])
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                audio = []
                for d, v, source in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    audio.append(covered(values(source), d) if source is not None else None if v is None else render(values(v)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], ["id", "audio"])

    return rows.mapInArrow(run, "id long, audio binary")


def op6_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """There is no audio among the tables: the vectors of ``embeddings`` are played, see ``rendered``."""
    return identify(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("id", "vec_id")
