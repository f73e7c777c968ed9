"""Language identification as inference of a mixture of languages.

Each language has a distribution over hashed byte n-grams, learned from labelled documents.  A document's n-grams come
from a mixture of languages; expectation-maximisation estimates its proportions, and the set of languages is the one of
the best penalised likelihood (half a logarithm of the document's size for each further language) on the way from all
languages down to one.

A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was learned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

N, BITS = 3, 15
BUCKETS = 1 << BITS
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = WORDLIKE.search(text)
    return bool(m) and (m[0].isalpha() or any(map(str.isalpha, text)))


def gram_counts(raw: bytes) -> np.ndarray:
    """Counts of the text's byte trigrams (a blank added at both ends) by bucket."""
    a = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    ids = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    return np.bincount(ids, minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    probs: np.ndarray  # buckets x languages

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        out, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t.decode("utf-8", "replace"))]
        if known:
            units, counts, sizes = [], [], []
            for i in known:
                c = gram_counts(texts[i])
                u = np.flatnonzero(c)
                units.append(u)
                counts.append(c[u])
                sizes.append(len(u))
            best, share = self.infer(np.concatenate(units), np.concatenate(counts).astype(np.float32), np.array(sizes))
            for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                out[i], scores[i] = self.languages[b], min(1.0, max(0.0, s))
        return out, scores

    def infer(self, units: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language with the largest share, and that share, of documents given as runs of (n-gram, count).

        Sets of languages are tried from all of them down to one: after each estimate the least language goes (and all
        below ``SLIGHT`` at once).  The set of the best penalised likelihood counts, of equal ones the smaller.
        """
        p = self.probs[units]
        p /= p.max(axis=1, keepdims=True)  # relative likelihoods: the same for every set of languages
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # n-grams overlap, so that each counts for an N-th of an independent draw
        price = 0.5 * np.log(np.maximum(np.add.reduceat(counts, starts) / N, 2.0))
        start = np.full((len(sizes), len(self.languages)), 1 / len(self.languages), np.float32)
        best, share = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.float32)
        score = np.full(len(sizes), -np.inf)
        live = np.arange(len(sizes))
        while len(live):
            rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in live]) if len(live) < len(sizes) else slice(None)
            pi, ll = mixture(p[rows], counts[rows], sizes[live], start[live])
            used = (start[live] > 0).sum(axis=1)
            penalised = ll / N - price[live] * (used - 1)
            better = penalised >= score[live]
            score[live[better]] = penalised[better]
            best[live[better]], share[live[better]] = pi[better].argmax(axis=1), pi[better].max(axis=1)
            # the next smaller set, if there is one
            left = np.where(start[live] > 0, pi, np.inf)
            rest = pi * (left > np.maximum(left.min(axis=1, keepdims=True), SLIGHT))
            none = (rest > 0).sum(axis=1) == 0
            rest[none] = np.eye(len(self.languages))[pi[none].argmax(axis=1)]  # only ties or slight ones were left
            rest = rest / rest.sum(axis=1, keepdims=True)
            start[live] = rest
            live = live[used > 1]
        return best, share


#: A share that leaves a set at once; change of a share below which an estimate has converged; rounds at most.
SLIGHT, CONVERGED, ROUNDS = 0.005, 1e-3, 200


def mixture(p: np.ndarray, counts: np.ndarray, sizes: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation from ``pi`` on (a language of share zero stays out), and their
    log-likelihood.  Documents whose shares stand still are done; the others go on."""
    pi, ll = pi.astype(np.float32), np.zeros(len(sizes))
    live, own_sizes, own_p, own_counts = np.arange(len(sizes)), sizes, p, counts
    for k in range(ROUNDS):
        starts = np.concatenate([[0], np.cumsum(own_sizes)[:-1]])
        joint = own_p * np.repeat(pi[live], own_sizes, axis=0)
        of = np.maximum(joint.sum(axis=1), 1e-30)
        ll[live] = np.add.reduceat(own_counts * np.log(of), starts)
        joint *= (own_counts / of)[:, None]
        new = np.add.reduceat(joint, starts, axis=0) / np.add.reduceat(own_counts, starts)[:, None]
        moves = np.abs(new - pi[live]).max(axis=1) >= CONVERGED
        pi[live] = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            keep = np.repeat(moves, own_sizes)
            live, own_sizes, own_p, own_counts = live[moves], own_sizes[moves], own_p[keep], own_counts[keep]
    return pi, ll


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500) -> Model:
    """Learn from labelled rows outside the held-out fold: about ``per_language`` of each language (by a hash of the
    id), their whole texts.  Counts are taken on the executors; the driver gets a count a language and bucket."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    cut = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_language / n) * 1_000_000))])
    rows = rows.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < cut[F.col("lang")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0):
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, c in sums.items():
            u = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u, pa.int32()), pa.array(c[u], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), 0.1)
    for r in counted.toLocalIterator():
        counts[r.bucket, languages.index(r.lang)] += r.n
    return Model(languages, (counts / counts.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of that language): a row for each row, from its text alone.

    A null or empty text and one without a letter is ``und`` with score 0.  Of languages with equal shares the first by
    name counts.  Rows that repeat get equal results, an empty table gives an empty one, and no other column is read.
    Whole texts count, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            lang, score = model.predict(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_share: float = 0.4) -> DataFrame:
    """The rows whose text has one language that makes up ``least_share`` at least.  Columns as in ``docs``.

    Null and empty texts and those without a letter go.  Rows that repeat stay or go together.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 4 << 20):
            lang, score = model.predict(batch.column(at).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least_share for x, s in zip(lang, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op4_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
