"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of the rows of its hash and of the hashes of its first four, five and six letters in one
table of fixed size, so that inflected forms share what was learned.  Filters of width one, two and three run over all
words of a text; the maximum over the text of each filter feeds a rectifier and a logistic unit.  All weights start at
random and are trained by minibatches with Adagrad and word dropout.  For each language (told from the words, by what was
learned from labelled rows) the threshold is calibrated on rows kept out of the training, and moved to the score ``AT``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

#: Marks cut off both ends of a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDTHS, FILTERS, DIM, PREFIXES, AT = (1, 2, 3), 6, 8, (4, 5, 6), 0.7
#: Rows of the embedding table, and of that of the languages; row 0 stands for no word.
BITS, LANGUAGE_BITS = 17, 15
PAD = max(WIDTHS) - 1


def features(word: bytes) -> tuple[int, ...]:
    """Rows of a bare word and of its beginnings (in code points)."""
    w = word.strip(MARKS)
    if not w:
        return ()
    s = w.decode("utf-8", "replace")
    named = (w, *[b"%d:" % n + s[:n].encode() for n in PREFIXES if len(s) > n])
    return tuple(1 + (zlib.crc32(x) * 2654435761 % (1 << 32) >> (32 - BITS)) for x in named)


WIDE = 1 + len(PREFIXES)


def padded(word: bytes) -> tuple[int, ...]:
    f = features(word)
    return f + (0,) * (WIDE - len(f))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts one after the other, where each begins), PAD zeros on both sides of each."""
    n = [len(t) + 2 * PAD for t in texts]
    starts = np.cumsum([0, *n[:-1]])
    ids = np.zeros(sum(n) + PAD, np.int64)
    for t, at in zip(texts, starts.tolist(), strict=True):
        ids[at + PAD : at + PAD + len(t)] = t
    return ids, starts


def convolved(parts: np.ndarray, n: int) -> np.ndarray:
    """Each filter at each of the first ``n`` places, from each word's product with each place of each filter."""
    out, block = [], 0
    for width in WIDTHS:
        z = parts[:n, block : block + FILTERS].copy()
        for j in range(1, width):
            z += parts[j : n + j, block + j * FILTERS : block + (j + 1) * FILTERS]
        out.append(z)
        block += width * FILTERS
    return np.concatenate(out, axis=1)


class _Table(dict):
    """From a word to the row of its products; starts anew when full, so that its size is bounded."""

    def __init__(self, parts: np.ndarray, languages: np.ndarray, limit: int = 300_000) -> None:
        self.parts, self.languages, self.limit = parts, languages, limit
        self.rows = np.zeros((limit + 1, parts.shape[1] + languages.shape[1]), np.float32)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Rows for all words of the texts, of which there are fewer than the limit."""
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = set().union(*texts)
        if not new:
            return
        words = sorted(new)
        of = np.array([padded(w) for w in words])
        at = np.arange(len(self) + 1, len(self) + 1 + len(words))
        width = self.parts.shape[1]
        got = self.parts[of[:, 0]]
        for k in range(1, WIDE):
            some = np.flatnonzero(of[:, k])
            got[some] += self.parts[of[some, k]]
        self.rows[at, :width] = got
        self.rows[at, width:] = np.where(of[:, :1] > 0, self.languages[of[:, 0] % len(self.languages)], 0)
        self.update(zip(words, at.tolist(), strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    emb: np.ndarray  # rows x DIM
    filters: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: np.ndarray  # of each filter
    out: np.ndarray
    out_bias: float
    languages: np.ndarray  # rows x languages: log-likelihoods
    thresholds: list[float] = field(default_factory=list)  # of each language; the last for texts without a known word

    def __post_init__(self) -> None:
        self.table: _Table | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def pooled(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(greatest of each filter, sums of the languages) of texts of 65,536 words in all, or of one text; a text with
        more words is taken in stretches, which overlap."""
        rows = self.table.rows
        if len(texts) == 1 and len(texts[0]) > 1 << 16:
            step = 1 << 16
            parts = [self.pooled([texts[0][max(0, i - PAD) : i + step]]) for i in range(0, len(texts[0]), step)]
            return np.max([p for p, _ in parts], axis=0), np.sum([q for _, q in parts], axis=0)
        self.table.learn(texts)
        ids, starts = laid_out([self.table.numbers(w) for w in texts])
        got = rows[ids]
        n, width = len(ids) - PAD, self.table.parts.shape[1]
        return np.maximum.reduceat(convolved(got, n), starts, axis=0), np.add.reduceat(got[:n, width:], starts, axis=0)

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language) of each text; the language is -1 if no word is known."""
        if self.table is None:
            parts = np.concatenate([self.emb @ f[j] for f in self.filters for j in range(len(f))], axis=1)
            self.table = _Table(parts.astype(np.float32), self.languages)
        tops, sums, held, size = [], [], [], 0
        for t in texts:
            words = t.lower().split() if t else []
            if held and size + len(words) > 1 << 16:
                for out, x in zip((tops, sums), self.pooled(held), strict=True):
                    out.append(x)
                held, size = [], 0
            held.append(words)
            size += len(words)
        if held:
            for out, x in zip((tops, sums), self.pooled(held), strict=True):
                out.append(x)
        if not tops:
            return np.zeros(0), np.zeros(0, int)
        lang = np.concatenate(sums)
        lang = np.where(np.abs(lang).sum(axis=1) > 0, lang.argmax(axis=1) if lang.shape[1] else -1, -1)
        return np.maximum(np.concatenate(tops) + self.bias, 0) @ self.out + self.out_bias, lang

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """From 0 to 1; ``AT`` is each language's threshold."""
        logit, lang = self.logits(texts)
        moved = logit - np.array(self.thresholds)[lang] + math.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(moved, -30, 30)))


def gradients(weights: list[np.ndarray], of: np.ndarray, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
    """(weighted loss, gradients of the filters, bias, out and out_bias, rows of the table, their gradients) of a batch.

    ``weights``: the table, the filters, bias, out, out_bias; ``of``: the features of each word number.
    """
    emb, *filters, bias, out, out_bias = weights
    u, inverse = np.unique(ids, return_inverse=True)
    x = emb[of[u]].sum(axis=1)[inverse]
    n, size = len(ids) - PAD, len(starts)
    z = convolved(np.concatenate([x @ f[j] for f in filters for j in range(len(f))], axis=1), n)
    top = np.maximum.reduceat(z, starts, axis=0)
    doc = np.repeat(np.arange(size), np.diff(np.append(starts, n)))
    at = np.minimum.reduceat(np.where(z == top[doc], np.arange(n)[:, None], n), starts, axis=0)
    hidden = np.maximum(top + bias, 0)
    logit = np.clip(hidden @ out + out_bias[0], -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean())
    g = weight * (p - y) / size
    d = g[:, None] * out * (hidden > 0)
    of_filters, places, moved = [], [], []
    for k, f in enumerate(filters):
        own, dk = at[:, k * FILTERS : (k + 1) * FILTERS], d[:, k * FILTERS : (k + 1) * FILTERS]
        of_filters.append(np.stack([np.einsum("bfd,bf->df", x[own + j], dk) for j in range(len(f))]))
        for j in range(len(f)):
            places.append((own + j).ravel())
            moved.append((dk[:, :, None] * f[j].T).reshape(-1, DIM))
    words, gx = ids[np.concatenate(places)], np.concatenate(moved)
    rows, gx = of[words].ravel(), np.repeat(gx, WIDE, axis=0)
    real = (rows > 0) & (np.abs(gx).sum(axis=1) > 0)
    rows, where = np.unique(rows[real], return_inverse=True)
    of_rows = np.zeros((len(rows), DIM))
    np.add.at(of_rows, where, gx[real])
    return loss, [*of_filters, d.sum(axis=0), hidden.T @ g, np.array([g.sum()])], rows, of_rows


def start(seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.03, (1 + (1 << BITS), DIM))
    emb[0] = 0
    h = len(WIDTHS) * FILTERS
    return [emb, *[rng.normal(0, 0.5 / math.sqrt(DIM * w), (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(h), rng.normal(0, 0.3, h), np.array([-1.0])]


def fit(texts: list[bytes], toxic: np.ndarray, lang: list[str | None], epochs: int = 10, batch: int = 32, rate: float = 0.1, drop: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Model:
    """Train on whole texts.  A quarter, by position in the shuffled sample, only calibrates if it is large enough.

    Either label weighs as much as the other.  The step size falls linearly to a tenth.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y, lang = toxic[order].astype(np.float64), [lang[i] for i in order]
    number: dict[bytes, int] = {b"": 0}
    numbered = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in (texts[i].lower().split() for i in order)]
    of = np.array([padded(w) for w in number])
    held = np.arange(len(y)) % 4 == 0
    if min(y[held].sum(), (1 - y[held]).sum()) < 40:
        held[:] = False
    names = sorted({x for x in lang if x is not None})
    counts = np.full((1 << LANGUAGE_BITS, len(names)), 0.1)
    for ids, x, h in zip(numbered, lang, held, strict=True):
        if x is not None and not h:
            first = of[ids, 0]
            np.add.at(counts[:, names.index(x)], first[first > 0] % len(counts), 1)
    weights = start(seed)
    share = min(0.99, max(0.01, y[~held].mean()))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    row_sums, sums = np.full(len(weights[0]), 1e-2), [np.full_like(w, 1e-2) for w in weights[1:]]
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = 1 - 0.9 * epoch / epochs
        shuffled = rng.permutation(own)
        for i in range(0, len(shuffled), batch):
            some = shuffled[i : i + batch]
            ids, starts = laid_out([numbered[k] for k in some])
            ids[rng.random(len(ids)) < drop] = 0
            _, g, rows, of_rows = gradients(weights, of, ids, starts, y[some], weight[some])
            of_rows += decay * weights[0][rows]
            row_sums[rows] += (of_rows**2).mean(axis=1)
            weights[0][rows] -= rate * step * of_rows / np.sqrt(row_sums[rows])[:, None]
            for w, total, gr in zip(weights[1:], sums, g, strict=True):
                gr = gr + decay * w
                total += gr * gr
                w -= rate / 5 * step * gr / np.sqrt(total)
    emb, *filters, bias, out, out_bias = weights
    model = Model(emb.astype(np.float32), filters, bias, out, float(out_bias[0]), np.log(counts / counts.sum(axis=0)).astype(np.float32))
    calibrate(model, [texts[i] for i, h in zip(order, held, strict=True) if h or not held.any()], y[held] if held.any() else y, len(names))
    return model


def calibrate(model: Model, texts: list[bytes], y: np.ndarray, n_languages: int, least: int = 8) -> None:
    """The threshold of the best F1 for each language with ``least`` texts of either label, else that of all texts."""
    parts = [model.logits(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    logit, lang = (np.concatenate(x) for x in zip(*parts, strict=True))

    def best(rows: np.ndarray) -> float:
        z, t = logit[rows], y[rows]
        order = np.argsort(-z)
        z, hits = z[order], np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1.0, t.sum()))
        k = int(f1.argmax())
        return float(z[k] if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)

    everything = best(np.arange(len(y)))
    model.thresholds = []
    for k in range(n_languages):
        rows = np.flatnonzero(lang == k)
        enough = len(rows) and min(y[rows].sum(), (1 - y[rows]).sum()) >= least
        model.thresholds.append(best(rows) if enough else everything)
    model.thresholds.append(everything)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_label: int = 2000, sample_bytes: int = 32 << 20) -> Model | None:
    """Learn from a bounded sample of labelled rows outside the held-out fold: about ``per_label`` of each label (by a
    hash of the id), their whole texts, and fewer if those are more than ``sample_bytes`` in all.

    Texts that repeat count once, with the label of their row of the least id.  None if a label is missing.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    hashed = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000))
    cut = F.when(F.col("toxic") == 1, per_label / sizes[1]).otherwise(per_label / sizes[0]) * 1_000_000
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")).filter("text is not null")
    # the sample is bounded by per_label, so it is the side to send out
    sample = texts.join(F.broadcast(rows.filter(hashed < cut)), "doc_id")
    size = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > sample_bytes:
        sample = sample.filter(hashed < cut * (sample_bytes / size))
    got = {}
    for r in sorted(sample.select("text", "toxic", "lang", "doc_id").toLocalIterator(), key=lambda r: (r.doc_id, r.toxic)):
        got.setdefault(bytes(r.text), (r.toxic, r.lang))
    if len({v[0] for v in got.values()}) < 2:
        return None
    return fit(list(got), np.array([v[0] for v in got.values()]), [v[1] for v in got.values()])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: a row for each row, from its whole text alone.

    A null text counts as empty; an empty text gets the score of a text without words.  Rows that repeat get equal scores,
    an empty table gives an empty one, and no other column is read.  Without a model all scores are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2 << 20):
            s = model.scores(batch.column(1).cast(pa.binary()).to_pylist()) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= AT).cast("int"))


def op9_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
