"""Quality rules as a short-circuit cascade.

Every text gets the base figures.  A text that passes the base rule then meets the other rules one by one and leaves
the cascade at the first that rejects it.  Their order comes from a sample: each rule's cost (seconds a text) and
selectivity (share rejected) are measured there, and rules go by rejections per cost.  The verdict is the conjunction
of all rules, so that the order changes the cost and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, slices

SYMBOLS = "#*$%&|<>"
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Text:
    """A text with the figures that several rules share."""

    raw: bytes
    words: list[bytes] = field(default_factory=list)
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # equal words have equal numbers
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0

    def __post_init__(self) -> None:
        self.words = self.raw.split()  # bytes: the ASCII blanks only
        text = self.raw.decode("utf-8", "replace")
        self.word_chars = len(text) - sum(map(text.count, BLANKS))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        self.n_dup_lines = len(lines) - len(set(lines))
        number: dict[bytes, int] = {}
        self.numbers = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, len(self.words))
        self.n_repeat_words = repeated_words(self.numbers, len(number))

    @property
    def base_failed(self) -> bool:
        return len(self.words) < 50 or 100 * self.n_repeat_words > 50 * len(self.words)


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """Words within windows of ``window`` words that occur twice or more, the first occurrence included, of words given
    by number (below ``distinct``)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys, size = ids[:n], distinct
    for k in range(1, window):
        if size > 1 << 31:  # keep products of two numbers below 2**63
            keys = np.unique(keys, return_inverse=True)[1]
            size = len(ids)
        keys = keys * distinct + ids[k : n + k]
        size *= distinct
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


# The rules: each says whether it rejects a text that passed the base rule.
def too_many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > len(t.words)


def odd_word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words)


def too_many_repeated_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 6 * sum(1 for x in t.raw.split(b"\n") if x.strip())


def shouting(t: Text) -> bool:
    """More than half of the cased ASCII letters are capitals."""
    upper = len(t.raw) - len(t.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(t.raw) - len(t.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def exclaiming(t: Text) -> bool:
    return 10 * t.raw.count(b"!") > 3 * len(t.words)


def few_distinct_words(t: Text) -> bool:
    """A word takes more than three tenths of a text (a stretch of one word repeated)."""
    return bool(10 * np.bincount(t.numbers).max() > 3 * len(t.words))


def word_runs(t: Text) -> bool:
    """More than a tenth of the words equal the word before."""
    return bool(10 * int((t.numbers[1:] == t.numbers[:-1]).sum()) > len(t.words))


RULES: tuple[Callable[[Text], bool], ...] = (few_distinct_words, word_runs, too_many_repeated_lines, shouting, exclaiming, odd_word_length, too_many_symbols)


def measure(texts: list[bytes], rules=RULES, clock=time.perf_counter) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) over the sample's texts that pass the base rule."""
    sample = [t for t in map(Text, texts) if not t.base_failed]
    out = []
    for rule in rules:
        began = clock()
        rejected = sum(map(rule, sample))
        out.append((rule.__name__, (clock() - began) / max(1, len(sample)), rejected / max(1, len(sample))))
    return out


def cascade_order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per cost, most first; ties by name."""
    return [name for name, _, _ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[0]))]


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = 256) -> list[bytes]:
    """About ``rows`` texts, drawn from all partitions alike: a bounded sample, only to estimate costs."""
    share = min(1.0, rows / max(1, docs.count()))
    return [bytes(r[0]) for r in docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary")).sample(share, seed=7).toLocalIterator()]


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = 256) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    A null or empty text has no words and so fails the base rule.  ``rejected_by`` is ``base``, null for a kept text, or
    the first rule in cascade order that rejects it.  A row out for each row in, repeats included; no other column is
    read, and an empty table gives an empty one.  Rules with equal rejections per cost go by name.
    """
    by_name = {r.__name__: r for r in rules}
    ordered = [by_name[n] for n in cascade_order(measure(sample_texts(docs, text_col, sample_rows), rules))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                t = Text(raw or b"")
                why = "base" if t.base_failed else next((r.__name__ for r in ordered if r(t)), None)
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, why == "base", why is None, why))
            cols = list(zip(*rows, strict=True))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {BASE_SCHEMA}, base_failed boolean, kept boolean, rejected_by string")


def op7_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


OP7_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), words AS (
  SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM split
), windows AS (
  SELECT rid, i, word, lag(word) OVER o AS prior, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
), counted AS (
  SELECT *, CASE WHEN w2 IS NULL THEN false ELSE count(*) OVER (PARTITION BY rid, word, w1, w2) > 1 END AS twice FROM windows
), covered AS (
  SELECT rid, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit, word = prior AS run FROM counted WINDOW o AS (PARTITION BY rid ORDER BY i)
), repeated AS (
  SELECT rid, count(*) FILTER (hit) AS n_repeat_words, count(*) FILTER (run) AS n_runs FROM covered GROUP BY rid
), top AS (
  SELECT rid, max(n) AS n_top FROM (SELECT rid, word, count(*) AS n FROM words GROUP BY ALL) GROUP BY rid
), base AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_runs, 0) AS n_runs, coalesce(n_top, 0) AS n_top,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower,
         length(text) - length(replace(text, '!', '')) AS marks
  FROM split LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN top USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND 10 * n_dup_lines <= 6 * n_lines AND upper <= lower AND 10 * marks <= 3 * n_words AND 10 * n_top <= 3 * n_words AND 10 * n_runs <= n_words AS kept
FROM judged
"""
