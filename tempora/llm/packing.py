"""Hierarchical best-fit packing of token pieces into sequences.

Each input partition tokenizes its documents and packs its pieces best-fit, longest first.  Nearly full bins are done.
Underfull bins go up a tree as items, in parts of at most 1 / PARTS of a sequence (or of one piece), so that they fit:
the items of FAN neighbouring groups are packed best-fit again, nearly full bins are done, the items of the others go on,
round by round, until one group is left.

Only how many items there are of each size travels up, never pieces: a group has at most as many sizes as a sequence has
tokens.  Its packing is a short plan of runs (items of a size by their rank, bins by their number), to which items are
joined by (group, size, range of ranks), so that no task holds the items of a group.
"""

from __future__ import annotations

import base64
import bisect
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialize, slices

FAN, PARTS = 16, 16
#: Items of one size are joined to their plan by so many ranks at a time.
CHUNK = 1 << 16


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin and offset of each item, fill of each bin): longest item first, each into the fullest bin that takes it."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = open_rooms >> n
        if n < capacity and fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            open_rooms |= 1 << (room - n)
    return bins, offsets, fills


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """``best_fit`` of so many items of each size: placements (size, first rank, how many, first bin, offset), one item a
    bin from there on, and (first bin, how many, fill) of all bins."""
    placed: list[tuple[int, int, int, int, int]] = []
    by_room: dict[int, list[tuple[int, int]]] = {}
    open_rooms = bins = 0  # bit r: some bin has room r
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fits = open_rooms >> size
            if fits:
                room = size + ((fits & -fits).bit_length() - 1)
                lo, n = by_room[room].pop()
            else:
                room, lo, n = capacity, bins, left
            take = min(n, max(1, left // (room // size)))  # so many bins are filled with this size
            if fits and take < n:
                by_room[room].append((lo + take, n - take))
            elif fits and not by_room[room]:
                open_rooms &= ~(1 << room)
            elif not fits:
                bins += take
            placed.append((size, rank, take, lo, capacity - room))
            by_room.setdefault(room - size, []).append((lo, take))
            if room > size:
                open_rooms |= 1 << (room - size)
            rank, left = rank + take, left - take
    return placed, [(lo, n, capacity - room) for room, runs in by_room.items() for lo, n in runs]


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of words met so far; starts anew when it is full."""

    def __init__(self, encode, limit: int = 400_000) -> None:
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own, with the words' ids remembered.

    The byte-level pattern always cuts before a single space between two other characters and on both sides of a single
    line feed between two others, so that a text's ids are those of its words in turn.
    """

    #: Blanks besides such single ones: the text is then cut at single spaces only.
    ODD = re.compile(r"\s\s|[^\S \n]")
    CUT = re.compile(r"(?<=\S) (?=\S)")
    PLAIN = re.compile(r"([^\W\d_]+)([.,!?;:*#$%&|<>\"()]*)\Z")

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.piece = None
        if ranks:  # the same vocabulary as ranks: quicker for a single piece
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.tails: dict[str, bytes] = {"": b""}
        self.first = _Words(self.whole, 50_000)
        self.rest = _Words(self.after_space)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def after_space(self, word: str) -> bytes:
        m = self.piece and self.PLAIN.match(word)
        if not m or not m[1].isalpha():
            return self.whole(" " + word)
        if m[2] not in self.tails:
            self.tails[m[2]] = self.whole(m[2])
        return self.packed(self.piece(f" {m[1]}".encode())) + self.tails[m[2]]

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            words = self.CUT.split(text)
            return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:])))
        return self.first["\n"].join(out)


def encoder(path: str, ranks: str | None) -> Encoder:
    """One encoder a worker, kept between tasks."""
    kept = sys.modules.setdefault("_tempora_encoders", types.ModuleType("_tempora_encoders"))
    if (path, ranks) not in kept.__dict__.setdefault("of", {}):
        kept.of[path, ranks] = Encoder(path, ranks)
    return kept.of[path, ranks]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, node long, size int, rank long"


def local_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: tuple[str, str | None] | None) -> DataFrame:
    """Tokenize, cut and pack within each input partition.

    A piece of a nearly full bin has its sequence_id and offset; any other is of an item: the partition is its node, and
    rank numbers the node's items of that size.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*(vocabulary or default_vocabulary()))
        rows: list[tuple] = []
        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end if text else end
                n = len(ids) // 4
                start, size, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    rows.append((doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, size, piece = start + size, capacity, piece + 1
        if not rows:
            return
        lengths = [r[3] for r in rows]
        bins, offsets, fills = best_fit(lengths, capacity)
        node = TaskContext.get().partitionId()
        # node, size and rank of the item that a piece is of
        items: list[tuple] = [(None, None, None)] * len(rows)
        ids = [sequence(0, node, b) for b in bins]
        under = [i for i, b in enumerate(bins) if fills[b] < nearly_full(capacity)]
        part = max(1, capacity // PARTS)
        small, large = [i for i in under if lengths[i] < part], [i for i in under if lengths[i] >= part]
        own, within, sizes = best_fit([lengths[i] for i in small], part)
        ranks: dict[int, int] = {}
        of = []
        for n in [*sizes, *(lengths[i] for i in large)]:
            of.append((node, n, ranks.get(n, 0)))
            ranks[n] = ranks.get(n, 0) + 1
        for i, item, at in [*zip(small, own, within, strict=True), *((i, len(sizes) + k, 0) for k, i in enumerate(large))]:
            items[i], ids[i], offsets[i] = of[item], None, at
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.int64()]
        for i in range(0, len(rows), 50_000):
            cols = [*zip(*rows[i : i + 50_000], strict=True), ids[i : i + 50_000], offsets[i : i + 50_000], *zip(*items[i : i + 50_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def sequence(level: int, node: int, b: int) -> int:
    """A number for bin ``b`` of a node."""
    return level << 58 | node << 32 | b


PLAN = "node long, size int, lo long, n long, sequence_id long, offset long, up long"


def merge_round(items: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """One round of the tree, from how many items (node, size, n) there are: a plan of runs of ranks, ``lo`` and ``n``
    of them in (node, size).  Their bins start at sequence_id, or, where that is null, they go on with rank ``up``."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["node"].iloc[0]) // FAN
        children: dict[int, list[tuple[int, int, int]]] = {}  # of each size: (first rank among all, how many, node)
        counts: dict[int, int] = {}
        for node, size, n in sorted(zip(pdf["node"].tolist(), pdf["size"].tolist(), pdf["n"].tolist(), strict=True)):
            children.setdefault(size, []).append((counts.get(size, 0), n, node))
            counts[size] = counts.get(size, 0) + n
        placed, bins = best_fit_counts(counts, capacity)
        done = sorted((lo, n) for lo, n, fill in bins if last or fill >= nearly_full(capacity))
        out: list[tuple] = []
        gone: dict[int, int] = {}  # of each size, the ranks that went on so far
        at = dict.fromkeys(children, 0)  # the child that has the next rank: placements of a size come by rank
        for size, rank, n, b, offset in placed:
            while n:
                k = bisect.bisect_right(done, (b, float("inf"))) - 1
                closed = k >= 0 and b < done[k][0] + done[k][1]
                edge = done[k][0] + done[k][1] if closed else done[k + 1][0] if k + 1 < len(done) else b + n
                base, m, node = children[size][at[size]]
                take = min(n, edge - b, base + m - rank)
                if closed:
                    out.append((node, size, rank - base, take, sequence(level, group, b), offset, None))
                else:
                    out.append((node, size, rank - base, take, None, None, gone.get(size, 0)))
                    gone[size] = gone.get(size, 0) + take
                rank, b, n = rank + take, b + take, n - take
                at[size] += rank == base + m
        return pd.DataFrame({c.split()[0]: pd.array(v, "Int64") for c, v in zip(PLAN.split(", "), zip(*out, strict=True), strict=True)})

    return items.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(merge, PLAN)


def nearly_full(capacity: int) -> int:
    return capacity - capacity // 64


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.  Only documents longer than
    ``capacity`` are cut, however long; the first piece has what is left over.  Repeated rows are packed as often as they
    occur, an empty table gives an empty one, and no other column is read.  Pieces of equal length go into bins in the
    order of their rows, bins of equal fill take them latest first: how many sequences there are depends on neither.
    ``vocabulary`` is the path of a tokenizer file and, to be quicker, that of the same vocabulary as ranks.
    """
    pieces = materialize(local_pieces(docs, id_col, text_col, capacity, end_id, vocabulary), "pieces")
    out = pieces.withColumnRenamed("offset", "at").withColumnRenamed("sequence_id", "bin")
    items = pieces.filter("rank is not null").groupBy("node", "size").agg((F.max("rank") + 1).alias("n"))
    nodes = pieces.agg(F.max("node")).first()[0]
    level = 0
    while nodes is not None:
        level, nodes = level + 1, nodes // FAN
        plan = materialize(merge_round(items, capacity, level, nodes == 0), "plan")
        runs = plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns], F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("lo") + F.col("n") - 1) / CHUNK))).alias("_chunk"))
        rank = F.col("rank")
        on = (F.col("node") == F.col("_node")) & (F.col("size") == F.col("_size")) & (F.floor(rank / CHUNK) == F.col("_chunk")) & (rank >= F.col("_lo")) & (rank < F.col("_lo") + F.col("_n"))
        later = rank - F.col("_lo")
        out = out.join(runs, on, "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("bin", F.col("_sequence_id") + later).alias("bin"),
            (F.col("at") + F.coalesce("_offset", F.lit(0))).alias("at"),
            F.floor(F.col("node") / FAN).alias("node"), "size", (F.col("_up") + later).alias("rank"),
        )  # a done piece has no rank and meets no run
        if nodes == 0:
            break
        items = plan.filter("up is not null").groupBy(F.floor(F.col("node") / FAN).alias("node"), "size").agg(F.sum("n").alias("n"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
