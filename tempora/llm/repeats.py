"""Exact removal of repeated byte strings with run-length indexes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or same document and
earlier start).  Whole texts are judged as they came in.

1. Cutting.  Each window of LENGTH bytes is named by its least hashed K-gram, the anchor; a maximal run of windows with
   one anchor is a piece.  Equal windows have equal anchors, so that only pieces of one anchor need to be compared.
2. Equal pieces (by anchor and a hash of the whole piece, 128 bits in all) keep their first occurrence; the others are
   marked at once.  Tasks combine their own pieces before the shuffle.  An anchor with more than ``HEAVY`` distinct pieces
   in one batch is a crowd at once: its pieces are dealt by anchor and hash, and a notice goes to the anchor's own bucket.
3. Indexing.  The distinct pieces of the anchors that have two or more, or one that may repeat within itself, go, as bytes, to shards by anchor.  A shard builds
   the run-length Burrows-Wheeler transform of its pieces, keeps the suffix array's samples at the ends of runs, and
   streams through the text the length and place of each position's longest match with its predecessor in suffix order
   (both follow from the last sample: place + 1, length - 1 for each step).  Matches of LENGTH or more tie windows into
   classes; all but the first of each class are marked.
   The pieces of a crowd (more than ``CROWD`` distinct pieces of an anchor) are split into single windows first, dealt by
   the window's own hash.
4. The marked runs of each document are merged and cut out.

Shards are as many as there are SHARD_BYTES of text.  A task has one or more; it takes them in turn, sorted, and holds no
more than one.  An index is built over about INDEX_BYTES of it at a time (all pieces of an anchor together).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free, mark, materialize, slices, trim

LENGTH, K, CROWD, HEAVY, SHARD_BYTES, LONGEST = 100, 32, 4096, 1024, 4 << 20, 128
#: Bytes of strings under one index, that a task holds before it sends them on, and of text whose pieces it combines.
INDEX_BYTES, HELD_BYTES, CUT_BYTES = 1 << 20, 4 << 20, 8 << 20
#: Bytes of text that are hashed at a time: their arrays (eight bytes a byte) stay in a core's cache.
SLICE_BYTES = 1 << 18
_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(0, 1 << 64, 256, np.uint64)
ODD = [int(x) | 1 for x in _rng.integers(0, 1 << 64, 8, np.uint64)]
#: In a piece's length: its anchor may stand in it twice.
INNER = np.uint32(1 << 31)
#: A piece: anchor, hash, document (doc_id, then the key of its row), start and length.
PIECE = np.dtype([("a", "<u8"), ("s", "<u8"), ("d", "<i8"), ("k", "<u8"), ("p", "<i8"), ("n", "<u4")])
#: A run of bytes to remove.
MARK = np.dtype([("d", "<i8"), ("k", "<u8"), ("p", "<i8"), ("n", "<u4")])
#: A piece whose bytes are wanted; c: whether its anchor has a crowd.
NEED = np.dtype([("a", "<u8"), ("d", "<i8"), ("k", "<u8"), ("p", "<i8"), ("n", "<u4"), ("c", "u1")])
#: An anchor that some batch found to be a crowd.
NOTICE = np.dtype([("a", "<u8")])
#: The id that stands for a null doc_id, whose key has the top bit set: after all others.
LAST = (1 << 63) - 1
FIELDS = ["bucket", "kind", "doc_id", "key", "text"]
SCHEMA = "bucket int, kind int, doc_id long, key long, text binary"
TEXT, PIECES, MARKS, NEEDS, STRINGS, CROWDS, NOTICES = range(7)
#: Partitions of a shuffle at most; beyond, a partition has several buckets.
PARTITIONS = 1 << 15


def row(bucket: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), pa.array(blobs, pa.binary())], FIELDS)


def dealt(records: np.ndarray, to: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Records as one blob for each bucket."""
    if len(records):
        order = np.argsort(to, kind="stable")
        records, to = records[order], to[order]
        at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        ends = [*at[1:].tolist(), len(to)]
        yield row(to[at].tolist(), kind, [pack(records[i:j]) for i, j in zip(at.tolist(), ends, strict=True)])


def pack(records: np.ndarray) -> bytes:
    """Column after column: they compress better than records."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def unpack(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // dtype.itemsize, dtype)
    at = 0
    for b in blobs:
        n = len(b) // dtype.itemsize
        offset = 0
        for f in dtype.names:
            kind = dtype[f]
            out[f][at : at + n] = np.frombuffer(b, kind, n, offset)
            offset += n * kind.itemsize
        at += n
    return out


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` for each 64-bit key."""
    x = x.astype(np.uint64) * np.uint64(ODD[6])
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def doc_bucket(d: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    return spread(d.astype(np.uint64) * np.uint64(ODD[3]) ^ k.astype(np.uint64), n)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position on (by doubling; K is a power of two)."""
    h, width, level = TABLE[data], 1, 0
    while width < K:
        h = h[:-width] * np.uint64(ODD[level]) + h[width:]
        width, level = 2 * width, level + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(ODD[5])
    h ^= h >> np.uint64(32)
    return h


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    m = h
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(m) - (width - done)], m[width - done :]) if done < width else m


def twice_near(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Anchors that may stand twice in one piece: such a piece can repeat windows of its own."""
    width = LENGTH - K + 1
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(h == ~window_least(~around, width))  # least of some window that has them
    order = np.lexsort((at, h[at]))
    at = at[order]
    near = (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] < LONGEST + width)
    return np.unique(h[at[1:][near]])


def pieces_of(texts: list[bytes], ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The pieces of whole texts."""
    keep = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not keep:
        return np.empty(0, PIECE)
    data = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    sizes = np.array([len(texts[i]) for i in keep])
    starts = np.cumsum(sizes) - sizes
    h = gram_hashes(data)
    least = window_least(h, LENGTH - K + 1)
    first = np.zeros(len(least), bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    first[starts] = True
    inner = twice_near(h, least)
    at = np.flatnonzero(first)
    doc = np.searchsorted(starts, at, side="right") - 1
    # windows that reach over the end of their document are none
    run = np.minimum(np.append(at[1:], len(least)), starts[doc] + sizes[doc] - LENGTH + 1) - at
    ok = run > 0
    at, doc, run = at[ok], doc[ok], run[ok]
    if run.max() > LONGEST:
        parts = -(-run // LONGEST)
        at, doc, left = np.repeat(at, parts), np.repeat(doc, parts), np.repeat(run, parts)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, run = at + nth * LONGEST, np.minimum(LONGEST, left - nth * LONGEST)
    n = run + LENGTH - 1
    s = n.astype(np.uint64)
    for j in range(-(-int(n.max()) // K)):
        s = s * np.uint64(ODD[7]) + h[np.minimum(at + j * K, at + n - K)]
        s ^= s >> np.uint64(31)
    out = np.empty(len(at), PIECE)
    out["a"], out["s"], out["p"], out["n"] = least[at], s, at - starts[doc], n
    out["n"][np.isin(out["a"], inner)] |= INNER
    out["d"], out["k"] = ids[keep][doc], keys[keep][doc]
    return out


def combine(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first piece of each anchor and hash, marks for the others).  Sorted by anchor."""
    r = r[np.lexsort((r["p"], r["k"], r["d"], r["s"], r["a"]))]
    new = np.ones(len(r), bool)
    new[1:] = (r["a"][1:] != r["a"][:-1]) | (r["s"][1:] != r["s"][:-1])
    firsts = r[new]
    owner = firsts[np.cumsum(new) - 1]
    # a row that repeats (same id and text) is not a copy of itself; cut() sees to it
    other = ~new & ((r["d"] != owner["d"]) | (r["k"] != owner["k"]) | (r["p"] != owner["p"]))
    return firsts, as_marks(r[other])


def as_marks(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), MARK)
    for f in MARK.names:
        out[f] = r[f]
    out["n"] &= ~INNER
    return out


def members(a: np.ndarray) -> np.ndarray:
    """Of sorted anchors, how many there are of each row's."""
    if not len(a):
        return np.zeros(0, int)
    new = np.concatenate([[True], a[1:] != a[:-1]])
    return np.diff(np.append(np.flatnonzero(new), len(a)))[np.cumsum(new) - 1]


def cut_pieces(docs: DataFrame, n_buckets: int, heavy: int) -> DataFrame:
    """Step 1 and the tasks' part of step 2: pieces by anchor, marks by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                firsts, more = combine(np.concatenate(held))
                held.clear()
                crowded = members(firsts["a"]) > heavy
                some, many = firsts[~crowded], firsts[crowded]
                yield from dealt(some, spread(some["a"], n_buckets), PIECES)
                yield from dealt(many, spread(many["a"] ^ many["s"] * np.uint64(ODD[2]), n_buckets), CROWDS)
                notices = np.unique(many["a"]).view(NOTICE)
                yield from dealt(notices, spread(notices["a"], n_buckets), NOTICES)
                yield from dealt(more, doc_bucket(more["d"], more["k"], n_buckets), MARKS)

        size = 0
        for batch in slices(batches, 2, SLICE_BYTES):
            texts = batch.column(2).to_pylist()
            held.append(pieces_of(texts, batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            size += sum(map(len, texts))
            if size > CUT_BYTES:
                yield from send()
                size = 0
        yield from send()

    return docs.mapInArrow(run, SCHEMA)


def dealt_out(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows by bucket, the buckets of a partition one after the other."""
    return rows.repartition(min(n_buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[tuple]]]:
    """Each bucket of a partition by kind: (doc_id, key, bytes)."""
    out: dict[int, list[tuple]] = {k: [] for k in range(7)}
    now = None
    for b in batches:
        for bucket, kind, *row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if bucket != now:
                if now is not None:
                    yield out
                    out = {k: [] for k in range(7)}
                now = bucket
            out[kind].append(tuple(row))
    if now is not None:
        yield out
    out = None
    trim()


def by_bucket(one: Callable[[dict], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that works bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in gathered(batches):
            yield from one(got)

    return run


def records(got: dict, kind: int, dtype: np.dtype) -> np.ndarray:
    return unpack([t for _, _, t in got.pop(kind)], dtype)


def compare_pieces(pieces: DataFrame, n_buckets: int, crowd: int) -> DataFrame:
    """Step 2: marks, and the pieces whose bytes are needed, both by document."""

    def one(got: dict) -> Iterator[pa.RecordBatch]:
        marks = [records(got, MARKS, MARK)]
        r, many, noticed = records(got, PIECES, PIECE), records(got, CROWDS, PIECE), records(got, NOTICES, NOTICE)
        if len(r):
            r = r[np.argsort(r["a"])]
            told = np.isin(r["a"], noticed["a"])
            r = r[(members(r["a"]) > 1) | (r["n"] >= INNER) | told]
        for part, all_crowd in ((r, False), (many, True)):
            if not len(part):
                continue
            firsts, more = combine(part)
            marks.append(more)
            size = members(firsts["a"])
            told = np.isin(firsts["a"], noticed["a"]) | all_crowd
            wanted = (size > 1) | (firsts["n"] >= INNER) | told
            need = np.empty(int(wanted.sum()), NEED)
            for f in ("a", "d", "k", "p", "n"):
                need[f] = firsts[f][wanted]
            need["n"] &= ~INNER
            need["c"] = (told | (size > crowd))[wanted]
            yield from dealt(need, doc_bucket(need["d"], need["k"], n_buckets), NEEDS)
        found = np.concatenate(marks)
        yield from dealt(found, doc_bucket(found["d"], found["k"], n_buckets), MARKS)

    return dealt_out(pieces, n_buckets).mapInArrow(by_bucket(one), SCHEMA)


def strings_blob(need: np.ndarray, strings: list[bytes]) -> bytes:
    return len(need).to_bytes(8, "little") + pack(need) + b"".join(strings)


def fetch_bytes(docs: DataFrame, needs: DataFrame, n_buckets: int) -> DataFrame:
    """Step 3, its first half: the bytes of needed pieces (of a crowd's windows), dealt by anchor (by window)."""

    def one(got: dict) -> Iterator[pa.RecordBatch]:
        need = records(got, NEEDS, NEED)
        if not len(need):
            return
        need = need[np.lexsort((need["p"], need["k"], need["d"]))]
        texts = {(d, k & (1 << 64) - 1): t for d, k, t in got[TEXT]}
        out: list[tuple] = []
        windows: dict[bytes, tuple] = {}
        marks: list[tuple] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            out.extend(windows.values())
            rec = np.array([(*x[:5], 0) for x in out], NEED)
            to = spread(rec["a"], n_buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            groups = np.split(order, cuts)
            yield row([int(to[g[0]]) for g in groups], STRINGS, [strings_blob(rec[g], [out[i][5] for i in g.tolist()]) for g in groups])
            more = np.array(marks, MARK)
            yield from dealt(more, doc_bucket(more["d"], more["k"], n_buckets), MARKS)
            out.clear()
            windows.clear()  # a window met again is sent again: the index ties it to the first
            marks.clear()

        for a, d, k, p, n, c in need.tolist():
            if held > HELD_BYTES:
                yield from send()
                held = 0
            s = texts[d, k][p : p + n]
            held += n if not c else LENGTH * (n - LENGTH + 1)
            if not c:
                out.append((a, d, k, p, n, s))
                continue
            for i in range(n - LENGTH + 1):  # in order of (document, start): the first stays
                w = s[i : i + LENGTH]
                if w in windows:
                    marks.append((d, k, p + i, LENGTH))
                else:
                    windows[w] = (int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), d, k, p + i, LENGTH, w)
        yield from send()

    both = with_bucket(docs, n_buckets).unionByName(needs)
    return dealt_out(both, n_buckets).mapInArrow(by_bucket(one), SCHEMA)


def with_bucket(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Texts with the bucket of their document: the same as ``doc_bucket``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(d, k.view(np.uint64), n_buckets), pa.int32()), pa.array(np.full(len(d), TEXT, np.int32)), *b.columns], FIELDS)

    return docs.mapInArrow(run, SCHEMA)


def suffix_order(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of strings laid end to end; ``left`` is how many bytes each position's string still has.

    A suffix ends with its string, and ends of strings sort before bytes and among themselves by position.  Prefixes are
    doubled; each round sorts only the suffixes that are still tied, within the places that they have.
    """
    n = len(data)
    code = np.zeros(n + 8, np.uint64)
    code[:n] = data
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven bytes and how many of them the string still has
        key = (key << np.uint64(8)) | np.where(left > j, code[j : n + j], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key)  # not stable, and much quicker for that: no ties are left at the end
    key = key[order]
    places, tied, width = np.arange(n), order, 7
    rank = np.empty(n, np.int64)  # the first place of the suffix's group: it changes only when the group is split
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        more = ~(new & np.append(new[1:], True))
        places, tied = places[more], tied[more]
        if not len(places):
            return order
        inside = left[tied] > width  # of one group, the others are equal strings: before these, by position
        key = rank[tied] * (2 * n) + np.where(inside, n + rank[np.where(inside, tied + width, 0)], tied)
        by = np.argsort(key)
        key, tied = key[by], tied[by]
        order[places] = tied
        width *= 2


def common_prefix(data: np.ndarray, left: np.ndarray, i: np.ndarray, j: np.ndarray, longest: int) -> np.ndarray:
    """Bytes that the strings from i and from j on have in common, up to ``longest``."""
    limit = np.minimum(np.minimum(left[i], left[j]), longest)
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k in range(longest):
        live = live[limit[live] > k]
        live = live[data[i[live] + k] == data[j[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def run_length_index(data: np.ndarray, left: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The samples at the ends of the runs of the Burrows-Wheeler transform, by text position: (head of a run, the suffix
    before it in suffix order, their common prefix).  The suffix array goes when its samples are taken."""
    sa = suffix_order(data, left)
    before = np.full(len(data), -1, np.int32)
    before[1:] = data[:-1]
    before[begins] = -1  # each string's end is a letter of its own
    bwt = before[sa]
    head = np.ones(len(sa), bool)
    head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
    heads = np.flatnonzero(head)
    at, prior = sa[heads], np.where(heads > 0, sa[heads - 1], -1)
    order = np.argsort(at)
    at, prior = at[order], prior[order]
    common = np.zeros(len(at), np.int64)
    ok = prior >= 0
    common[ok] = common_prefix(data, left, at[ok], prior[ok], int(left.max()))
    return at, prior, common


def stream_matches(n: int, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of each position's match with its predecessor in suffix order, from the samples alone."""
    at, prior, common = index
    steps = np.diff(np.append(at, n))
    since = np.arange(n) - np.repeat(at, steps)
    return np.repeat(common, steps) - since, np.repeat(prior, steps) + since


def repeated_windows(need: np.ndarray, strings: bytes) -> np.ndarray:
    """Marks for all windows of a shard's strings but the first of each class.  ``need`` is in document order."""
    data = np.frombuffer(strings, np.uint8)
    sizes = need["n"].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(need)), sizes)
    left = (begins + sizes)[of] - np.arange(len(data))
    length, place = stream_matches(len(data), run_length_index(data, left, begins))
    linked = np.flatnonzero((length >= LENGTH) & (left >= LENGTH))
    if not len(linked):
        return np.empty(0, MARK)
    root = np.arange(len(data))
    root[linked] = place[linked]
    members = linked
    while True:
        further = root[root[members]]
        if (further == root[members]).all():
            break
        root[members] = further
    members = np.union1d(linked, root[linked])
    r = root[members]
    order = np.lexsort((members, r))
    r, members = r[order], members[order]
    late = np.sort(members[1:][r[1:] == r[:-1]])
    if not len(late):
        return np.empty(0, MARK)
    new = np.concatenate([[True], (late[1:] != late[:-1] + 1) | (of[late[1:]] != of[late[:-1]])])
    firsts = late[new]
    lasts = np.append(late[:-1][new[1:]], late[-1])
    out = np.empty(len(firsts), MARK)
    own = of[firsts]
    out["d"], out["k"] = need["d"][own], need["k"][own]
    out["p"], out["n"] = need["p"][own] + firsts - begins[own], lasts - firsts + LENGTH
    return out


def index_shards(strings: DataFrame, n_buckets: int) -> DataFrame:
    """Step 3, its second half: a run-length index a shard; marks by document."""

    def one(got: dict) -> Iterator[pa.RecordBatch]:
        marks = [records(got, MARKS, MARK)]
        needs, strings = [], []
        for _, _, blob in got.pop(STRINGS):
            n = int.from_bytes(blob[:8], "little")
            end = 8 + n * NEED.itemsize
            rec = unpack([blob[8:end]], NEED)
            needs.append(rec)
            strings.append(blob[end:])
        if needs:
            need, pool = np.concatenate(needs), b"".join(strings)
            strings.clear()
            sizes = need["n"].astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            # anchors apart, so that an index holds about INDEX_BYTES; within each, in document order
            order = np.lexsort((need["p"], need["k"], need["d"]))
            part = spread(need["a"] ^ np.uint64(ODD[4]), max(1, len(pool) // INDEX_BYTES))
            for b in range(int(part.max()) + 1):
                own = order[part[order] == b]
                if len(own):
                    marks.append(repeated_windows(need[own], b"".join(pool[i : i + n] for i, n in zip(begins[own].tolist(), sizes[own].tolist(), strict=True))))
        found = np.concatenate(marks)
        yield from dealt(found, doc_bucket(found["d"], found["k"], n_buckets), MARKS)

    return dealt_out(strings, n_buckets).mapInArrow(by_bucket(one), SCHEMA)


def merged(p: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of a document's marks."""
    order = np.argsort(p)
    starts, ends = p[order], np.maximum.accumulate(p[order] + n[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), np.append(ends[:-1][new[1:]], ends[-1]).tolist(), strict=True))


def cut(docs: DataFrame, marks: DataFrame, n_buckets: int) -> DataFrame:
    """Step 4: doc_id, key, kept (bytes), n_bytes, spans (start, end) of what was removed."""

    def one(got: dict) -> Iterator[pa.RecordBatch]:
        r = records(got, MARKS, MARK)
        r = r[np.lexsort((r["k"], r["d"]))]
        new = np.flatnonzero(np.concatenate([[True], (r["d"][1:] != r["d"][:-1]) | (r["k"][1:] != r["k"][:-1])])) if len(r) else np.zeros(0, int)
        of = {(int(r["d"][i]), int(r["k"][i])): (i, j) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(r)], strict=False)}
        seen: set[tuple[int, int]] = set()
        out = []
        for d, k, text in got[TEXT]:
            row = (d, k & (1 << 64) - 1)
            i, j = of.get(row, (0, 0))
            spans = merged(r["p"][i:j], r["n"][i:j].astype(np.int64)) if j > i else []
            if len(text) >= LENGTH:
                if row in seen:  # the row repeats: all of it starts earlier
                    spans = [(0, len(text))]
                seen.add(row)
            at, kept = 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            out.append((None if k < 0 else d, k, b"".join(kept), len(text), spans))
            if len(out) == 1000:
                yield result(out)
                out = []
        if out:
            yield result(out)

    def result(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in cols[4]], pa.list_(span))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), spans], ["doc_id", "key", "kept", "n_bytes", "spans"])

    both = with_bucket(docs, n_buckets).unionByName(marks)
    return dealt_out(both, n_buckets).mapInArrow(by_bucket(one), "doc_id long, key long, kept binary, n_bytes long, spans array<struct<start:long,end:long>>")


def row_key(doc_id: Column, text: Column) -> Column:
    """63 bits of the text's XXH64 with the top bit for a null id: what tells rows of one id apart."""
    short = F.shiftrightunsigned(F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b""))), 1)
    return F.when(doc_id.isNull(), short.bitwiseOR(F.lit(-(1 << 63)))).otherwise(short)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, heavy: int = HEAVY) -> DataFrame:
    """doc_id, key, kept, n_bytes, spans: a row for each row.

    A null text is empty.  A null doc_id comes after all others.  Rows that share a doc_id (or have none) but not their
    text follow each other by ``row_key``, and work on them is spread by it; a row that repeats both is removed whole (if
    it has LENGTH bytes).  An empty table gives an empty one.  Of other columns none is read.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc_id"), row_key(doc_id, text).alias("key"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))
    free(docs.sparkSession)  # what came before
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(8, size // shard_bytes)
    compared = materialize(compare_pieces(cut_pieces(rows, n_buckets, heavy), n_buckets, crowd), "compared")
    free(docs.sparkSession)
    strings = fetch_bytes(rows, compared.filter(F.col("kind") == NEEDS), n_buckets)
    matched = materialize(index_shards(strings, n_buckets), "matched")
    free(docs.sparkSession)
    return cut(rows, compared.filter(F.col("kind") == MARKS).unionByName(matched), n_buckets)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; a text that loses all its bytes goes with its row.

    Bytes of a character that was cut in two are dropped.  ``length_col``, where there is one, counts the new text's code
    points.  Rows that share an id are told apart by their text; of rows that repeat both, one stays.
    """
    begun = mark()
    found = remove_repeats(docs, id_col, text_col).groupBy("doc_id", "key").agg(F.count("*").alias("_n"), F.max(F.struct(F.length("kept").alias("left"), "kept", F.size("spans").alias("cuts"))).alias("b"))
    found = found.filter("_n > 1 or b.cuts > 0")
    found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_n", F.col("b.kept").alias("_kept"), (F.col("b.cuts") > 0).alias("_cut")), "changed")
    drop_written(docs.sparkSession, begun, found)
    free(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of theirs clashes
    doc_id, said = F.col("row")[id_col].cast("long"), F.col("row")[text_col]
    on = doc_id.eqNullSafe(F.col("_id")) & (row_key(doc_id, said) == F.col("_key"))
    out = rows.join(found, on, "left").filter(~F.coalesce(F.col("_cut") & (F.length("_kept") == 0), F.lit(False)))
    text = F.regexp_replace(F.make_valid_utf8(F.col("_kept").cast("string")), "\ufffd", "")
    changed = F.col("row").withField(text_col, text)
    if length_col in docs.columns:
        changed = changed.withField(length_col, F.length(text).cast(docs.schema[length_col].dataType))
    out = out.withColumn("row", F.when(F.col("_cut"), changed).otherwise(F.col("row")))
    once = out.filter(F.coalesce("_n", F.lit(1)) == 1).select("row.*")
    if found.filter("_n > 1").isEmpty():
        return once
    return once.unionByName(out.filter("_n > 1").dropDuplicates(["_id", "_key"]).select("row.*"))
