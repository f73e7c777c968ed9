import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tempora.llm import packing


TOKENIZER = Tokenizer.from_file(packing.default_vocabulary()[0])
TOKENIZER.encode_special_tokens = True


def reference_ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids + [0] if text else [0]


TEXTS = [None, "", " ", "\n", "a", "a b", "a  b", "a b ", " a", "a \n b", "\n\na\n", "don't they're 12,5 x\tz", "x\r\ny", "é ßün ñ 日本語 テスト", "a b c d",
         "erhe.### ***of, (\"thus\") <|endoftext|> it's", "x_y a1 b-c 1st ... --", "ǅ ª º Ⅷ ² ½ 𝒳", "\x1c\x1d a\x85b", "é äb", "THE!! END.!!", "a\n'll b\n's", "​zero ﻿bom"]


def test_ids_equal_the_tokenizers():
    enc = packing.Encoder(*packing.default_vocabulary())
    rng = random.Random(1)
    alphabet = ["the", " ", "\n", "é", "'s", "###", ".", ",", "1", "  ", "\t", "日", "word", "Ab", "!", "'", " ", "_"]
    for text in [t for t in TEXTS if t] + ["".join(rng.choices(alphabet, k=40)) for _ in range(500)]:
        assert list(np.frombuffer(enc.encode(text), "<u4")) == reference_ids(text)[:-1], repr(text)


def check(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, got = reference_ids(text), sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum(r.length for r in got) == len(ids)
        assert all(r.length == capacity for r in got[1:]) and (len(got) == 1) == (len(ids) <= capacity)
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_pack_round_trip_and_fill(spark):
    rng = random.Random(2)
    docs = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choices(["the", "word", "of", "stone"], k=rng.randint(1, 150)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    rows = packing.pack(df, capacity=64).collect()
    n = check(rows, docs, 64)
    one = check(packing.pack(df.coalesce(1), capacity=64).collect(), docs, 64)
    assert n <= 1.01 * one


def test_forty_partitions_take_what_one_takes(spark):
    """Short texts in many partitions, where whole underfull bins would fit badly; and pieces that fit with no other."""
    texts = [(r.doc_id, r.text[:300]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lengths = [r.length for r in packing.pack(df.coalesce(1)).collect()]
    best = len(packing.best_fit(lengths, 2048)[2])
    assert check(packing.pack(df.repartition(40)).collect(), texts, 2048) <= 1.01 * best
    large = [(i, "the " * 40) for i in range(300)]
    n = check(packing.pack(spark.createDataFrame(large, "doc_id long, text string").repartition(20), capacity=64).collect(), large, 64)
    assert n == 300


def test_best_fit_of_counts():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        placed, bins = packing.best_fit_counts(counts, 40)
        fill, used = {}, {}
        for size, rank, n, b, offset in placed:
            assert rank == used.get(size, 0)
            used[size] = rank + n
            for k in range(b, b + n):
                assert fill.get(k, 0) == offset
                fill[k] = offset + size
        assert used == counts and max(fill.values()) <= 40
        assert {k: f for lo, n, f in bins for k in range(lo, lo + n)} == fill
        plain = packing.best_fit([s for s, n in counts.items() for _ in range(n)], 40)[2]
        assert len(fill) <= len(plain) + 1


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, None, None)], "doc_id long, text string, bin int")).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 1), (1, 2), (1, 2)]


def test_best_fit_prefers_the_fullest_bin():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert fills == [10, 10] and bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8]
