import hashlib
import random

import numpy as np
import xxhash

from tempora.llm import repeats


def brute(docs, length=100):
    """docs: (doc_id, text) in order; removed spans of each row."""
    seen, out = set(), []
    for _, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = []
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
            own.append(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=160):
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    passages = [say(40) for _ in range(4)]
    common = say(30)
    docs = [None, "", "short", "a" * 1000, "a" * 700, "ab" * 300, say(19), "x" * 99, "x" * 100, "x" * 101, say(9) + "ed, " * 300 + say(5) + "ed, " * 90, "ab cd " * 40, say(30) + "xy" + "0123456789" * 11 + "zz" + "abcdefghijklmnopqrstuvwxyz" * 9]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and len(docs) > 15:
            t = rng.choice(docs[10:])
        elif kind < 0.45 and len(docs) > 15:
            t = list(rng.choice(docs[10:]))
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice("zq")
            t = "".join(t)
        else:
            t = say(rng.randint(5, 150))
        if rng.random() < 0.5:
            t = say(rng.randint(0, 20)) + rng.choice(passages)[rng.randint(0, 40) :] + t
        docs.append(say(3) + common + t if rng.random() < 0.5 else t)
    return [(i * 3, t) for i, t in enumerate(docs)]


def query(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(df, **options).collect()}


def test_equals_brute_force(spark):
    docs = corpus(random.Random(4))
    want = dict(zip([d for d, _ in docs], brute(docs), strict=True))
    shuffled = docs[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    for options in ({}, {"crowd": 2}, {"shard_bytes": 4000}, {"heavy": 1}, {"heavy": 3, "crowd": 5}):
        got = query(df, **options)
        assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_small_holds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD_BYTES", 500)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 3000)
    docs = corpus(random.Random(9), 60)
    want = dict(zip([d for d, _ in docs], brute(docs), strict=True))
    got = query(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), crowd=2)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_index_is_the_suffix_array_in_runs():
    rng = random.Random(2)
    base = bytes(rng.choices(b"ab", k=150))
    strings = [base, base[10:], bytes(rng.choices(b"ab", k=120)), base[:140] + b"z", base]
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(data))
    suffix = [bytes(data[i : i + left[i]]) for i in range(len(data))]
    order = sorted(range(len(data)), key=lambda i: (suffix[i], i))
    assert repeats.suffix_order(data, left).tolist() == order
    index = repeats.run_length_index(data, left, begins)
    assert len(index[0]) < len(data)
    length, place = repeats.stream_matches(len(data), index)
    for a, b in zip(order, order[1:], strict=False):
        n = next((k for k in range(min(len(suffix[a]), len(suffix[b]))) if suffix[a][k] != suffix[b][k]), min(len(suffix[a]), len(suffix[b])))
        assert place[b] == a and length[b] == n


def test_buckets_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PARTITIONS", 3)
    docs = corpus(random.Random(11), 80)
    want = dict(zip([d for d, _ in docs], brute(docs), strict=True))
    got = query(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=2000)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_odd_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    a, b = "p" * 30 + "".join(map(str, range(100))), "".join(map(str, range(200)))
    rows = [(1, a, 1), (1, a, 1), (1, b, 2), (None, a, 3), (2, None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_bytes - len(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, bucket int")).collect())
    first = xxhash.xxh64_intdigest(a.encode(), 42) >> 1 < xxhash.xxh64_intdigest(b.encode(), 42) >> 1
    assert (2, 0, 0) in got and (99, len(a), len(a)) in got and (1, len(a), len(a)) in got
    assert sum(x[2] for x in got) == (2 * len(a) + len(a) - 30 if first else 3 * len(a) - 30)


def test_rows_without_ids_are_judged_by_their_texts(spark):
    """Null ids, one id for all, and the greatest id beside null: each text is cut where it repeats one before it."""
    rng = random.Random(6)
    texts = sorted({t for _, t in corpus(rng, 60) if t}, key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 1)
    for doc_id in (None, 5):
        df = spark.createDataFrame([(doc_id, t, "x") for t in rng.sample(texts, len(texts))], "doc_id long, text string, key string").repartition(4)
        got = sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(df, shard_bytes=3000).collect())
        assert got == sorted(brute([(0, t) for t in texts]))
    last = (1 << 63) - 1
    df = spark.createDataFrame([(None, "x" * 10 + texts[0] * 3), (last, "x" * 10 + texts[0] * 3)], "doc_id long, text string")
    kept = {r.doc_id: len(r.kept) for r in repeats.remove_repeats(df).collect()}
    assert kept[None] == 0 < kept[last]


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    rng = random.Random(11)
    strings = ["".join(rng.choices("abcdefgh", k=200)).encode() for _ in range(40)]
    strings += [strings[0][:150] + b"z" * 50, strings[0], b"ab" * 60, b"ab" * 60]
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    text = data.tobytes()
    want = sorted(range(len(data)), key=lambda i: (text[i : i + left[i]], i))
    sorted_so_far = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_so_far.append(len(x)) or argsort(x, *a, **k))
    assert repeats.suffix_order(data, left).tolist() == want
    assert sum(sorted_so_far) < 3 * len(data)
