import random

import xxhash
from pyspark.sql import functions as F

from tempora.llm import simhash


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeé", k=4)) for _ in range(200)]
    docs = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one two"), (5, "ÀB cd")]
    for k in range(30):
        base = rng.choices(vocab, k=300)
        for _ in range(6):
            docs.append((len(docs), " ".join(w if rng.random() > 0.003 else w.upper() + "x" for w in base)))
    docs = [(d + 10, t) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    want = [(d, brute_fp(t)) for d, t in docs]
    assert {d: got[d].fp & (2**64 - 1) for d, _ in docs} == dict(want)
    assert {d: got[d].component_id for d, _ in docs} == brute_components(want)
    assert {r.doc_id for r in simhash.keep_one(df, shingle=3, similarity=None).collect()} == set(brute_components(want).values())


def test_large_buckets_find_the_same_links(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(120):  # a dense group, a chain, and noise
        fps.add(base ^ sum(1 << b for b in rng.sample(range(20), 3)))
    x = rng.getrandbits(64)
    for b in range(0, 60, 2):
        x ^= 3 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(simhash.signed(f),) for _, f in rows], "fp long")
    want = brute_components(rows)
    from tempora.llm.graph import components

    for bucket in (1, 4, 1000):
        comp = {r.node & (2**64 - 1): r.component for r in components(simhash.links(nodes, bucket)).collect()}
        groups = {}
        for i, f in rows:
            groups.setdefault(comp.get(f, simhash.signed(f)), set()).add(i)
        brute = {}
        for i, _ in rows:
            brute.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def similar(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def test_groups_by_similarity_equal_all_pairs(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    passage = rng.choices(vocab, k=40)
    texts = ["", "a", "a b c", "A b  c"]
    for k in range(25):  # copies at similarities around 0.8, some behind a passage that all share
        base = rng.choices(vocab, k=rng.choice([30, 120, 400]))
        for _ in range(5):
            words = [w if rng.random() > 0.02 else w + "x" for w in base]
            texts.append(" ".join((passage if k % 3 == 0 else []) + words))
    base = rng.choices(vocab, k=150)  # a group that is larger than a bucket, with its original
    texts.append(" ".join(base))
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 5])):
            words[at] = rng.choice(vocab) + "y"
        texts.append(" ".join(words))
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string").repartition(5)
    ids, text = [d for d, _ in rows], [t for _, t in rows]
    fps = [simhash.fingerprint(t.encode(), 5) for t in text]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2 or (text[i] and text[j] and similar(text[i], text[j])):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    want = {d: least[find(i)] for i, d in enumerate(ids)}
    got = simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()
    assert len(got) == len(rows) + 20 and {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 100
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))


def test_pairs_of_members_of_two_pivots_are_judged(spark):
    # two originals that are not linked, and a text near either; a link of those two joins the groups
    rng = random.Random(4)
    base, x, y = (["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)] for n in (204, 48, 48))

    def near(at, tail):
        return [*base[:at], "changed", *base[at + 1 :], *tail[:12]]

    texts = [" ".join(t) for t in ([*base, *x], [*base, *y], near(20, x), near(60, y))]
    assert [(i, j) for i in range(4) for j in range(i) if similar(texts[i], texts[j])] == [(2, 0), (3, 1), (3, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1).persist()
    nodes = simhash.prefixes(df, 5, 0.8, simhash.np.empty(0, "<u8")).persist()
    bucket = nodes.select(F.lit(1).cast("long").alias("h"), "k", F.struct("n", "rare", F.lit(0).alias("at")).alias("of"))
    linked = spark.createDataFrame([(1, 2, 0, 0.19), (1, 3, 1, 0.19)], "h long, k long, pivot long, far double")
    pivots = spark.createDataFrame([(1, 0), (1, 1)], "h long, k long")
    found = spark.createDataFrame([(0, 2), (1, 3)], "a long, b long")
    got = simhash.crossing(linked, pivots, bucket, found, nodes, df, 5, 0.8)
    assert [tuple(sorted(r)) for r in got.collect()] == [(2, 3)]
    joined = found.unionByName(got)  # of one group nothing is judged again
    assert simhash.crossing(linked, pivots, bucket, joined, nodes, df, 5, 0.8).count() == 0


def test_texts_that_only_share_a_shingle_do_not_meet(spark):
    # one passage in texts that differ else: all pairs of the bucket met before, of which none is a link
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    passage, base = [word() for _ in range(6)], [word() for _ in range(80)]
    texts = [" ".join([*passage, *(word() for _ in range(80))]) for _ in range(12)] + [" ".join([*passage, *base]), " ".join([*passage, *base[:-1], "x"])]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    nodes = simhash.prefixes(df, 5, 0.8, simhash.np.empty(0, "<u8"))
    parts = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(simhash.PARITY // 64)]
    bucket = nodes.select(F.lit(1).alias("h"), "k", F.struct("n", "rare", F.lit(0).alias("at"), *parts).alias("of"))
    assert sorted(tuple(r) for r in simhash.met(bucket, bucket, ["h"], 0.8).select("a", "b").collect()) == [(12, 13), (13, 12)]
    edges = simhash.similar_links(df.withColumn("k", F.xxhash64("text")), 5, 0.8).collect()
    assert len(edges) == 1


def test_near_copies_meet_in_few_buckets_and_long_unlike_texts_in_none(spark, monkeypatch):
    # four copies that differ by a word meet in about a hundred buckets with the same members; long texts that share a
    # passage have an odd number of shingles on half of few places, whatever they are
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    base, passage = [word() for _ in range(600)], [word() for _ in range(6)]
    copies = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in (50, 200, 350, 500)]
    unlike = [" ".join([*passage, *(word() for _ in range(rng.choice([1000, 1030])))]) for _ in range(12)]
    df = spark.createDataFrame([(t,) for t in copies + unlike], "text string").withColumn("k", F.xxhash64("text")).coalesce(1)
    rows, met = [], simhash.met

    def counted(*a):
        rows.append(met(*a).count())
        return met(*a)

    monkeypatch.setattr(simhash, "met", counted)
    edges = [(r.a, r.b) for r in simhash.similar_links(df, 5, 0.8).collect()]
    fps = {simhash.fingerprint(t.encode(), 5) for t in copies}
    assert fps == {x for e in edges for x in e} and 0 < sum(rows) < 200


def test_parities_of_twice_as_many_places_are_added_up(spark):
    # 1,020 and 1,030 shingles: 1,024 and 2,048 places; one text is the other's beginning
    words = [f"w{i}" for i in range(1034)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:1024]))], "k long, text string").coalesce(1)
    nodes = simhash.prefixes(df, 5, 0.8, simhash.np.empty(0, "<u8")).persist()
    assert sorted(len(r.wide) for r in nodes.collect()) == [16, 32]
    bucket = nodes.select(F.lit(1).alias("h"), "k", F.struct("n", "rare", F.lit(0).alias("at"), "wide").alias("of"))
    assert sorted(tuple(r) for r in simhash.met(bucket, bucket, ["h"], 0.8).select("a", "b").collect()) == [(1, 2), (2, 1)]


def test_empty_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " "), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(nothing).collect()] == [1]
    odd = spark.createDataFrame([(1, "a b c", 5, "x"), (1, "a b c", 5, "x"), (None, "a b c", 6, None)], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}
    assert simhash.keep_one(odd).select("doc_id", F.col("fp")).collect() == [(1, 5)]


def test_keep_one_keeps_different_texts_of_null_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, b), (None, a), (5, c), (5, d), (6, c), (None, d)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(0, a), (0, b), (5, c), (5, d)])
