import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from tempora.llm import chroma


def test_alignment_recall_and_exact_classes(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(0, 0.25, 64) for _ in range(40)]
    rows, truth = [], {}
    for i, v in enumerate(base):
        rows.append((50 * i, chroma.render(v)))
        if i % 2:  # a part of it, shifted and with noise
            x = np.frombuffer(chroma.render(v[8:56])[44:], "<i2") + rng.normal(0, 150, 48 * 400)
            blob = chroma.render(v[8:56])[:44] + np.clip(x, -32000, 32000).astype("<i2").tobytes()
            rows.append((50 * i + 1, blob))
            truth[50 * i] = 50 * i + 1
    rows += [(7, rows[0][1]), (8, b""), (9, None), (None, rows[2][1]), (11, b"RIFFjunk")]
    df = spark.createDataFrame(rows, "id long, audio binary")
    got = {r.id: r for r in chroma.identify(df).collect()}
    assert got[7].class_id == 0 and got[0].class_id == 0 and got[8].class_id is None and got[9].n_ints == got[11].n_ints == 0
    # brute force over all pairs and offsets
    fp = {r.id: np.array(r.fp) for r in chroma.fingerprints(df).collect() if r.id is not None}
    want = {(q, o) for q in fp for o in fp if q % 50 == 0 and o not in (q, 7) and len(fp[o]) and len(fp[q]) and any((e := chroma.bit_errors(fp[q], fp[o], k))[0] >= 16 and e[1] <= 0.15 for k in range(-60, 61))}
    assert set(truth.items()) <= want
    found = {q for q in got if q is not None and got[q].is_query and got[q].n_links}
    assert len(found & {q for q, _ in want}) >= 0.9 * len({q for q, _ in want})
    hit = [q for q, o in truth.items() if got[q].best_class == o and abs(got[q].best_offset + 16) <= 1]
    assert len(hit) >= 0.9 * len(truth)


def shifted(v, by, noise, rng):
    """The same notes, cut by some samples and with noise."""
    blob = chroma.render(v)
    x = np.frombuffer(blob[44:], "<i2")[by:]
    x = np.clip(x + rng.normal(0, noise, len(x)), -32000, 32000).astype("<i2").tobytes()
    return blob[:40] + np.uint32(len(x)).tobytes() + x


def brute(fp, max_error=chroma.MAX_ERROR):
    """The best alignment of all pairs of a query and another, at every offset."""
    want = {}
    for q in (q for q in fp if q % 50 == 0):
        for o in (o for o in fp if o != q):
            tried = [chroma.bit_errors(fp[q], fp[o], k) for k in range(-len(fp[q]), len(fp[o]))]
            if good := [e for n, e in tried if n >= chroma.MIN_OVERLAP and e <= max_error]:
                want[q, o] = min(good)
    return want


def test_recall_of_links_up_to_the_error_allowed(spark):
    """Excerpts, shifts by parts of a hop, noise and changed notes: links against brute force."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(25):
        v = rng.normal(0, 0.125, 64)
        w = v.copy()
        w[rng.choice(64, i % 6, replace=False)] += 0.2
        rows += [(50 * i, chroma.render(v)), (50 * i + 1, shifted(w[i % 20 : 64 - i % 9], 8 * i, 50 * i, rng))]
    df = spark.createDataFrame(rows, "id long, audio binary")
    want = brute({r.id: np.array(r.fp) for r in chroma.fingerprints(df).collect()})
    assert sum((50 * i, 50 * i + 1) in want for i in range(25)) > 14 and max(want.values()) > 0.12
    reps = chroma.classes(chroma.fingerprints(df))
    fp = {r.class_id: np.array(r.fp) for r in reps.collect()}
    got = {(r.query, r.other): r for r in chroma.search(reps.filter("class_id % 50 = 0"), reps).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(chroma.bit_errors(fp[q], fp[o], r.offset) == (r.overlap, r.error) for (q, o), r in got.items())
    assert sum(abs(r.error - want[k]) < 1e-9 for k, r in got.items()) >= 0.9 * len(got)


def test_query_has_links_and_their_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = chroma.op6_chroma_fingerprints(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    fps = chroma.fingerprints(chroma.rendered(vectors)).collect()
    want = brute({r.id: np.array(r.fp) for r in fps})
    got = sum(r.n_links or 0 for r in rows)
    assert len(rows) == len(fps) and len(want) >= 20 and 0.9 * len(want) <= got <= len(want)


def test_every_voted_offset_is_tried(spark):
    """More equal keys at an offset that fails than at the one that passes."""
    rng = np.random.default_rng(2)
    bits = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    jingle, tail = bits(30), bits(40)
    flips = (np.uint32(1) << rng.integers(0, 32, 40).astype(np.uint32)) | (np.uint32(1) << rng.integers(0, 32, 40).astype(np.uint32))
    flips[:14] = 0
    a, b = np.r_[jingle, bits(200), tail], np.r_[tail ^ flips, bits(90), jingle, bits(150)]
    rows = spark.createDataFrame([(1, a.astype(int).tolist()), (2, b.astype(int).tolist()), (3, bits(300).astype(int).tolist())], "class_id long, fp array<long>")
    got = chroma.search(rows.filter("class_id = 1"), rows).collect()
    assert [(r.other, r.offset, r.overlap) for r in got] == [(2, -230, 40)]


def test_held_tones_have_few_keys_and_are_found(spark):
    at, k, run_of = chroma.keys_of(np.full(5000, 77, np.int64))
    assert at.tolist() == [0, 4989] and k[0] == k[1] and run_of.all()
    rows = spark.createDataFrame([(0, [77] * 60), (1, [77] * 90), (2, [1 << 31] * 90)], "class_id long, fp array<long>")
    assert {(r.query, r.other, r.error) for r in chroma.search(rows.filter("class_id = 0"), rows).collect()} >= {(0, 1, 0.0)}


def test_empty_and_odd_columns(spark):
    assert chroma.identify(spark.createDataFrame([], "id long, audio binary")).count() == 0
    blob = chroma.render(np.linspace(-0.3, 0.3, 64))
    df = spark.createDataFrame([(50, blob, 1, "k"), (50, blob, 2, None), (None, blob, 3, "x")], "id long, audio binary, fp int, key string")
    assert {(r.id, r.class_id, r.n_links) for r in chroma.identify(df).collect()} == {(50, 50, 0), (None, 50, None)}


def test_executors_need_no_installation(tmp_path):
    """Functions travel with their code: the workers of a driver elsewhere do not have this package on their path."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(chroma.__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from tempora.llm import chroma, extraction, langid, packing, quality, repeats, simhash, toxicity
import numpy as np
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
blob = chroma.render(np.linspace(-0.3, 0.3, 64))
print("ROWS", chroma.identify(spark.createDataFrame([(50, blob), (51, blob)], "id long, audio binary")).count())
docs = spark.createDataFrame([(1, "one two three four " * 20, "en", "s"), (2, None, "de", "s")], "doc_id long, text string, lang string, source string")
print("ROWS", packing.pack(docs).count(), quality.assess(docs).count(), repeats.remove_repeats(docs).count(), simhash.near_duplicates(docs).count(), langid.predict(docs, langid.train(docs)).count())
print("ROWS", extraction.extract(spark.createDataFrame([(1, "<p>x")], "page_id long, html string")).count(), toxicity.score(docs, toxicity.fit([b"a b", b"c"], np.array([0, 1]), [None, None])).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x.split()[1:] for x in out.stdout.splitlines() if x.startswith("ROWS")] == [["2"], ["2", "2", "2", "2", "2"], ["1", "2"]], out.stderr[-3000:]
