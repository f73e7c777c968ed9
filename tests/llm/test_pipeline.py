import zlib

import pandas as pd
import pyarrow as pa

import corpus_pipeline as pipeline
from tempora.llm import langid, mixing, repeats, simhash
from tempora.llm.common import BATCH_BYTES, materialize

SF = "/root/testdata/sf0.001"


def test_stages_over_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    n = docs.count()
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns and kept[-1].count() > 0, name
    known, single, cut, mixed = kept[1:]
    model = langid.train(docs)
    want = [r.doc_id for r in docs.collect() if (p := model.predict([(r.text or "").encode() or None])) and p[0][0] != "und" and p[1][0] >= 0.4]
    assert sorted(r.doc_id for r in known.collect()) == sorted(want) and len(want) > 0.9 * n
    groups = {r.component_id for r in simhash.near_duplicates(known, shingle=5, similarity=0.8).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups)

    rows = sorted(single.collect(), key=lambda r: r.doc_id)
    seen, texts = set(), {}
    for r in rows:
        b = r.text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if (w := b[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left or not b:
            texts[r.doc_id] = left
    assert {r.doc_id: r.text for r in cut.collect()} == texts and all(r.n_chars == len(r.text) for r in cut.collect())
    plan = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(cut).collect()}
    got = pd.Series([r.doc_id for r in mixed.collect()]).value_counts().to_dict()
    assert got == {d: k for d, k in plan.items() if k}
    pieces = pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    assert sum(p.length for p in pieces if p.piece == 0) > 0 and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert {p.doc_id for p in pieces} == set(got)


def test_without_repeats_keeps_one_of_repeated_rows(spark):
    a = "".join(f"{i} wörd " for i in range(60))
    rows = [(1, a, 5), (1, a, 6), (2, "é" + a[8:], 7), (3, None, 8), (4, "x", 9)]
    got = sorted((r.doc_id, r.text) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, _n int")).collect())
    assert got == [(1, a), (2, "é"), (3, None), (4, "x")] and zlib.crc32(b"") == 0


def test_batches_of_texts_are_bounded_by_bytes(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some words ', 1000) AS text")  # 33 MB

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    got = [r.n for r in materialize(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) > 33_000_000 and max(got) < 2 * BATCH_BYTES
