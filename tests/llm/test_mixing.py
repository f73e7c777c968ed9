from collections import defaultdict

from tempora.llm import mixing


def test_small_sources_reach_their_targets(spark):
    rows = [(f"large{i}", "w " * 500) for i in range(6) for _ in range(20)]
    rows += [(f"small{i:02}", "w " * (1 + 7 * i % 40)) for i in range(30)] + [(None, "w w w"), ("empty", "")]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs, n_slots=128).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = int(r.target)
    assert len(taken) == 38 and dict(taken) == target
