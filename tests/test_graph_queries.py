import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tempora.operators import apply as A
from tempora.operators import evaluate as V
from tempora.operators import graph as G
from tempora.operators import rules as R
from tempora.operators import walks as K
from tempora.plans import catalogue as C

SF = "/root/testdata/sf0.001"
EDGES = "eid long, sub long, rel long, obj long, ts long, split string"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["edges_with_inverse", "split_counts", "new_entities", "window_edges_w7", "window_edges_learn", "cyclic_walks_l2", "no_backtrack_effect", "walk_start_sample", "walk_next_uniform", "walk_exp_choice", "sampled_walks", "sampled_walks_l3", "rule_support_l1", "rule_support_sampled", "rule_support_l3", "early_stop_rank", "candidates_in_order", "rules_ranked", "rule_lines_sampled", "noisy_or", "answer_rank_best", "answer_rank_average", "answer_rank_worst", "metrics", "rel_obj_dist", "llm_response_parse", "path_format"])
def test_query_equals_sql(spark, duck, name):
    got, want = C.QUERIES[name](spark, SF).toPandas(), duck.sql(C.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def graph(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDGES)


def test_no_backtrack_bites_on_self_loops(spark):
    # a self-loop start, its inverse at the same time, and another way home
    g = graph(spark, [(1, 0, 1, 9, "train"), (1, 1, 2, 5, "train"), (2, 4, 1, 5, "train"), (2, 3, 1, 4, "train")])
    kept = K.cyclic_walks(g, 3, 3).collect()
    assert sorted(tuple(w.rels) for w in kept) == [(0, 1, 3)] and K.cyclic_walks(g, 3, 3, no_backtrack=False).count() == 2


def test_walk_underflow_is_uniform_and_bad_names_fail(spark):
    g = graph(spark, [(1, 0, 2, 5000, "train"), (2, 1, 1, 3, "train"), (2, 2, 1, 2, "train")])
    state = spark.createDataFrame([("w", 1, 0, 2, 5000, 1)], "walk string, prev_sub long, prev_rel long, at long, now long, start long")
    far = {K.next_edges(g, state, True, "exp", s, 3).first().eid for s in range(12)}
    near = {K.next_edges(g, state.withColumn("now", F.lit(4)), True, "unif", s, 3).first().eid for s in range(12)}
    assert far == near == {1, 2}
    with pytest.raises(ValueError):
        K.next_edges(g, state, True, "other", 1, 3)
    with pytest.raises(ValueError):
        G.in_window(F.lit(1), F.lit(1), F.lit("train"), -2)


def test_support_of_duplicates_and_patterns(spark):
    rows = [(1, 0, 2, 1, "train"), (1, 0, 2, 1, "train"), (1, 1, 2, 2, "train"), (3, 0, 3, 1, "train"), (4, 0, 5, 7, "train"), (4, 1, 5, 7, "train")]
    rules = spark.createDataFrame([(1, [0], []), (1, [0], [[0, 1]]), (1, [2], [])], "head_rel long, body_rels array<long>, var_constraints array<array<int>>")
    got = {(tuple(r.body_rels), str(r.var_constraints)): (r.rule_supp, r.body_supp, r.conf) for r in R.support(rules, graph(spark, rows)).collect()}
    # a later head only: the one at the same time does not count
    assert got == {((0,), "[]"): (1, 3, 0.333333), ((0,), "[[0, 1]]"): (0, 1, 0.0), ((2,), "[]"): (0, 0, 0.0)}


def test_support_of_length_three_by_brute_force(spark):
    import random

    rng = random.Random(11)
    rows = list({(rng.randint(1, 5), rng.randint(0, 2), rng.randint(1, 5), rng.randint(0, 6), "train") for _ in range(70)})
    wanted = [(h, b, v) for h in (0, 1) for b in ([0, 1, 2], [1, 1, 0], [2, 0]) for v in ([], [[0, 2]], [[0, 1], [2, 3]]) if not v or max(map(max, v)) <= len(b)]
    want = {}
    for h, b, v in wanted:
        paths = [((s, o), t) for s, r, o, t, _ in rows if r == b[0]]
        for rel in b[1:]:
            paths = [((*e, o), x) for e, t in paths for s, r, o, x, _ in rows if s == e[-1] and r == rel and x >= t]
        same = lambda e: sorted(g for g in ([i for i in range(len(e)) if e[i] == x] for x in set(e)) if len(g) > 1)
        paths = [(e, t) for e, t in paths if not v or same(e) == v]
        hits = sum(any(s == e[0] and o == e[-1] and r == h and x > t for s, r, o, x, _ in rows) for e, t in paths)
        want[h, tuple(b), str(v)] = (hits, len(paths))
    rules = spark.createDataFrame(wanted, "head_rel long, body_rels array<long>, var_constraints array<array<int>>")
    got = {(r.head_rel, tuple(r.body_rels), str(r.var_constraints)): (r.rule_supp, r.body_supp) for r in R.support(rules, graph(spark, rows)).collect()}
    assert got == want and any(x for x, _ in want.values())


def test_half_even_confidence(spark):
    # 1/128 = 0.0078125: half-even at six digits
    assert spark.range(1).select(F.bround(F.lit(1) / F.lit(128), 6)).first()[0] == 0.007812


def brute_apply(edges, queries, rules, window):
    out = Counter()
    for qid, s, r, _, t in queries:
        for head, rank, body, vc in rules:
            if head != r:
                continue
            paths = [((s,), ())]
            for rel in body:
                paths = [((*e, o), (*ts, x)) for e, ts in paths for a, b, o, x, sp in edges if a == e[-1] and b == rel and (not ts or x >= ts[-1]) and ((x < t and (not window or x >= t - window)) if window >= 0 else sp == "train")]
            for e, ts in paths:
                if all(len({e[i] for i in g}) == 1 for g in vc):
                    k = (qid, rank, e[-1])
                    out[k] = max(out.get(k, -1), ts[0])
    return dict(out)


@pytest.mark.parametrize("window", [0, 3, -1])
def test_apply_equals_brute_force(spark, window):
    import random

    rng = random.Random(7)
    rows = [(rng.randint(1, 5), rng.randint(0, 2), rng.randint(1, 5), t := rng.randint(0, 9), "train" if t < 7 else "test") for _ in range(60)]
    queries = [(i, rng.randint(1, 5), rng.randint(0, 2), 1, rng.randint(6, 9)) for i in range(8)]
    rules = [(h, 10 * h + k, b, v) for h in range(3) for k, (b, v) in enumerate([([0], []), ([1], [[0, 1]]), ([1, 2], []), ([0, 1], [[0, 2]]), ([2, 0, 1], []), ([0, 0, 1], [[0, 2], [1, 3]])])]
    df = spark.createDataFrame([(h, r, b, v, 1, 2) for h, r, b, v in rules], "head_rel long, rule_rank long, body_rels array<long>, var_constraints array<array<int>>, rule_supp long, body_supp long")
    q = spark.createDataFrame(queries, "qid long, sub long, rel long, obj long, ts long")
    got = {(r.qid, r.rule_rank, r.cand): r.start for r in A.apply_rules(q, df, graph(spark, rows), window).collect()}
    assert got == brute_apply(rows, queries, rules, window)


def test_rules_of_length_three_carry_no_plan(spark):
    # with the plan that found them, what applies them did not fit 1 GB of the driver on any table
    rules = C.mined3(spark, SF, 2)
    assert rules.count() and "Join" not in rules._jdf.queryExecution().toString()


def test_early_stop_equals_the_definition(spark):
    import random

    rng = random.Random(3)
    rows = [(q, k, c, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5])) for q in range(12) for k in range(6) for c in range(8) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "qid long, rule_rank long, cand long, score double")
    want = {}
    for q in range(12):
        mine = [r for r in rows if r[0] == q]
        want[q] = max(r[1] for r in mine)
        for k in sorted({r[1] for r in mine}):
            lists = {}
            for _, rank, c, s in mine:
                if rank <= k:
                    lists.setdefault(c, []).append(s)
            top = sorted((sorted(v, reverse=True) for v in lists.values()), reverse=True)[:4]
            if len(lists) >= 4 and len(set(map(tuple, top))) == 4:
                want[q] = k
                break
    assert {r.qid: r.last_rank for r in A.early_stop(df, 4).collect()} == want


def test_noisy_or_of_a_certain_score_and_grid(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 0.2), (1, 6, 0.5), (1, 6, 0.5)], "qid long, cand long, score double")
    assert {r.cand: (r.scores, r.score) for r in A.candidate_lists(df).collect()} == {5: ([1.0, 0.2], 1.0), 6: ([0.5, 0.5], 0.75)}
    m = spark.createDataFrame([(1, 2, 4, 10, 12)], "qid long, rule_supp long, body_supp long, start long, q_ts long")
    got = {(r.lmbda, r.a): r.score for r in A.score_grid(m, [(0.1, 0.5), (0.5, 0.0)]).collect()}
    assert math.isclose(got[0.1, 0.5], 0.25 + 0.5 * math.exp(-0.2)) and math.isclose(got[0.5, 0.0], math.exp(-1.0))
    plain = A.score_candidates(m, lambda rs, bs, start, now: rs / (bs + 4)).first().score
    assert plain == 0.25


def test_ranks_filter_and_baseline(spark):
    q = spark.createDataFrame([(0, 1, 0, 7, 5), (1, 1, 0, 8, 5), (2, 2, 1, 9, 5), (3, 2, 4, 9, 6)], "qid long, sub long, rel long, obj long, ts long")
    c = spark.createDataFrame([(0, 7, 0.5), (0, 8, 0.9), (0, 6, 0.5), (0, 5, 0.5), (1, 7, 0.4), (1, 8, 0.3)], "qid long, cand long, score double")
    f = V.filter_other_answers(q, c)
    assert sorted((r.qid, r.cand) for r in f.collect()) == [(0, 5), (0, 6), (0, 7), (1, 8)]  # 8 and 7 are true answers too
    rank = lambda s: {r.qid: r["rank"] for r in V.ranks(q, f, 99, s).collect()}
    assert rank("best") == {0: 1, 1: 1, 2: 99, 3: 99} and rank("worst")[0] == 3 and rank("average")[0] == 2
    m = V.metrics(V.ranks(q, f, 99)).first()
    assert (m.hits1, m.hits10, m.mrr) == (0.5, 0.5, round((2 + 2 / 99) / 4, 6))
    rel = spark.createDataFrame([(1, 9, 0.75)], "rel long, obj long, p double")
    every = spark.createDataFrame([(3, 0.5)], "obj long, p double")
    assert sorted(map(tuple, V.with_baseline(q, f, rel, every).filter("qid > 1").collect())) == [(2, 9, 0.75), (3, 3, 0.5)]
    with pytest.raises(ValueError):
        V.ranks(q, f, 9, "middle")


def test_counts_without_candidates_equal_those_of_all_matches(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(1, 6), rng.randint(0, 3), rng.randint(1, 6), rng.randint(0, 9), "train") for _ in range(70)]
    queries = [(i, rng.randint(1, 8), rng.randint(0, 3), 1, rng.randint(1, 9)) for i in range(30)]
    rules = [(0, 1, [1], [], 1, 2), (0, 2, [2], [[0, 1]], 1, 4), (1, 1, [3], [[0, 1]], 1, 3), (2, 1, [0], [], 2, 3)]
    df = spark.createDataFrame(rules, "head_rel long, rule_rank long, body_rels array<long>, var_constraints array<array<int>>, rule_supp long, body_supp long")
    q = spark.createDataFrame(queries, "qid long, sub long, rel long, obj long, ts long")
    every = A.apply_rules(q, df, graph(spark, rows)).collect()
    by = {i: (s, r, t) for i, s, r, _, t in queries}
    assert {tuple(r) for r in A.answered_contexts(q, df, graph(spark, rows)).collect()} == {by[m.qid] for m in every} != set(by.values())
    got = {(r.q_ts, r.head_rel, r.rule_rank, r.start): r.m for r in A.counted_starts(q, df, graph(spark, rows)).collect()}
    assert got == Counter((m.q_ts, m.head_rel, m.rule_rank, m.start) for m in every)


def test_contexts_are_matched_once_and_ranked_as_each_query(spark):
    asked = spark.createDataFrame([(q, s, 0, o, 9) for q, (s, o) in enumerate([(1, 5), (1, 6), (1, 6), (1, 9), (2, 5), (1, 7)])], "qid long, sub long, rel long, obj long, ts long")
    scores = {1: {5: 0.5, 6: 0.7, 7: 0.5, 8: 0.5, 4: 0.9, 3: 0.1}, 2: {5: 0.2, 6: 0.2, 7: 0.3}}
    contexts = G.contexts_of(asked).collect()
    assert sorted((r.qid, r.sub) for r in contexts) == [(0, 1), (4, 2)]
    c = spark.createDataFrame([(r.qid, k, v) for r in contexts for k, v in scores[r.sub].items()], "qid long, cand long, score double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    listed = V.filter_other_answers(asked, G.for_queries(c, asked))
    assert rows(V.filtered_by_context(G.in_contexts(asked), c)) == rows(listed) and G.for_queries(c, asked).count() == 5 * 6 + 3
    for setting in ("best", "average", "worst"):
        assert rows(V.ranks_by_context(G.in_contexts(asked), c, 77, setting)) == rows(V.ranks(asked, listed, 77, setting))


def test_matches_do_not_grow_with_the_queries_of_a_context(spark, monkeypatch):
    g = graph(spark, [(1, 0, 2, 1, "train"), *[(1, 1, 2, 30, "test")] * 5])
    rules = spark.createDataFrame([(1, [0], [], 1, 2, 1)], "head_rel long, body_rels array<long>, var_constraints array<array<int>>, rule_supp long, body_supp long, rule_rank int")
    monkeypatch.setattr(C, "events_graph", lambda *_: g.withColumn("is_inverse", F.lit(False)))
    monkeypatch.setattr(C, "usable", lambda *_: rules)
    assert C.matched(spark, SF).count() == 1 and sorted(r.qid for r in C.noisy_or(spark, SF).collect()) == [0, 1, 2, 3, 4]


def test_rules_of_two_by_counts_equal_listed_walks(spark):
    import random

    from tempora.operators import triangles as T

    rng = random.Random(5)
    rows = [(rng.randint(1, 5), rng.randint(0, 2), rng.randint(1, 5), rng.randint(0, 6), "train") for _ in range(50)]
    g = G.with_inverses(graph(spark, [*rows, *rows[:9]]), 3).persist()
    key = lambda r: (r.head_rel, tuple(r.body_rels), str(r.var_constraints))
    closed = T.closed_walks(g, 3).collect()
    assert sum(r.n_walks for r in closed) == K.cyclic_walks(g, 3, 3).count()
    assert sum(r.n_walks + r.n_back for r in closed) == K.cyclic_walks(g, 3, 3, no_backtrack=False).count()
    want = R.support(R.rules_from_walks(K.cyclic_walks(g, 3, 3), 3), g, longest=2).collect()
    got = {key(r): (r.rule_supp, r.body_supp, r.conf) for r in T.rules_of_two(g, 3).collect()}
    assert got == {key(r): (r.rule_supp, r.body_supp, r.conf) for r in want} and len(got) > 50


def test_no_walk_through_a_hub_is_listed(spark):
    from tempora.operators import triangles as T

    # all 400 edges meet in one node: 400 * 399 / 2 open walks through it, and no triangle
    rows = [(n, 0, 1000, n % 7, "train") for n in range(200)] + [(1000, 1, n, n % 7, "train") for n in range(200, 400)]
    w = T.closed_walks(graph(spark, rows), 3)
    assert w.count() == 0


@pytest.mark.parametrize("window", [0, 3, -1])
def test_rules_of_two_by_blocks_equal_listed_matches(spark, window, monkeypatch):
    import random

    from tempora.operators import pairs as D

    monkeypatch.setattr(D, "CELLS", 7)  # blocks are cut too
    rng = random.Random(9)
    rows = [(rng.randint(1, 5), rng.randint(0, 2), rng.randint(1, 5), t := rng.randint(0, 9), "train" if t < 7 else "test") for _ in range(60)]
    g = graph(spark, [*rows, *rows[:9]])
    q = spark.createDataFrame([(i, rng.randint(1, 5), rng.randint(0, 2), 1, rng.randint(6, 9)) for i in range(12)], "qid long, sub long, rel long, obj long, ts long")
    forms = [[], [[0, 1]], [[0, 2]], [[1, 2]], [[0, 1, 2]]]
    rules = [(h, 100 * h + 10 * k + i, [a, b], v, 1, 2) for h in range(3) for k, (a, b) in enumerate([(0, 1), (2, 2), (1, 0)]) for i, v in enumerate(forms)]
    df = spark.createDataFrame(rules, "head_rel long, rule_rank long, body_rels array<long>, var_constraints array<array<int>>, rule_supp long, body_supp long")
    loose = df.filter(F.size("var_constraints") == 0)
    listed = A.apply_rules(q, df, g, window).select("qid", "rule_rank", "cand", "start", "n_walks").collect()
    is_loose = lambda r: r.rule_rank % 10 == 0
    key = lambda rs: sorted(map(tuple, rs))

    packed = D.of_rules(D.loose_lists(q, loose, g, window), q, loose).select("qid", "rule_rank", F.inline(F.arrays_zip("cands", "starts", "walks")))
    assert key(packed.collect()) == key(filter(is_loose, listed)) != []
    tied = D.of_rules(D.tied_matches(q, g, window), q, df)
    assert key(tied.collect()) == key(r for r in listed if not is_loose(r)) != []
    told = {}
    for r in filter(is_loose, listed):
        n, m, t = told.get((r.qid, r.rule_rank), (0, 0, 0))
        told[r.qid, r.rule_rank] = n + 1, m + r.n_walks, t + (r.cand + 1) * (r.start + 1)
    got = D.of_rules(D.loose_totals(q, loose, g, window), q, loose).collect()
    assert {(r.qid, r.rule_rank): (r.n_cands, r.n_walks, r.told) for r in got} == told

    walks = D.listed_walks(q, df, g, window, lambda s, b0, x1, t0, b1, x2, t1: F.concat_ws(" ", *[x.cast("string") for x in (s, b0, x1, t0, b1, x2, t1)])).collect()
    want = Counter((r.qid, r.rule_rank, f"{r.ents[0]} {r.rels[0]} {r.ents[1]} {r.tss[0]} {r.rels[1]} {r.ents[2]} {r.tss[1]}") for r in A.explained_walks(q, df, g, window, 2).collect())
    assert {(r.qid, r.rule_rank, r.walk): r.n for r in walks} == want and len(walks) == len(want)


@pytest.mark.parametrize("name", ["apply_walks_l2", "apply_walks_constrained", "apply_walks_l2_best", "apply_walks_complete"])
def test_pairs_equal_sql(spark, duck, name):
    got, want = C.QUERIES[name](spark, SF).toPandas(), duck.sql(C.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[cols].astype(object).itertuples(index=False, name=None)))
    assert cols == sorted(got.columns) and rows(got) == rows(want)


def test_complete_walks_are_those_of_all_rules(spark):
    rules = C.ranked2(spark, SF)
    assert "Join" not in rules._jdf.queryExecution().toString()  # nor do they carry the plan that found them
    loose = {(r.head_rel, r.rule_rank) for r in rules.filter(F.size("var_constraints") == 0).collect()}
    heads = {r.qid: r.rel for r in G.queries_of(C.events_graph(spark, SF)).collect()}
    shown = {(heads[r.qid], r.rule_rank) for r in C.apply_walks_complete(spark, SF).collect()}
    assert shown & loose and shown - loose


def test_rules_of_one_by_counts_equal_listed_walks(spark):
    import random

    from tempora.operators import triangles as T

    rng = random.Random(6)
    rows = [(rng.randint(1, 6), rng.randint(0, 2), rng.randint(1, 6), rng.randint(0, 6), "train") for _ in range(40)]
    rows += [(9, 0, 9, 1, "train"), (9, 1, 9, 4, "train")]
    g = G.with_inverses(graph(spark, [*rows, *rows[:9]]), 3).persist()
    key = lambda r: (r.head_rel, tuple(r.body_rels), str(r.var_constraints))
    listed = R.support(R.rules_from_walks(K.cyclic_walks(g, 2, 3), 3), g, longest=1).collect()
    got = {key(r): (r.rule_supp, r.body_supp, r.conf) for r in T.rules_of_one(g).collect()}
    assert got == {key(r): (r.rule_supp, r.body_supp, r.conf) for r in listed} and len(got) > 20
    loops = G.with_inverses(graph(spark, rows[-2:]), 3)  # no rule without constraints comes of loops alone
    assert {key(r)[2] for r in T.rules_of_one(loops).collect()} == {"[[0, 1]]"}


def test_rules_of_one_are_applied_as_any_and_matched_without_lists(spark):
    import random

    rng = random.Random(8)
    g = graph(spark, [(rng.randint(1, 6), rng.randint(0, 3), rng.randint(1, 6), rng.randint(0, 9), "train") for _ in range(70)])
    q = spark.createDataFrame([(i, rng.randint(1, 8), rng.randint(0, 3), 1, rng.randint(1, 9)) for i in range(30)], "qid long, sub long, rel long, obj long, ts long")
    rules = [(0, 1, [1], [], 1, 2), (0, 2, [2], [[0, 1]], 1, 4), (1, 1, [3], [[0, 1]], 1, 3), (2, 1, [0], [], 2, 3)]
    df = spark.createDataFrame(rules, "head_rel long, rule_rank long, body_rels array<long>, var_constraints array<array<int>>, rule_supp long, body_supp long")
    every, got = A.apply_rules(q, df, g), A.apply_rules_of_one(q, df, g)
    rows = lambda x: sorted(map(tuple, x.select(*every.columns).collect()))
    assert rows(got) == rows(every) != []
    contexts = A.apply_rules_of_one(G.contexts_of(q), df, g)
    spread = G.for_queries(contexts, q)
    assert rows(spread) == rows(every) and "explode" in spread._jdf.queryExecution().toString()
