import json

from pyspark.sql import functions as F

from tempora.functions import rules as X
from tempora.operators import prompts as P
from tempora.operators import rules as R
from tempora.sources import files as S

LINE = "1.000000     6     6  Accede_to_demands_for_change_in_institutions,_regime(X0,X2,T3) <- _Consult(X0,X1,T0), _Consult(X1,X0,T1), Demand_change_in_institutions,_regime(X0,X2,T2)"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ints(x):
    return F.lit(None).cast("array<array<int>>") if x is None else F.from_json(F.lit(json.dumps(x)), "array<array<int>>")


def test_inverse_is_an_involution(spark):
    rows = spark.range(10).select("id", X.inverse("id", 5).alias("i"), X.inverse(X.inverse("id", 5), 5).alias("j")).collect()
    assert all(r.id == r.j and r.i == (r.id + 5) % 10 for r in rows)
    assert tuple(one(spark, X.inverse_name(F.lit("a")), X.inverse_name(F.lit("_a")))) == ("_a", "a")


def test_var_constraints(spark):
    def groups(ents):
        return one(spark, X.var_constraints(F.from_json(F.lit(json.dumps(ents)), "array<int>")))[0]

    assert groups([4, 2, 4]) == [[0, 2]] and groups([1, 2, 3]) == [] and groups([1, 2, 1, 2]) == [[0, 2], [1, 3]] and groups([7, 7, 7, 1]) == [[0, 1, 2]]


def test_constraints_hold_when_further_entities_repeat(spark):
    ents = F.array(*map(F.lit, (1, 1, 1)))
    assert tuple(one(spark, X.holds(ints([[0, 1]]), ents), X.holds(ints([]), ents), X.holds(ints([[0, 2]]), F.array(*map(F.lit, (1, 1, 2)))))) == (True, True, False)


def test_verbalize_golden_line(spark):
    body = F.array(F.lit("_Consult"), F.lit("_Consult"), F.lit("Demand_change_in_institutions,_regime"))
    head = F.lit("Accede_to_demands_for_change_in_institutions,_regime")
    assert one(spark, X.verbalized(F.lit(1.0), F.lit(6), F.lit(6), head, body, ints([[0, 2]])))[0] == LINE
    plain = one(spark, X.verbalized(F.lit(0.5), F.lit(12345), F.lit(24690), F.lit("r"), F.array(F.lit("_s")), ints([])))[0]
    assert plain == "0.500000  12345  24690  r(X0,X1,T1) <- _s(X0,X1,T0)"


def test_verbalized_walk(spark):
    names = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, X.verbalized_walk(names("a", "b", "c"), names("r", "s"), names("d1", "d2")))[0] == "a\tr\tb\td1\ts\tc\td2"


def test_parse_rule_lines(spark):
    odd = "0.250000     1     4  Appeal_(such_as_support)(X0,X1,T1) <- Visit(X0,X1,T0)"
    lines = spark.createDataFrame([(LINE,), (odd,), ("no rule",), ("",)], "value string")
    got = {r["head"]: r for r in P.parse_rule_lines(lines).collect()}
    assert set(got) == {"Accede_to_demands_for_change_in_institutions,_regime", "Appeal_(such_as_support)"}
    assert got["Appeal_(such_as_support)"].conf == 0.25 and got["Appeal_(such_as_support)"].body == "Visit(X0,X1,T0)"
    assert {r["head"] for r in P.parse_rule_lines(lines, compat=True).collect()} == {"Accede_to_demands_for_change_in_institutions,_regime", "Appeal_"}


def test_weighted_sample(spark):
    rows = [("a", f"r{i}", float(i % 4)) for i in range(13)] + [("b", f"s{i}", 0.0) for i in range(10)] + [("c", f"t{i}", 0.0) for i in range(11)]
    df = spark.createDataFrame(rows, "head string, rule string, conf double")
    got = R.weighted_sample(df, "head", "conf", "rule", 1).collect()
    n = {h: sum(r["head"] == h for r in got) for h in "abc"}
    assert n == {"a": 7, "b": 10, "c": 6} and sum(r["head"] == "a" and r.conf == 0 for r in got) == 0
    assert sorted(got) == sorted(R.weighted_sample(df.repartition(7), "head", "conf", "rule", 1).collect())


def test_path_format_and_responses(spark):
    assert one(spark, X.path_format(F.lit("father|inv_mother|b"), F.lit("h")))[0] == "h(X,Y) <-- father(X, Z_1) & inv_mother(Z_1, Z_2) & b(Z_2, Y)"
    assert one(spark, X.path_format(F.lit("a"), F.lit("h")))[0] == "h(X,Y) <-- a(X, Y)"
    df = spark.createDataFrame([(1, "h", " x(X,Y) <-- a(X,Y) \n\n.b(X,Y).\nnothing\n"), (2, None, "b(X,Y)"), (3, "h", None)], "response_id long, head string, response string")
    assert sorted((r.response_id, r.rule) for r in P.parse_responses(df).collect()) == [(1, "h(X,Y) <-- b(X,Y)"), (1, "x(X,Y) <-- a(X,Y)")]


def test_completions_skip_what_is_done_and_survive_errors(spark):
    asked = spark.createDataFrame([("a/b", "p1"), ("c d", "p2"), ("e", "p3")], "head string, prompt string")

    def answer(prompt):
        if prompt == "p2":
            raise RuntimeError
        return prompt.upper()

    got = P.complete(asked, answer, done=spark.createDataFrame([("e",)], "head string")).collect()
    assert sorted(map(tuple, got)) == [("a/b", "a-b", "P1"), ("c d", "cd", "")]


def test_statistics_of_counts(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([2, 2, 5, 5, 9])], "rel int, n long")
    r = R.describe_counts(df).first()
    assert (r.relations, r.rules, r["mean"], r["median"], r["mode"], r.stdev, r["min"], r["max"], r.variance) == (5, 23, 4.6, 5.0, 2, 2.88, 2, 9, 8.3)
    assert [x.rel for x in R.top_relations(df, "rel", 3).collect()] == [4, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "rel.json").write_text(json.dumps({"r (a)": 0, "s": 1}))
    (tmp_path / "ent.json").write_text(json.dumps({"x": 0, "y": 1}))
    (tmp_path / "ts.json").write_text(json.dumps({"2014-01-01": 0, "2014-01-02": 1}))
    (tmp_path / "facts.txt").write_text('x\tr (a)\ty\t2014-01-02\ny\ts\tx\t2014-01-01')
    d = lambda n: S.read_dictionary(spark, str(tmp_path / f"{n}.json"))
    quads = S.read_quads(spark, str(tmp_path / "facts.txt"))
    assert sorted(map(tuple, S.encode_quads(quads, d("ent"), d("rel"), d("ts")).collect())) == [(0, 0, 1, 1), (1, 1, 0, 0)]
    (tmp_path / "bad.txt").write_text("x\tnone\ty\t2014-01-02\n")
    try:
        S.encode_quads(S.read_quads(spark, str(tmp_path / "bad.txt")), d("ent"), d("rel"), d("ts")).collect()
        raise AssertionError("an unknown name was taken")
    except Exception as e:
        assert "unknown relation" in str(e)
    rule = {"head_rel": 3, "body_rels": [1, 2], "var_constraints": [[0, 2]], "conf": 0.5, "rule_supp": 1, "body_supp": 2}
    (tmp_path / "rules.json").write_text(json.dumps({"3": [rule, {**rule, "conf": 0.25}]}))
    back = S.read_rules(spark, str(tmp_path / "rules.json"))
    assert [r.rule_rank for r in back.orderBy("rule_rank").collect()] == [0, 1]
    assert json.loads(S.rules_json(back).first().value) == {"3": [rule, {**rule, "conf": 0.25}]}
    (tmp_path / "counts.json").write_text('{"1": [{"a": 1}, {"a": 2}], "2": "x", "3": [{"a": 1}')
    assert {r.relation: r.n for r in S.read_rule_counts(spark, str(tmp_path / "counts.json")).collect()} == {"1": 2, "2": 0, "3": 1}
    (tmp_path / "cands.json").write_text(json.dumps({"0": {"5": 0.5, "6": 0.25}}))
    assert sorted(map(tuple, S.read_candidates(spark, str(tmp_path / "cands.json")).collect())) == [(0, 5, 0.5), (0, 6, 0.25)]
    assert S.rules_file_name("t", [1, 2], 100, "exp", 12) == "t_r[1,2]_n100_exp_s12_rules.json"
    assert S.candidates_file_name("t_r[1]_rules.json", [1, 2], 0, "score_12") == "t_r[1]_cands_r[1,2]_w0_score_12.json"


def test_rule_lines_by_place_as_the_sql_takes_them(spark):
    import duckdb

    from tempora.operators import prompts as P

    lines = ["0.500000     5    10  view(X0,X1,T1) <- click(X0,X1,T0)", "0.250000  12345  49380  view(X0,X1,T1) <- _view(X0,X1,T0)"]
    got = P.parse_rule_lines(spark.createDataFrame([(x,) for x in lines], "value string"), width=22).collect()
    sql = "select regexp_extract(t, '^.{22}(.*?)\\(X0,', 1), substr(t, 23) from (select unnest(?) as t)"
    assert sorted((r.head, r.rule) for r in got) == sorted(duckdb.execute(sql, [lines]).fetchall())
