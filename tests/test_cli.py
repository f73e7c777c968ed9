import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tempora import cli
from tempora.operators import prompts as P


def write_folder(tmp_path):
    days = [f"2020-01-{d:02d}" for d in range(1, 11)]
    (tmp_path / "ts2id.json").write_text(json.dumps({d: i for i, d in enumerate(days)}))
    (tmp_path / "relation2id.json").write_text(json.dumps({"asks": 0, "answers": 1}))
    (tmp_path / "entity2id.json").write_text(json.dumps({x: i for i, x in enumerate("abcd")}))
    facts = [f"{s}\t{r}\t{o}\t{days[t]}" for s, o in (("a", "b"), ("c", "d"), ("b", "c")) for t, r in ((0, "asks"), (2, "answers"), (4, "asks"), (6, "answers"))]
    (tmp_path / "train.txt").write_text("\n".join(facts))
    (tmp_path / "valid.txt").write_text(f"a\tasks\tb\t{days[7]}\n")
    (tmp_path / "test.txt").write_text(f"a\tanswers\tb\t{days[8]}\nc\tanswers\td\t{days[8]}\n")


def test_learn_apply_evaluate(spark, tmp_path):
    write_folder(tmp_path)
    graph = cli.load(spark, str(tmp_path))
    cli.learn(graph, [1]).write.parquet(str(tmp_path / "rules"))
    rules = spark.read.parquet(str(tmp_path / "rules"))
    best = rules.filter("head_rel = 1 and rule_rank = 1").first()
    assert list(best.body_rels) == [0] and best.conf == 1.0 and best.body_supp == 6
    cli.apply(graph, rules, [1], stop_k=2).write.parquet(str(tmp_path / "candidates"))
    m = cli.evaluate(graph, spark.read.parquet(str(tmp_path / "candidates"))).first()
    # of the inverse queries, b also asked c and d answered only c
    assert m.hits3 == 1.0 and m.mrr >= 0.75


SESSION = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "{parts}").config("spark.sql.autoBroadcastJoinThreshold", "-1").config("spark.sql.adaptive.enabled", "false").getOrCreate()
from tempora import cli
from tempora.operators import prompts as P
for line in {lines!r}:
    cli.main(line.split())
"""


def session(tmp_path, parts, *lines):
    """The programs in a process of their own, with shuffled dictionary joins."""
    code = SESSION.format(repo=str(Path(cli.__file__).resolve().parents[1]), parts=parts, lines=lines)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_programs_in_separate_sessions(spark, tmp_path):
    write_folder(tmp_path)
    session(tmp_path, 3, "learn --data . --rules rules -l 1", "apply --data . --rules rules --candidates cands --stop-k 2", "stat --rules rules/rules.json --out stat")
    shown = session(tmp_path, 5, "evaluate --data . --candidates cands --out eval", "demo --data . --rules rules --query 0", "prompt --data . --rules rules/rules.txt --out asked", "prompt --data . --rules rules/rules.txt --out asked")
    graph = cli.load(spark, str(tmp_path))
    rules = cli.learn(graph, [1])
    want = cli.evaluate(graph, cli.apply(graph, rules, [1], stop_k=2)).first()
    lines = dict(r.value.split(": ") for r in spark.read.text(str(tmp_path / "eval")).collect())
    assert {k: float(v) for k, v in lines.items()} == {"Hits@1": want.hits1, "Hits@3": want.hits3, "Hits@10": want.hits10, "MRR": want.mrr}
    text = [r.value for r in spark.read.text(str(tmp_path / "rules" / "rules.txt")).collect()]
    assert len(text) == rules.count() and any("answers(X0,X1,T1) <- asks(X0,X1,T0)" in x and x.startswith("1.000000") for x in text)
    stat = json.loads(spark.read.text(str(tmp_path / "stat")).first().value)
    assert sum(stat["relation_rule_counts"].values()) == rules.count() == stat["statistics"]["rules"] and set(stat) == {"relation_rule_counts", "statistics", "top_10_relations"}
    heads = {x.split("(X0,")[0].split()[-1] for x in text}
    assert {d.name for d in (tmp_path / "asked").iterdir() if d.is_dir()} == {f"file_name={h}" for h in heads}
    assert all(len(list(d.glob("*.txt"))) == 1 for d in (tmp_path / "asked").iterdir() if d.is_dir())  # the second run asked nothing
    assert "scores" in shown and "rels" in shown


def test_prompts_without_samples_and_validation(spark):
    rules = spark.createDataFrame([("h", f"h(X0,X1,T1) <- r{i}(X0,X1,T0)") for i in range(60)] + [("g", "g <- x")], "head string, rule string")
    zero = {r["head"]: r.prompt for r in P.prompts(rules, ["r"], shots=0).collect()}
    few = {r["head"]: r.prompt for r in P.prompts(rules, ["r"], shots=3).collect()}
    assert "There are no samples." in zero["h"] and "Write the 50" in zero["h"] and "as many" in zero["g"]
    assert few["h"].count(" <- ") == 4 and "Write the 50" in few["h"] and few["g"].count(" <- ") == 2
    assert P.prompts(rules, ["r"], k=0).count() == 0
    better = P.parse_responses(P.complete(P.optimize_prompts(rules), lambda p: "a(X,Y) <-- b(X,Y)\nno").withColumn("response_id", F.lit(1)))
    assert {r.rule for r in better.collect()} == {"a(X,Y) <-- b(X,Y)"}
    said = P.validated(rules, lambda p: "True" if "r7(" in p else 1 / 0)
    assert [r.rule for r in said.filter("valid").collect()] == ["h(X0,X1,T1) <- r7(X0,X1,T0)"] and said.count() == 61
