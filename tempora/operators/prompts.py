"""The text side: rule lines, prompts for a language model, its responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.rules import path_format, safe_name
from tempora.operators.rules import uniform_sample, weighted_sample

def parse_rule_lines(lines: DataFrame, compat: bool = False, width: int | None = None) -> DataFrame:
    """(conf, head, rule, body) of verbalized rules (column ``value``); other lines go.

    A line has four columns apart: confidence, two supports, and the rule, the last with blanks of its own.  A head ends at
    its variables; ``compat`` ends it at the first parenthesis, which cuts names that have one.  With ``width`` the rule
    is what follows so many characters, blanks included, however wide the other columns are.
    """
    cells = F.split(F.trim("value"), " +", 4)
    at = lambda i: F.get(cells, F.lit(i))
    good = at(0).try_cast("double").isNotNull() & at(1).try_cast("long").isNotNull() & at(2).try_cast("long").isNotNull() & F.contains(at(3), F.lit(" <- "))
    parsed = lines.filter(F.coalesce(good, F.lit(False))).select(at(0).alias("conf"), (F.substring("value", width + 1, 1 << 30) if width else at(3)).alias("rule"))
    head = F.substring_index("rule", "(", 1) if compat else F.regexp_extract("rule", r"^(.*?)\(X0,", 1)
    return parsed.select(F.col("conf").cast("double").alias("conf"), head.alias("head"), "rule", F.element_at(F.split("rule", " <- "), 2).alias("body"))


def sampled_rules(parsed: DataFrame, seed: int = 3) -> DataFrame:
    return weighted_sample(parsed, "head", "conf", "rule", seed)


def prompts(rules: DataFrame, candidates: list[str], k: int = 50, least: int = 50, with_inverses: bool = False, shots: int | None = None, seed: int = 5) -> DataFrame:
    """(head, prompt): a prompt for each head of (head, rule), its rules as samples in order; k is asked for if the head
    has ``least`` rules or more, else as many as there are.  ``shots`` samples are shown at most (0: none, and the prompt
    says so); with k = 0 there is nothing to ask."""
    if k == 0:
        return rules.select("head", F.lit("").alias("prompt")).limit(0)
    if shots == 0:
        heads = rules.groupBy("head").agg(F.count("*").alias("n"))
        return heads.select("head", F.concat_ws("\n", F.lit(INTRO), F.lit("There are no samples."), ask_for(k, F.col("n") >= least), use_only(candidates, with_inverses)).alias("prompt"))
    sizes = rules.groupBy("head").agg(F.count("*").alias("n")) if shots else None
    rules = few_shot(rules, shots, seed) if shots else rules
    grouped = rules.groupBy("head").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    grouped = grouped.join(sizes, "head") if shots else grouped.withColumn("n", F.size("rules"))
    return grouped.select("head", F.concat_ws("\n", F.lit(INTRO), F.lit("Samples:"), F.array_join("rules", "\n"), ask_for(k, F.col("n") >= least), use_only(candidates, with_inverses)).alias("prompt"))


INTRO = "A temporal rule says that its head follows once all of its body has happened, in the form head <- body."


def ask_for(k: int, enough: Column) -> Column:
    many = F.concat(F.lit(f"Write the {k} rules that matter most for the head \""), F.col("head"), F.lit("\"."))
    some = F.concat(F.lit("Write as many rules that matter as you can for the head \""), F.col("head"), F.lit("\"."))
    return F.when(enough, many).otherwise(some)


def use_only(candidates: list[str], with_inverses: bool) -> Column:
    names = [*candidates, *[f"_{c}" for c in candidates]] if with_inverses else candidates
    return F.lit("Use these relations only: " + "; ".join(names) + ". Return rules and nothing else.")


def optimize_prompts(rules: DataFrame) -> DataFrame:
    """(head, prompt) that ask for better rules than those of (head, rule); the answer goes through ``parse_responses``."""
    grouped = rules.groupBy("head").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    return grouped.select("head", F.concat_ws("\n", F.lit(INTRO), F.lit("Rules so far:"), F.array_join("rules", "\n"), F.lit("Drop those that cannot hold, make the others more exact, and return rules and nothing else.")).alias("prompt"))


def validated(rules: DataFrame, completion: Callable[[str], str] | None = None) -> DataFrame:
    """``rules`` (head, rule) with ``valid``: whether the completion says True when asked if the rule can hold."""
    asked = rules.select("head", "rule", F.concat(F.lit(INTRO + "\nCan this rule hold? Answer True or False.\n"), F.col("rule")).alias("prompt"))
    return _answered(asked, ["head", "rule"], completion).select("head", "rule", approved(F.col("response")).alias("valid"))


def few_shot(rules: DataFrame, n: int, seed: int = 5) -> DataFrame:
    return uniform_sample(rules, "head", "rule", n, seed)


def path_prompts(paths: DataFrame) -> DataFrame:
    """(head, text) of path samples (head, paths)."""
    return paths.select("head", F.explode("paths").alias("path")).select("head", path_format(F.col("path"), F.col("head")).alias("text"))


def parse_responses(responses: DataFrame, head: Column | None = None) -> DataFrame:
    """(response_id, line_no, rule) of responses (response_id, head, response): lines with ``<--`` are rules; others with
    parentheses become the body of a rule for the head, if there is one."""
    head = F.col("head") if head is None else head
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = responses.select("response_id", head.alias("head"), F.posexplode(F.split(trim(F.col("response")), "\n")).alias("line_no", "line")).withColumn("line", trim(F.col("line")))
    body = trim(F.regexp_replace("line", r"^\.+|\.+$", ""))
    rule = F.when(F.contains("line", F.lit("<--")), F.col("line")).when(F.col("head").isNotNull() & F.contains("line", F.lit("(")) & F.contains("line", F.lit(")")), F.concat("head", F.lit("(X,Y) <-- "), body))
    return lines.filter("line <> ''").withColumn("rule", rule).filter("rule is not null").select("response_id", "line_no", "rule")


def approved(responses: Column) -> Column:
    return F.contains(responses, F.lit("True"))


def _answered(asked: DataFrame, keys: list[str], completion: Callable[[str], str] | None) -> DataFrame:
    """``keys`` and response.  Without a completion, and where it fails, the response is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str:
            try:
                return completion(prompt) if completion else ""
            except Exception:  # as promised above
                return ""

        for pdf in batches:
            yield pdf[keys].assign(response=[one(p) for p in pdf.prompt])

    return asked.select(*keys, "prompt").mapInPandas(run, ", ".join(f"{k} string" for k in [*keys, "response"]))


def complete(asked: DataFrame, completion: Callable[[str], str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """(head, file_name, response): the completion of each prompt; heads that ``done`` (head) has are skipped.  An error
    of the completion is an empty response."""
    asked = asked if done is None else asked.join(done.select("head"), "head", "left_anti")
    return _answered(asked, ["head"], completion).select("head", safe_name(F.col("head")).alias("file_name"), "response")
