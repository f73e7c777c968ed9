"""Column expressions over relations, rules and walks.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(rel: Column | str, n_relations: int) -> Column:
    """Id of the inverse relation: i + N for a relation, i - N (by remainder) for an inverse one."""
    rel = F.col(rel) if isinstance(rel, str) else rel
    return F.when(rel < n_relations, rel + n_relations).otherwise(rel % n_relations)


def inverse_name(name: Column | str) -> Column:
    """``_r`` is the inverse of ``r``."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.startswith("_"), F.substring(name, 2, 1 << 20)).otherwise(F.concat(F.lit("_"), name))


def var_constraints(ents: Column) -> Column:
    """Groups (of two and more, ascending) of the positions that have the same entity, in lexicographic order."""
    at = F.sequence(F.lit(0), F.size(ents) - 1)
    groups = F.transform(F.array_distinct(ents), lambda x: F.filter(at, lambda i: F.get(ents, i) == x))
    return F.array_sort(F.filter(groups, lambda g: F.size(g) > 1))


def holds(constraints: Column, ents: Column) -> Column:
    """True if every group of positions has one entity; further equalities are allowed."""
    return F.forall(constraints, lambda g: F.forall(g, lambda i: F.get(ents, i) == F.get(ents, F.get(g, F.lit(0)))))


def constraints_text(c: Column) -> Column:
    """``[[0,2],[1,3]]``"""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda g: F.concat(F.lit("["), F.array_join(g.cast("array<string>"), ","), F.lit("]"))), ","), F.lit("]"))


def list_text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def _groups(constraints: Column, n: Column) -> Column:
    """Constraint groups and the positions that are in none, in lexicographic order: variable k is group k."""
    used = F.flatten(constraints)
    alone = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: ~F.array_contains(used, i)), lambda i: F.array(i))
    return F.array_sort(F.concat(constraints, alone))


def _variable(groups: Column, i: Column) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(groups) - 1), lambda k: F.array_contains(F.get(groups, k), i))
    return F.concat(F.lit("X"), F.get(at, F.lit(0)).cast("string"))


def verbalized(conf: Column, rule_supp: Column, body_supp: Column, head: Column, body: Column, constraints: Column) -> Column:
    """``conf  supp  body  head(X0,Xk,Tn) <- r(X0,X1,T0), ...``; head and body are names.  A pure function."""
    n = F.size(body)
    groups = _groups(constraints.cast("array<array<int>>"), n)
    atoms = F.transform(body, lambda r, i: F.concat(r, F.lit("("), _variable(groups, i), F.lit(","), _variable(groups, i + 1), F.lit(",T"), i.cast("string"), F.lit(")")))
    start = F.format_string("%8.6f  %4d  %4d  ", conf.cast("double"), rule_supp.cast("long"), body_supp.cast("long"))
    return F.concat(start, head, F.lit("(X0,"), _variable(groups, n), F.lit(",T"), n.cast("string"), F.lit(") <- "), F.array_join(atoms, ", "))


def verbalized_walk(ents: Column, rels: Column, tss: Column) -> Column:
    """``entity <tab> relation <tab> entity <tab> time ...`` of arrays of names."""
    steps = F.transform(rels, lambda r, i: F.concat_ws("\t", r, F.get(ents, i + 1), F.get(tss, i)))
    return F.concat_ws("\t", F.get(ents, F.lit(0)), F.array_join(steps, "\t"))


def verbalized_steps(first: Column, *steps: Column) -> Column:
    """``verbalized_walk`` of a walk that is in columns: its first entity, then relation, entity and time of each step."""
    return F.concat_ws("\t", *[x.cast("string") for x in (first, *steps)])


def uniform(seed: int, *keys: Column | str) -> Column:
    """52 bits of an MD5 of the keys as a long: the same for any partitioning and in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])), 1, 13), 16, 10).cast("long")


def unit(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), from ``uniform``."""
    return (uniform(seed, *keys) + 0.5) / float(1 << 52)


def path_format(path: Column, head: Column) -> Column:
    """``a|b|c`` as ``head(X,Y) <-- a(X, Z_1) & b(Z_1, Z_2) & c(Z_2, Y)``."""
    parts = F.split(path, r"\|")
    last = F.size(parts) - 1
    left = lambda i: F.when(i == 0, F.lit("X")).otherwise(F.concat(F.lit("Z_"), i.cast("string")))
    right = lambda i: F.when(i == last, F.lit("Y")).otherwise(F.concat(F.lit("Z_"), (i + 1).cast("string")))
    atoms = F.transform(parts, lambda r, i: F.concat(r, F.lit("("), left(i), F.lit(", "), right(i), F.lit(")")))
    return F.concat(head, F.lit("(X,Y) <-- "), F.array_join(atoms, " & "))


def safe_name(head: Column) -> Column:
    """A head relation as a file name: slashes become hyphens, blanks go."""
    return F.regexp_replace(F.regexp_replace(head, "/", "-"), " ", "")
