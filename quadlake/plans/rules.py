"""Conjunctive rules over quads, compiled to equi-joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = ("subject", "relation", "object", "condition")
STRONG = 0.70


@dataclass(frozen=True)
class Rule:
    """``pattern``: 4-tuples of terms; ``head``: one; a term that starts with ? is a variable."""

    name: str
    pattern: tuple[tuple[str, str, str, str], ...]
    head: tuple[str, str, str, str]
    confidence: float = 1.0

    def __post_init__(self) -> None:
        if not self.pattern or any(len(a) != 4 for a in (*self.pattern, self.head)):
            raise ValueError(f"rule {self.name}: atoms have four terms")


def match(quads: DataFrame, rule: Rule) -> DataFrame:
    """One row for each way to satisfy the pattern, a column for each variable (?x becomes x).

    Atoms become filtered scans: literals are filters, a variable twice in an atom is an equality. They are joined
    on shared variables from left to right; Catalyst may reorder them. Atoms without a shared variable multiply."""
    out = None
    for atom in rule.pattern:
        part, names = quads, {}
        for slot, term in zip(SLOTS, atom, strict=True):
            if not term.startswith("?"):
                part = part.where(F.col(slot) == term)
            elif term in names:
                part = part.where(F.col(slot) == F.col(names[term]))
            else:
                names[term] = slot
        part = part.select(*[F.col(s).alias(v[1:]) for v, s in names.items() if v != "?_"])
        if out is None:
            out = part
        else:
            shared = [c for c in part.columns if c in out.columns]
            out = out.join(part, shared) if shared else out.crossJoin(part)
    return out


def derive(quads: DataFrame, rules: list[Rule], cap: int | None = None) -> DataFrame:
    """(subject, relation, object, condition, rule, confidence, strong): distinct heads, the first rule wins.

    A rule whose head has an unbound variable yields nothing. cap: matches kept by rule before duplicates go, in
    order of the head's terms."""
    parts = []
    for i, rule in enumerate(rules):
        bound = {t for atom in rule.pattern for t in atom if t.startswith("?")}
        if any(t.startswith("?") and t not in bound for t in rule.head):
            continue
        rows = match(quads, rule).select(*[(F.col(t[1:]) if t.startswith("?") else F.lit(t)).alias(s) for s, t in zip(SLOTS, rule.head, strict=True)])
        if cap is not None:
            rows = rows.orderBy(*SLOTS).limit(cap)
        parts.append(rows.groupBy(*SLOTS).agg(F.lit(i).alias("i")))
    if not parts:
        return quads.select(*SLOTS, F.lit("").alias("rule"), F.lit(0.0).alias("confidence"), F.lit(False).alias("strong")).limit(0)
    first = reduce(DataFrame.unionByName, parts).groupBy(*SLOTS).agg(F.min("i").alias("i"))
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("i") + 1)
    value = F.element_at(F.array(*[F.lit(float(r.confidence)) for r in rules]), F.col("i") + 1)
    return first.select(*SLOTS, name.alias("rule"), value.alias("confidence"), (value >= STRONG).alias("strong"))


def _apart(a: Rule, b: Rule) -> bool:
    """Whether no fact can come from both: some slot of their heads holds different literals."""
    return a.name != b.name and any(x != y and not x.startswith("?") and not y.startswith("?") for x, y in zip(a.head, b.head, strict=True))


def _several(rows: DataFrame, ends: list[str]) -> DataFrame:
    """The rows of those values of ``ends`` that have more than one."""
    n = rows.groupBy(*[F.col(c).alias(f"{c}?") for c in ends]).agg(F.count("*").alias("?n")).where(F.col("?n") > 1)
    return rows.join(n, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}?")) for c in ends], F.lit(True)), "left_semi")


def _counts(quads: DataFrame, rule: Rule) -> DataFrame:
    """One row (n_facts, n_subjects): distinct heads of a rule of two atoms or more, and their distinct subjects.

    The last atom is one side, what matches the others is the other. For each value of the variables they share, the
    rows of the sides are counted and the counts multiplied. A head is met more often than once only if it has several
    of those values on both sides; such heads alone are written out, and what was counted too often is taken off."""
    head = {t[1:] for t in rule.head if t.startswith("?")}
    sides = [match(quads, Rule(rule.name, atoms, rule.head)) for atoms in (rule.pattern[:-1], rule.pattern[-1:])]
    keys = [c for c in sides[1].columns if c in sides[0].columns]
    if not keys:
        keys, sides = ["?"], [x.withColumn("?", F.lit(0)) for x in sides]
    sides = [x.select(*[c for c in x.columns if c in head or c in keys]).dropna(subset=keys).distinct() for x in sides]
    ends = [[c for c in x.columns if c in head] for x in sides]
    ways = [x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in zip(sides, ("?a", "?b"), strict=True)]
    out = ways[0].join(ways[1], keys).agg(F.coalesce(F.sum(F.col("?a") * F.col("?b")), F.lit(0)).alias("n_facts"))
    if not any(set(keys) <= set(e) for e in ends):
        again = _several(sides[0], ends[0]).join(_several(sides[1], ends[1]), keys).groupBy(*sorted(head)).agg((F.count("*") - 1).alias("?n"))
        out = out.crossJoin(again.agg(F.coalesce(F.sum("?n"), F.lit(0)).alias("?n"))).select((F.col("n_facts") - F.col("?n")).alias("n_facts"))  # one row each
    if not rule.head[0].startswith("?"):
        return out.withColumn("n_subjects", F.when(F.col("n_facts") > 0, 1).otherwise(0).cast("long"))
    subject = rule.head[0][1:]
    own, other = sides if subject in sides[0].columns else sides[::-1]
    return out.crossJoin(own.join(other, keys, "left_semi").agg(F.countDistinct(subject).alias("n_subjects")))


def tally(quads: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, strong, confidence, n_facts, n_subjects): how many facts of :func:`derive` each rule has, and on how many
    subjects; rules without a fact have no row.

    The facts of a rule of several atoms whose head meets no other rule's are counted without being written out."""
    live = [r for r in rules if not any(t.startswith("?") and t not in {u for a in r.pattern for u in a} for t in r.head)]
    written = lambda r: len(r.pattern) < 2 or "?_" in r.head or not any(t.startswith("?") for t in r.head)
    alone = [i for i, r in enumerate(live) if not written(r) and all(i == j or _apart(r, s) for j, s in enumerate(live))]
    facts = derive(quads, [r for i, r in enumerate(live) if i not in alone])
    parts = [facts.groupBy("rule", "strong", "confidence").agg(F.count("*").alias("n_facts"), F.countDistinct("subject").alias("n_subjects"))]
    for r in (live[i] for i in alone):
        parts.append(_counts(quads, r).where("n_facts > 0").select(F.lit(r.name).alias("rule"), F.lit(r.confidence >= STRONG).alias("strong"), F.lit(float(r.confidence)).alias("confidence"), "n_facts", "n_subjects"))
    return reduce(DataFrame.unionByName, parts)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
