"""Facts in the first and third person from sentences, with their conditions, by a ladder of patterns.

The ladder and the split into object and condition are tables of patterns; one function turns them into columns,
another into SQL. A null text has no sentences. Letters, digits and white space are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.text import valid_entity

#: Fixed patterns of the condition at the end of an object: in brackets, in time, a quantity.
BRACKETS = r"^(.*?)\(([^)]+)\)\s*$"
TEMPORAL = (
    r"^(.*?)(\s+in (?:about |approximately )?(?:\w+ )?(?:[\d.]+\s+)?(?:a )?(?:week|month|day|hour|minute|year)(?:s)?(?:\s+and\s+a\s+half)?"
    r"|\s+last (?:week|month|year|night|time)"
    r"|\s+on (?:Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday)\w*"
    r"|\s+since (?:20\d\d|\w+)"
    r"|\s+(?:each|per|every) (?:way|day|week|month|year|shift|rotation)"
    r"|\s+(?:about|approximately|around) [\d.]+ (?:minutes?|hours?|weeks?|days?)(?:\s+\w+)?)"
)
QUANTITY = r"^(.*?)([\d.]+\s+(?:minutes?|hours?|weeks?|days?|months?)(?:\s+\w+)?)\s*$"

#: Fixed rungs in order: pattern, any case, subject (a group, or the user), relation (groups and text), object group.
USER = "user"
RUNGS = (
    (r"^I\s+(\w+)\s+(at|in|for|with|on|from|to)\s+(.+?)$", True, USER, (1, "_", 2), 3),
    (r"^I(?:'m| am)\s+(?:a |an )?(.+?)$", True, USER, ("is",), 1),
    (r"^I(?:'ve| have)\s+(?:been\s+)?(.+?)$", True, USER, ("has",), 1),
    (r"^I\s+(prefer|like|want|need|enjoy|love|hate|dislike)\s+(.+?)$", True, USER, (1, "s"), 2),
    (r"^I\s+(graduated|studied|majored)\s+(?:with |in |from )?(.+?)$", True, USER, (1, "_with"), 2),
    (r"^I\s+(watched|went|visited|tried|attended|bought|got|received|took|started|completed|finished)\s+(?:to |at |all )?(.+?)$", True, USER, (1,), 2),
    (r"^I(?:'m|'ve been)\s+(\w+ing)\s+(.+?)$", True, USER, (1,), 2),
    (r"^[Mm]y\s+(.+?)\s+(?:is|are|was|were|takes?|costs?|has|lasts?)\s+(.+?)$", False, USER, (1,), 2),
    (r"^[Tt]he user\s+(\w+(?:s|ed|es)?)\s+(at|in|for|with|on|from|to)\s+(.+)$", False, USER, (1, "_", 2), 3),
    (r"^[Tt]he user\s+(\w+(?:s|ed|es)?)\s+(.+?)$", False, USER, (1,), 2),
    (r"^(.+?)\s+(\w+(?:s|ed|es))\s+(.+?)$", True, 1, (2,), 3),
    (r"^(.+?)\s+(?:is|are|was|were)\s+(?:a |an |the )?(.+?)$", True, 1, ("is",), 2),
)
#: The rung whose relation is a phrase, written with underscores.
PHRASE = 7
SENTENCES, ROLE, BULLET = r"[.!?\n]+", r"^\[(?:user|assistant)\]:\s*", r"^[-*\d]+[.)]\s*"
#: A subject of a general sentence has fewer words than this.
SUBJECT_WORDS = 6


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def _java(pattern: str, any_case: bool) -> str:
    return f"(?{'i' if any_case else ''}d){pattern}"


def split_condition(text: Column) -> Column:
    """(clean, condition) of an object: the condition in brackets, else in time, else a quantity that ends it."""
    clean = _strip(text)
    end = _java(QUANTITY, False)
    before = F.regexp_extract(clean, end, 1)
    whole = F.struct(clean.alias("clean"), F.lit("").alias("condition"))

    def parts(pattern: str) -> Column:
        return F.struct(_strip(F.regexp_extract(clean, pattern, 1)).alias("clean"), _strip(F.regexp_extract(clean, pattern, 2)).alias("condition"))

    out = F.when(clean.rlike(_java(BRACKETS, False)), parts(_java(BRACKETS, False))).when(clean.rlike(_java(TEMPORAL, True)), parts(_java(TEMPORAL, True)))
    return out.when(clean.rlike(end) & (F.length(before) > 5) & (F.length(_strip(before)) > 3), parts(end)).otherwise(whole)


def fact_quads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, subject, relation, object, condition): the first rung with valid entities, for every sentence."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, SENTENCES)).alias("pos", "raw"))
    s = _strip(F.col("raw"))
    rows = rows.select("id", F.col("pos").cast("long").alias("pos"), s.alias("s")).where(F.length("s") >= 5)
    s = _strip(F.regexp_replace(F.regexp_replace("s", ROLE, ""), BULLET, ""))
    rows = rows.select("id", "pos", s.alias("s")).where(F.length("s") >= 5)

    def rung(i: int) -> Column:
        pattern, any_case, subject, relation, obj = RUNGS[i]
        p = _java(pattern, any_case)
        group = lambda g: F.regexp_extract("s", p, g)
        name = F.concat(*[group(r) if isinstance(r, int) else F.lit(r) for r in relation])
        if i == PHRASE:
            name = F.replace(_strip(name), F.lit(" "), F.lit("_"))
        who = F.lit(USER) if subject == USER else _strip(group(subject))
        return F.when(F.col("s").rlike(p), F.struct(who.alias("subject"), name.alias("relation"), group(obj).alias("raw")))

    def whole(x: Column) -> Column:
        o = split_condition(x["raw"])
        return F.struct(x["subject"].alias("subject"), x["relation"].alias("relation"), o["clean"].alias("object"), o["condition"].alias("condition"))

    def valid(x: Column) -> Column:
        named = valid_entity(x["subject"]) & (F.size(F.split(x["subject"], r"\s+")) < SUBJECT_WORDS)
        return valid_entity(x["object"]) & ((x["subject"] == USER) | named)

    hits = F.filter(F.array(*[rung(i) for i in range(len(RUNGS))]), lambda x: x.isNotNull())
    found = F.get(F.filter(F.transform(hits, whole), valid), F.lit(0))
    return rows.withColumn("f", found).where("f is not null").select("id", "pos", "f.subject", "f.relation", "f.object", "f.condition")


def fact_sql(rows: str) -> str:
    """SQL of :func:`fact_quads` over ``rows``, a query of (id, text)."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    strip = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
    valid = lambda c: f"(trim({c}) <> '' AND length({c}) < 200 AND len(string_split_regex(trim({c}), '\\s+')) < 15)"

    def rung(i: int) -> str:
        pattern, any_case, subject, relation, obj = RUNGS[i]
        p = q(("(?i)" if any_case else "") + pattern)
        group = lambda g: f"regexp_extract(s, {p}, {g})"
        name = " || ".join(group(r) if isinstance(r, int) else q(r) for r in relation)
        if i == PHRASE:
            name = f"replace({strip(name)}, ' ', '_')"
        who = q(USER) if subject == USER else strip(group(subject))
        return f"SELECT id, pos, {i} AS rung, {who} AS subject, {name} AS relation, {strip(group(obj))} AS raw FROM s WHERE regexp_matches(s, {p})"

    b, t, e = q(BRACKETS), q("(?i)" + TEMPORAL), q(QUANTITY)
    kind = f"CASE WHEN regexp_matches(raw, {b}) THEN 1 WHEN regexp_matches(raw, {t}) THEN 2 WHEN regexp_matches(raw, {e}) AND length(regexp_extract(raw, {e}, 1)) > 5 AND length({strip(f'regexp_extract(raw, {e}, 1)')}) > 3 THEN 3 ELSE 0 END"
    part = lambda g, rest: "CASE k " + " ".join(f"WHEN {i} THEN {strip(f'regexp_extract(raw, {p}, {g})')}" for i, p in ((1, b), (2, t), (3, e))) + f" ELSE {rest} END"
    return f"""WITH l AS (SELECT id, string_split_regex(text, {q(SENTENCES)}) AS l FROM ({rows}) r),
  a AS (SELECT id, i - 1 AS pos, {strip('l[i]')} AS s FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
  s AS (SELECT * FROM (SELECT id, pos, {strip(f"regexp_replace(regexp_replace(s, {q(ROLE)}, ''), {q(BULLET)}, '')")} AS s FROM a WHERE length(s) >= 5) WHERE length(s) >= 5),
  g AS ({" UNION ALL ".join(rung(i) for i in range(len(RUNGS)))}),
  k AS (SELECT *, {kind} AS k FROM g),
  o AS (SELECT id, pos, rung, subject, relation, {part(1, 'raw')} AS object, {part(2, "''")} AS condition FROM k),
  v AS (SELECT * FROM o WHERE {valid('object')} AND (subject = '{USER}' OR ({valid('subject')} AND len(string_split_regex(subject, '\\s+')) < {SUBJECT_WORDS})))
SELECT id, pos, subject, relation, object, condition FROM v QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY rung) = 1"""
