"""Quads from text: rule ladders over sentences, lines and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.text import valid_entity

#: Fixed values, in either case: copula, verb with preposition, verb with object.
IS = r"(?i)^(.+?)\s+(?:is|are|was|were)\s+(?:a|an|the\s+)?(.+?)$"
VERB_PREP = r"(?i)^(.+?)\s+(\w+)\s+(at|in|for|with|on|from|to)\s+(.+?)$"
SVO = r"(?i)^(.+?)\s+(\w+(?:s|ed|es))\s+(.+?)$"


def sentence_quads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, subject, relation, object): the first rung of the ladder with two valid entities, by sentence."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "[.!?;]+")).alias("pos", "raw"))
    s = F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "")
    rows = rows.select("id", F.col("pos").cast("long").alias("pos"), s.alias("s")).where("s <> '' and not contains(s, '\n')")

    def rung(pattern: str, relation: Column, subject: int, obj: int) -> Column:
        a, b = F.regexp_extract("s", pattern, subject), F.regexp_extract("s", pattern, obj)
        return F.when(F.col("s").rlike(pattern) & valid_entity(a) & valid_entity(b), F.struct(F.trim(a).alias("subject"), relation.alias("relation"), F.trim(b).alias("object")))

    found = F.coalesce(
        rung(IS, F.lit("is"), 1, 2),
        rung(VERB_PREP, F.concat_ws("_", F.regexp_extract("s", VERB_PREP, 2), F.regexp_extract("s", VERB_PREP, 3)), 1, 4),
        rung(SVO, F.regexp_extract("s", SVO, 2), 1, 3),
    )
    return rows.withColumn("f", found).where("f is not null").select("id", "pos", "f.subject", "f.relation", "f.object")


def template_quads(docs: DataFrame, id_col: str, text_col: str, pattern: str, relation: str, group: int = 1) -> DataFrame:
    """(subject, relation, object): one quad for every match of ``pattern`` with a non-empty group."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group)))
    return docs.select(F.col(id_col).cast("string").alias("subject"), F.lit(relation).alias("relation"), found.alias("object")).where("object <> ''")
