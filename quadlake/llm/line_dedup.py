"""Operator 2: line deduplication by overlapping windows of three lines.

Lines end at line feeds. Every run of WINDOW consecutive lines with something else than white space in it is hashed
(MD5); a window that occurs more than once keeps its first occurrence, by (doc_id, hash of the text, line), and all
others are later ones. Lines covered by any later occurrence go; the covered positions of a document are merged
first. Texts of fewer lines have no window and stay whole.

The windows of all documents are counted with map-side aggregation, so a window that a third of the rows share is
one row per task; finding its later occurrences is an equi-join that adaptive execution can split.

Null texts stay null and have no lines; the empty text is one empty line. A null doc_id sorts last. Rows that
repeat both doc_id and text count as one occurrence and are treated alike. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime

WINDOW = 3
#: Later windows, as (long, long, int), whose join side is still broadcast.
BROADCAST_WINDOWS = 1_000_000


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept text in place, and the columns __n_lines and __n_removed (with more underscores after them
    where ``docs`` has columns of these names)."""
    runtime.tune(docs.sparkSession)
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text_col).alias("h"), lines.alias("lines"))
    spans = F.expr(f"transform(if(size(lines) >= {window}, sequence(0, size(lines) - {window}), cast(array() as array<int>)), i -> concat_ws('\n', slice(lines, i + 1, {window})))")
    found = keyed.select("d", "h", F.posexplode(spans).alias("i", "w")).where(F.col("w").rlike(r"\S")).select("d", "h", "i", F.unhex(F.md5("w")).alias("w"))
    found = runtime.cut(found)
    place = F.struct("d", "h", "i")
    first = found.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("w", "first")
    later = found.join(first, "w").where(place > F.col("first"))
    covered = F.array_distinct(F.flatten(F.collect_list(F.expr(f"sequence(i, i + {window - 1})"))))
    later = runtime.cut(later.groupBy("d", "h").agg(covered.alias("__covered")))
    n = later.agg(F.sum(F.size("__covered"))).first()[0] or 0
    runtime.drop(found)

    d, h, cells, gone = (runtime.fresh(docs.columns, x) for x in ("__d", "__h", "__lines", "__covered"))
    n_lines, n_removed = counted(docs.columns)
    out = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).withColumn(h, F.xxhash64(text_col))
    side = later.withColumnsRenamed({"d": d, "h": h, "__covered": gone})
    out = out.join(F.broadcast(side) if n <= BROADCAST_WINDOWS else side, [d, h], "left")
    out = out.withColumn(cells, lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size(cells) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(cells, i)), "\n"))
    counts = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long").alias(name) for x, name in ((cells, n_lines), (gone, n_removed))]
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *counts)


def counted(columns: list[str]) -> list[str]:
    """Names of the counts of lines beside these columns."""
    return [runtime.fresh(columns, x) for x in ("__n_lines", "__n_removed")]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(l[i:i + 2], chr(10))) AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)
  WHERE regexp_matches(array_to_string(l[i:i + 2], chr(10)), '\\S')
), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM r WHERE n > 1
), k AS (
  SELECT a.doc_id, count(*) FILTER (c.p IS NOT NULL) AS n_removed, string_agg(x, chr(10) ORDER BY a.p) FILTER (c.p IS NULL) AS t
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM d) a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
