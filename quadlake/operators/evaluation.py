"""Grading of predictions, reports of it, and records in fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_type(pred: Column, gold: Column) -> Column:
    """Of an ordering: correct, empty, wrong_files or wrong_order."""
    other = (F.size(pred) != F.size(gold)) | (F.size(F.array_except(pred, gold)) > 0) | (F.size(F.array_except(gold, pred)) > 0)
    return F.when(pred == gold, "correct").when(F.size(pred) == 0, "empty").when(other, "wrong_files").otherwise("wrong_order")


def failure_class(parse_error: Column, n_primitives: Column, n_docs: Column, least: Column, n_strong: Column, n_ambiguous: Column, ordering: Column, pred: Column, gold: Column) -> Column:
    """Why a case failed, the first that holds; ``least``: quads that each document should give."""
    same_files = (F.size(F.array_except(pred, gold)) == 0) & (F.size(F.array_except(gold, pred)) == 0)
    return (
        F.when(parse_error, "parse_error")
        .when((n_primitives == 0) | ((n_docs > 0) & (n_primitives < least * n_docs)), "missing_primitive")
        .when((n_strong == 0) & (n_ambiguous == 0), "zero_strong_edges")
        .when(ordering & same_files & (pred != gold), "wrong_order")
        .when(pred != gold, "wrong_answer")
        .otherwise("correct")
    )


def evaluate(cases: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, n, n_correct, accuracy, passed) of graded cases (by, failure), where passed is accuracy at the threshold."""
    right = F.count_if(F.col("failure") == "correct")
    return cases.groupBy(by).agg(F.count("*").alias("n"), right.alias("n_correct"), (right / F.count("*")).alias("accuracy")).withColumn("passed", F.col("accuracy") >= threshold)


def markdown(cases: DataFrame, by: str) -> DataFrame:
    """(by, text): failures by kind, commonest first, then the first five failed cases by id."""
    kinds = cases.groupBy(by, "failure").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "failure"))), lambda x: F.format_string("- %s: %d", x["failure"], -x["o"]))
    kinds = kinds.groupBy(by).agg(F.array_join(listed, "\n").alias("kinds"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("qid"))  # Spark limits each group before its shuffle
    failed = cases.where("failure <> 'correct'").withColumn("place", place).where("place <= 5").groupBy(by).agg(F.array_sort(F.collect_list("qid")).alias("first"))
    first = F.coalesce(F.array_join(F.transform("first", lambda x: F.concat(F.lit("- case "), x.cast("string"))), "\n"), F.lit(""))
    return kinds.join(failed, by, "left").select(by, F.concat(F.lit("## Failures\n"), "kinds", F.lit("\n## First cases\n"), first).alias("text"))


RECORD = ("qi", "exact", "predicted_order", "gt_order", "n_files", "error_type")


def records(cases: DataFrame) -> DataFrame:
    """Cases (qi, pred, gold) in the columns of recorded results."""
    return cases.select("qi", (F.col("pred") == F.col("gold")).alias("exact"), F.col("pred").alias("predicted_order"), F.col("gold").alias("gt_order"), F.size("gold").alias("n_files"), error_type(F.col("pred"), F.col("gold")).alias("error_type"))


def extractor_test(docs: DataFrame, quads: DataFrame, by: str, least: int = 1, most: int = 800, total: int = 0, required: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_docs, n_primitives, passed, issues, feedback) of the quads (by, doc, relation) that an extractor gave for
    docs (by, doc): too few or too many from a document, too few in all, and relations that are missing."""
    counts = quads.groupBy(by, "doc").agg(F.count("*").alias("n"))
    each = docs.select(by, "doc").distinct().join(counts, [by, "doc"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = F.format_string(f"document '%s' produced %d primitives (expected >= {least})", F.col("doc").cast("string"), "n")
    many = F.format_string(f"document '%s' produced %d primitives (max {most}; patterns too loose)", F.col("doc").cast("string"), "n")
    issue = F.when(F.col("n") < least, few).when(F.col("n") > most, many)
    out = each.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_primitives"), F.array_sort(F.collect_list(issue)).alias("of_docs"))
    kinds = quads.groupBy(by, "relation").agg(F.count("*").alias("n")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "relation"))).alias("kinds"))
    out = out.join(kinds, by, "left")
    names = F.coalesce(F.transform("kinds", lambda x: x["relation"]), F.array().cast("array<string>"))
    absent = F.array(*[F.when(~F.array_contains(names, r), F.lit(f"missing required relation '{r}'")) for r in required]) if required else F.array().cast("array<string>")
    overall = F.array(F.when(F.col("n_primitives") < total, F.format_string(f"too few primitives overall (%d < {total})", "n_primitives")))
    out = out.withColumn("issues", F.filter(F.concat(overall, "of_docs", absent), lambda x: x.isNotNull())).withColumn("passed", F.size("issues") == 0)
    shown = F.array_join(F.transform(F.slice("kinds", 1, 8), lambda x: F.format_string("%s=%d", x["relation"], -x["o"])), ", ")
    head = F.format_string("Extractor test: %s\n  docs: %d  primitives: %d", F.when(F.col("passed"), "PASSED").otherwise("FAILED"), "n_docs", "n_primitives")
    lines = F.when(~F.col("passed"), F.concat(F.lit("Issues:\n"), F.array_join(F.transform("issues", lambda x: F.concat(F.lit("  - "), x)), "\n")))
    feedback = F.concat_ws("\n", head, F.when(F.size("kinds") > 0, F.concat(F.lit("  relations: "), shown)), lines)
    return out.select(by, "n_docs", "n_primitives", "passed", "issues", feedback.alias("feedback"))
