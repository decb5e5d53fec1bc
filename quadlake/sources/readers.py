"""Sources of files, tasks and recorded results, and a cache of what was extracted from files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Most files of one repository that a scan keeps; the first by path.
MAX_FILES = 4000


def scan(spark: SparkSession, root: str, suffix: str = ".py", limit: int | None = MAX_FILES) -> DataFrame:
    """(path, text) of the files below ``root`` that end with ``suffix``, paths relative to it.

    Files in ``__pycache__`` and files that are no UTF-8 are left out, then the first ``limit`` by path are kept."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(base)
    # Spark lists empty files but does not read them
    listed = spark.createDataFrame([(unquote(urlsplit(x).path),) for x in files.inputFiles()], "at string")
    read = files.select(F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?(?=/)", "").alias("at"), F.col("content").cast("string").alias("text"))
    folder = unquote(urlsplit(base).path) + "/"
    files = listed.join(read, "at", "left").select(F.substring_index("at", folder, -1).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files = files.where(F.is_valid_utf8("text") & ~F.array_contains(F.split("path", "/"), "__pycache__"))
    return files if limit is None else files.orderBy("path").limit(limit)


def json_documents(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(*keep, path, text) of JSON objects {path: text}; anything that is no object has no documents."""
    return rows.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("path", "text"))


CASES = "python array<struct<repo: string, content: map<string,string>, needles: array<struct<name: string, description: string, path: string, start_line: int>>>>"


def load_cases(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(repo, name, description, path, line) of the functions to be found; lines count from one."""
    rows = spark.read.schema(CASES).option("multiLine", str(multiline).lower()).json(path)
    needles = rows.select(F.explode("python").alias("r")).select("r.repo", F.explode("r.needles").alias("n"))
    return needles.select("repo", "n.name", "n.description", "n.path", (F.col("n.start_line") + 1).alias("line"))


def load_items(items: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Items whose array ``files`` has a length in the range."""
    return items.where(F.size("files").between(least, most))


def parsed_items(items: DataFrame) -> DataFrame:
    """(qi, files, contents, gold) of items with ``files`` as structs (path, text) in their wanted order.

    The files are given in order of their paths; gold keeps the wanted one."""
    by_path = F.array_sort("files", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    paths = lambda c: F.transform(c, lambda x: x["path"])
    return items.select("qi", paths(by_path).alias("files"), F.map_from_entries(F.transform(by_path, lambda x: F.struct(x["path"], x["text"]))).alias("contents"), paths(F.col("files")).alias("gold"))


def task_card(source: str | dict) -> dict:
    """A task from a dictionary, or a file of JSON (or YAML, where a parser is installed)."""
    card = source
    if isinstance(source, str):
        text = Path(source).read_text(encoding="utf-8")
        if source.endswith((".yaml", ".yml")):
            import yaml

            card = yaml.safe_load(text)
        else:
            card = json.loads(text)
    missing = [k for k in ("domain", "description", "input_schema", "query") if k not in card]
    if missing:
        raise ValueError(f"task card without {', '.join(missing)}")
    grading = {"metric": "exact_match", "threshold": 0.80, **card.get("eval", {})}
    return {"few_shot": [], "holdout": [], "options": {}, **card, "eval": grading}


def content_key(text: Column) -> Column:
    """16 hexadecimal digits that stand for a text."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16)


class ExtractionCache:
    """What an extractor found in each distinct text, as Parquet by content key; an entry is there once its index row is."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.place}/{name}")
        except AnalysisException:
            return None

    def index(self) -> DataFrame:
        """(key) of the texts with an entry."""
        found = self._read("index")
        return self.spark.createDataFrame([], "key string") if found is None else found.select("key").distinct()

    def extract(self, files: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``files`` (with a column text) with key and status, ``hit`` or ``miss``; misses are extracted and kept.

        The extractor gets (key, text), one row for each distinct text, and gives (key, seq, ...)."""
        keyed = files.withColumn("key", content_key(F.col("text")))
        had = self.index().withColumn("hit", F.lit(True))
        out = keyed.join(had, "key", "left").withColumn("status", F.when(F.col("hit"), "hit").otherwise("miss")).drop("hit")
        status = f"{self.place}/status/{uuid.uuid4().hex}"
        out.write.parquet(status)  # what was there when the extraction began
        out = self.spark.read.schema(out.schema).parquet(status)
        fresh = out.where("status = 'miss'").groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
        extractor(fresh).write.mode("append").option("compression", "zstd").parquet(f"{self.place}/facts")
        fresh.select("key").write.mode("append").parquet(f"{self.place}/index")
        return out

    def facts(self) -> DataFrame:
        """All kept facts; by key and seq they are in their order."""
        return self._read("facts")

    def stats(self, status: DataFrame) -> DataFrame:
        """(n_hits, n_misses, hit_rate) of an extraction."""
        hits = F.count_if(F.col("status") == "hit")
        return status.agg(hits.alias("n_hits"), F.count_if(F.col("status") == "miss").alias("n_misses"), (hits / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"))

    def clear(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.place)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
