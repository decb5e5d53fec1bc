"""Operator 8: benchmark decontamination by winnowing.

Items and documents are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Of every
WINDOW - GRAM + 1 consecutive GRAM-grams the rightmost least hash is a fingerprint, so any span of WINDOW common
words shares at least one fingerprint at the same place in both. The fingerprints of documents are joined with those
of items; in the documents that meet any, each common fingerprint is extended to the windows of WINDOW words around
it, and those that are an item's (an equi-join by hash) are hits. An item of fewer words is one window of all of
them; at most SHORT such windows at a time are sent to the scan of the documents, which looks up its runs of that
length.

Every window of a document that is an item's is found, so neighbouring hits merge into the whole shared span. A
fingerprint that very many documents or items have is one row on the items' side of its join, and ids of items are
joined to distinct windows of a document only: no pairs of places are made. Items come to the driver only as at most
SHORT hashes of short windows at a time. Words are compared by 64-bit hashes, rows of documents by a hash of id and
text: rows of one key are equal and have equal hits.

Null or empty texts have no words: they are neither hit nor hit others. Repeated rows are judged each by itself;
items with equal texts are all reported. The words of an item without id are hits like any, but no id is listed.
Ids are of any type. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

U64 = np.uint64
WINDOW = 10
GRAM = 5
#: Windows of short items that are sent to the tasks at a time.
SHORT = 1 << 20


def fingerprints(hashes: np.ndarray, rows: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, word position) chosen by winnowing; ``rows`` tells the texts apart."""
    g = textops.grams(hashes, gram)
    span = window - gram + 1
    if len(g) < span:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(g) - span + 1
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        le = g[j : j + n] <= best  # the rightmost of equal ones
        np.copyto(best, g[j : j + n], where=le)
        at[le] = j
    at += np.arange(n)
    whole = rows[:n] == rows[window - 1 : window - 1 + n]
    at = at[whole]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    return g[at], at


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row of each word, words of each row) of pieces of a batch."""
    for at, end, data, bounds in textops.pieces(column):
        starts, ends, rows, low = textops.words(data, bounds, textops.NOT_ALNUM)
        yield at, end, textops.word_hashes(low, starts, ends), rows, np.bincount(rows, minlength=end - at)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (item, text) to (item, n, window): the distinct windows of each item, n: their words."""
    for batch in batches:
        for at, end, hashes, _, count in _words(batch.column(1)):
            owner, size, value = [], [], []
            first = np.cumsum(count) - count
            for i in np.flatnonzero(count).tolist():
                n = min(WINDOW, int(count[i]))
                g = np.unique(textops.grams(hashes[first[i] : first[i] + count[i]], n))
                owner.append(np.full(len(g), at + i))
                size.append(np.full(len(g), n, np.int32))
                value.append(g.view(np.int64))
            if owner:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(size)), pa.array(np.concatenate(value))], ["item", "n", "window"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text) to (print)."""
    for batch in batches:
        for _, _, hashes, rows, _ in _words(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(fingerprints(hashes, rows)[0]).view(np.int64))], ["print"])


def _scan(short: dict[int, np.ndarray]):
    """Batches of (doc_id, key, text) to (doc_id, key, n_words, prints, starts, sizes, windows).

    The last three are the runs of words that are windows of short items, whose hashes are given by length."""
    names = ["doc_id", "key", "n_words", "prints", "starts", "sizes", "windows"]

    def lists(rows: np.ndarray, n: int, value: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, hashes, rows, count in _words(batch.column(2)):
                n = end - at
                value, place = fingerprints(hashes, rows)
                first = np.cumsum(count) - count
                found = [np.zeros((0, 3), np.int64)]
                for size, wanted in short.items():
                    g = textops.grams(hashes, size)
                    if len(g):
                        p = np.flatnonzero(np.isin(g, wanted) & (rows[: len(g)] == rows[size - 1 :]))
                        found.append(np.stack([p, np.full(len(p), size), g[p].view(np.int64)], axis=1))
                hit = np.concatenate(found)
                hit = hit[np.argsort(hit[:, 0], kind="stable")]
                row = rows[hit[:, 0]] if len(hit) else np.zeros(0, np.int64)
                made = [pa.array(count, pa.int64()), lists(rows[place] if len(place) else np.zeros(0, np.int64), n, value.view(np.int64))]
                made += [lists(row, n, (hit[:, 0] - first[row]).astype(np.int32)), lists(row, n, hit[:, 1].astype(np.int32)), lists(row, n, hit[:, 2])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *made], names)

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text, prints) to (key, start, window): windows around the places of those fingerprints."""
    for batch in batches:
        wanted = batch.column(2)
        for at, end, hashes, rows, count in _words(batch.column(1)):
            n = end - at
            value, place = fingerprints(hashes, rows)
            owner = rows[place] if len(place) else np.zeros(0, np.int64)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            keep = np.zeros(len(value), bool)
            for r in range(n):
                keep[cuts[r] : cuts[r + 1]] = np.isin(value[cuts[r] : cuts[r + 1]].view(np.int64), wanted[at + r].values.to_numpy())
            g = textops.grams(hashes, WINDOW)
            p = np.unique((place[keep][:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
            p = p[(p >= 0) & (p < len(g))]
            p = p[rows[p] == rows[p + WINDOW - 1]] if len(p) else p
            first = np.cumsum(count) - count
            row = rows[p] if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), pa.array((p - first[row]).astype(np.int32)), pa.array(g[p].view(np.int64))], ["key", "start", "window"])


def _short_blocks(windows: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """Hashes of the windows of short items by length, at most about SHORT at a time; an empty one if there are none."""
    rows = windows.where(F.col("n") < WINDOW).select("n", "window").distinct()
    blocks = max(1, -(-rows.count() // SHORT))
    for b in range(blocks):
        table = rows.where(F.pmod("window", F.lit(blocks)) == b).toArrow()
        n, value = table.column("n").to_numpy(), table.column("window").to_numpy().view(U64)
        yield {int(k): np.sort(value[n == k]) for k in np.unique(n)}


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, starts, ends, items): disjoint hit spans [start, end) in words, ids of occurring items."""
    runtime.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    windows = runtime.cut(items.mapInArrow(_windows, f"item {item_kind}, n int, window long").distinct())
    prints = runtime.cut(items.select("text").mapInArrow(_prints, "print long").distinct())

    schema = f"doc_id {kind}, key long, n_words long, prints array<long>, starts array<int>, sizes array<int>, windows array<long>"
    scanned, hits = None, []
    for block in _short_blocks(windows):
        more = rows.mapInArrow(_scan(block), schema)
        if scanned is None:
            scanned = more = runtime.cut(more)
        short = more.where(F.size("starts") > 0).select("key", F.explode(F.arrays_zip("starts", "sizes", "windows")).alias("x"))
        hits.append(runtime.cut(short.select("key", F.col("x.starts").alias("start"), F.col("x.sizes").alias("n"), F.col("x.windows").alias("window"))))

    meet = scanned.select("key", F.explode("prints").alias("print")).join(runtime.small(prints, prints.count()), "print")
    meet = runtime.cut(meet.groupBy("key").agg(F.collect_set("print").alias("prints")))
    near = rows.select("key", "text").join(runtime.small(meet, meet.count()), "key")
    near = near.select("key", "text", "prints").mapInArrow(_extend, "key long, start int, window long")
    whole = windows.where(F.col("n") == WINDOW).select("n", "window").distinct()
    hits.append(near.join(runtime.small(whole, whole.count()), "window").select("key", "start", "n", "window"))
    occurring = hits[0]
    for x in hits[1:]:
        occurring = occurring.unionByName(x)
    occurring = runtime.cut(occurring.distinct())

    step = """aggregate(s, cast(array() as array<struct<starts: int, ends: int>>), (x, y) ->
        if(size(x) > 0 and y.starts <= element_at(x, -1).ends,
           concat(slice(x, 1, size(x) - 1), array(named_struct('starts', element_at(x, -1).starts, 'ends', greatest(element_at(x, -1).ends, y.ends)))),
           concat(x, array(y))))"""
    spans = occurring.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("starts"), (F.col("start") + F.col("n")).alias("ends")))).alias("s")).select("key", F.expr(step).alias("s"))
    owners = occurring.select("key", "n", "window").distinct().join(windows.where("item is not null"), ["n", "window"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = runtime.cut(spans.join(owners, "key", "left"))
    out = scanned.select("doc_id", "key", "n_words").join(runtime.small(facts, facts.count()), "key", "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "key", "n_words", F.coalesce("s.starts", none).alias("starts"), F.coalesce("s.ends", none).alias("ends"), F.coalesce("items", F.array().cast(f"array<{item_kind}>")).alias("items"))


def _n_hit():
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """``docs`` without rows of which more than ``share`` of the words are hit; all columns stay."""
    found = contamination(docs, items)
    key = runtime.fresh(docs.columns, "key")
    gone = runtime.cut(found.where(_n_hit() > share * F.col("n_words")).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(runtime.small(gone, gone.count()), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = _n_hit()
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


NO_ITEMS = hashlib.sha256(b"").hexdigest()

ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS x FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, x)
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
