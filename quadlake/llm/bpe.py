"""Operator 4: byte-level BPE encoding and decoding with overlapping chunks.

A text of up to CHUNK code points is encoded where it is read. A longer one is cut into chunks that overlap by
OVERLAP code points; tasks pre-tokenise the chunks in parallel, each from its own first code point, and report the
pre-token boundaries inside both overlaps. Where a chunk and its successor agree on a boundary after something
else than white space, both sequences are the same from there on (a match depends on what follows it only), so the
text is cut there, and the pieces are encoded in parallel and put together in order. If neighbours agree nowhere,
as in a run of letters longer than the overlap, the whole text is one piece. Decoding concatenates the bytes of
the ids; no id depends on its neighbours.

Ids are little-endian unsigned 32-bit integers in one binary value. Null and empty texts have no ids. Repeated
rows are encoded each by itself. Extra columns are ignored. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime

CHUNK = 32_768
OVERLAP = 512
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def _read(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("quadlake", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_read(path), special_tokens={})


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, and offsets."""
    ranks = _read(path)
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in table])])


def encode_text(text: str, path: str) -> bytes:
    return np.array(encoding(path).encode_ordinary(text), dtype="<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    raw, off = _vocabulary(path)
    x = np.frombuffer(ids, "<u4").astype(np.int64)
    if not len(x):
        return b""
    parts = []
    for a in range(0, len(x), 1 << 16):
        y = x[a : a + (1 << 16)]
        size = off[y + 1] - off[y]
        jump = np.repeat(off[y] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        parts.append(raw[jump].tobytes())
    return b"".join(parts)


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def cut_points(text: str, last: bool) -> np.ndarray:
    """Ends of pre-tokens that don't end with white space, from the first code point on.

    Unless the text ends here, a match that touches its end may go on, so it counts for nothing."""
    ends = [m.end() for m in _pattern().finditer(text) if not text[m.end() - 1].isspace()]
    return np.array([x for x in ends if last or x < len(text)], np.int32)


def _boundaries(chunk: int, overlap: int):
    """Batches of (row, i, text) to (row, i, head, tail): cut points in the overlaps, from the chunk's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(2):
                x = cut_points(text.as_py(), False)
                heads.append(x[x < overlap].tolist())
                tails.append((x[x >= chunk] - chunk).tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], ["row", "i", "head", "tail"])

    return run


def _encode(path: str, column: int):
    """The text column becomes ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # parts of about 4 MB of text
                some = batch.slice(at, 256)
                at += 256
                ids = pa.array([encode_text(x.as_py() or "", path) for x in some.column(column)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(column)), ids], [*batch.schema.names[:column], "ids"])

    return run


def _decode(path: str):
    """Batches of (..., ids) with the decoded bytes after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raw = pa.array([decode_ids(x.as_py(), path) for x in some.column(some.num_columns - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, raw], [*batch.schema.names, "bytes"])

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, pieces in order) to (doc_id, ids)."""
    for batch in batches:
        ids = pa.array([b"".join(x["ids"] for x in p.as_py()) for p in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row."""
    runtime.tune(docs.sparkSession)
    path = path or ranks_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode(path, 1), f"doc_id {kind}, ids binary")

    long = runtime.cut(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    parts = runtime.partitions(docs.sparkSession)
    each = long.select("row", F.explode(F.expr(f"sequence(0, cast(floor((length(text) - 1) / {chunk}) as int))")).alias("i"), "text")
    each = each.select("row", "i", F.expr(f"substring(text, i * {chunk} + 1, {chunk + overlap})").alias("text")).repartition(parts, "row", "i")
    seen = each.mapInArrow(_boundaries(chunk, overlap), "row long, i int, head array<int>, tail array<int>")
    seen = seen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "head", "tail"))).alias("c"))
    agreed = F.expr(f"transform(sequence(1, size(c) - 1), k -> element_at(array_intersect(c[k - 1].tail, c[k].head), 1) + k * {chunk})")
    found = F.expr("transform(sequence(1, size(c) - 1), k -> size(array_intersect(c[k - 1].tail, c[k].head)) > 0)")
    cuts = seen.select("row", F.when(F.forall(found, lambda x: x), agreed).otherwise(F.array().cast("array<int>")).alias("cuts"))
    pieces = long.join(cuts, "row").withColumn("cuts", F.expr("concat(array(0), cuts, array(length(text)))"))
    pieces = pieces.select("row", "doc_id", F.explode(F.expr("transform(sequence(0, size(cuts) - 2), k -> struct(k as k, substring(text, cuts[k] + 1, cuts[k + 1] - cuts[k]) as text))")).alias("p"))
    pieces = pieces.select("row", "doc_id", F.col("p.k").alias("k"), F.col("p.text").alias("text")).repartition(parts, "row", "k")
    done = pieces.mapInArrow(_encode(path, 3), f"row long, doc_id {kind}, k int, ids binary")
    done = done.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("pieces"))
    return short.unionByName(done.select("doc_id", "pieces").mapInArrow(_join, f"doc_id {kind}, ids binary"))


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``ids`` (last column: ids) with a column ``bytes``."""
    return ids.mapInArrow(_decode(path or ranks_path()), ", ".join(f"`{n}` {t}" for n, t in ids.dtypes) + ", bytes binary")


def digests(docs: DataFrame) -> DataFrame:
    out = decode(encode(docs))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
