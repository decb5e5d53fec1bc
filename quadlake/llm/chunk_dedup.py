"""Operator 10: substring deduplication with content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = (h << 1) + GEAR[byte], of which the low 16 bits follow the last 16
bytes. A position is a cut where its hash is the rightmost least within REACH positions on either side; that
depends on nearby bytes only, so chunks (REACH + 1 bytes at least but for the ends of a text, about twice that on
average) realign right after an insertion. Bytes without a cut for LONGEST positions are cut there. Equal chunks
by 64-bit digest are one content; its first document by doc_id keeps it (and there its first place), every other
occurrence is a repeat and is counted as such. Repeats are removed where neighbouring ones make up ``least_run``
bytes (LEAST_RUN unless the caller says otherwise; 0 removes all) or the whole text, so that common phrases stay.

Digests are counted with long keys and map-side aggregation; repeats come from an equi-join that adaptive execution
can split; nothing is gathered by content.

Null and empty texts have no chunks. Rows that share a doc_id follow each other in the order in which they are read,
so of equal rows one stays; a null doc_id comes last. Cuts never split a code point. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

REACH = 24
LONGEST = 1024
LEAST_RUN = 96

_GEAR = (textops.mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The 16 low bits of the gear hash at each byte, by doubling: each step joins two windows of half the length."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint32(s)
    return h << np.uint32(16)  # only the low half counts


def _local_least(h: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose value is the rightmost least of all within ``reach`` on both sides."""
    n = len(h)
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFFFF)))
    width = 2 * reach + 1
    padded = np.full(n + 2 * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[reach : reach + n] = key
    low, span = padded, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n], low[width - span : width - span + n])
    return np.flatnonzero(low == key)


def chunks(data: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = _local_least(gear(data), reach)
    at = at[(at >= reach) & (at < n - reach)] + 1  # near the ends the neighbourhood is cut off
    ends = np.append(at, n)
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > longest:
        ends = np.unique(np.concatenate([ends, *(np.arange(a + longest, b, longest) for a, b in zip(starts, ends, strict=True) if b - a > longest)]))
    if n > 1 and (data > 127).any():  # a cut inside a code point moves to its end
        ends = ends.copy()
        for _ in range(3):
            inner = (ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80)
            ends[inner] += 1
        ends = np.unique(ends)
    return ends


def chunk_table(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, digest) of all chunks of several texts."""
    ends, rows = [], []
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        e = chunks(data[a:b])
        ends.append(e + a)
        rows.append(np.full(len(e), r))
    if not ends:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    end, row = np.concatenate(ends), np.concatenate(rows)
    start = np.concatenate([[0], end[:-1]])[: len(end)]
    start = np.maximum(start, bounds[row])
    return row, start, end, textops.word_hashes(data, start, end).view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc, row, text) to distinct (doc, row, digest)."""
    for batch in batches:
        doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, end, data, bounds in textops.pieces(batch.column(2)):
            row, _, _, digest = chunk_table(data, bounds)
            pairs = np.unique(np.stack([row, digest]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at:end][pairs[0]], pa.int64()), pa.array(place[at:end][pairs[0]], pa.int64()), pa.array(pairs[1], pa.int64())], ["doc", "row", "digest"])


def removed(row: np.ndarray, start: np.ndarray, end: np.ndarray, later: np.ndarray, least: int, whole: np.ndarray) -> np.ndarray:
    """Which later chunks are in runs of ``least`` bytes, or of whole texts of size ``whole``."""
    if not len(row):
        return later
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (later[1:] != later[:-1])])
    run = np.cumsum(edge) - 1
    size = np.bincount(run, weights=(end - start))
    return later & ((size[run] >= least) | (size[run] == whole[row]))


def _strip(least_run: int):
    """Batches of (doc_id, text, later digests) to what stays, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, data, bounds in textops.pieces(batch.column(1)):
                row, start, end, digest = chunk_table(data, bounds)
                n = stop - at
                lists = batch.column(2).slice(at, n)
                gone = [np.array(x.as_py(), np.int64) if x.is_valid else np.zeros(0, np.int64) for x in lists]
                first = np.searchsorted(row, np.arange(n + 1))
                later = np.zeros(len(row), bool)
                for r in range(n):
                    a, b = first[r], first[r + 1]
                    seen = np.ones(b - a, bool)
                    seen[np.unique(digest[a:b], return_index=True)[1]] = False
                    later[a:b] = seen | (np.isin(digest[a:b], gone[r]) if len(gone[r]) else False)
                cut = removed(row, start, end, later, least_run, np.diff(bounds))
                texts = []
                for r in range(n):
                    a, b = first[r], first[r + 1]
                    c = cut[a:b]
                    texts.append(b"".join(data[s:e].tobytes() for s, e, x in zip(start[a:b], end[a:b], c, strict=True) if not x) if c.any() else data[bounds[r] : bounds[r + 1]].tobytes())

                def count(mask: np.ndarray) -> pa.Array:
                    return pa.array(np.bincount(row[mask], minlength=n), pa.int64())

                def size(mask: np.ndarray) -> pa.Array:
                    return pa.array(np.bincount(row[mask], weights=(end - start)[mask], minlength=n).astype(np.int64))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array([t.decode() for t in texts], pa.string()), pa.array(np.bincount(row, minlength=n), pa.int64()), count(later), size(later), count(cut), size(cut)],
                    ["doc_id", "text", "n_chunks", "n_repeats", "repeat_bytes", "n_removed", "removed_bytes"],
                )

    return run


def deduplicate_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, text, n_chunks, n_repeats, repeat_bytes, n_removed, removed_bytes) of every row, text: what stays."""
    runtime.tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    # ids that are no keys: rows get numbers of their own, and places are (id, number)
    rows = runtime.cut(rows.withColumn("row", F.monotonically_increasing_id())) if shared else rows.withColumn("row", F.col("doc"))
    place = F.struct("doc", "row") if shared else F.col("doc")
    seen = runtime.cut(rows.select("doc", "row", "text").mapInArrow(_occurrences, "doc long, row long, digest long"))
    first = seen.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first").select("digest", "first")
    later = runtime.cut(seen.join(first, "digest").where(place > F.col("first")).groupBy("row").agg(F.collect_set("digest").alias("later")))
    runtime.drop(seen)
    # one plan at every size: texts move once to their documents' repeated chunks
    joined = rows.join(later.hint("merge"), "row", "left")
    return joined.select("doc_id", "text", "later").mapInArrow(_strip(least_run), "doc_id long, text string, n_chunks long, n_repeats long, repeat_bytes long, n_removed long, removed_bytes long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chunks", "n_repeats", "repeat_bytes", "n_removed", "removed_bytes", (F.col("n_removed") > 0).alias("repeats"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
