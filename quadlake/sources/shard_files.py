"""Compact binary files of shards: a string table, quads and tapes as little-endian 16-bit numbers.

Layout (fixed): magic ``PMEM``; four u16 (capacity, strings, quads, tape rows); each string as u8 length and UTF-8;
each quad as four u16 (subject, relation, object, condition or 0xFFFF); each tape row the same and a u8 stop flag; the
rest is the summary. A shard is one file by format, so it is written by one task: strings of over 255 bytes and
shards of over 65,534 strings or 65,535 quads or tape rows raise before a byte is written.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, NONE = b"PMEM", 0xFFFF


def encode(quads: list[tuple[str, str, str, str]], tape: list[tuple[str, str, str, str] | None] = (), capacity: int = 256, summary: str = "") -> bytes:
    """Bytes of one shard; ``None`` in the tape is a stop row."""
    index: dict[str, int] = {}
    number = lambda s: index.setdefault(s, len(index))
    row = lambda q: (*map(number, q[:3]), number(q[3]) if q[3] else NONE)
    cells = [struct.pack("<4H", *row(q)) if len(index) <= NONE else b"" for q in quads]
    tapes = [struct.pack("<4HB", *(row(q) if q else (0, 0, 0, 0)), not q) for q in tape]
    strings = [s.encode() for s in index]
    if len(strings) >= NONE or max(len(cells), len(tapes)) > NONE or any(len(s) > 255 for s in strings):
        raise ValueError("a shard exceeds the format: 65,534 strings of 255 bytes, 65,535 quads and tape rows")
    head = MAGIC + struct.pack("<4H", capacity, len(strings), len(cells), len(tapes))
    return b"".join([head, *(bytes([len(s)]) + s for s in strings), *cells, *tapes, summary.encode()])


def decode(data: bytes) -> tuple[list[tuple[str, str, str, str]], list[tuple[str, str, str, str] | None], int, str]:
    """(quads, tape, capacity, summary) of :func:`encode`."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    capacity, n_strings, n_quads, n_tape = struct.unpack_from("<4H", data, 4)
    at, strings = 12, []
    for _ in range(n_strings):
        end = at + 1 + data[at]
        strings.append(data[at + 1 : end].decode())
        at = end
    named = lambda r: (strings[r[0]], strings[r[1]], strings[r[2]], "" if r[3] == NONE else strings[r[3]])
    quads = [named(r) for r in struct.iter_unpack("<4H", data[at : at + 8 * n_quads])]
    at += 8 * n_quads
    tape = [None if r[4] else named(r) for r in struct.iter_unpack("<4HB", data[at : at + 9 * n_tape])]
    return quads, tape, capacity, data[at + 9 * n_tape :].decode()


def encode_shards(quads: DataFrame) -> DataFrame:
    """(shard, data) of rows (shard, subject, relation, object, condition); a later row of a cell replaces the earlier
    one, where the order is that of relation and condition."""
    last = quads.groupBy("shard", "subject", "object").agg(F.max(F.struct("relation", "condition")).alias("x")).select("shard", "subject", "x.relation", "object", "x.condition")

    def one(x: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(x[["subject", "relation", "object", "condition"]].itertuples(index=False, name=None))
        return pd.DataFrame({"shard": [x["shard"].iloc[0]], "data": [encode(rows)]})

    return last.groupBy("shard").applyInPandas(one, "shard string, data binary")


def decode_shards(files: DataFrame) -> DataFrame:
    """(shard, subject, relation, object, condition) of rows (shard, data)."""

    def rows(batches):
        for batch in batches:
            out = [(s, *q) for s, d in batch.itertuples(index=False) for q in decode(bytes(d))[0]]
            yield pd.DataFrame(out, columns=["shard", "subject", "relation", "object", "condition"])

    return files.select("shard", "data").mapInPandas(rows, "shard string, subject string, relation string, object string, condition string")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Quads of all ``*.pmem`` files of a folder, the shard named by its file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pmem").load(folder)
    return decode_shards(files.select(F.regexp_extract("path", r"([^/]+)\.pmem$", 1).alias("shard"), F.col("content").alias("data")))
