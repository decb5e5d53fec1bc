"""Operator 3: media columns, chroma fingerprints of audio.

Audio is a binary column of WAV files (PCM, 16 bits, one channel, RATE Hz). Frames of FRAME samples every HOP are
transformed to 12 pitch classes and normalised. Over the integral image of the pitch-class frames, FILTERS compare
sums of rectangles in a window of WIDTH frames; each answer becomes two bits (Gray code), 16 answers one 32-bit
integer a frame. Equal fingerprints form a class (its least id stands for it). To align two recordings, equal
integers vote for an offset (a sustained sound, whose integers repeat, votes once); every offset with VOTES votes is
verified by the share of unequal bits where the recordings overlap, and the best one counts.

Queries are a stated set, the recordings whose id is divisible by 100, compared to all classes. Votes come from an
equi-join by integer, summed map-side by (query, class, offset) right behind it; adaptive execution splits integers
that very many recordings have. Nothing comes to the driver.

Null, malformed or empty audio is a class of its own. Audio too short for an integer is in one class with equal
samples and is aligned with nothing. Repeated rows are recordings of their own (of one class). Extra columns are
ignored.

The tables hold no audio, so the query derives a recording from each turn of ``conversations``: every word of the
whole text is a tone of TONE samples whose two pitches follow from the word's hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

RATE, FRAME, HOP, WIDTH, TONE = 2048, 512, 128, 16, 256
VOTES, OVERLAP, ERRORS = 4, 16, 0.2
LEVEL = 0.25

#: (kind, lowest pitch class, pitch classes, frames) of each filter.
FILTERS = tuple((i % 4, (5 * i) % 9, 3 + i % 4 if (5 * i) % 9 + 3 + i % 4 <= 12 else 3, (4, 8, 12, 16)[(i // 4) % 4]) for i in range(16))

_WINDOW = np.hanning(FRAME).astype(np.float32)


def _pitch_classes() -> np.ndarray:
    out = np.zeros((FRAME // 2 + 1, 12), np.float32)
    for k in range(1, FRAME // 2 + 1):
        hz = k * RATE / FRAME
        if hz >= 60:
            out[k, round(12 * np.log2(hz / 261.6256)) % 12] = 1
    return out


_CLASSES = _pitch_classes()


def write_wav(samples: np.ndarray) -> bytes:
    raw = np.clip(samples * 32767, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, 2 * RATE, 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw


def read_wav(raw: bytes | None) -> np.ndarray:
    """Samples of -1 to 1; none if it isn't a file of the kind above."""
    none = np.zeros(0, np.float32)
    if not raw or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return none
    at, fine = 12, False
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            if size < 16 or at + 24 > len(raw):
                return none
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            fine = (code, channels, rate, bits) == (1, 1, RATE, 16)
        elif kind == b"data":
            body = raw[at + 8 : at + 8 + size]
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768 if fine else none
        at += 8 + size + size % 2
    return none


def chroma(samples: np.ndarray) -> np.ndarray:
    """frames x 12, each frame of length one (silent ones zero)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    out = np.empty((n, 12), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for a in range(0, n, 1024):
        power = np.abs(np.fft.rfft(view[a : a + 1024] * _WINDOW, axis=1)) ** 2
        out[a : a + 1024] = power @ _CLASSES
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each window of WIDTH frames."""
    c = chroma(samples)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        t, m = w // 2, y + h // 2
        if kind == 0:
            a, b = area(0, w, y, m), area(0, w, m, y + h)
        elif kind == 1:
            a, b = area(0, t, y, y + h), area(t, w, y, y + h)
        elif kind == 2:
            a, b = area(0, t, y, m) + area(t, w, m, y + h), area(t, w, y, m) + area(0, t, m, y + h)
        else:
            a, b = area(w // 4, w - w // 4, y, y + h), area(0, w // 4, y, y + h) + area(w - w // 4, w, y, y + h)
        level = np.log((1 + a) / (1 + b))
        step = (level > -LEVEL).astype(np.uint32) + (level > 0) + (level > LEVEL)
        out = (out << np.uint32(2)) | (step ^ (step >> np.uint32(1)))
    return out


def sonify(hashes: np.ndarray) -> np.ndarray:
    """A tone for each word: two of 24 pitches from 262 Hz on, by its hash."""
    if not len(hashes):
        return np.zeros(0)
    low, high = (hashes % np.uint64(24)).astype(int), (hashes // np.uint64(24) % np.uint64(24)).astype(int)
    time = np.arange(TONE) / RATE
    tones = np.sin(2 * np.pi * 261.6256 * 2.0 ** (np.arange(24)[:, None] / 12) * time)
    return ((tones[low] + 0.5 * tones[high]) / 1.6).ravel()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, turn, text) to (conv_id, turn, audio)."""
    for batch in batches:
        for at, end, data, bounds in textops.pieces(batch.column(2), 1 << 15):
            starts, ends, rows, low = textops.words(data, bounds, textops.SPACE)
            each = np.split(textops.word_hashes(low, starts, ends), np.searchsorted(rows, np.arange(1, end - at)))
            audio = pa.array([write_wav(sonify(x)) for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), audio], ["conv_id", "turn", "audio"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, turn, audio) to (conv_id, turn, codes, class)."""
    for batch in batches:
        codes, kind = [], []
        for x in batch.column(2):
            samples = read_wav(x.as_py())
            codes.append(fingerprint(samples).view(np.int32))
            kind.append(textops.digest128(codes[-1].tobytes() if len(codes[-1]) else b"short" + samples.tobytes()) if len(samples) else None)
        off = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *codes])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(kind, pa.binary())], ["conv_id", "turn", "codes", "class"])


def fingerprints(media: DataFrame) -> DataFrame:
    """(conv_id, turn, codes, class) of the media rows (conv_id, turn, audio)."""
    return media.select("conv_id", "turn", "audio").mapInArrow(_fingerprints, "conv_id long, turn long, codes array<int>, class binary")


def alignments(prints: DataFrame) -> DataFrame:
    """(query, class, offset, overlap, errors) of every query class and every other class that align.

    place in class = place in query + offset."""
    classes = prints.where("class is not null and size(codes) > 0").groupBy("class").agg(F.first("codes").alias("codes"), F.max((F.col("conv_id") % 100 == 0).cast("int")).alias("asked"))
    classes = runtime.cut(classes)
    begins = "inline(filter(transform(codes, (c, i) -> struct(c as code, i as place)), x -> x.place = 0 or codes[x.place - 1] <> x.code))"
    asked = classes.where("asked = 1").select(F.col("class").alias("query"), "codes")
    index = asked.select("query", F.expr(begins)).withColumnRenamed("place", "at")
    votes = classes.select("class", F.expr(begins)).join(index, "code").where("class <> query").groupBy("query", "class", (F.col("place") - F.col("at")).alias("offset")).count().where(F.col("count") >= VOTES)
    both = votes.join(classes.select("class", F.col("codes").alias("c")), "class").join(asked.withColumnRenamed("codes", "q"), "query")
    both = both.withColumn("a", F.greatest(F.lit(0), "offset")).withColumn("n", F.least(F.size("c"), F.col("offset") + F.size("q")) - F.col("a")).where(F.col("n") >= OVERLAP)
    unequal = F.zip_with(F.expr("slice(c, a + 1, n)"), F.expr("slice(q, a - offset + 1, n)"), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    both = both.withColumn("bits", F.aggregate(unequal, F.lit(0), lambda s, x: s + x)).where(F.col("bits") <= ERRORS * 32 * F.col("n"))
    best = both.groupBy("query", "class").agg(F.min(F.struct((F.col("bits") / (32 * F.col("n"))).alias("errors"), (-F.col("n")).alias("o"), "offset")).alias("b"))
    return runtime.cut(best.select("query", "class", F.col("b.offset").cast("long").alias("offset"), (-F.col("b.o")).cast("long").alias("overlap"), "b.errors"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    # few bytes of text make many of audio: spread them over all tasks
    turns = turns.repartition(4 * runtime.partitions(spark), F.xxhash64("conv_id", "turn"))
    prints = runtime.cut(fingerprints(turns.mapInArrow(_render, "conv_id long, turn long, audio binary")))
    first = prints.where("class is not null").groupBy("class").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    links = alignments(prints)
    each = links.groupBy("query").agg(F.count("*").alias("n_links"), F.min(F.struct("errors", (-F.col("overlap")).alias("o"), "class", "offset")).alias("b"))
    each = each.join(first.select(F.col("class").alias("c"), F.col("first").alias("other")), F.col("b.class") == F.col("c"), "left")
    each = each.select(F.col("query").alias("class"), "n_links", F.col("other.conv_id").alias("best_conv_id"), F.col("other.turn").alias("best_turn"), F.col("b.offset").alias("best_offset"), F.col("b.errors").alias("bit_errors"))
    facts = runtime.cut(first.join(each, "class", "left"))
    out = prints.join(facts, "class", "left")
    asked = F.col("conv_id") % 100 == 0
    n = F.when(asked, F.coalesce("n_links", F.lit(0)))
    only = [F.when(asked, F.col(c)).alias(c) for c in ("best_conv_id", "best_turn", "best_offset", "bit_errors")]
    return out.select("conv_id", "turn", F.size("codes").cast("long").alias("n_codes"), F.coalesce("first.conv_id", "conv_id").alias("class_conv_id"), F.coalesce("first.turn", "turn").alias("class_turn"), F.hex("class").alias("class"), n.alias("n_links"), *only)
