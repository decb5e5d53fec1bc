"""Operator 7: quality classifier, a sparse ensemble of rules.

Statistics of the whole text (FEATURES) are computed in one vectorised pass over its bytes. On a bounded sample of
labelled rows (at most SAMPLE, the least by hash; rows whose crc32(doc_id) mod 5 is 0 are never used) shallow
gradient trees are grown; every path from a root to a node is a rule, a conjunction of thresholds. An L1-penalised
logistic regression over the rules keeps a few, and the sum of their weights is compiled into one Spark column
expression, so scoring runs inside Spark's generated code. Labels, lang, source and doc_id are never inputs.

Null and empty texts have zero statistics and get a score like any other. Labels that are null or belong to no row
are ignored; if a doc_id has several rows or labels, each pair is an example. Without examples of both classes the
score is the smoothed share of label 1 (0.5 without any). Rows that repeat are scored each by itself. A null doc_id
counts as an empty text in the hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

#: At most this many labelled rows are fitted on.
SAMPLE = 20_000
TREES, DEPTH, LEAF, BINS = 40, 3, 25, 32
PENALTY, STEPS = 2e-3, 400
THRESHOLD = 0.3

FEATURES = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "upper", "digits", "symbols", "marks", "non_ascii",
    "distinct_words", "repeated_pairs", "marked_words", "bare_words", "line_words", "common_word",
)

_IS = {name: np.zeros(256, bool) for name in ("upper", "digit", "symbol", "mark", "letter")}
_IS["upper"][65:91] = True
_IS["digit"][48:58] = True
_IS["symbol"][[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
_IS["mark"][[ord(c) for c in "!?.,;:'\"()-"]] = True
_IS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(bounds) - 1
    size = np.diff(bounds)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    starts, ends, rows, low = textops.words(data, bounds, textops.SPACE)
    h = textops.word_hashes(low, starts, ends)
    words = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    least = np.maximum(words, 1)
    letters = np.concatenate([[0], np.cumsum(_IS["letter"][data])])
    bare = letters[ends] == letters[starts] if len(starts) else np.zeros(0, bool)
    marked = ~(_IS["letter"][data[ends - 1]]) if len(starts) else np.zeros(0, bool)
    lines = share(data == 10) + (size > 0)
    distinct, common = np.zeros(n), np.zeros(n)
    for r in range(n):
        x = np.sort(h[first[r] : first[r + 1]])
        if len(x):
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            distinct[r], common[r] = len(at), np.diff(np.append(at, len(x))).max()
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=n).astype(float)
    b = np.maximum(size, 1)
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), np.bincount(rows, weights=ends - starts, minlength=n) / least,
        share(_IS["upper"][data]) / b, share(_IS["digit"][data]) / b, share(_IS["symbol"][data]) / b, share(_IS["mark"][data]) / b, share(data > 127) / b,
        distinct / least, same / least, np.bincount(rows[marked], minlength=n) / least, np.bincount(rows[bare], minlength=n) / least,
        words / np.maximum(lines, 1), common / least,
    ], axis=1)


def _measure(column: int):
    """The text column gives way to the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in textops.pieces(batch.column(column)):
                x = statistics(data, bounds)
                kept = [batch.column(i).slice(at, end - at) for i in range(column)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], [*batch.schema.names[:column], *FEATURES])

    return run


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold) hold: value > threshold if above, else value <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            c = F.col(FEATURES[f])
            out &= (c > F.lit(t)) if above else (c <= F.lit(t))
        return out


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, rng: np.random.Generator, rules: list[tuple]) -> np.ndarray:
    """One regression tree on the gradient; adds its paths to ``rules`` and returns its step."""
    step = np.zeros(len(x))

    def split(rows: np.ndarray, terms: tuple, depth: int) -> None:
        if terms:
            rules.append(terms)
        g = gradient[rows]
        step[rows] = g.mean()
        if depth == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-9, -1, 0)
        for f in rng.permutation(len(edges))[: max(4, len(edges) // 2)]:
            k = len(edges[f]) + 1
            if k < 2:
                continue
            c = np.bincount(codes[rows, f], minlength=k)[:-1].cumsum()
            s = np.bincount(codes[rows, f], weights=g, minlength=k)[:-1].cumsum()
            ok = (c >= LEAF) & (len(rows) - c >= LEAF)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(c, 1) + (g.sum() - s) ** 2 / np.maximum(len(rows) - c, 1) - g.sum() ** 2 / len(rows), 0)
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(f), int(gain.argmax()))
        if best[1] < 0:
            return
        _, f, at = best
        t = float(edges[f][at])
        left = codes[rows, f] <= at
        split(rows[left], (*terms, (f, False, t)), depth + 1)
        split(rows[~left], (*terms, (f, True, t)), depth + 1)

    split(np.arange(len(x)), (), 0)
    return step


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Rule]]:
    """(bias, rules with weights)."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 2 * LEAF or y.min() == y.max():
        return float(np.log(share / (1 - share))), []
    rng = np.random.default_rng(11)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, found = np.zeros(len(y)), []
    for _ in range(TREES):
        gradient = y - 1 / (1 + np.exp(-margin))
        margin += 1.5 * _grow(x, codes, edges, gradient, rng, found)
    terms = list(dict.fromkeys(found))
    z = np.stack([Rule(t).holds(x) for t in terms], axis=1).astype(np.float32)
    mean, dev = z.mean(0), np.maximum(z.std(0), 1e-3)
    z = (z - mean) / dev
    # accelerated proximal gradient; the Lipschitz constant is a quarter of the largest eigenvalue
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        norm = np.linalg.norm(v)
        v /= norm
    rate = len(y) / (0.25 * norm * 1.05 + 0.25 * len(y))
    w, b, u, c, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ u.astype(np.float32) + c))) - y
        w2 = u - rate * (z.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * PENALTY, 0)
        b2 = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / dev
    return float(b - (w * mean).sum()), [Rule(s, float(k)) for s, k in zip(terms, w, strict=True) if k]


def compiled(bias: float, rules: list[Rule]) -> Column:
    """The score as a column over FEATURES."""
    terms = [F.lit(bias), *(F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in rules)]
    while len(terms) > 1:  # a balanced sum: a chain of hundreds of terms is too deep for the analyser
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return 1 / (1 + F.exp(-terms[0]))


def _remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FEATURES) of every row, written to the shared folder."""
    runtime.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return runtime.cut(rows.mapInArrow(_measure(1), ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FEATURES)])))


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[Rule]]:
    """Fits the rules on at most ``sample`` labelled rows that are not held out."""
    marked = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("__y"))
    rows = stats.where(_remainder() != 0).join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "__y", *FEATURES).limit(sample)
    table = rows.select("__y", *FEATURES).toArrow()
    x = np.stack([table.column(f).to_numpy() for f in FEATURES], axis=1) if len(table) else np.zeros((0, len(FEATURES)))
    return fit(x, table.column("__y").to_numpy())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    stats = measured(docs)
    score = compiled(*learn(stats, labels))
    out = stats.select("doc_id", (_remainder() == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def _both(column: int, names: list[str]):
    """All columns, then the statistics under these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in textops.pieces(batch.column(column)):
                x = statistics(data, bounds)
                some = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], [*batch.schema.names, *names])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all columns stay.

    Only the sampled rows are measured to fit the rules (SAMPLE ids at most are sent to find them); then all rows are
    measured once."""
    marked = labels.where("quality is not null").select("doc_id", "quality")
    ids = docs.select("doc_id").where(_remainder() != 0).join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "quality").limit(SAMPLE).select("doc_id").distinct()
    bias, rules = learn(measured(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")), labels)
    names = [runtime.fresh(docs.columns, f"__q_{f}") for f in FEATURES]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *(f"`{n}` double" for n in names)])
    wide = docs.mapInArrow(_both(docs.columns.index("text"), names), schema)
    score = compiled(bias, rules)
    # the rules speak of FEATURES by name: the document is a struct beside them
    inner = wide.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *[F.col(n).alias(f) for n, f in zip(names, FEATURES, strict=True)])
    return inner.where(score >= threshold).select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
