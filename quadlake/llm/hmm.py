"""Operator 9: language-model scoring with a hidden Markov model trained by Baum-Welch.

Tokens are lower-cased (A-Z) words of non-space bytes, and one end token for each text. The commonest OWN words of
the training texts are emission symbols of their own; any other word is emitted as one of SHAPES classes (by its
last bytes) times its share of the class, (c + 1) / (N_class + V_class + 1), where words never seen share the one
added to V_class. So the model is a proper distribution over texts, and each text's likelihood is exact: the scaled
forward recursion over its whole symbol sequence, and a sum over its words.

Counting words is a distributed sum over all training texts. Expected counts of starts, transitions and emissions
are computed by scaled forward-backward passes in the tasks and summed by Spark; only the parameters (STATES
times the symbols) come to the driver. Each of the ROUNDS reads all training texts, whose symbols are written once.

Counts of the commonest HEAD words are sent to the tasks (a fixed bound); the counts of all other words are joined
by Spark to the words of the texts. Words are compared by 64-bit hashes.

Texts whose crc32(doc_id) mod 7 is 2 are held out of all counts; a null doc_id counts as an empty text there. Null
and empty texts have just the end token. Repeated rows count and are scored each by itself. Without training texts
every count is zero and the model is uniform. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

U64 = np.uint64
OWN, HEAD, SHAPES, STATES = 4096, 1 << 19, 2048, 8
ROUNDS = 5
FLUSH_WORDS, FLUSH_TOKENS = 1_000_000, 1_000_000
END = textops.mix(np.array([0x5EED], U64))[0]


def tokenise(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape class, row) of the words of several texts, without end tokens."""
    starts, ends, rows, low = textops.words(data, bounds, textops.SPACE)
    hashes = textops.word_hashes(low, starts, ends)
    size = ends - starts
    last = low[ends - 1].astype(U64)
    last += np.where(size > 1, low[np.maximum(ends - 2, 0)], 0).astype(U64) << U64(8)
    last += np.where(size > 2, low[np.maximum(ends - 3, 0)], 0).astype(U64) << U64(16)
    return hashes, (textops.mix(last) % U64(SHAPES)).astype(np.int64), rows


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, at, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, g[at], np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text) to (token, shape, c); the end token has shape -1."""
    held: list = []
    total = 0

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        u, g, c = _summed(parts)
        for a in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 50_000].view(np.int64)), pa.array(g[a : a + 50_000]), pa.array(c[a : a + 50_000])], ["token", "shape", "c"])

    texts = 0
    for batch in batches:
        texts += batch.num_rows
        for _, _, data, bounds in textops.pieces(batch.column(0)):
            h, g, _ = tokenise(data, bounds)
            held.append(_summed([(h, g, np.ones(len(h), np.int64))]))
            total += len(held[-1][0])
            if total > 2 * FLUSH_WORDS:
                held = [_summed(held)]
                total = len(held[0][0])
                if total > FLUSH_WORDS:
                    yield from out(held)
                    held, total = [], 0
    if texts:
        held.append((np.array([END], U64), np.array([-1]), np.array([texts])))
    if held:
        yield from out(held)


class Lookup:
    """Places of hashes among sorted ones, by a table over their first bits and a step for each collision."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.append(words, ~U64(0))
        self.shift = U64(64 - max(1, self.n.bit_length()))
        self.first = np.searchsorted(words, np.arange(1 << max(1, self.n.bit_length()), dtype=U64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the hash is there)."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.words[at] < hashes)
        while len(todo):
            at[todo] += 1
            todo = todo[self.words[at[todo]] < hashes[todo]]
        return at, (self.words[at] == hashes) & (at < self.n)


@dataclass
class Model:
    own: np.ndarray  # sorted hashes of the words with symbols of their own; symbol: place + 1
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols; symbol 0: end; after the own words the shapes
    prior: np.ndarray  # share of each symbol

    def symbols(self, index: Lookup, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, own = index.find(hashes)
        return np.where(own, at + 1, shapes + 1 + len(self.own)), own


def initial(own: np.ndarray, prior: np.ndarray, states: int = STATES) -> Model:
    rng = np.random.default_rng(7)
    emit = prior * np.exp(0.5 * rng.standard_normal((states, len(prior))))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(own, np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True), prior)


class _Packed:
    """Sequences as columns by time, longest first: at step t the first n[t] of them are alive."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        flat = np.concatenate([sequences[i] for i in self.order])
        time = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by = np.argsort(time, kind="stable")
        self.flat = flat[by]
        self.n = np.bincount(time)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        at = self.at.tolist()
        self.steps = list(zip(at[:-1], at[1:], strict=True))


def forward(m: Model, p: _Packed, keep: bool):
    """Log-likelihood of each packed sequence, the scaled forward values if they are wanted, emissions and scales."""
    emission = np.ascontiguousarray(m.emit.T)[p.flat]
    scale = np.empty(len(p.flat))
    alpha = np.empty_like(emission) if keep else None
    ones = np.ones(len(m.start))
    a = emission[: p.n[0]] * m.start
    for t, (lo, hi) in enumerate(p.steps):
        if t:
            a = a[: hi - lo] @ m.move
            a *= emission[lo:hi]
        s = np.dot(a, ones, out=scale[lo:hi])
        a /= s[:, None]
        if keep:
            alpha[lo:hi] = a
    logs = np.log(scale)
    total = np.bincount(np.arange(len(p.flat)) - np.repeat(p.at[:-1], p.n), weights=logs, minlength=len(p.order))
    out = np.empty(len(p.order))
    out[p.order] = total
    return out, alpha, emission, scale


def expected(m: Model, p: _Packed) -> np.ndarray:
    """Expected starts, transitions and emissions as one vector."""
    _, alpha, emission, scale = forward(m, p, True)
    k = len(m.start)
    emission /= scale[:, None]
    back = np.ascontiguousarray(m.move.T)
    moves = np.zeros((k, k))
    gamma = alpha  # becomes alpha * beta, back to front
    beta = np.ones((p.n[-1], k))
    for t in range(len(p.n) - 1, 0, -1):
        lo, hi = p.steps[t]
        if len(beta) < hi - lo:
            beta = np.concatenate([beta, np.ones((hi - lo - len(beta), k))])
        x = emission[lo:hi]  # times beta, in place: each is needed once
        x *= beta
        gamma[lo:hi] *= beta
        before = p.steps[t - 1][0]
        moves += alpha[before : before + (hi - lo)].T @ x
        beta = x @ back
    if len(beta) < p.n[0]:
        beta = np.concatenate([beta, np.ones((p.n[0] - len(beta), k))])
    gamma[: p.n[0]] *= beta
    emits = np.stack([np.bincount(p.flat, weights=gamma[:, s], minlength=m.emit.shape[1]) for s in range(k)])
    return np.concatenate([gamma[: p.n[0]].sum(0), (moves * m.move).ravel(), emits.ravel()])


def refit(m: Model, counts: np.ndarray) -> Model:
    """The next parameters; a little of the prior keeps every symbol possible in every state."""
    k, n = m.emit.shape
    start = counts[:k] + 0.1
    move = counts[k : k + k * k].reshape(k, k) + 0.1
    emit = counts[k + k * k :].reshape(k, n) + 20.0 * m.prior
    return Model(m.own, start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), m.prior)


def _sequences(m: Model, index: Lookup, data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], tuple]:
    h, g, rows = tokenise(data, bounds)
    sym, own = m.symbols(index, h, g)
    cuts = np.searchsorted(rows, np.arange(1, len(bounds) - 1))
    return [np.append(x, 0) for x in np.split(sym, cuts)], (h, g, rows, own)


def _symbols(m: Model):
    """Batches of (text) to (symbols), the end token last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lookup(m.own)
        for batch in batches:
            for _, _, data, bounds in textops.pieces(batch.column(0)):
                seqs, _ = _sequences(m, index, data, bounds)
                off = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(seqs).astype(np.int32)))], ["symbols"])

    return run


def _learn(m: Model):
    """Batches of (symbols) to (i, v): the expected counts, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = None, [], 0

        def add() -> None:
            nonlocal total, held, size
            if held:
                x = expected(m, _Packed(held))
                total = x if total is None else total + x
                held, size = [], 0

        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            for lo, hi in zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False):
                held.append(flat[lo:hi])
                size += hi - lo
                if size > FLUSH_TOKENS:
                    add()
        add()
        if total is not None:
            at = np.flatnonzero(total)
            for a in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 50_000]), pa.array(total[at[a : a + 50_000]])], ["i", "v"])

    return run


@dataclass
class Head:
    words: np.ndarray  # sorted
    counts: np.ndarray
    shape_log: np.ndarray  # log10(N + V + 1) of each shape class


def _score(m: Model, head: Head):
    """Batches of (doc_id, text) to token counts, partial sums and the words beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, heads = Lookup(m.own), Lookup(head.words)
        for batch in batches:
            seqs, parts = [], []
            for at, end, data, bounds in textops.pieces(batch.column(1)):
                n = end - at
                some, (h, g, rows, own) = _sequences(m, index, data, bounds)
                seqs += some
                k, known = heads.find(h)
                logs = np.zeros(len(h))
                logs[known] = np.log10(head.counts[k[known]] + 1.0)
                shares = np.bincount(rows[~own], weights=(logs - head.shape_log[g])[~own], minlength=n)
                parts.append((np.bincount(rows[known], minlength=n), np.bincount(rows, weights=logs, minlength=n), shares, np.bincount(rows[~known], minlength=n), h[~known].view(np.int64)))
            if not parts:
                continue
            known, base, like, more, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
            size = np.array([len(s) for s in seqs], np.int64)
            cuts = np.searchsorted(np.cumsum(size), np.arange(FLUSH_TOKENS, int(size.sum()), FLUSH_TOKENS)) + 1
            groups = [x for x in np.split(np.arange(len(seqs)), cuts) if len(x)]  # of about FLUSH_TOKENS each
            like += np.concatenate([forward(m, _Packed([seqs[i] for i in x]), False)[0] for x in groups]) / np.log(10)
            off = np.concatenate([[0], np.cumsum(more)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(known, pa.int64()), pa.array(base), pa.array(like), pa.ListArray.from_arrays(pa.array(off), pa.array(tail))], ["doc_id", "n_tokens", "known", "base", "hmm", "tail"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _commonest(vocabulary: DataFrame, sizes: list[tuple[int, int]], most: int) -> DataFrame:
    """The words with at least the least count that no more than ``most`` words have."""
    held, least = 0, 1 << 62
    for c, n in sorted(sizes, reverse=True):
        if held + n > most:
            break
        held, least = held + n, c
    return vocabulary.where(F.col("c") >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    runtime.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    training = rows.where(~held_out()).select("text")
    counted = training.mapInArrow(_count, "token long, shape long, c long")
    vocabulary = runtime.cut(counted.groupBy("token").agg(F.first("shape").alias("shape"), F.sum("c").alias("c")))
    total, distinct = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    texts = ([r.c for r in vocabulary.where("shape = -1").select("c").collect()] or [0])[0]
    words = vocabulary.where("shape >= 0")
    # counts are in classes of 1/16 octave from 32 on, so that this table is bounded
    classed = F.when(F.col("c") < 32, F.col("c")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.col("c").cast("double")) * 16) / 16)))
    sizes = [(r[0], r[1]) for r in words.groupBy(classed.cast("long").alias("k")).count().collect()]
    shapes = {r[0]: (r[1], r[2]) for r in words.groupBy("shape").agg(F.sum("c"), F.count("*")).collect()}

    top = _commonest(words, sizes, HEAD).select("token", "c").toArrow()
    token, count = top.column("token").to_numpy().view(U64), top.column("c").to_numpy()
    order = np.argsort(token)
    token, count = token[order], count[order]
    own_least = np.sort(count)[::-1][OWN] + 1 if len(count) > OWN else 0
    mine = count >= own_least
    own, own_count = token[mine], count[mine]
    own_rows = _commonest_shapes(words, int(own_least))
    n_shape, v_shape = np.zeros(SHAPES), np.zeros(SHAPES)
    for g, (c, n) in shapes.items():
        n_shape[g], v_shape[g] = c, n
    for g, c, n in own_rows:
        n_shape[g] -= c
        v_shape[g] -= n
    head = Head(token, count, np.log10(n_shape + v_shape + 1))
    prior = np.concatenate([[texts + 1], own_count + 1.0, n_shape + 1]).astype(float)
    model = initial(own, prior / prior.sum())
    sequences = runtime.cut(training.mapInArrow(_symbols(model), "symbols array<int>"))
    for _ in range(ROUNDS):
        sums = sequences.mapInArrow(_learn(model), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        counts = np.zeros(STATES + STATES * STATES + STATES * len(prior))
        counts[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        model = refit(model, counts)
    runtime.drop(sequences)

    scored = rows.mapInArrow(_score(model, head), f"doc_id {kind}, n_tokens long, known long, base double, hmm double, tail array<long>")
    scored = runtime.cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count("*").alias("n"))
    rest = rest.join(words.select("token", "c"), "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    end = 1 if texts else 0
    fixed = float(np.log10(texts + 1.0))
    out = scored.join(rest, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    share = float(np.log10(total + distinct + 1))
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "n_tokens",
        (F.col("known") + more + end).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs + fixed - F.col("n_tokens") * share).alias("base_score"),
        (F.col("hmm") + logs).alias("score"),
    )


def _commonest_shapes(words: DataFrame, least: int) -> list[tuple[int, int, int]]:
    """Sums of counts and numbers of the words with symbols of their own, by shape."""
    return [(r[0], r[1], r[2]) for r in words.where(F.col("c") >= least).groupBy("shape").agg(F.sum("c"), F.count("*")).collect()]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
