"""Operator 1: exact Jaccard join on word shingles with token-combination prefixes.

1. Equal shingle sets form one *class* (its smallest doc_id stands for it); only classes are compared.
2. *Extended random prefixes* drop classes without partners: of a set of n shingles at most n - ceil(3n/4) may be
   missing in a partner, so the first (missing + k) shingles in hash order hold at least k that a partner has in
   its own first ones. Shingles are dealt to buckets as packed bytes; a class with fewer than k prefix shingles
   seen in another class is out.
3. Among the rest the document frequency of every shingle is counted exactly and orders the shingles, rare first.
   The signature of a class follows its first shingles: a rare one is a key by itself; frequent ones are divided
   into sub-classes by hash and every *pair* of one sub-class is a key. The prefix is extended until its keys
   cannot all be missed: each rare shingle adds one to what must be missing, each frequent one after the first of
   its sub-class likewise. Sub-classes depend on the size class, hence a class is indexed for its own and the
   next size class.
4. Only classes that share a key are compared, in rounds: each round every key that still has classes of several
   components takes its least class as pivot, the others of another component are compared with it (once, however
   many keys they share), links join components, and the pivot leaves the key. Pairs that links join already are
   never compared, so a group of near copies costs about its size. What is left after ROUNDS rounds (keys whose
   classes rarely link) is compared within groups, in pairs of blocks of bounded bytes, by counting common shingles
   with an inverted index; only a spanning forest of the links is emitted, never all pairs.
5. Components of the links give component_id.

A shingle that very many classes hold is never gathered in one task: step 2 counts what is common within a task there
and sends on two classes of each such shingle, step 3 counts with map-side aggregation and an equi-join whose hot
keys adaptive execution can split.

Shingles are compared by 64-bit hashes. Null, empty or blank texts have no shingles and link with nothing. Rows
that repeat a doc_id are separate documents. Rows without a doc_id link like others: component_id is the least
doc_id of the component, and null only where no row of it has one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime, textops

U64 = np.uint64
WORDS = 5
#: Links need 100 * |intersection| >= 75 * |union|.
NUM, DEN = 75, 100
#: A shingle in more classes than this is frequent.
FREQUENT = 100
#: Packed tokens are flushed at this many, and a bucket gets about BUCKET of them.
FLUSH, BUCKET = 500_000, 250_000
#: Rounds of comparisons with pivots, and tokens in a block of what they leave.
ROUNDS, BLOCK = 3, 100_000


def _least(n, num: int = NUM, den: int = DEN):
    """ceil(n * num / den): shingles that a partner must share."""
    return -(-n * num // den)


def _k(n):
    return 1 + n // 10


def _sets(k: int, width: int, emit_sets: bool):
    """Batches of (..., text) to the same columns without the text, and n, node[, hashes]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in textops.pieces(batch.column(width)):
                value, off = textops.shingle_sets(data, bounds, k)
                node = [textops.digest64(value[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                cols = [*(batch.column(i).slice(at, end - at) for i in range(width)), pa.array(np.diff(off), pa.int64()), pa.array(node, pa.int64())]
                if emit_sets:
                    cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(value.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], "n", "node", "hashes"][: len(cols)])

    return run


class _Dealer:
    """Packs (token, node) by bucket = token mod buckets: 4 bytes of the rest of the token, 8 of the node.

    Tokens that several nodes have within one flush are known to be shared: their nodes are counted here, and only two
    of them go to the bucket (as told ones, which count no more), so that a hot token never fills one."""

    COLUMNS = ("bucket", "tokens", "nodes", "told_tokens", "told_nodes", "counted", "counts")
    SCHEMA = "bucket long, tokens binary, nodes binary, told_tokens binary, told_nodes binary, counted binary, counts binary"

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, token: np.ndarray, node: np.ndarray) -> None:
        self.parts.append((token, node))
        self.held += len(token)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        token, node = _distinct(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        often = _frequency(token) > 1
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        told = often & (first | np.concatenate([[False], first[:-1]]))
        bucket = (token % U64(self.buckets)).astype(np.int64)
        rest = (token // U64(self.buckets)).astype(np.uint32)
        packed: dict[int, list[bytes]] = {}
        for at, mask in ((0, ~often), (2, told)):
            order = np.flatnonzero(mask)
            if not len(order):
                continue
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
                row = packed.setdefault(int(bucket[order[s]]), [b""] * 6)
                row[at], row[at + 1] = rest[order[s:e]].tobytes(), node[order[s:e]].tobytes()
        counted, counts = np.unique(node[often], return_counts=True)
        if len(counted):
            row = packed.setdefault(int(counted[0]) % self.buckets, [b""] * 6)
            row[4], row[5] = counted.tobytes(), counts.astype(np.int64).tobytes()
        keys = list(packed)
        for a in range(0, len(keys), 256):
            some = keys[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([packed[k][i] for k in some], pa.binary()) for i in range(6))], list(self.COLUMNS))


def _distinct(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, node), by token."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    return token[new], node[new]


def _frequency(token: np.ndarray) -> np.ndarray:
    """How often each element's value occurs in a sorted array."""
    if not len(token):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(np.append(starts, len(token)))
    return np.repeat(counts, counts)


def _deal_prefixes(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(buckets)
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, bounds in textops.pieces(batch.column(0)):
                value, off = textops.shingle_sets(data, bounds, k)
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    if b - a > 2:  # smaller sets link with equal ones only
                        node = textops.digest64(value[a:b].tobytes())
                        if node not in seen:
                            seen.add(node)
                            n = b - a
                            p = min(n, n - _least(n) + _k(n))
                            dealer.add(value[a : a + p], np.full(p, node, np.int64))
                if dealer.held >= FLUSH:
                    yield from dealer.flush()
        yield from dealer.flush()

    return run


def _shared_counts(table: pa.Table) -> pa.Table:
    """(node, shared): how many of a node's tokens another node has too, at least as many as there are."""

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)

    told = set(zip(joined("told_tokens", np.uint32).tolist(), joined("told_nodes", np.int64).tolist(), strict=True))
    told_token, told_node = (np.array([x[i] for x in sorted(told)], t) for i, t in ((0, np.uint32), (1, np.int64)))
    own_token, own_node = _distinct(joined("tokens", np.uint32), joined("nodes", np.int64))
    token = np.concatenate([own_token, told_token])
    order = np.argsort(token, kind="stable")
    shared = np.zeros(len(token), bool)
    shared[order] = _frequency(token[order]) > 1
    node = np.concatenate([own_node[shared[: len(own_node)]], joined("counted", np.int64)])
    count = np.concatenate([np.ones(len(node) - len(joined("counted", np.int64)), np.int64), joined("counts", np.int64)])
    return pa.table({"node": pa.array(node, pa.int64()), "shared": pa.array(count, pa.int64())}).group_by("node").aggregate([("shared", "sum")]).rename_columns(["node", "shared"])


def size_class(n: int) -> int:
    """Partners' sizes differ by 4/3 at most, hence their size classes by one at most."""
    return int(math.floor(math.log(n) / math.log(DEN / NUM) + 1e-9))


def _subclasses(tag: int) -> int:
    return max(1, int(_least(int((DEN / NUM) ** (tag - 1) * 0.999))) // 4)


def signature(tokens: np.ndarray, dfs: np.ndarray, n: int, frequent: int = FREQUENT) -> np.ndarray:
    """Keys of a class of n shingles, of which ``tokens`` occur in other classes with frequencies ``dfs``."""
    miss = len(tokens) - int(_least(n)) + 1  # so many must be beyond a partner's reach before a link is impossible
    if miss <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, dfs))
    tokens, often = tokens[order], dfs[order] > frequent
    if not often[:miss].any():
        return textops.mix(tokens[:miss])
    keys: list[np.ndarray] = []
    tag = size_class(n)
    for t in (tag, tag + 1):
        groups = _subclasses(t)
        kind = (tokens % U64(groups)).astype(np.int64)
        # a frequent token adds nothing if it is the first of its sub-class
        at = np.flatnonzero(often)
        _, first = np.unique(kind[at], return_index=True)
        gain = np.ones(len(tokens), np.int64)
        gain[at[first]] = 0
        end = int(np.searchsorted(np.cumsum(gain), miss)) + 1
        rare, more = tokens[:end][~often[:end]], tokens[:end][often[:end]]
        if t == tag:
            keys.append(textops.mix(rare))
        kind = (more % U64(groups)).astype(np.int64)
        more = more[np.argsort(kind, kind="stable")]
        cuts = np.cumsum(np.bincount(kind, minlength=groups))[:-1]
        for part in np.split(more, cuts):
            if len(part) > 1:
                i, j = np.triu_indices(len(part), 1)
                a, b = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
                keys.append(textops.mix(a * U64(3) + textops.mix(b + U64(t))))
    return np.concatenate(keys)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for node, n, tokens, dfs in zip(*(batch.column(i) for i in range(4)), strict=True):
            s = signature(tokens.values.to_numpy().view(np.uint64), dfs.values.to_numpy(), n.as_py())
            parts.append((s.view(np.int64), np.full(len(s), node.as_py(), np.int64), np.full(len(s), n.as_py(), np.int64)))
        if parts:
            s, v, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            for a in range(0, len(s), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (s, v, n)], ["sig", "node", "n"])


def block_links(nodes: np.ndarray, sides: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between classes whose token lists follow each other in ``tokens``.

    both: only links between side 0 and side 1 are looked for. Counts common tokens by an inverted index."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    _, tid, count = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(tid, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(count)])
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for x in range(len(nodes)):
        if both and sides[x]:
            continue
        t = tid[off[x] : off[x + 1]]
        t = t[count[t] > 1]
        c = count[t]
        if not len(t):
            continue
        jump = np.repeat(start[t] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        common = np.bincount(posting[jump], minlength=len(nodes))
        linked = DEN * common >= NUM * (sizes[x] + sizes - common)
        if both:
            linked &= sides == 1
        else:
            linked[: x + 1] = False
        for y in np.flatnonzero(linked & (common > 0)).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def _block_pair(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block = table.column("block").to_numpy()
    lists = table.column("hashes").chunk(0)
    a, b = block_links(table.column("node").to_numpy(), (block == j) & (i != j), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), i != j)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    runtime.tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")  # rows of one key are equal
    members = runtime.cut(docs.mapInArrow(_sets(words, 2, False), "row long, doc_id long, n long, node long"))
    classes = runtime.cut(members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.min("row").alias("row")))
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * runtime.partitions(spark), tokens * 35 // 100 // BUCKET)
    dealt = docs.select("text").mapInArrow(_deal_prefixes(words, buckets), _Dealer.SCHEMA)
    shared = dealt.groupBy("bucket").applyInArrow(_shared_counts, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    least = F.floor((F.col("n") * NUM + DEN - 1) / DEN)
    alive = runtime.cut(classes.join(shared, "node").where(F.col("shared") >= 1 + F.floor(least / 10)).select("node", "row", "n"))
    n_alive = alive.count()

    texts = docs.select("row", "text").join(runtime.small(alive.select("row"), n_alive), "row").groupBy("row").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(_sets(words, 1, True), "row long, n long, node long, hashes array<long>")
    sets = runtime.cut(sets.join(runtime.small(alive.select("row", "node"), n_alive), ["row", "node"]).select("node", "n", "hashes"))

    posted = sets.select("node", F.explode("hashes").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    posted = posted.join(often, "token").groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("p"))
    posted = posted.join(runtime.small(alive.select("node", "n"), n_alive), "node").where(F.size("p") >= least).select("node", "n", F.col("p.token").alias("tokens"), F.col("p.df").alias("dfs"))
    sigs = runtime.cut(posted.mapInArrow(_signatures, "sig long, node long, n long"))
    links = _links(sets, sigs)
    label = runtime.components(links)
    label = classes.join(label, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least_id = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = runtime.cut(label.join(least_id, "label").select("node", "component_id"))
    for x in (classes, alive, sets, sigs, links):
        runtime.drop(x)
    out = members.join(of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) of classes that link."""
    sides = [sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(DEN * common >= NUM * (F.size("ha") + F.size("hb") - common)).select(pairs.columns)


def _links(sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that span all links between classes that share a key (sig, node, n)."""
    schema = "a long, b long"
    found = sets.sparkSession.createDataFrame([], schema)
    now, written = sigs.withColumn("label", F.col("node")), []
    for _ in range(ROUNDS):
        pivots = now.groupBy("sig").agg(F.min(F.struct("node", "label", "n")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        rest = runtime.cut(now.join(pivots.where("lo < hi").select("sig", "p"), "sig").where(F.col("node") != F.col("p.node")))
        apart = (F.col("label") != F.col("p.label")) & (DEN * F.least("n", "p.n") >= NUM * F.greatest("n", "p.n"))
        pairs = rest.where(apart).select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("label").alias("la"), F.col("p.label").alias("lb")).distinct()
        linked = runtime.cut(_compared(pairs, sets))
        joined = runtime.components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        after = rest.select("sig", "node", "n", "label").join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
        after = runtime.cut(after.select("sig", "node", "n", F.coalesce("to", "label").alias("label")))
        found = found.unionByName(linked.select("a", "b"))
        if written:
            runtime.drop(written.pop())
        runtime.drop(rest)
        now = after
        written.append(after)
        if after.isEmpty():
            break
    else:
        left = now.groupBy("sig").agg(F.min("node").alias("b"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        near = now.join(left.select("sig", "b"), "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        groups = runtime.cut(runtime.components(runtime.cut(near)))
        if not groups.isEmpty():
            found = found.unionByName(_group_links(sets, groups))
    return runtime.cut(found)


def _group_links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) that span the links within groups (node, label), compared in pairs of blocks."""
    grouped = runtime.cut(sets.select("node", "n").join(groups, "node"))
    weights = grouped.groupBy("label").agg(F.sum("n").alias("w"))
    total = grouped.agg(F.sum("n")).first()[0] or 0
    packs = max(1, total // BLOCK * 2, 4 * runtime.partitions(sets.sparkSession))
    placed = grouped.join(weights, "label").select(
        "node",
        F.ceil(F.col("w") / BLOCK).cast("int").alias("blocks"),
        F.when(F.col("w") <= BLOCK, F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(F.lit(None)).alias("pack"),
        "label",
    )
    placed = placed.select("node", "blocks", F.coalesce(F.col("pack"), F.lit(-1).cast("long")).alias("pack"), F.when(F.col("pack").isNull(), F.col("label")).otherwise(F.lit(0)).alias("label"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    rows = runtime.small(placed, grouped.count())
    each = sets.join(rows, "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    each = each.select("node", "hashes", "pack", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return each.groupBy("pack", "label", "i", "j").applyInArrow(_block_pair, "a long, b long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
), t AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.reach), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(sh)
"""
