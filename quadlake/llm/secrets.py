r"""Operator 6: secret scans, with DataFrame functions only.

Base spans come from three patterns (ASSIGN, ACCESS, HEX), leftmost and without overlap by kind. To them the
randomness battery adds spans of kind ``random``. Every run of LEAST or more characters of [A-Za-z0-9+/_-] gets an
encoding (digits, hex, lower-case letters, base32, base62, base64), and its symbols, as numbers of that alphabet, are
tested for uniformity (chi-squared, by the Wilson-Hilferty normal form), for the number of runs above and below the
middle of the alphabet, and for serial correlation. Fisher's method joins the three p-values; a run for which the
joint value is below REJECT is not random.

Passing is weak evidence in a short run, so false discoveries are controlled by length. Ordinary writing repeats its
symbols: two symbols agree with a chance (kappa) that is measured on the letters of long ordinary words of all
documents, drawn towards 2 / alphabet by PRIOR letters, and 2 / alphabet at least in the other encodings. With it
chi-squared of an ordinary run of n symbols is noncentral by (n - 1) * (alphabet * kappa - 1), whose normal form
gives the chance that an ordinary run of that encoding and length is as uniform. The Benjamini-Hochberg rule over
these chances, of all runs of an encoding that no base span covers, gives the highest chance at which a share of
ALPHA of the added spans is expected to be ordinary. Only the histograms of chances, at most BINS numbers for each
encoding, and the letter counts, at most 26, come to the driver.

Spans are kind:start:end in code points, end exclusive, by start and then kind in the order assign, access, hex,
random. Runs that overlap a base span are not listed again; ``confirmed`` counts those of them whose chance is below
ALPHA by itself. Null texts are empty and have no spans. Repeated rows are scanned each by itself. Extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import runtime

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Long enough runs only: a run is maximal, so the counted form finds the same ones.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
LEAST = 16
RUN = r"[A-Za-z0-9+/_-]{%d,}" % LEAST
#: Ordinary long words: too short to be judged themselves.
WORD = r"(?<![A-Za-z0-9+/_-])[a-z]{12,15}(?![A-Za-z0-9+/_-])"

ALPHA, REJECT, PRIOR = 0.05, 0.01, 1000
#: Bins of chances, each a tenth of an octave wide.
BINS = 400
MARK = "\ue000"

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("lower", r"^[A-Z]?[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", r"^[A-Za-z0-9]+$", BASE64[:62]),
    ("base64", r"", BASE64),
)
LOWERED = 2  # encodings up to this one ignore case
SPAN = "struct<s: int, e: int, m: string>"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str) -> Column:
    """Array of (s, e, m) of all matches of ``pattern`` in the column ``text``, which has no MARK in it."""
    parts = f"split(regexp_replace({text}, {_quoted('(' + pattern + ')')}, '{MARK}$1{MARK}'), '{MARK}', -1)"
    step = f"""aggregate({parts}, named_struct('i', 0, 'at', 0, 'out', cast(array() as array<{SPAN}>)),
        (a, p) -> named_struct('i', a.i + 1, 'at', a.at + length(p),
            'out', if(a.i % 2 = 1, concat(a.out, array(named_struct('s', a.at, 'e', a.at + length(p), 'm', p))), a.out)), a -> a.out)"""
    return F.when(F.col(text).rlike(pattern), F.expr(step)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _tail(z: Column) -> Column:
    """The chance of a normal value above z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return series * F.exp(-z * z / 2) / 2.5066282746310002


def _bind(value: Column, body) -> Column:
    """body of a value that is computed once: it is the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _encoding(m: Column) -> Column:
    kind = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        kind = F.when(m.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(kind)
    return kind


def battery(m: Column) -> Column:
    """(kind, len, chi, p) of a run: its encoding, chi-squared, and the joint p-value of the three tests."""

    def symbols(e: Column) -> Column:
        text = F.when(e["kind"] <= LOWERED, F.lower(m)).otherwise(F.translate(m, "-_", "+/"))
        return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: (F.instr(e["alphabet"], x) - 1).cast("double"))

    def sums(e: Column, c: Column) -> Column:
        size = e["size"]
        squares = F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(c, lambda y: y == x)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(c, lambda x: x * 2 >= size)).cast("double")
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
        pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(F.size(c).cast("double").alias("n"), squares.alias("squares"), high.alias("high"), mean.alias("mean"), pairs.alias("pairs"), (size - 1).alias("df"))

    def scores(e: Column, c: Column, s: Column) -> Column:
        n, high, df, mean = s["n"], s["high"], s["df"], s["mean"]
        chi = (df + 1) / n * s["squares"] - n
        z1 = (F.pow(chi / df, F.lit(1.0 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        runs = 1 + F.size(F.filter(s["pairs"], lambda x: (x["a"] * 2 >= df + 1) != (x["b"] * 2 >= df + 1)))
        z2 = _bind(2 * high * (n - high) / n + 1, lambda mu: _bind((mu - 1) * (mu - 2) / (n - 1), lambda var: F.when(var > 0, (runs - mu) / F.sqrt(var)).otherwise(7.0)))
        cross = F.aggregate(s["pairs"], F.lit(0.0), lambda a, x: a + (x["a"] - mean) * (x["b"] - mean))
        spread = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        z3 = _bind(spread, lambda v: F.when(v > 0, cross / v * F.sqrt(n)).otherwise(7.0))
        return F.struct(n.cast("int").alias("len"), chi.alias("chi"), F.array(z1, z2, z3).alias("z"))

    def joined(e: Column, r: Column) -> Column:
        logs = F.transform(r["z"], lambda z: -F.log(F.greatest(2 * _tail(F.least(F.abs(z), F.lit(7.0))), F.lit(1e-12))))
        p = _bind(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x), lambda half: F.exp(-half) * (1 + half + half * half / 2))
        return F.struct(e["kind"].alias("kind"), r["len"].alias("len"), r["chi"].alias("chi"), p.alias("p"))

    def known(kind: Column) -> Column:
        alphabet = F.get(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), kind)
        e = F.struct(kind.alias("kind"), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"))
        return _bind(e, lambda e: _bind(symbols(e), lambda c: _bind(sums(e, c), lambda s: _bind(scores(e, c, s), lambda r: joined(e, r)))))

    return _bind(_encoding(m), known)


def kappas(letters: dict[str, int]) -> list[float]:
    """The chance that two symbols of ordinary writing agree, by encoding, from the counts of letters."""
    total = sum(letters.values())
    measured = sum((c / total) ** 2 for c in letters.values()) if total else 0.0
    drawn = (total * measured + PRIOR * 2 / 26) / (total + PRIOR)
    return [drawn if name == "lower" else max(drawn, 2 / len(alphabet)) for name, _, alphabet in ENCODINGS]


def _bin(t: Column, kappa: list[float]) -> Column:
    """The bin of the chance that an ordinary run is as uniform (0: rejected as not random; higher: less likely)."""
    size = F.get(F.array(*[F.lit(float(len(a))) for _, _, a in ENCODINGS]), t["kind"])
    far = (t["len"] - 1) * (size * F.get(F.array(*[F.lit(k) for k in kappa]), t["kind"]) - 1)
    z = _bind(F.struct(far.alias("far"), size.alias("size")), lambda x: (t["chi"] - (x["size"] - 1 + x["far"])) / F.sqrt(2 * (x["size"] - 1 + 2 * x["far"])))
    chance = _bind(z, lambda z: F.when(z >= 0, 1.0).otherwise(2 * _tail(F.least(-z, F.lit(8.0))))) / 2
    return F.when((t["p"] < REJECT) | F.isnan(t["p"]), 0).otherwise(F.least(F.floor(-F.log2(chance) * 10), F.lit(BINS - 1)).cast("int"))


def least_bin(counts: dict[int, int], alpha: float = ALPHA) -> int:
    """The Benjamini-Hochberg rule over runs counted by bin: the lowest bin that counts as random (BINS: none does)."""
    total, held, best = sum(counts.values()), 0, BINS
    for b in range(BINS - 1, 9, -1):  # a bin's chance is 2 ** (-b / 10) at most
        held += counts.get(b, 0)
        if held and 2 ** (-b / 10) <= alpha * held / total:
            best = b
    return best


def _reached(first: str, others: str) -> Column:
    """For each span of ``others``, by its start, whether a span of ``first`` that starts no later ends beyond its start.

    One pass over both lists in order of their starts."""
    return F.expr(f"""aggregate(array_sort(concat(transform({first}, x -> struct(x.s as s, 0 as k, x.e as e)), transform({others}, x -> struct(x.s as s, 1 as k, x.e as e)))),
        named_struct('far', -2147483647, 'out', cast(array() as array<boolean>)),
        (a, x) -> if(x.k = 0, named_struct('far', greatest(a.far, x.e), 'out', a.out), named_struct('far', a.far, 'out', concat(a.out, array(a.far > x.s)))), a -> a.out)""")


def _mirrored(name: str) -> Column:
    return F.reverse(F.transform(name, lambda x: F.struct((-x["e"]).alias("s"), (-x["s"]).alias("e"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random, confirmed) of every row: arrays of spans (s, e, m), and a number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit("\ufffd")).alias("t"))
    assign = F.filter(spans("t", ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    runs = F.transform(spans("t", RUN), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), battery(x["m"]).alias("t")))
    words = F.array_join(F.regexp_extract_all("t", F.lit(WORD), 0), "")
    found = runtime.cut(rows.select("doc_id", assign.alias("assign"), spans("t", ACCESS_LONG).alias("access"), spans("t", HEX_LONG).alias("hex"), runs.alias("runs"), words.alias("words")))
    letters = found.where("words <> ''").select(F.explode(F.split("words", "")).alias("x")).where("x <> ''").groupBy("x").count()
    kappa = kappas({r[0]: r[1] for r in letters.collect()})

    # access and hex spans lie within a run; assign spans reach over its start or its end, as they hold a : or =
    # (arguments of zip_with are computed once, a column inside a lambda would be for each run)
    mirrored = found.select("*", _mirrored("assign").alias("am"), _mirrored("runs").alias("rm"))
    flags = F.zip_with(_reached("assign", "runs"), F.reverse(_reached("am", "rm")), lambda a, b: a | b)
    placed = F.zip_with("runs", flags, lambda r, f: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["m"].alias("m"), r["t"]["kind"].alias("kind"), _bin(r["t"], kappa).alias("b"), (f | r["m"].rlike(f"{HEX_LONG}|{ACCESS_LONG}")).alias("covered")))
    judged = mirrored.select("doc_id", "assign", "access", "hex", placed.alias("runs"))
    bins = judged.where(F.size("runs") > 0).select(F.explode("runs").alias("r")).where("not r.covered").groupBy("r.kind", "r.b").count()
    counts: list[dict[int, int]] = [{} for _ in ENCODINGS]
    for kind, b, c in bins.collect():
        counts[kind][b] = c
    low = F.array(*[F.lit(least_bin(c)) for c in counts])
    alone = math.ceil(-10 * math.log2(ALPHA))
    confirmed = F.filter("runs", lambda r: r["covered"] & (r["b"] >= alone))
    added = F.transform(F.filter("runs", lambda r: ~r["covered"] & (r["b"] >= F.get(low, r["kind"]))), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["m"].alias("m")))
    return judged.select("doc_id", "assign", "access", "hex", added.alias("random"), F.size(confirmed).cast("long").alias("confirmed"))


def _listed(*kinds: str) -> Column:
    def placed(i: int, k: str) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), F.concat(F.lit(f"{k}:"), x["s"], F.lit(":"), x["e"]).alias("v")))

    each = [placed(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["v"]), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_listed("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"), _listed("assign", "access", "hex", "random").alias("spans"), F.size("random").cast("long").alias("n_random"), F.col("confirmed").alias("n_confirmed"))
