"""Secret scan: fixed patterns, and a randomness test battery for strings that no pattern names.

Base spans (kinds ``assign``, ``access``, ``hex``) are always kept.  Candidates for added spans
(kind ``random``) are unbroken runs of ``MIN_RUN`` or more code characters with a digit and a letter
that overlap no base span.  Each gets the smallest encoding that holds it (hex, base32 and base36 in
either case, base62, base64 or its URL form; a UUID's hyphens don't count) and three tests of its
symbols' values: chi-squared uniformity over the alphabet, runs above and below the middle, and
lag-one serial correlation, combined by Fisher's method into a p-value for "random".

False discoveries are controlled twice by Benjamini-Hochberg, within length classes, over all candidates of the corpus:

* The battery's p-values: what is rejected at ``REJECT`` isn't random and is dropped, so of what is dropped that
  share at most is random after all.  A short key has few symbols to fail by; its class has its own level.
* Whether ordinary text could look so: character-class transitions, counted over all texts, give the
  probability of the run's classes as text against that under its encoding.  The ratio is a p-value for "ordinary
  text" (Markov's inequality) that falls with length; what is rejected at ``FDR`` becomes a span.

Both work on histograms of the p-values (tenths of a power of ten), whose size doesn't depend on the input.

Null text is empty and has no spans.  Places are code points, ends exclusive; ties of start go by
kind as listed.  Repeated rows each give their own result; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, tidy

KINDS = ("assign", "access", "hex", "random")
BASE = 3
MIN_RUN, REJECT, FDR = 20, 0.01, 0.01
#: Upper lengths of the length classes.
LENGTHS = (32, 64)
BINS = 3000

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
UUID = re.compile(r"(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12})")
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")

UP, LOW, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Smallest alphabet first.
ENCODINGS = {
    "hex": DIGIT + "ABCDEF", "lower hex": DIGIT + "abcdef", "base32": UP + "234567", "lower base32": LOW + "234567", "base36": DIGIT + UP, "lower base36": DIGIT + LOW,
    "base62": UP + LOW + DIGIT, "base64": UP + LOW + DIGIT + "+/", "base64url": UP + LOW + DIGIT + "-_",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost matches by kind, those of enough characters."""
    spans = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def symbols(run: str) -> str:
    """The run without padding, and without the hyphens of a UUID's groups."""
    return run.replace("-", "") if UUID.fullmatch(run) else run.rstrip("=")


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run."""
    return next((name for name, letters in ENCODINGS.items() if set(run) <= set(letters)), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, alphabet: str) -> float:
    """Fisher's combination of the three tests: a p-value for "uniformly random"."""
    v = np.array([alphabet.index(c) for c in run], dtype=float)
    n, a = len(v), len(alphabet)
    cells = min(a, max(4, n // 5))
    counts = np.bincount((v * cells // a).astype(int), minlength=cells)
    share = np.bincount((np.arange(a) * cells // a), minlength=cells) / a
    chi, df = float(((counts - n * share) ** 2 / (n * share)).sum()), cells - 1
    chi_p = normal_tail(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    high = v >= a / 2
    ups = int(high.sum())
    expected = 2 * ups * (n - ups) / n + 1
    spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    runs_p = 2 * normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - expected) / spread) if 0 < ups < n else 0.5 ** (n - 1)
    d = v - v.mean()
    total = float((d * d).sum())
    serial_p = 2 * normal_tail(abs(float((d[1:] * d[:-1]).sum()) / total * math.sqrt(n))) if total else 0.0
    x = -sum(math.log(max(p, 1e-300)) for p in (chi_p, runs_p, serial_p))
    return math.exp(-x) * (1 + x + x * x / 2)


#: Classes of a character: 0 other, 1 upper, 2 lower, 3 digit.  White space and the rest of Unicode is other.
CLASSES = np.zeros(128, dtype=np.int64)
for _i, _letters in enumerate((UP, LOW, DIGIT), 1):
    CLASSES[[ord(c) for c in _letters]] = _i


def transitions(text: str) -> np.ndarray:
    """Counts of the 16 pairs of neighbouring classes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = CLASSES[np.where(codes < 128, codes, 32)]
    return np.bincount(c[:-1] * 4 + c[1:], minlength=16)


def tenths(p: float) -> int:
    """Tenths of -log10 of a p-value, rounded down."""
    return min(BINS, int(-10 * math.log10(max(p, 1e-300))))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, list[int]]]:
    """(start, end, encoding, tenths of the battery's p-value, transitions) of the runs."""
    out = []
    for m in RUN.finditer(text):
        run = symbols(m[0])
        if any(a < m.end() and m.start() < b for a, _, b in base) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            continue
        if name := encoding(run):
            out.append((m.start(), m.end(), name, tenths(battery(run, ENCODINGS[name])), transitions(run).tolist()))
    return out


SCANNED = "base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,encoding:string,odd:int,pairs:array<long>>>, pairs array<long>"


def scan(batches):
    """Over Arrow batches whose last column is text: in its place, base spans, candidates and class transitions."""
    import pyarrow as pa

    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    run = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("odd", pa.int32()), ("pairs", pa.list_(pa.int64()))])
    for batch in batches:
        base, runs, pairs = [], [], []
        for t in batch.column(batch.num_columns - 1):
            text = t.as_py() or ""
            base.append(base_spans(text))
            runs.append(candidates(text, base[-1]))
            pairs.append(transitions(text).tolist())
        own = [
            pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in base], pa.list_(span)),
            pa.array([[dict(zip(("start", "end", "encoding", "odd", "pairs"), s)) for s in x] for x in runs], pa.list_(run)),
            pa.array(pairs, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "base", "runs", "pairs"])


def log_ratios(pairs: list[int]) -> dict[str, list[float]]:
    """For each encoding, ln(P(class pair | text) / P(class | encoding)) of the 16 pairs."""
    out = {}
    for name, letters in ENCODINGS.items():
        share = np.array([sum(c not in UP + LOW + DIGIT for c in letters), *(sum(c in g for c in letters) for g in (UP, LOW, DIGIT))]) / len(letters)
        counts = np.array(pairs, dtype=float).reshape(4, 4) + 0.5
        text = counts / counts.sum(axis=1, keepdims=True)
        out[name] = np.log(text / np.maximum(share, 1e-3)[None, :]).ravel().tolist()
    return out


def length_class(n: Column) -> Column:
    of = F.lit(len(LENGTHS))
    for i, most in reversed(list(enumerate(LENGTHS))):
        of = F.when(n < most, i).otherwise(of)
    return of


def thresholds(counts: list[tuple[int, int, int]], fdr: float) -> dict[int, int]:
    """Benjamini-Hochberg on (length class, bin, n): the least bin, from above, that holds by class."""
    least = {}
    for c in {x[0] for x in counts}:
        bins = sorted(((b, n) for k, b, n in counts if k == c), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if 10 ** (-b / 10) * total <= fdr * above:  # the largest p of a bin is at its lower edge
                least[c] = b
    return least


def rejected(runs: DataFrame, bin_: str, fdr: float):
    """A test of a run (class, the bin): whether its hypothesis is rejected, over all of ``runs``; at most classes * BINS counts reach the driver."""
    counts = runs.groupBy("class", bin_).count().collect()
    least = thresholds([tuple(r) for r in counts], fdr)

    def of(r: Column) -> Column:
        out = F.lit(False)
        for c, b in least.items():
            out = out | ((r["class"] == c) & (r[bin_] >= b))
        return out

    return of


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``found``, an array of (start, kind, end) by start and kind, for every row."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("_text"))
    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    rows = checkpointed(rows.mapInArrow(tidy(scan), kinds + SCANNED))
    pairs = rows.agg(*[F.coalesce(F.sum(F.col("pairs")[i]), F.lit(0)).alias(f"p{i}") for i in range(16)]).first()
    ratios = log_ratios(list(pairs))

    def surprise(run: Column) -> Column:
        """Tenths of -log10 of the run's p-value as text."""
        total = F.lit(0.0)
        for name, ratio in ratios.items():
            dot = F.aggregate(F.zip_with(run["pairs"], F.array(*map(F.lit, ratio)), lambda n, w: n * w), F.lit(0.0), lambda a, x: a + x)
            total = F.when(run["encoding"] == name, dot).otherwise(total)
        return F.least(F.greatest(F.floor(total * (-10 / math.log(10))), F.lit(0)), F.lit(BINS)).cast("int")

    scored = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.lit(BASE).alias("kind"), r["end"].alias("end"), r["odd"].alias("odd"), surprise(r).alias("bin"), length_class(r["end"] - r["start"]).alias("class")))
    rows = rows.select(*names, "base", scored.alias("runs"))
    runs = rows.select(F.explode("runs").alias("r")).select("r.*")
    ordered = rejected(runs, "odd", REJECT)
    strange = rejected(runs.filter(~ordered({c: F.col(c) for c in ("class", "odd")})), "bin", FDR)
    added = F.transform(F.filter("runs", lambda r: ~ordered(r) & strange(r)), lambda r: F.struct(*[r[c].alias(c) for c in ("start", "kind", "end")]))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.array_sort(F.concat("base", added)).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
