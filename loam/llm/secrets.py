"""Secret scan: fixed patterns, and a randomness battery with length-aware false-discovery control.

Every run of 20 or more symbols of base64 and its URL form is a candidate; one that fits no alphabet is cut at the signs.
Its encoding is the smallest of a few alphabets that holds it. Three tests make the battery:

* chi-squared uniformity of the symbols over the alphabet,
* Wald-Wolfowitz runs above and below the alphabet's middle,
* lag-one serial correlation of the symbols' places in the alphabet.

The null of the discovery test is that a run's symbols were drawn from the corpus's own distribution of the alphabet's
symbols: under it the chi-squared statistic has a mean and a spread that follow from the run's length, which give a
one-sided p-value (random runs are more even than text). The two tests of independence do not depend on that
distribution, so their combined p-value (Fisher) is independent of it under the null and may weigh it: a run with
structure gets a low weight, the weights of a length class have mean 1, and Benjamini-Hochberg at level ``LEVEL`` runs
over p-value by weight inside each class, over the candidates of all documents. P-values are rounded up to a fixed grid,
so that only counts meet, a bounded number of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, stored, texts_of, tidy

#: Fixed patterns of the base scan; letters of the first one's keywords match in either case, ASCII only.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PART = re.compile(r"[A-Za-z0-9]{20,}")
#: Encodings from narrow to wide: name and alphabet in its natural order.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
#: Combined p-value of runs and serial correlation at which a run's weight is half of a run's without structure.
HALF_WEIGHT = 1e-2
LEVEL = 0.01
#: Upper ends of the length classes; logarithms of p-values are counted in steps of 1 / GRID.
LENGTHS = (24, 32, 40, 48, 64, 96, 128)
GRID = 20
LEAST_Z = -37.0  # the normal tail is still a number there


def encoding_of(run: str) -> str | None:
    seen = set(run)
    return next((k for k, s in _SETS.items() if seen <= s), None)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, encoding)`` of every run to be judged."""
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if encoding := encoding_of(run):
            yield m.start(), m.end(), encoding
        else:
            yield from ((m.start() + p.start(), m.start() + p.end(), encoding_of(p.group())) for p in PART.finditer(run))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, encoding: str) -> tuple[float, tuple[float, float, float]]:
    """The chi-squared statistic, and the p-values of uniformity, runs and serial correlation."""
    alphabet = ENCODINGS[encoding]
    n, k = len(run), len(alphabet)
    place = np.fromiter(map(alphabet.index, run), np.float64, n)
    counts = np.bincount(place.astype(np.int64), minlength=k)
    x = float(k / n * (counts.astype(float) ** 2).sum() - n)
    p_uniform = chi2_tail(x, k - 1)
    high = place >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    spread = place - place.mean()
    var = float((spread**2).sum())
    r = float((spread[1:] * spread[:-1]).sum()) / var if var else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return x, (p_uniform, p_runs, p_serial)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def weight(p_runs: float, p_serial: float) -> float:
    """Weight of a run before its class's mean is known: from Fisher's combination of the tests of independence."""
    both = max(p_runs * p_serial, 1e-300)
    p = both * (1 - math.log(both))
    return p / (p + HALF_WEIGHT)


def length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


_STRUCT = "struct<start:long,end:long,encoding:string,n:int,x:double,weight:double>"
_ROW = f"part int, doc_id long, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, found array<{_STRUCT}>, symbols array<long>, sizes array<double>"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int32()), ("x", pa.float64()), ("weight", pa.float64())]))

@tidy

def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its spans and candidates; a row per batch with counts of symbols, and the sum and number of weights by length class."""
    for batch in small_batches(batches, "text"):
        base, sums, found = [], [], []
        symbols, sizes = np.zeros(256, np.int64), np.zeros(2 * (len(LENGTHS) + 1))
        for text in texts_of(batch, "text"):
            symbols += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            sums.append(hashlib.sha256(_line(spans).encode()).hexdigest())
            rows = []
            for a, b, encoding in candidates(text):
                x, (_, p_runs, p_serial) = battery(text[a:b], encoding)
                w = weight(p_runs, p_serial)
                sizes[2 * length_class(b - a) : 2 * length_class(b - a) + 2] += w, 1
                rows.append({"start": a, "end": b, "encoding": encoding, "n": b - a, "x": x, "weight": w})
            found.append(rows)
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * k + [1], pa.int32()), pa.array([*batch.column(0).to_pylist(), None], pa.int64()), pa.array([*base, None], _BASE), pa.array([*sums, None], pa.string()), pa.array([*found, None], _FOUND), pa.array([None] * k + [symbols.tolist()], pa.list_(pa.int64())), pa.array([None] * k + [sizes.tolist()], pa.list_(pa.float64()))],
            names=["part", "doc_id", "base", "base_sha256", "found", "symbols", "sizes"],
        )


def background(symbols: np.ndarray) -> dict[str, tuple[float, float, int]]:
    """Per encoding: sums of the squared and cubed shares of its symbols in the corpus, and its size."""
    out = {}
    for name, alphabet in ENCODINGS.items():
        n = symbols[[ord(c) for c in alphabet]].astype(float) + 1
        q = n / n.sum()
        out[name] = (float((q**2).sum()), float((q**3).sum()), len(alphabet))
    return out


def log_p(n: int, x: float, encoding: str, about: dict[str, tuple[float, float, int]]) -> float:
    """Logarithm of the chance that a run from the corpus's distribution is so even."""
    a, b, k = about[encoding]
    mean = k * ((1 - a) + n * a) - n
    # Variance of the sum of squared multinomial counts, over n squared, times k squared.
    var = k * k * (4 * n * (b - a * a) + 2 * (a + a * a - 2 * b))
    z = max((x - mean) / math.sqrt(max(var, 1e-9)), LEAST_Z)
    return math.log(0.5 * math.erfc(-z / math.sqrt(2)))


def step(c: dict, about: dict[str, tuple[float, float, int]], means: list[float]) -> int:
    """Grid step of a candidate's p-value by weight: the p-value is at most ``exp(-step / GRID)``."""
    got = log_p(c["n"], c["x"], c["encoding"], about) - math.log(max(c["weight"], 1e-300) / means[length_class(c["n"])])
    return max(0, math.floor(-got * GRID))


def thresholds(counts: dict[tuple[int, int], int], level: float = LEVEL) -> dict[int, int]:
    """Benjamini-Hochberg in each length class: the lowest step whose p-value is within the level times its rank over the class's size; none: no key."""
    out = {}
    for size in {k for k, _ in counts}:
        steps = sorted(((s, n) for (k, s), n in counts.items() if k == size), reverse=True)
        total, rank = sum(n for _, n in steps), 0
        for s, n in steps:
            rank += n
            if math.exp(-s / GRID) <= level * rank / total:
                out[size] = s
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``, one row per input row.

    ``base_sha256`` digests the base spans ``kind:start:end`` (code points, end exclusive) by start, then kind; ``spans``
    lists all spans likewise. Spans of the battery that a base span overlaps are not added again. Null and empty texts have
    none; texts of any length are read whole; repeated rows and rows with a null id are scanned and returned each; an empty
    table gives none; other columns play no part, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    seen = stored(src.mapInArrow(_scan, _ROW), "secrets")
    total = seen.where("part = 1").select(F.posexplode(F.concat(F.col("symbols").cast("array<double>"), "sizes")).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # 256 symbols, two numbers a length class
    sums = np.zeros(256 + 2 * (len(LENGTHS) + 1))
    for r in total:
        sums[r["at"]] = r["n"]
    about = background(sums[:256])
    means = [float(w / n) if n else 1.0 for w, n in sums[256:].reshape(-1, 2)]

    @tidy
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            n.update((length_class(c["n"]), step(c, about, means)) for found in batch.column(0).to_pylist() for c in found)
        yield pa.RecordBatch.from_pydict({"size": pa.array([k for k, _ in n], pa.int32()), "step": pa.array([k for _, k in n], pa.int32()), "n": pa.array(list(n.values()), pa.int64())})

    rows = seen.where("part = 0")
    counts = rows.where(F.size("found") > 0).select("found").mapInArrow(steps, "size int, step int, n long").groupBy("size", "step").agg(F.sum("n").alias("n")).collect()  # length classes x grid steps at most
    limits = thresholds({(r["size"], r["step"]): r["n"] for r in counts}, level)

    @tidy
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, spans, random = [], [], []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                old = [(s["start"], s["kind"], s["end"]) for s in base]
                new = [(c["start"], 3, c["end"]) for c in found if (at := limits.get(length_class(c["n"]))) is not None and step(c, about, means) >= at]
                new = [s for s in new if not any(a < s[2] and s[0] < b for a, _, b in old)]
                kinds.append([sum(k == i for _, k, _ in old) for i in range(3)])
                spans.append(_line(sorted(old + new)))
                random.append(len(new))
            counts = [pa.array([k[i] for k in kinds], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, batch.column(2), pa.array(spans, pa.string()), pa.array(random, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return rows.select("doc_id", "base", "base_sha256", "found").mapInArrow(decide, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
