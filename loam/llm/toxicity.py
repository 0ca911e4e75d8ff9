"""Toxic spans by a linear-chain conditional random field.

Labels are given per document. Token labels follow from them: of the words that stand almost only in toxic documents, a
greedy cover picks those that explain the toxic documents; their tokens are labelled toxic. Beginnings of words count as
words of their own, so that inflected forms help each other. The field has two states, one weight per known word in each of
three places (the word itself, the one before, the one after) and per known beginning, one for unknown ones, and
transitions. Forward-backward marginals mark the offending tokens; a document's expected number of them, calibrated on the
training documents, is its score.

Forward-backward runs over whole batches at once: the sequences of a batch stand end to end, messages are products of
2 x 2 matrices, taken first inside chunks, then over the chunks, so that long documents cost no more per word than
short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, small_batches, stored, tidy

#: Bounds of the training sample: documents counted for words, and documents the field is trained on. The settings below were
#: chosen by cross-validation over learnt rows.
SAMPLE_ROWS = 12_000
FIELD_DOCS = 400
#: Labelled documents of more bytes do not train the field, so that the two samples of ``FIELD_DOCS`` are bounded in bytes too.
FIELD_BYTES = 1 << 17
#: Words and beginnings that the field knows: the most telling ones of those in ``MIN_DOCS`` toxic documents or more.
VOCABULARY = 20_000
MIN_DOCS = 3
PURITY = 0.8
STEPS = 40
RATE = 0.3
RIDGE = 1e-3
CHUNK = 128
MARK = 0.5
#: Marginals below the first count nothing, so that long clean texts do not add up to a toxic one; the second stands for none.
LEAST_MARGINAL, LEAST_EXPECTED = 1e-3, 1e-6
#: Lengths of the beginnings of longer words; they are marked so that none can be taken for a word.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[\w']+")


def word_key(piece: str) -> str:
    """The word inside a white-space piece: lower case, without surrounding signs."""
    found = _WORD.findall(piece.lower())
    return max(found, key=len) if found else ""


def features(word: str) -> list[str]:
    """The word and its marked beginnings, one for each of ``STEMS``, empty where the word is no longer than that."""
    return [word, *(f"{word[:n]}-{n}" if len(word) > n else "" for n in STEMS)]


def numbers(words: dict[str, int], word: str) -> tuple[int, ...]:
    return tuple(words.get(f, 0) if f else 0 for f in features(word))


@dataclass
class Field:
    words: dict[str, int]  # word or marked beginning -> number; 0 is any other
    emit: np.ndarray  # (3 + beginnings) x words
    start: float
    trans: np.ndarray  # log potentials [[0, O->T], [T->O, T->T]]
    slope: float = 1.0
    offset: float = 0.0


def _chain(e: np.ndarray, first: np.ndarray, start: float, a_ot: float, a_to: float, a_tt: float) -> np.ndarray:
    """Forward ratios alpha(T) / alpha(O) for emissions ``e`` (as ratios), sequences starting where ``first``."""
    n = len(e)
    cols = -(-n // CHUNK)
    pad = cols * CHUNK - n
    e2 = np.concatenate([e, np.ones(pad)]).reshape(cols, CHUNK).T
    f2 = np.concatenate([first, np.zeros(pad, bool)]).reshape(cols, CHUNK).T
    # Products of the chunk's matrices: rows map (O, T) of the chunk before to (O, T) now.
    p00, p01, p10, p11 = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for i in range(CHUNK):
        em, fs = e2[i], f2[i]
        s0, s1 = p00 + p10, p01 + p11
        n0, n1 = np.where(fs, s0, p00 + p10 * a_to), np.where(fs, s1, p01 + p11 * a_to)
        t0, t1 = np.where(fs, s0 * start, p00 * a_ot + p10 * a_tt) * em, np.where(fs, s1 * start, p01 * a_ot + p11 * a_tt) * em
        top = np.maximum(np.maximum(n0, n1), np.maximum(t0, t1))
        p00, p01, p10, p11 = n0 / top, n1 / top, t0 / top, t1 / top
    r = np.empty(cols)
    x, y = 1.0, 0.0
    for c in range(cols):
        r[c] = y / x if x else 1e300
        x, y = p00[c] * x + p01[c] * y, p10[c] * x + p11[c] * y
        top = max(x, y) or 1.0
        x, y = x / top, y / top
    out = np.empty((CHUNK, cols))
    for i in range(CHUNK):
        r = np.where(f2[i], start, (a_ot + r * a_tt) / (1 + r * a_to)) * e2[i]
        r = np.minimum(r, 1e12)
        out[i] = r
    return out.T.reshape(-1)[:n]


def forward_backward(score: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and the forward ratios."""
    if not len(score):
        return np.zeros(0), np.zeros(0)
    e = np.exp(np.clip(score, -25, 25))
    a_ot, a_to, a_tt = np.exp(field.trans[0, 1]), np.exp(field.trans[1, 0]), np.exp(field.trans[1, 1])
    fwd = _chain(e, first, np.exp(field.start), a_ot, a_to, a_tt)
    # Backward is a forward pass over the reversed sequence with the transposed transitions: it gives e * beta.
    last = np.concatenate([first[1:], [True]])
    back = _chain(e[::-1], last[::-1], 1.0, a_to, a_ot, a_tt)[::-1]
    odds = fwd * (back / e)
    return odds / (1 + odds), fwd


def _emission(ids: np.ndarray, first: np.ndarray, emit: np.ndarray) -> np.ndarray:
    word = ids[:, 0]
    score = emit[0][word]
    for i in range(len(STEMS)):
        score = score + emit[3 + i][ids[:, 1 + i]]
    if len(ids) > 1:
        before = emit[1][word[:-1]]
        after = emit[2][word[1:]]
        inner = ~first[1:]
        score[1:] += np.where(inner, before, 0)
        score[:-1] += np.where(inner, after, 0)
    return score


def train(ids: np.ndarray, gold: np.ndarray, starts: np.ndarray, words: dict[str, int]) -> Field:
    """Gradient ascent on the conditional likelihood: observed less expected counts, from forward-backward.

    ``ids`` holds the features' numbers of all sequences end to end, ``gold`` their labels, ``starts`` where each begins.
    """
    first = np.zeros(len(ids), bool)
    first[starts] = True
    field = Field(words, np.zeros((3 + len(STEMS), len(words) + 1)), -2.0, np.array([[0.0, -2.0], [0.0, 0.0]]))
    inner = ~first[1:]
    shape = field.emit.shape[1]
    m = np.zeros_like(field.emit)
    v = np.zeros_like(field.emit)
    mt, vt = np.zeros(4), np.zeros(4)
    for step in range(1, STEPS + 1):
        score = _emission(ids, first, field.emit)
        p, fwd = forward_backward(score, first, field)
        diff = gold - p
        word = ids[:, 0]
        g = [np.bincount(word, diff, shape), np.bincount(word[:-1], np.where(inner, diff[1:], 0), shape), np.bincount(word[1:], np.where(inner, diff[:-1], 0), shape)]
        g = np.stack(g + [np.bincount(ids[:, 1 + i], diff, shape) for i in range(len(STEMS))])
        # Pair marginals: the pair (i, j) is alpha_i * potential * what follows; what follows from the odds at j.
        a_ot, a_to, a_tt = np.exp(field.trans[0, 1]), np.exp(field.trans[1, 0]), np.exp(field.trans[1, 1])
        r = fwd[:-1]
        to_o, to_t = 1 + r * a_to, a_ot + r * a_tt
        q = p[1:]
        pairs = [q * a_ot / to_t, (1 - q) * r * a_to / to_o, q * r * a_tt / to_t]
        x, y = gold[:-1], gold[1:]
        seen = [(1 - x) * y, x * (1 - y), x * y]
        gt = np.array([((s - w) * inner).sum() for s, w in zip(seen, pairs, strict=True)] + [diff[first].sum()])
        n = len(starts)
        g, gt = g / n - RIDGE * field.emit, gt / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        lift = lambda a, b: RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)  # noqa: E731, B023
        field.emit = field.emit + lift(m, v)
        d = lift(mt, vt)
        field.trans = field.trans + np.array([[0, d[0]], [d[1], d[2]]])
        field.start += d[3]
    return field


def pure_words(counts: dict[str, tuple[int, int]]) -> set[str]:
    """Words that stand almost only in toxic documents."""
    return {w for w, (t, f) in counts.items() if t >= MIN_DOCS and t / (t + f) >= PURITY}


def cover(toxic: list[set[str]], counts: dict[str, tuple[int, int]]) -> set[str]:
    """Words to label: by number of toxic documents not yet explained, among words that are pure enough."""
    pure = pure_words(counts)
    where: dict[str, set[int]] = {w: set() for w in pure}
    for i, words in enumerate(toxic):
        for w in words & pure:
            where[w].add(i)
    left, chosen = set(range(len(toxic))), set()
    while left and where:
        # Of words that explain equally many, the one with more toxic documents in all, then by name.
        best = max(where, key=lambda w: (len(where[w] & left), len(where[w]), w))
        if len(where[best] & left) < MIN_DOCS:
            break
        chosen.add(best)
        left -= where.pop(best)
    # Words as frequent and as pure as the chosen ones mean the same, though what they explain was explained before.
    typical = np.median([counts[w][0] for w in chosen]) if chosen else 0
    return chosen | {w for w in pure if counts[w][0] >= typical / 2 and counts[w][1] == 0}


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on labelled rows; null labels are ignored. At most about ``sample_rows`` rows are counted and ``FIELD_DOCS`` of each label train the field."""
    bound_batches(labelled.sparkSession)
    src = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    return _fit(bounded_sample(src, "id", sample_rows))


def fit_joined(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Field:
    """As :func:`fit`, with labels in a table of their own: the bounded sample of labels is broadcast to the documents."""
    bound_batches(docs.sparkSession)
    few = bounded_sample(labels.where(F.col(label_col).isNotNull()), id_col, sample_rows).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    src = docs.select(docs[id_col].alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(few), F.col("key") == F.col("id"))
    return _fit(stored(src.select("id", "text", "label"), "labelled"))


def _fit(src: DataFrame) -> Field:
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for label in (0, 1):
                n: Counter[str] = Counter()
                for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if y == label:
                        n.update({f for w in {word_key(x) for x in text.split()} for f in features(w)})
                n.pop("", None)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([label] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["word", "label", "n"])

    hits = src.mapInArrow(count, "word string, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("f"))
    top = hits.where(F.col("t") >= MIN_DOCS).withColumn("lift", F.log((F.col("t") + 0.5) / (F.col("f") + 0.5))).orderBy(F.desc("lift"), F.desc("t"), "word").limit(VOCABULARY).collect()
    counts = {r["word"]: (r["t"], r["f"]) for r in top}
    words = {w: i + 1 for i, w in enumerate(sorted(counts))}
    n = {r["label"]: r["count"] for r in src.groupBy("label").count().collect()}
    short = src.where(F.octet_length("text") <= FIELD_BYTES)
    half = [bounded_sample(short.where(F.col("label") == y), "id", FIELD_DOCS) for y in (0, 1) if n.get(y)]
    rows = [r for part in half for r in part.select("id", "text", "label").collect()]  # at most about 2 * FIELD_DOCS documents of FIELD_BYTES
    rows.sort(key=lambda r: (r["label"], r["id"] is None, r["id"]))
    if n.get(1, 0) == 0 or not words:
        return Field({}, np.zeros((3 + len(STEMS), 1)), 0.0, np.zeros((2, 2)), 0.0, -10.0)
    # Documents as numbers of distinct words: the sample's strings are kept once.
    seen: dict[str, int] = {}
    texts = [np.fromiter((seen.setdefault(word_key(x), len(seen)) for x in r["text"].split()), np.int32) for r in rows]
    label = np.array([r["label"] for r in rows])
    del rows
    table = np.array([numbers(words, w) for w in seen], np.int32).reshape(-1, 1 + len(STEMS))
    pure = pure_words(counts)
    holds = [frozenset(f for f in features(w) if f in pure) for w in seen]
    marked = cover([set().union(*(holds[i] for i in np.unique(t))) for t, y in zip(texts, label, strict=True) if y == 1], counts)
    toxic = np.array([not marked.isdisjoint(h) for h in holds], float)
    kept = [i for i, t in enumerate(texts) if len(t)]
    sequence = np.concatenate([texts[i] for i in kept])
    lens = np.array([len(texts[i]) for i in kept])
    gold = toxic[sequence] * np.repeat(label[kept] == 1, lens)
    ids, starts = table[sequence], np.cumsum([0, *lens])[:-1]
    field = train(ids, gold, starts, words)
    y = label[kept].astype(float)
    _calibrate(field, ids, starts, y, np.where(y == 1, n.get(1, 0) / max(1, (label == 1).sum()), n.get(0, 0) / max(1, (label == 0).sum())))
    return field


def _calibrate(field: Field, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic curve from the logarithm of the expected number of toxic tokens to the document's label, by Newton's method;
    weights restore the labels' frequencies, which the sample evens out."""
    first = np.zeros(len(ids), bool)
    first[starts] = True
    p = _marginals(field, ids, first)
    x = np.log(np.maximum(LEAST_EXPECTED, np.add.reduceat(np.where(p > LEAST_MARGINAL, p, 0.0), starts)))
    weight = weight / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        ga, gb = (weight * (y - q) * x).sum() - 1e-3 * a, (weight * (y - q)).sum()
        v = weight * q * (1 - q)
        haa, hab, hbb = (v * x * x).sum() + 1e-3, (v * x).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
    field.slope, field.offset = max(a, 1e-3), b


def _marginals(field: Field, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return forward_backward(_emission(ids, first, field.emit), first, field)[0]


def score_column(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Scores of a column's texts, marginals of all tokens, and the tokens with their texts' bounds."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pieces.flatten()
    coded = flat.dictionary_encode()
    known = field.words
    ids = np.array([numbers(known, word_key(x)) for x in coded.dictionary.to_pylist()], np.int64).reshape(-1, 1 + len(STEMS))
    ids = ids[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else ids
    bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    first = np.zeros(len(ids), bool)
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[starts] = True
    p = _marginals(field, ids, first)
    sums = np.concatenate([[0.0], np.cumsum(np.where(p > LEAST_MARGINAL, p, 0.0))])
    x = np.log(np.maximum(LEAST_EXPECTED, sums[bounds[1:]] - sums[bounds[:-1]]))
    return 1 / (1 + np.exp(-np.clip(field.slope * x + field.offset, -30, 30))), p, flat, bounds


def _marked(key, text: str, p: np.ndarray) -> list[tuple]:
    """Offending tokens of a text from its tokens' marginals: ``(key, start, end, token, marginal)`` in code points."""
    return [(key, m.start(), m.end(), m.group(), float(q)) for m, q in zip(re.finditer(r"[^ \t-\r]+", text), p, strict=True) if q >= MARK]


def _each(batch: pa.RecordBatch, p: np.ndarray, flat: pa.Array, bounds: np.ndarray) -> dict[int, list[tuple]]:
    """Offending tokens by row, for rows that have any."""
    hits = np.concatenate([[0], np.cumsum(p >= MARK)])
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    out = {}
    for i in np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]]).tolist():
        at = slice(bounds[i], bounds[i + 1])
        out[i] = _marked(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), p[at][filled[at]])
    return out


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, n_spans, spans`` of every whole text, one row per input row.

    ``spans`` lists the offending tokens' offsets ``start:end`` in code points, comma-joined. Null, empty and blank texts
    score as texts without words; texts of any length are scored whole; repeated rows and rows with a null id are returned
    each; an empty table gives none; other columns play no part, whatever their names.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            got, p, flat, bounds = score_column(shared.value, batch.column(1))
            marked = _each(batch, p, flat, bounds)
            many = [len(marked.get(i, ())) for i in range(batch.num_rows)]
            spans = [",".join(f"{a}:{b}" for _, a, b, _, _ in marked.get(i, ())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32)), pa.array(many, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "score", "predicted", "n_spans", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_spans long, spans string")


def spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Offending tokens: ``doc_id, start, end, token, marginal`` in code points, for every token marked toxic; rows as in :func:`score`."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            _, p, flat, bounds = score_column(shared.value, batch.column(1))
            rows = [r for found in _each(batch, p, flat, bounds).values() for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "end", "token", "marginal"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, start long, end long, token string, marginal double")
