"""Language identification by bit-sliced Bloom filters.

One table of bit masks holds a Bloom filter for every language at once: slot ``h`` keeps bit ``l`` if some n-gram of
language ``l`` hashes there. The AND of an n-gram's slots names all languages that hold it. A text's count for a language,
less the expected false positives of that language's slice, over the number of its n-grams, is its coverage; the language
with the highest coverage is returned.

An n-gram belongs to a language if it makes up at least ``min_share`` of the language's n-grams and at least
``rival`` of its share in the language where it is most common; so at most ``1 / min_share`` n-grams a language exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, stored, texts_of, tidy

UNKNOWN = "und"
ORDERS = (3, 4)
SAMPLE_ROWS = 20_000
MIN_SHARE = 1 / 20_000
RIVAL = 0.25
SLOT_BITS = 18
HASHES = 2
#: Text that is looked at in one go.
PART_BYTES = 1 << 18


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray  # per language: chance that an n-gram of no language passes


_IS_LETTER: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, as ``str.isalpha`` has it: by a table of the basic plane; others are few and asked for one by one."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    found = _IS_LETTER[0][np.minimum(codes, 0xFFFF)]
    high = codes >= 0x10000
    if high.any():
        there, which = np.unique(codes[high], return_inverse=True)
        found[high] = np.fromiter((chr(c).isalpha() for c in there), bool, len(there))[which]
    return found


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters (runs of others count as a border), the text each is from, and whether each text has a letter.

    Every text stands between two borders of its own. An n-gram has borders at its ends only, so none reaches into the next
    text, and a text's n-grams do not depend on its neighbours.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters(codes)
    lens = np.fromiter(map(len, low), np.int64, len(low)) + 2
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(low)), lens)
    has = np.logical_or.reduceat(letter, ends - lens) if len(low) else np.zeros(0, bool)
    plain = np.where(letter, codes, 0).astype(np.uint64)
    found, docs = [], []
    mul = np.uint64(0x9E3779B97F4A7C15)
    for n in ORDERS:
        if len(plain) < n:
            continue
        m = len(plain) - n + 1
        inside = np.ones(m, bool)
        for i in range(1, n - 1):  # borders only stand at the ends
            inside &= letter[i : i + m]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ plain[at + i]) * mul
            h ^= h >> np.uint64(29)
        found.append(h)
        docs.append(doc[at])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(docs), has


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - bits * (i + 1))) & np.uint64((1 << bits) - 1) for i in range(HASHES)]


def _sample(src: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of ``id, text, lang``, as many of each language as it has up to an equal share: a rare language is not lost. One row a language reaches the driver."""
    per = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = {r["lang"]: r["n"] for r in per.collect()}
    each = max(1, rows // max(1, len(langs)))
    if all(n <= each for n in langs.values()):
        return src.select("text", "lang")
    part = src.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in langs.items()], "of string, share double")
    kept = src.join(F.broadcast(part), F.col("lang") == F.col("of"))
    return kept.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, slot_bits: int = SLOT_BITS) -> Model:
    """Fit on a bounded sample of about ``sample_rows`` labelled rows, dealt equally over the languages, the same ones on every run.

    Rows without a language are ignored; null and empty texts add nothing; repeated rows count each; an empty table gives a
    model without languages; other columns play no part, whatever their names. At most ``1 / MIN_SHARE`` n-grams a language
    are kept.
    """
    bound_batches(labelled.sparkSession)
    src = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 * PART_BYTES):
            langs = np.array(batch.column(1).to_pylist(), object)
            h, doc, _ = grams(texts_of(batch, "text"))
            for lang in sorted(set(langs)):
                got, n = np.unique(h[(langs == lang)[doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = stored(_sample(src, sample_rows).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in total.collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((1 << slot_bits, 1), np.uint64), np.zeros(0))
    # At most 1 / MIN_SHARE rows a language.
    top = counts.join(F.broadcast(total), "lang").where(F.col("n") >= F.greatest(F.lit(1.0), F.col("total") * MIN_SHARE)).select("lang", "gram", "n").toPandas()
    top["share"] = top["n"] / top["lang"].map(totals)
    top = top[top["share"] >= RIVAL * top.groupby("gram")["share"].transform("max")]
    masks = np.zeros((1 << slot_bits, -(-len(langs) // 64)), np.uint64)
    for i, lang in enumerate(langs):
        h = top.loc[top["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for slot in _slots(h, slot_bits):
            masks[slot, i // 64] |= np.uint64(1 << (i % 64))
    full = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, masks, np.minimum(full**HASHES, 0.99))


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score (share of the best coverage in the sum of all) of each text."""
    h, doc, has = grams(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(float)
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    bits = model.masks.shape[0].bit_length() - 1
    seen = None
    for slot in _slots(h, bits):
        got = model.masks[slot]
        seen = got if seen is None else seen & got
    cover = np.zeros((len(texts), len(model.langs)))
    for i in range(len(model.langs)):
        hit = ((seen[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float)
        hits = np.bincount(doc, weights=hit, minlength=len(texts))
        cover[:, i] = np.clip((hits - n * model.false_rate[i]) / np.maximum(n * (1 - model.false_rate[i]), 1e-9), 0, 1)
    best = cover.argmax(1)
    total = cover.sum(1)
    score = np.where(total > 0, cover.max(1) / np.maximum(total, 1e-12), 0.0)
    langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
    return langs, [float(s) if ok else 0.0 for s, ok in zip(score, has, strict=True)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, one row per input row.

    Null texts and those without a letter are ``und`` with score 0, as is every text if the model has no language; ties go
    to the first language by name. Texts of any length are scored whole, by themselves; repeated rows and rows with a null
    id are returned each; an empty table gives none; other columns play no part, whatever their names.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", PART_BYTES):
            langs, score = score_texts(shared.value, texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language: those that :func:`identify` does not call ``und``.

    The decision travels with the row, so no join or shuffle follows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in _parts(batch, at):
                    langs, _ = score_texts(shared.value, [x or "" for x in part.column(at).to_pylist()])
                    yield part.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    each = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.column(at).nbytes)))
    for lo in range(0, batch.num_rows, each):
        yield batch.slice(lo, each)
