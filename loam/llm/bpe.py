"""BPE encoding and decoding by tree concatenation.

A text is halved until its leaves are short. Leaves are encoded on their own, and where two neighbours meet, a window
around the join is encoded again and grown until it agrees with both sides, so that the result is exactly that of
encoding the whole. Two levels use the same rule:

* between pieces separated by ASCII white space no merge, normalisation or special token can reach across, so a window
  of the pieces cut by the join settles at once;
* inside one long unsplit run of letters or of signs the window grows token by token. A sequence of tokens is the BPE
  encoding of its text exactly if every adjacent pair is the encoding of that pair's text, so the check of the pairs
  around both edges of the window is a proof, not a heuristic.

Texts over ``SPLIT_CHARS`` are halved into parts that separate tasks encode in parallel; a part keeps the text before its
first and after its last white space, and the join encodes the window around each cut, which reaches from white space
to white space (over whole parts, if they have none), so that both sides agree with the whole.

Runs repeat very often; a task keeps those it has encoded in a table that is bounded in bytes and dropped at its end.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, texts_of, tidy

#: Fixed values of the tokenizer's file format: its splitting pattern (ASCII and Latin-1 letters only; other text takes the library's own way) and special tokens.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: A piece of lower-case letters, then ASCII signs (either may be missing): two runs of the pattern above.
_TWO_RUNS = r"^(?P<letters>[a-zß-öø-ÿ]*)(?P<signs>[!-/:-@\[-`{-~]*)$"
WORD_END = "</w>"
LEAF_CHARS = 1 << 15
LEAF_RUN = 256
#: Longer texts are encoded by several tasks, in parts of at most so many characters.
SPLIT_CHARS = 1 << 17
#: Bytes that a task's table of runs may take; a full table starts anew.
TABLE_BYTES = 40 << 20
#: Longer runs are not kept: they hardly repeat.
KEPT_CHARS = 64


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet, fixed by the format: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class TreeEncoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False).ids``, whole columns at a time."""

    def __init__(self, path: str, most_bytes: int = TABLE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.most_bytes, self._decoded = self.tokenizer.model, most_bytes, None
        self.model._resize_cache(0)  # the table below does its work
        letters = _byte_letters()
        self.forget()
        self.spelling = {c: "".join(chr(letters[b]) for b in chr(c).encode()) for c in range(0x21, 0x100)}

    def forget(self) -> None:
        """Drop what the table of runs holds: the place of each run's ids in one array of all."""
        self.place: dict[str, int] = {}
        self.sizes, self.flat, self.held = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    # -- one unsplit run -------------------------------------------------------------------------------------------
    def _model(self, run: str, ends: bool) -> list[tuple[int, str]]:
        """Tokens of a run in byte letters. Without ``ends``, the run goes on: its last letter bears no word end."""
        if ends:
            return [(t.id, t.value) for t in self.model.tokenize(run)]
        return self._open(run)

    def _open(self, run: str) -> list[tuple[int, str]]:
        """Merges of a run that goes on; the model has no such mode, so this applies its merge order directly."""
        ranks = self._ranks()
        parts = list(run)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 30))
            if (pair := (parts[best], parts[best + 1])) not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [(self.tokenizer.token_to_id(p), p) for p in parts]

    def _ranks(self) -> dict[tuple[str, str], int]:
        if not hasattr(self, "_rank_table"):
            import json

            merges = json.loads(self.tokenizer.to_str())["model"]["merges"]
            self._rank_table = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        return self._rank_table

    def _pair_fits(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        ends = b[1].endswith(WORD_END)
        text = a[1] + (b[1].removesuffix(WORD_END) if ends else b[1])
        return self._model(text, ends) == [a, b]

    def run_tokens(self, run: str, ends: bool = True) -> list[tuple[int, str]]:
        """Tree concatenation of one run: halves, then windows around the join that grow until both sides agree."""
        if len(run) <= LEAF_RUN:
            return self._model(run, ends)
        half = len(run) // 2
        left, right = self.run_tokens(run[:half], False), self.run_tokens(run[half:], ends)
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            tail = j == len(right)
            text = "".join(t for _, t in left[i:] + right[:j])
            window = self._model(text.removesuffix(WORD_END) if ends and tail else text, ends and tail)
            if (not i or self._pair_fits(left[i - 1], window[0])) and (tail or self._pair_fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def run(self, run: str) -> list[int]:
        """Ids of one run of letters or of signs."""
        text = run if run.isascii() else run.translate(self.spelling)
        return [i for i, _ in self.run_tokens(text)] if len(text) > LEAF_RUN else [t.id for t in self.model.tokenize(text)]

    # -- one piece without white space -----------------------------------------------------------------------------
    def piece(self, text: str) -> list[int]:
        """Ids of any piece: its runs, one by one, or the library's own way where its splitting is not known here."""
        low = text.lower()
        if _SIMPLE.fullmatch(text) and not any(x in low for x in _SPECIAL):
            return [i for run in _SPLIT.findall(low) for i in self.run(run)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    # -- columns of texts ------------------------------------------------------------------------------------------
    def _append(self, ids: list[list[int]]) -> np.ndarray:
        """Add lists of ids to the table's arrays; returns their places."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        at = len(self.sizes)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.held += 12 * len(ids) + 4 * int(sizes.sum())
        return np.arange(at, at + len(ids))

    def _places(self, runs: list[str]) -> np.ndarray:
        """Places of runs in the table, which encodes those it has not seen."""
        place = np.fromiter(map(self.place.get, runs, itertools.repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [runs[i] for i in missing]
            place[missing] = self._append([self.run(x) for x in new])
            kept = [(x, i) for x, i in zip(new, place[missing].tolist(), strict=True) if len(x) <= KEPT_CHARS]
            self.place.update(kept)
            self.held += 230 * len(kept)  # an entry, its text and its number
        return place

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and the number of each text's. Most pieces are letters, then signs: two runs that are
        looked up once each for a whole column; the others go one by one."""
        if self.held >= self.most_bytes:
            self.forget()
        low = pc.ascii_lower(texts)
        # Lower-casing A-Z first only makes pieces repeat more often; special tokens are matched before it.
        special = pc.match_substring_regex(low, "<\\|(start|end)oftext\\|>")
        pieces = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        coded = pieces.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _TWO_RUNS)
        plain = np.asarray(pc.is_valid(cut))
        letters, signs = (cut.field(i).filter(pa.array(plain)).dictionary_encode() for i in (0, 1))
        with _uncollected():
            first, second = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
            for out, runs in ((first, letters), (second, signs)):
                out[plain] = self._places(runs.dictionary.to_pylist())[runs.indices.to_numpy(zero_copy_only=False)]
            first[~plain] = self._append([self.piece(x) for x in coded.dictionary.filter(pa.array(~plain)).to_pylist()])
            second[~plain] = self._append([[]])[0]
        sizes, flat = self.sizes, self.flat
        which = np.stack([first, second], axis=1)[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        many = sizes[which]
        ends = np.cumsum(many, dtype=np.int32)  # a batch holds a few megabytes of text, so far fewer ids than 2 ** 31
        starts = (np.cumsum(sizes, dtype=np.int32) - sizes)[which]
        ids = np.repeat(starts - (ends - many), many)
        ids += np.arange(len(ids), dtype=np.int32)
        bounds = np.concatenate([np.zeros(1, np.int32), ends])[2 * (pieces.offsets.to_numpy() - pieces.offsets[0].as_py())]
        return flat[ids], np.diff(bounds).astype(np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole column, end to end, and the number of each text's; null counts as empty. Long texts go as the leaves and windows of their trees."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        wide = np.asarray(pc.greater(pc.binary_length(texts), LEAF_CHARS))
        if not wide.any():
            return self._segments(texts)
        segments = [tree_segments(t) if w else [t] for t, w in zip(texts.to_pylist(), wide, strict=True)]
        ids, many = self._segments(pa.array(list(itertools.chain.from_iterable(segments)), pa.string()))
        first = np.cumsum([0, *map(len, segments)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(many)])[first])

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decoded(self) -> pa.Array:
        """The decoding of every id alone: this format has no decoder, so a sequence is its tokens' joined by spaces."""
        if self._decoded is None:
            n = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self._decoded = pa.array([self.tokenizer.decode([i], skip_special_tokens=False) for i in range(n)], pa.string())
            self._decimal = pa.array([str(i) for i in range(n)], pa.string())
        return self._decoded

    def digests(self, ids: np.ndarray, many: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each text's ids in decimal, and of its decoding."""
        decoded = self.decoded()
        at = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int64())
        index = pa.array(ids)
        out = []
        for words in (self._decimal, decoded):
            joined = pc.binary_join(pa.LargeListArray.from_arrays(at, words.take(index)), " ")
            out.append([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined])
        return out[0], out[1]


def tree_segments(text: str) -> list[str]:
    """Leaves and windows of a text's tree, in order. The text is halved until its leaves are short; the window around each
    cut grows to white space on both sides, where both halves agree with the whole."""

    def walk(a: int, b: int) -> list[str]:
        if b - a <= LEAF_CHARS:
            return [text[a:b]]
        half = (a + b) // 2
        lo, hi = half, half
        step = 64
        while lo > a and not _edge(text[lo - 1]):
            at = max((text.rfind(c, max(a, lo - step), lo) for c in _SPACES), default=-1)
            lo = at + 1 if at >= 0 else max(a, lo - step)
            step *= 2
        step = 64
        while hi < b and not _edge(text[hi]):
            at = min((x for c in _SPACES if (x := text.find(c, hi, min(b, hi + step))) >= 0), default=-1)
            hi = at if at >= 0 else min(b, hi + step)
            step *= 2
        if lo <= a and hi >= b:  # one unsplit piece: the tree goes on inside its runs
            return [text[a:b]]
        return walk(a, lo) + [text[lo:hi]] + walk(hi, b)

    return walk(0, len(text))


@contextmanager
def _uncollected() -> Iterator[None]:
    """No garbage collection meanwhile: many short lists live for a moment, none of them in a cycle."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


#: The worker's tokenizers, with empty tables between tasks.
_ENCODERS: dict[str, TreeEncoder] = {}


@contextmanager
def task_encoder(path: str) -> Iterator[TreeEncoder]:
    """The worker process's encoder for one task; at its end, also an early one, its table is dropped, since the worker may serve any other operator next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        _ENCODERS[path].forget()


_SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(r"[ \t-\r]")


def _edge(c: str) -> bool:
    return c in _SPACES


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Short texts, null ones included, and long ones: ``doc_id, text``."""
    bound_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    is_long = F.coalesce(F.octet_length("text") > SPLIT_CHARS, F.lit(False)) & (F.char_length("text") > SPLIT_CHARS)
    return src.where(~is_long), src.where(is_long)


def _id_lists(ids: np.ndarray, many: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(ids))


def _long_ids(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """Long texts ``doc_id, text``: parts are encoded in parallel, joined exactly, and ``finish(encoder, ids)`` makes a row of them.

    Rows that repeat an id and text are encoded once and returned as often as they stand.
    """
    whole = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))

    @tidy
    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                many = 1 << max(1, (len(text) - 1).bit_length() - (SPLIT_CHARS - 1).bit_length())
                each, digest = -(-len(text) // many), hashlib.sha256(text.encode()).hexdigest()
                for lo in range(0, many, 64):
                    at = range(lo, min(many, lo + 64))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * len(at), pa.int64()), "digest": [digest] * len(at), "copies": pa.array([copies] * len(at), pa.int64()), "part": pa.array(at, pa.int64()), "text": pa.array([text[each * i : each * (i + 1)] for i in at], pa.string())})

    parts = whole.mapInArrow(halved, "doc_id long, digest string, copies long, part long, text string").repartition("doc_id", "digest", "part")

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as encoder:
            for batch in small_batches(batches, "text"):
                head, inner, tail = [], [], []
                for text in texts_of(batch, "text"):
                    a = m.start() if (m := _SPACE.search(text)) else None
                    b = max(text.rfind(c) for c in _SPACES)
                    head.append(text if a is None else text[:a])
                    inner.append("" if a is None else text[a : b + 1])
                    tail.append(None if a is None else text[b + 1 :])
                cols = [batch.column(k) for k in range(4)]
                ids = _id_lists(*encoder.encode_column(pa.array(inner, pa.string())))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(head, pa.string()), ids, pa.array(tail, pa.string())], names=["doc_id", "digest", "copies", "part", "head", "ids", "tail"])

    coded = parts.mapInArrow(encode, "doc_id long, digest string, copies long, part long, head string, ids array<int>, tail string")
    fields = [x.split() for x in schema.split(", ")]

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        with task_encoder(path) as encoder:
            ids: list[int] = []
            held: list[str] = []  # text since the last white space
            for head, inner, tail in zip(*(table.column(c).to_pylist() for c in ("head", "ids", "tail")), strict=True):
                held.append(head)
                if tail is not None:
                    ids += encoder.encode("".join(held))
                    ids += inner
                    held = [tail]
            ids += encoder.encode("".join(held))
            row = (table.column("doc_id")[0].as_py(), *finish(encoder, ids))
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        return pa.table([pa.array([v] * table.column("copies")[0].as_py(), kinds[k]) for v, (_, k) in zip(row, fields, strict=True)], names=[n for n, _ in fields])

    return coded.groupBy("doc_id", "digest").applyInArrow(join, schema)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: ``(doc_id, ids array<int>)``.

    Null, empty and blank texts have no ids; repeated rows and rows with a null id are returned each; an empty table gives
    none; other columns play no part, whatever their names.
    """
    short, long = _source(docs, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as encoder:
            for batch in small_batches(batches, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(*encoder.encode_column(batch.column(1)))], names=["doc_id", "ids"])

    schema = "doc_id long, ids array<int>"
    return short.mapInArrow(run, schema).unionByName(_long_ids(long, path, lambda encoder, ids: (ids,), schema))


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The library's ``decode(ids, skip_special_tokens=False)``: this format has no decoder, so tokens join with spaces. Null lists decode as empty ones."""
    bound_batches(df.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as encoder:
            for batch in batches:
                out = [encoder.tokenizer.decode(x or [], skip_special_tokens=False) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so that ids of short texts never leave the worker.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row. The decoding of a sequence is its
    tokens' joined by spaces, so both digests come from two columns of words by id. Null, empty and blank texts give 0 tokens and the digests of the empty string; texts over
    ``SPLIT_CHARS`` are encoded by several tasks; repeated rows and rows with a null id are returned each; an empty table
    gives none; other columns play no part, whatever their names.
    """
    short, long = _source(docs, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as encoder:
            for batch in small_batches(batches, "text"):
                ids, many = encoder.encode_column(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), *map(pa.array, encoder.digests(ids, many))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def finish(encoder: TreeEncoder, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), *(x[0] for x in encoder.digests(np.array(ids, np.int32), np.array([len(ids)])))

    return short.mapInArrow(run, schema).unionByName(_long_ids(long, path, finish, schema))
