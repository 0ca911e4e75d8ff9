"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory that has a license file.

Header lines, and paragraphs of wrapped lines joined without their comment signs, are compared with header templates, whole
documents with header and license texts. A text is a sparse vector: every term of a template has a dimension of its own, and all other terms share ``HASHED`` dimensions by their
hash. Document frequencies come from all candidate lines, or from all documents that have one: a count per dimension,
which is bounded, so it is added up once and handed to every task; no term meets its like in one task. Both passes
decide each row by itself. Paths are joined by directory, in salted groups.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, stored, texts_of, tidy

#: Header and title lines of well-known public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License.",
    "GPL-2.0": "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Short forms of header lines. They share much with any line about licenses, so they need a higher cosine.
SHORT = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Released under the ISC License."),
]
#: The longer headers that are usually wrapped over several lines.
HEADERS = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: A license with a version is only given to a text that names it, with or without a ``v``.
VERSIONS = {"Apache-2.0": ("2", "2.0"), "GPL-2.0": ("2", "2.0"), "GPL-3.0": ("3", "3.0"), "LGPL-2.1": ("2.1",), "LGPL-3.0": ("3", "3.0"), "MPL-2.0": ("2", "2.0"), "CC-BY-4.0": ("4", "4.0"), "CC-BY-SA-4.0": ("4", "4.0"), "CC-BY-NC-4.0": ("4", "4.0")}
#: An identifier tag names its license itself.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)")
#: Signs that stand before and behind the text of a comment line.
_COMMENT = re.compile(r"^[ \t]*(?://[/!]*|/\*+!?|\*+/?|#+!?|--+|;+|%+|<!--|\"{3}|'{3}|\.\.(?=[ \t]))[ \t]*")
_CLOSING = re.compile(r"[ \t]*(?:\*+/|-->|\"{3}|'{3})?[ \t\r]*$")
#: Whole license texts, a file each.
TEXTS = Path(__file__).parent / "license_texts"
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A line, paragraph or document is a candidate if it holds one of these words in any case: what says nothing of the kind is no
#: statement of a license, however near to the rest of a template's wording. Every template and every tag does.
CUE = r"licen[sc]e|permission|redistribut|copyright|public domain|unencumbered"
_CUE = re.compile(CUE)
LEAST = 0.35
SHORT_LEAST = 0.7
#: A document is a license file for its directory if its whole text has this cosine to a template that covers this share of its words.
FILE_LEAST, COVERED = 0.7, 0.8
#: Dimensions of the terms that no template has.
HASHED = 1 << 16
#: Directories with license files are broadcast up to this number; rows are joined to directories in so many groups each.
BROADCAST_DIRS, SALTS = 10_000, 16
LINE, BODY = 0, 1


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def kind(term: str) -> str | None:
    """The kind of cue that a term is, in any spelling."""
    found = _CUE.search("public domain" if term == "domain" else term)
    return found and found[0].replace("licence", "license")


@dataclass
class Templates:
    """Licenses and forms of the templates, the dimension of each of their terms, and their term counts."""

    names: list[str]
    forms: list[str]
    places: dict[str, int]
    counts: list[Counter]

    @property
    def width(self) -> int:
        return len(self.places) + HASHED

    def place(self, term: str) -> int:
        found = self.places.get(term)
        return len(self.places) + zlib.crc32(term.encode()) % HASHED if found is None else found

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions of a text and their counts."""
        n = Counter(map(self.place, words))
        return np.fromiter(n.keys(), np.int64, len(n)), np.fromiter(n.values(), np.float64, len(n))


def templates() -> Templates:
    texts = [(f.name.removesuffix(".txt"), "text", f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    every = [*[(k, "header", v) for k, v in TEMPLATES.items()], *[(k, "header", v) for k, v in HEADERS], *[(k, "short", v) for k, v in SHORT], *texts]
    counts = [Counter(terms(v)) for _, _, v in every]
    words = sorted(set().union(*counts))
    return Templates([k for k, _, _ in every], [f for _, f, _ in every], {w: i for i, w in enumerate(words)}, counts)


def idf(df: np.ndarray, units: int) -> np.ndarray:
    return np.log((units + 1) / (df + 1)) + 1


class Scorer:
    """Cosines of lines, or of whole documents, to those templates they are compared with."""

    def __init__(self, t: Templates, unit: int, df: np.ndarray, units: int) -> None:
        self.kind, self.idf = unit, idf(df, units)
        self.at = [i for i, f in enumerate(t.forms) if f != ("text" if unit == LINE else "short")]
        self.names = [t.names[i] for i in self.at]
        self.short = np.array([t.forms[i] == "short" for i in self.at])
        self.known = len(t.places)
        # Templates weigh a term that no unit has as 1, so that rare words do not rule them.
        seen = np.where(df[: self.known] > 0, self.idf[: self.known], 1.0)
        self.weights = np.zeros((self.known, len(self.at)))
        for col, i in enumerate(self.at):
            for w, n in t.counts[i].items():
                self.weights[t.places[w], col] = self.damp(n) * seen[t.places[w]]
        self.weights /= np.sqrt((self.weights**2).sum(0))
        self.held = self.weights > 0
        # For each template the dimensions of the versions one of which a text must name; none for a license without version.
        self.named = [[t.place(p + v) for v in VERSIONS.get(n, ()) for p in ("", "v")] for n in self.names]
        # And those of its own kinds of cue words: a text about a license does not say that it is in the public domain.
        kinds = [{kind(w) for w in t.counts[i]} - {None} for i in self.at]
        self.cues = [[place for w, place in t.places.items() if kind(w) in k] for k in kinds]

    def damp(self, n):
        """Counts of a line weigh as they are, those of a document 1 + log n: else long prose is near any long license by its articles alone."""
        return n if self.kind == LINE else 1 + np.log(n)

    def scores(self, dims: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = self.damp(counts) * self.idf[dims]
        norm = math.sqrt(float((w * w).sum()))
        inside = dims < self.known
        return np.round(w[inside] @ self.weights[dims[inside]] / norm, 6) if norm else np.zeros(len(self.at))

    def best(self, dims: np.ndarray, counts: np.ndarray, least: float) -> tuple[float, str] | None:
        """Highest score that is enough and its license, by name where scores are equal."""
        got = self.scores(dims, counts)
        enough = np.where(self.short, max(least, SHORT_LEAST), least) if self.kind == LINE else np.full(len(got), FILE_LEAST)
        good = got >= enough
        if not good.any():
            return None
        if self.kind == BODY:
            inside = dims < self.known
            good &= counts[inside] @ self.held[dims[inside]] >= COVERED * counts.sum()
        there = set(dims.tolist())
        says = lambda i: not there.isdisjoint(self.cues[i]) and (not self.named[i] or not there.isdisjoint(self.named[i]))
        return max(((float(got[i]), self.names[i]) for i in np.flatnonzero(good).tolist() if says(i)), default=None)


def paragraphs(text: str) -> list[str]:
    """Joined lines of every paragraph of several lines, without comment signs. An empty line ends one, and so does a change between comment and other text."""
    out: list[list[str]] = [[]]
    kind = None
    for line in text.split("\n"):
        bare = _COMMENT.sub("", line)
        mark, bare = bare != line, _CLOSING.sub("", bare).strip()
        if not bare or mark != kind:
            out.append([])
        if bare:
            kind = mark
            out[-1].append(bare)
    return [" ".join(p) for p in out if len(p) > 1]


def tagged(text: str) -> str | None:
    """The license that an identifier tag names, without its suffix; of several tags the first by name."""
    return min((re.sub(r"-(?:only|or-later)$|\+$", "", m).rstrip(".-") for m in SPDX.findall(text)), default=None)


def units_of(texts: pa.Array) -> Iterator[tuple[int, list[list[str]], list[str], str | None]]:
    """Row, terms of each candidate line and paragraph, terms of the whole text, and its tag, for every text that holds a candidate line."""
    hit = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(pc.ascii_lower(texts), CUE), False)))
    for i in hit.tolist():
        text = texts[i].as_py()
        yield i, [terms(x) for x in (*text.split("\n"), *paragraphs(text)) if _CUE.search(x.lower())], terms(text), tagged(text)


def frequencies(texts: DataFrame, t: Templates) -> tuple[np.ndarray, list[int]]:
    """Units that hold each dimension, by kind of unit, and the units of each kind. ``2 * width`` counts reach the driver at most."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, t.width + 1), np.int64)  # the last one counts the units
        for batch in small_batches(batches, "text"):
            for _, lines, body, _ in units_of(batch.column(0)):
                for kind, words in [(LINE, x) for x in lines] + [(BODY, body)]:
                    df[kind, t.vector(words)[0]] += 1
                    df[kind, -1] += 1
        kind, dim = np.nonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(df[kind, dim])], names=["kind", "dim", "n"])

    got = texts.mapInArrow(count, "kind int, dim int, n long").groupBy("kind", "dim").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((2, t.width + 1))
    df[got["kind"], got["dim"]] = got["n"]
    return df[:, :-1], df[:, -1].astype(int).tolist()


def scan(docs: DataFrame, path: F.Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id, path, own_license, own_score, is_file, license, license_dir``, one row per input row.

    ``own_license`` is the template nearest to a license file's whole text, else what an identifier tag names (score 1), else the
    template nearest to one of the document's lines or paragraphs (best cosine of at least ``least``, for short forms
    ``SHORT_LEAST``, then by name). A version is given only where the text names it. A license file is one whose words a template
    covers, so a header over code makes none.
    A document without one inherits from the nearest ancestor directory that holds a license file, where the best of
    several files counts: its path is cut into its ancestors (the root, ``''``, is one), which are joined to the
    directories, the longest found winning.

    Null and empty texts have no license of their own; rows with a null path keep their own license and inherit nothing;
    rows that repeat an id or a path are scanned and returned each; texts of any length are read whole; an empty table
    gives none; the names of other columns do not matter.
    """
    bound_batches(docs.sparkSession)
    t = templates()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), path.alias("path"), docs[text_col].alias("text"))
    df, units = frequencies(rows.select("text"), t)
    shared = docs.sparkSession.sparkContext.broadcast([Scorer(t, kind, df[kind], units[kind]) for kind in (LINE, BODY)])

    @tidy
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_line, by_body = shared.value
        for batch in small_batches(batches, "text"):
            found: list[tuple[float, str] | None] = [None] * batch.num_rows
            file = np.zeros(batch.num_rows, bool)
            for i, lines, body, tag in units_of(batch.column(2)):
                found[i] = by_body.best(*t.vector(body), least)
                file[i] = found[i] is not None
                if found[i] is None and tag:
                    found[i] = (1.0, tag)
                if found[i] is None:
                    found[i] = max((x for words in lines if (x := by_line.best(*t.vector(words), least))), default=None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x and x[1] for x in found], pa.string()), pa.array([x and x[0] for x in found], pa.float64()), pa.array(file)], names=["doc_id", "path", "own_license", "own_score", "is_file"])

    marked = stored(rows.mapInArrow(own, "doc_id long, path string, own_license string, own_score double, is_file boolean"), "licenses")
    marked = marked.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    dirs = marked.where("is_file and dir is not null").groupBy(F.col("dir").alias("license_dir")).agg(F.max_by("own_license", F.struct("own_score", "own_license")).alias("dir_license"))
    dirs = stored(dirs, "license-dirs")
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = marked.where("dir is not null").select("dir").distinct().withColumn("parts", parts)
    up = up.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("license_dir"))
    nearest = up.join(F.broadcast(dirs) if dirs.count() <= BROADCAST_DIRS else dirs, "license_dir").groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), F.length("license_dir")).alias("found"))
    # A directory may hold any share of the rows, so each of its salts finds the directory's license.
    nearest = nearest.select(F.col("dir").alias("d"), "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int"))
    out = salted.join(nearest, (F.col("dir") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return out.select("doc_id", "path", "own_license", "own_score", "is_file", F.coalesce("own_license", "found.dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("found.license_dir")).alias("license_dir"))


def document_path(docs: DataFrame) -> F.Column:
    """A path for tables without one: the source, then two levels of a thousand and a hundred ids."""
    return F.concat_ws("/", F.coalesce(docs["source"], F.lit("unknown")), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"), docs["doc_id"].cast("string"))
