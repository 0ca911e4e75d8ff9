"""Audit of how far sources diverge in their words, by wide term vectors.

Each language keeps the terms that enough of its documents hold. A kept term becomes one row with an array of its counts
by source, so that the sources' smoothed probabilities, scaled to whole numbers, lie side by side. Higher-order functions turn
a row into the contributions of its pairs of sources, first by one source, then by the other, and Spark's map-side aggregation
sums them: one row a task and pair reaches the shuffle. All of it is in whole numbers.

Terms are cut and counted in Arrow batches, in every task first, so no frequent word and no large source meets in one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, stored, tidy

#: ASCII letters become lower-case and other ASCII characters spaces; all bytes of other characters stay, so terms can be cut from UTF-8.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SLICE, HELD = 1 << 20, 400_000
LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Up to so many groups are broadcast, as one row a language.
BROADCAST_GROUPS = 10_000


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    return docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, about ``SLICE`` bytes at a time, each slice ending where a term does."""
    clean, at = text.translate(_LETTERS), 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term, counted in every task before they are shuffled.

    A task's tables hold ``HELD`` terms at most and are passed on and emptied when they are full.
    """

    def passed_on(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            docs = held[lang, source]
            terms, k = list(n), len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, terms), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(Counter), defaultdict(Counter)
        for batch in small_batches(batches, "text"):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = set()
                for words in _words(text):
                    counts[lang, source].update(words)
                    own.update(words)
                held[lang, source].update(own)
            if sum(map(len, counts.values())) > HELD:
                yield from passed_on(counts, held)
                counts, held = defaultdict(Counter), defaultdict(Counter)
        yield from passed_on(counts, held)

    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").where(F.octet_length("term") > 0)
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(rows: DataFrame) -> DataFrame:
    """``lang, sources``: a row a language with its sources in order; windows run over one row per group."""
    each = rows.select("lang", "source").distinct()
    return each.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def _joined(rows: DataFrame, langs: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(langs) if few else langs, "lang")


def wide_vectors(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, bool]:
    """``lang, term, counts`` (by the place of a source among its language's), ``lang, sources, sizes, size, terms`` (sums over kept terms), and whether the latter is short."""
    bound_batches(docs.sparkSession)
    rows = _rows(docs, text_col, lang_col, source_col)
    groups = stored(_groups(rows), "groups")
    few = groups.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_GROUPS
    places = groups.select("lang", F.posexplode("sources").alias("place", "source"), F.size("sources").alias("width"))
    found = term_counts(rows).join(F.broadcast(places) if few else places, ["lang", "source"])
    by = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("place", "n"))).alias("held")).where(F.col("docs") >= least)
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    before = lambda i: F.coalesce(F.when(i > 0, F.get("held", i - 1)["place"]), F.lit(-1))
    filled = F.flatten(F.transform("held", lambda x, i: F.concat(zeros(x["place"] - before(i) - 1), F.array(x["n"]))))
    wide = stored(by.select("lang", "term", F.concat(filled, zeros(F.col("width") - F.element_at("held", -1)["place"] - 1)).alias("counts")), "wide")
    sums = wide.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    sizes = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("sizes"), F.sum("n").alias("size"), F.max("terms").alias("terms"))
    langs = groups.join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))
    return wide, stored(langs, "langs"), few


def _scaled(count, size):
    """``1 + floor(UNIT * (count + SMOOTH) / (size + SMOOTH * terms))``, exact: products are decimals of up to 38 digits."""
    over = (count + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, (size + F.lit(SMOOTH) * F.col("terms")).cast("decimal(19,0)"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group, its distance to every other source of its language, and the terms it has most beyond the language.

    Null text, language and source count as ''. A group without terms has the smoothed probabilities alone; a language without
    kept terms has distances of 0 and no terms; a language of one source has no pairs. Equal values are ranked by the item's
    bytes. Repeated rows count each; texts of any length count whole; an empty table gives none; other columns are ignored.
    """
    wide, langs, few = wide_vectors(docs, text_col, lang_col, source_col, least)
    known = langs.where("terms > 0")
    p = F.transform("counts", lambda c, i: _scaled(c, F.get("sizes", i)))
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    scaled = _joined(wide, known, few).select("lang", "term", "counts", p.alias("p"), _scaled(whole, F.col("size")).alias("q"), "sources")

    one = scaled.select("lang", "p", F.posexplode("p").alias("a", "pa"))
    beyond = F.transform(F.slice("p", F.col("a") + 2, F.greatest(F.size("p") - F.col("a") - 1, F.lit(0))), lambda x, i: F.struct((F.col("a") + 1 + i).alias("b"), F.abs(F.col("pa") - x).alias("f")))
    pairs = one.select("lang", "a", F.explode(beyond).alias("e")).groupBy("lang", "a", "e.b").agg(F.sum("e.f").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    apart = _joined(pairs.select("lang", "value", both.alias("o")), known, few).select("lang", F.get("sources", F.col("o.x")).alias("source"), F.get("sources", F.col("o.y")).alias("item"), "value")
    none = langs.where("terms = 0").select("lang", "sources", F.explode("sources").alias("source"))
    none = none.select("lang", "source", F.explode(F.array_remove("sources", F.col("source"))).alias("item"), F.lit(0).cast("long").alias("value"))

    terms = scaled.select("lang", "term", "q", F.explode(F.zip_with(F.arrays_zip("counts", "p"), "sources", lambda x, s: F.struct(s.alias("source"), x["counts"].alias("n"), x["p"].alias("p")))).alias("e"))
    terms = terms.where((F.col("e.n") > 0) & (F.col("e.p") > F.col("q"))).select("lang", "e.source", F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(apart.unionByName(none), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
f AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + {SMOOTH})) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + {SMOOTH} * v) AS p FROM f JOIN v USING (lang)),
t AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n)::HUGEINT + {SMOOTH})) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + {SMOOTH} * any_value(v)) AS q FROM f JOIN v USING (lang) GROUP BY 1, 2),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s JOIN t USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= {TOP}
"""
