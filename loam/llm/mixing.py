"""Mixing sources to target weights by a low-discrepancy schedule.

The van der Corput points of ``slots`` slots run through the sources' cumulative weights; since those points are the
grid ``i / slots`` in bit-reversed order, a source owns a contiguous range of the grid and its slots follow by reversing
the bits, without a join. A source's slots, ranked in schedule order, take one equal-token block each from the line of
its shuffled documents, over and over again (at most three times): that gives every piece of a document its slot, so the
order of the mix. Prefix sums run over three levels of buckets, so that no source, however large, meets in one task; rows
that repeat id, source and text are one group with a number of copies, so that no repeated row meets its like in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.shared import cut

from .common import WORD

SLOT_BITS = 18
CHUNK_BITS = 9
BUCKET_ROWS = 128
COARSE = 512
MOST_TIMES = 3
#: Sources up to this number are broadcast: a few hundred bytes each.
BROADCAST_SOURCES = 10_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, rank, weight, source_size, target`` for rows of ``source, size``: shares by weight of all sizes, none above three times the source's size.

    The level all uncapped sources share per unit of weight is where, by rising cap per weight, the first source's cap
    is not below what is left for it. Windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = by.withColumn("rank", F.row_number().over(order))
    w = w.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size").cast("double") * MOST_TIMES).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    w = w.withColumn("below", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("all", F.sum("source_size").over(every)).withColumn("level", (F.col("all") - F.col("below")) / F.col("left"))
    w = w.withColumn("level", F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"], F.lit(float("inf"))))
    return w.select("source", "rank", "weight", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """Slots in training order: ``slot, source_rank, nth, slots`` (``nth`` counts a source's slots from 0).

    A source with a target but too small a share for one of the grid's points gets one slot at the end.
    """
    n = 1 << bits
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = targets.where(F.col("target") >= 0.5).select(F.col("rank").alias("source_rank"), "rank", (F.sum("target").over(up) / F.sum("target").over(every)).alias("hi"), F.col("target"))
    part = part.withColumn("to", F.round(F.col("hi") * n).cast("long"))
    part = part.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("rank")), F.lit(0).cast("long"))).withColumn("slots", F.greatest(F.col("to") - F.col("from"), F.lit(1)))
    grid = part.select("source_rank", "slots", "from", F.explode(F.when(F.col("to") > F.col("from"), F.sequence(F.col("from"), F.col("to") - 1)).otherwise(F.array(F.lit(-1).cast("long")))).alias("i"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("i"), bits, "0")), 2, 10).cast("long")
    slots = grid.select("source_rank", "slots", F.when(F.col("i") < 0, F.lit(n) + F.col("source_rank")).otherwise(reverse).alias("slot"))
    slots = slots.withColumn("chunk", F.shiftright("slot", CHUNK_BITS))
    per = slots.groupBy("source_rank", "chunk").agg(F.count(F.lit(1)).alias("in_chunk"))
    per = per.select("source_rank", "chunk", (F.sum("in_chunk").over(Window.partitionBy("source_rank").orderBy("chunk")) - F.col("in_chunk")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source_rank", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(per, ["source_rank", "chunk"]).select("slot", "source_rank", (F.col("before") + F.col("inside")).alias("nth"), "slots")


def _lines(rows: DataFrame, n_rows: int) -> DataFrame:
    """``start``: words of the source's groups before this one in shuffled order; a group takes ``size * copies`` words."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = rows.withColumn("shuffled", F.xxhash64(F.lit("mix"), "doc_id", "mark")).withColumn("bucket", F.pmod("shuffled", F.lit(buckets)))
    rows = rows.withColumn("wide", F.col("size") * F.col("rows"))
    fine = rows.groupBy("rank", "bucket").agg(F.sum("wide").alias("s")).withColumn("coarse", F.floor(F.col("bucket") / COARSE))
    coarse = fine.groupBy("rank", "coarse").agg(F.sum("s").alias("c"))
    coarse = coarse.select("rank", "coarse", (F.sum("c").over(Window.partitionBy("rank").orderBy("coarse")) - F.col("c")).alias("coarse_start"))
    fine = fine.withColumn("fine_start", F.sum("s").over(Window.partitionBy("rank", "coarse").orderBy("bucket")) - F.col("s"))
    base = fine.join(coarse, ["rank", "coarse"]).select("rank", "bucket", (F.col("coarse_start") + F.col("fine_start")).alias("base"))
    order = Window.partitionBy("rank", "bucket").orderBy("shuffled", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("wide").over(order)).join(base, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("wide"))


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> dict[str, F.Column]:
    """What tells rows apart: id, source, size and a mark of the text."""
    return {"doc_id": docs[id_col].cast("long"), "source": docs[source_col].cast("string"), "size": word_count(docs[text_col]), "mark": F.xxhash64(docs[text_col])}


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the source's line, numbered by ``uid, copy``, and the pieces that the slots take of them."""
    keys = _keys(docs, id_col, source_col, text_col)
    sized = cut(docs.select(*[v.alias(k) for k, v in keys.items()]).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    targets = cut(source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights))
    few = targets.count() <= BROADCAST_SOURCES
    known = targets.withColumnRenamed("source", "s").drop("weight")
    rows = sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = _lines(rows, sized.count()).select("doc_id", "source", "size", "mark", "rows", "rank", "source_size", "target", "start")
    # The numbers are written with the rows, so they stay.
    rows = cut(rows.withColumn("goal", F.round("target").cast("long")).withColumn("uid", F.monotonically_increasing_id()))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))

    slots = cut(schedule(targets, bits))
    small = slots.groupBy(F.col("source_rank").alias("rank")).agg(F.max("slots").alias("n"))
    times = F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))).alias("time")
    passes = rows.where("size > 0 and source_size > 0").select("uid", "copy", "rank", "size", "goal", "start", "source_size", times)
    passes = passes.withColumn("lo", F.col("time") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal"))).where("lo < hi")
    passes = passes.join(F.broadcast(small) if few else small, "rank")
    block = lambda x: F.expr(f"(({x} + 1) * n + goal - 1) div goal - 1")  # noqa: E731  blocks end at floor(nth * goal / n)
    pieces = passes.select("uid", "copy", "rank", "size", "lo", "hi", "goal", "n", F.explode(F.sequence(block("lo"), block("hi - 1"))).alias("nth"))
    pieces = pieces.join(slots.select(F.col("source_rank").alias("rank"), "nth", "slot"), ["rank", "nth"])
    begin, end, middle = F.expr("greatest(lo, nth * goal div n)"), F.expr("least(hi, (nth + 1) * goal div n)"), F.expr("lo + size div 2")
    return rows, pieces.select("uid", "copy", "slot", (end - begin).alias("words"), ((middle >= begin) & (middle < end)).alias("middle"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), bits: int = SLOT_BITS) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies, first_slot, last_slot, pieces``.

    ``taken`` counts the words the mix takes from the document, repeats included: the overlap of its place in its
    source's line with the blocks of the scheduled slots, whose first and last are given (null if none takes any) beside
    the number of pieces. ``copies`` is the number of pieces that hold the document's middle word, for callers that repeat
    whole documents.

    Null texts have size 0 and are never taken; null sources form one source, the last; rows that repeat id, source and
    text stand side by side in the line; texts of any length count whole; an empty table gives none; the names of other
    columns do not matter. Documents are shuffled by a hash of id and text, so reruns agree.
    """
    rows, pieces = _placed(docs, id_col, source_col, text_col, weights, bits)
    found = pieces.groupBy(F.col("uid").alias("u"), F.col("copy").alias("c"))
    found = found.agg(F.sum("words").alias("taken"), F.count_if("middle").alias("copies"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("pieces"))
    out = rows.join(found, (F.col("uid") == F.col("u")) & (F.col("copy") == F.col("c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "size", "source_size", "target", zero("taken"), zero("copies"), "first_slot", "last_slot", zero("pieces"))


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), bits: int = SLOT_BITS) -> DataFrame:
    """``docs`` in the order of the schedule: each row once for every slot that takes its middle word (0 to 3 times), all columns kept.

    Rows that repeat id, source and text each stand as often as they do on average, rounded, at the slots of the first of
    them. Null and empty texts are left out; otherwise as :func:`mix`.
    """
    rows, pieces = _placed(docs, id_col, source_col, text_col, weights, bits)
    hits = pieces.where("middle").groupBy("uid").agg(F.count(F.lit(1)).alias("hits"), F.sort_array(F.collect_set(F.when(F.col("copy") == 0, F.col("slot")))).alias("slots"))
    group = rows.where("copy = 0").join(hits, "uid").withColumn("times", F.round(F.col("hits") / F.col("rows")).cast("int")).where("times > 0")
    last = F.coalesce(F.element_at("slots", -1), F.lit(0).cast("long"))
    at = F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: F.coalesce(F.get("slots", i), last))
    names = ("doc_id", "source", "size", "mark")
    plan = group.select(*[F.col(k).alias(f"__p_{k}") for k in names], F.explode(at).alias("__slot"))
    marked = docs.withColumns({f"__d_{k}": v for k, v in _keys(docs, id_col, source_col, text_col).items()})
    same = F.lit(True)
    for k in names:
        same = same & F.col(f"__d_{k}").eqNullSafe(F.col(f"__p_{k}"))
    return marked.join(plan, same).repartitionByRange("__slot").sortWithinPartitions("__slot").select(*docs.columns)
