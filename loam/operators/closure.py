"""What every seed reaches, kept up to date while edges come and go.

The closure is a table ``origin, id`` with a row ``origin, origin`` for each seed. Edges that go may leave other ways to the same
vertex, so their consequences are first deleted and then derived anew from what is left (delete and re-derive); edges that
come are followed from the pairs that they start at. Every step follows the last step's pairs only (semi-naive), and asks for
the edges of their vertices by name while they are few, so that files of sorted edges without them are skipped.

Where many vertices lead to each other, pairs grow with the square of them. :func:`condensed` then keeps the closure by pieces of
such vertices: its work grows with the edges, and only :func:`pairs` makes a row for each seed and vertex.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.shared import cut

#: Edges of so few vertices are asked for by name; pairs up to so many are broadcast.
LISTED, BROADCAST = 500, 200_000


def _beside(edges: DataFrame, pairs: DataFrame, at: str, to: str) -> DataFrame:
    """``origin, id`` of the other ends of edges whose ``at`` end is a pair's vertex. ``pairs`` is a written table."""
    if pairs.count() <= BROADCAST:
        ids = [r["id"] for r in pairs.select("id").distinct().limit(LISTED + 1).collect()]
        near = edges.where(F.col(at).isin(ids)) if len(ids) <= LISTED else edges
        return near.join(F.broadcast(pairs), F.col(at) == F.col("id")).select("origin", F.col(to).alias("id")).distinct()
    return edges.join(pairs, F.col(at) == F.col("id")).select("origin", F.col(to).alias("id")).distinct()


def _grown(edges: DataFrame, front: DataFrame, within: DataFrame | None, known: DataFrame) -> DataFrame:
    """``front`` and all that follows from it along ``edges``, inside ``within`` if that is given, without what is ``known``. ``front`` holds nothing known."""
    found = front
    while not front.isEmpty():
        step = _beside(edges, front, "src", "dst").join(known, ["origin", "id"], "left_anti").join(found, ["origin", "id"], "left_anti")
        front = cut(step if within is None else step.join(within, ["origin", "id"], "left_semi"))
        found = cut(found.unionByName(front))
    return found


def built(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The closure from nothing: edges ``src, dst``, seeds ``id``. Edges may repeat and form cycles."""
    first = cut(seeds.select(F.col("id").alias("origin"), "id").distinct())
    return _grown(edges.select("src", "dst"), first, None, first.limit(0))


def maintained(closure: DataFrame, edges: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """The closure after the edges ``went`` are taken out of ``edges`` and the edges ``came`` are added.

    ``edges`` are those of the closure given. An edge that repeats is one edge; one in both ``came`` and ``went`` is there
    afterwards; taking out an edge that is not there changes nothing.
    """
    old = edges.select("src", "dst")
    went = cut(went.select("src", "dst").distinct().join(came.select("src", "dst"), ["src", "dst"], "left_anti").join(old, ["src", "dst"], "left_semi"))
    came = cut(came.select("src", "dst").distinct().join(old, ["src", "dst"], "left_anti"))
    kept = old.join(F.broadcast(went) if went.count() <= BROADCAST else went, ["src", "dst"], "left_anti")
    after = kept.unionByName(came)
    seeds = F.col("origin") == F.col("id")

    # What may rest on an edge that went.
    starts = cut(closure.join(went, F.col("id") == F.col("src"), "left_semi"))
    first = cut(_beside(went, starts, "src", "dst").where(~seeds))
    shaky = cut(_grown(old, first, closure.where(~seeds), first.limit(0)))
    firm = cut(closure.join(shaky, ["origin", "id"], "left_anti"))

    # What has another way: an edge from a firm pair, and all that follows inside the shaky ones.
    into = shaky.withColumnRenamed("id", "to")
    if shaky.count() <= BROADCAST:
        ways = after.join(F.broadcast(into), F.col("dst") == F.col("to"))
    else:
        ways = after.join(into, F.col("dst") == F.col("to"))
    back = cut(ways.select("origin", F.col("src").alias("id"), "to").join(firm, ["origin", "id"], "left_semi").select("origin", F.col("to").alias("id")).distinct())
    firm = cut(firm.unionByName(_grown(after, back, shaky, firm)))

    # What the edges that came lead to.
    reached = cut(firm.join(came, F.col("id") == F.col("src"), "left_semi"))
    new = cut(_beside(came, reached, "src", "dst").join(firm, ["origin", "id"], "left_anti"))
    return firm.unionByName(_grown(after, new, None, firm))


@dataclass(frozen=True)
class Condensed:
    """A closure by pieces, whose vertices all lead to each other: ``pieces`` has ``id, piece`` of vertices other than the one
    that names their piece, ``seeds`` has ``origin, id`` with a seed's piece, ``closure`` is that of the seeds' pieces."""

    pieces: DataFrame
    seeds: DataFrame
    closure: DataFrame


#: Pieces are looked for again, at most so often, while more than so many edges are left and the last round has taken a tenth away.
ROUNDS, SMALL = 4, 1_000
#: Members of a piece that one task joins, and rows that a task of :func:`pairs` makes, about.
MEMBERS, ROWS = 20_000, 4_000_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _told(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """``id, mark``: each vertex's greatest mark of its own and of those that lead to it. Marks may be null."""
    known = cut(marks.select("id", "mark"))
    front = known.where("mark is not null")
    while n := front.count():
        told = edges.join(F.broadcast(front) if n <= BROADCAST else front, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max("mark").alias("told"))
        grew = F.coalesce(F.col("told") > F.col("mark"), F.col("told").isNotNull())
        known = cut(known.join(told, "id", "left").select("id", F.greatest("mark", "told").alias("mark"), grew.alias("grew")))
        front = known.where("grew").select("id", "mark")
        known = known.select("id", "mark")
    return known


def _named(rows: DataFrame, column: str, pieces: DataFrame) -> DataFrame:
    """``rows`` with the piece in the place of the vertex in ``column``."""
    names = pieces.select(F.col("id").alias("vertex"), "piece")
    return rows.join(names, F.col(column) == F.col("vertex"), "left").withColumn(column, F.coalesce("piece", column)).drop("vertex", "piece")


def _between(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Edges between pieces, each once."""
    few = _few(pieces)
    return cut(_named(_named(edges.select("src", "dst"), "src", few), "dst", few).where("src <> dst").distinct())


def _round(edges: DataFrame) -> DataFrame:
    """``id, piece`` of some vertices that lead to each other: every vertex takes the greatest rank that leads to it, then those
    that lead back to the one of that rank, among equals, are its piece. Ranks begin with the lesser degree, so they mostly lie in
    large pieces; of vertices that share a rank none gets a piece."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    degree = F.shiftleft(F.least("outgoing", "incoming", F.lit(1023)).cast("long"), 53)
    rank = F.when(F.col("outgoing").isNotNull() & F.col("incoming").isNotNull(), degree.bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1))))
    ranks = cut(out.join(into, "id", "full").select("id", rank.alias("mark")))
    colours = cut(_told(edges, ranks).withColumnRenamed("mark", "colour"))
    heads = ranks.join(colours, "id").where("mark = colour").groupBy("mark").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n = 1")
    few = _few(colours)
    of = lambda side: few.select(F.col("id").alias(f"{side}_id"), F.col("colour").alias(f"{side}_colour"))
    back = edges.join(of("src"), F.col("src") == F.col("src_id")).join(of("dst"), F.col("dst") == F.col("dst_id")).where("src_colour = dst_colour")
    back = cut(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    marks = colours.select("id").join(heads.select("head"), F.col("id") == F.col("head"), "left").select("id", F.col("head").alias("mark"))
    return cut(_told(back, marks).where("mark is not null and mark <> id").select("id", F.col("mark").alias("piece")))


def _pieces(edges: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of a graph, some of which are given, and the edges between them. A vertex may be left alone; that costs rows, but is not wrong."""
    left = _between(edges, pieces)
    size = left.count()
    for _ in range(ROUNDS):
        if size <= SMALL:
            break
        more = _round(left)
        if more.isEmpty():
            break
        pieces = cut(_named(pieces.withColumnRenamed("piece", "of"), "of", more).withColumnRenamed("of", "piece").unionByName(more))
        left, before = _between(left, more), size
        size = left.count()
        if size > 0.9 * before:
            break
    return pieces, left


def _by_pieces(edges: DataFrame, seeds: DataFrame, pieces: DataFrame) -> Condensed:
    pieces, left = _pieces(edges, pieces)
    own = cut(_named(seeds.select(F.col("id").alias("origin"), "id").distinct(), "id", pieces))
    return Condensed(pieces, own, built(left, own.select("id")))


def condensed(edges: DataFrame, seeds: DataFrame) -> Condensed:
    """The closure from nothing, by pieces: edges ``src, dst``, seeds ``id``. Edges may repeat and form cycles."""
    none = edges.select(F.col("src").alias("id"), F.col("dst").alias("piece")).limit(0)
    return _by_pieces(edges, seeds, cut(none))


def changed(closure: Condensed, edges: DataFrame, came: DataFrame, went: DataFrame) -> Condensed:
    """As :func:`maintained`, by pieces: those that lose none of their own edges stay whole, the others are looked for among
    the edges left, and what leads from piece to piece is derived anew."""
    old = edges.select("src", "dst")
    went = cut(went.select("src", "dst").distinct().join(came.select("src", "dst"), ["src", "dst"], "left_anti"))
    after = old.join(_few(went), ["src", "dst"], "left_anti").unionByName(came.select("src", "dst"))
    few = _few(closure.pieces)
    broken = cut(_named(_named(went, "src", few), "dst", few).where("src = dst").select(F.col("src").alias("piece")).distinct())
    whole = cut(closure.pieces.join(_few(broken), "piece", "left_anti").select("id", "piece"))
    return _by_pieces(after, closure.seeds.select(F.col("origin").alias("id")), whole)


def pairs(closure: Condensed) -> DataFrame:
    """``origin, id``: a row for each seed and each vertex that it leads to. Members of a piece are dealt to many tasks."""
    led = cut(closure.seeds.withColumnRenamed("id", "start").join(closure.closure.select(F.col("origin").alias("start"), F.col("id").alias("piece")), "start").select("origin", "piece"))
    own = led.select("origin", F.col("piece").alias("id"))
    sizes = closure.pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    made = led.groupBy("piece").agg(F.count(F.lit(1)).alias("led")).join(sizes, "piece").agg(F.sum(F.col("led") * F.col("n"))).first()[0] or 0
    tasks = max(1, made // ROWS)
    if led.count() <= BROADCAST:
        return own.unionByName(closure.pieces.repartition(tasks, "id").join(F.broadcast(led), "piece").select("origin", "id"))
    slices = sizes.select("piece", F.ceil(F.col("n") / MEMBERS).alias("slices"))
    dealt = led.join(slices, "piece").select("origin", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    members = closure.pieces.join(slices, "piece").select("id", "piece", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"))
    return own.unionByName(members.repartition(tasks, "piece", "slice").join(dealt.repartition(tasks, "piece", "slice"), ["piece", "slice"]).select("origin", "id"))
