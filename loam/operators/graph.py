"""Graphs as edge tables: traversal, paths, ranking and closures.

Loops run on the driver, one join a step, over frontiers that stay distributed. A frontier is used twice by the next step, so
each is written to the shared folder.
"""

from __future__ import annotations

import contextlib
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.shared import cut as _cut
from loam.functions.shared import dealt_to

CUT_EVERY = 5
#: Scores of up to so many vertices and queries (40 bytes each) are broadcast to the edges.
BROADCAST_SCORES = 500_000
#: Edges of so few vertices are asked for by name.
LISTED_SOURCES = 500
#: From so many scores on, edges are dealt out once, so that no step shuffles them.
DEALT_FROM = 10_000


def degrees(edges: DataFrame) -> DataFrame:
    """``id, incoming, outgoing`` of every vertex, by distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    return into.join(out, "id", "full").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """Vertices within ``depth`` steps of ``seeds`` (column ``id``) and their least distance.

    Edges may repeat. They are not shuffled while a step's vertices are few, as those are broadcast.
    """
    e = edges.select("src", "dst")
    if both:
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = _cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        ids = front.select("id")
        near = e.join(F.broadcast(ids) if ids.count() <= BROADCAST_SCORES else ids, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        front = _cut(front)
        seen = seen.unionByName(front)
    return seen


def closure_with_origin(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``origin, id, depth``: what each seed reaches, each vertex at its least depth."""
    e = edges.select("src", "dst").distinct()
    seen = seeds.select(F.col("id").alias("origin"), "id").withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        near = front.join(e, F.col("id") == F.col("src")).select("origin", F.col("dst").alias("id")).distinct()
        front = _cut(near.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``id, path, hops``: one shortest path from any source to each target within ``depth`` (the smallest by vertex ids)."""
    e = edges.select("src", "dst").distinct()
    seen = sources.select("id").distinct().withColumn("path", F.array("id"))
    front = seen
    for _ in range(depth):
        near = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        near = near.groupBy("id").agg(F.min("path").alias("path"))
        front = _cut(near.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(targets.select("id").distinct(), "id").select("id", "path", (F.size("path") - 1).alias("hops"))


def paths_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int, most: int) -> DataFrame:
    """``source, target, path, hops``: for each pair one shortest path within ``depth`` (the smallest by vertex ids), the ``most`` shortest of each target, by path."""
    from pyspark.sql import Window

    e = edges.select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("source"), "id").distinct().withColumn("path", F.array("id"))
    front = seen
    for _ in range(depth):
        near = front.join(e, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        near = near.groupBy("source", "id").agg(F.min("path").alias("path"))
        front = _cut(near.join(seen.select("source", "id"), ["source", "id"], "left_anti"))
        seen = seen.unionByName(front)
    found = seen.join(targets.select("id").distinct(), "id").where(F.col("id") != F.col("source")).withColumn("hops", F.size("path") - 1)
    place = F.row_number().over(Window.partitionBy("id").orderBy("hops", "path"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("source", F.col("id").alias("target"), "path", "hops")


def call_graph(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """``id, role, depth, weight``: callers and callees of ``root`` within ``depth`` steps, each at its least depth.

    The root stands for itself at depth 0; a vertex that is both is returned in both roles. ``weight`` is the sum of the
    edges that lead from the step before (for callers: to it).
    """
    out = []
    for role, e in (("callee", edges.select("src", "dst", "weight")), ("caller", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        seen = edges.sparkSession.createDataFrame([(root, 0)], "id long, depth int")
        front = seen
        for d in range(1, depth + 1):
            near = front.select("id").join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight"))
            front = _cut(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
            out.append(front.select("id", F.lit(role).alias("role"), "depth", "weight"))
            seen = seen.unionByName(front.select("id", "depth"))
    first = edges.sparkSession.createDataFrame([(root, "root", 0)], "id long, role string, depth int").withColumn("weight", F.lit(0).cast(dict(edges.dtypes)["weight"]))
    return reduce(DataFrame.unionByName, out, first)


def pagerank(edges: DataFrame, seeds: DataFrame, steps: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank, ``id, score``, over ``src, dst, weight``: teleport to the seeds that are vertices, weights
    normalised per source, mass of vertices without edges dropped.

    It ends after ``steps`` steps, or at a cut, every ``CUT_EVERY`` steps, where no score has moved by ``tolerance`` in the
    last one. Edges are dealt out by source once; a step shuffles its flows by vertex, which deals them out for the next.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = _cut(edges.join(total, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("total")).alias("p")).repartition("src"))
    vertices = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    valid = seeds.select("id").distinct().join(vertices, "id", "left_semi")
    count = valid.agg(F.count(F.lit(1)).alias("seeds"))
    home = _cut(valid.crossJoin(F.broadcast(count)).select("id", (1 / F.col("seeds")).alias("home")))  # one row

    def step(rank: DataFrame) -> DataFrame:
        flow = rank.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (damping * F.col("score") * F.col("p")).alias("part"))
        return flow.unionByName(home.select("id", ((1 - damping) * F.col("home")).alias("part"))).groupBy("id").agg(F.sum("part").alias("score"))

    rank = home.select("id", F.col("home").alias("score"))
    for i in range(1, steps + 1):
        if i % CUT_EVERY or i == steps:
            rank = step(rank)
            continue
        before = _cut(rank)
        rank = _cut(step(before))
        moved = rank.join(before.withColumnRenamed("score", "was"), "id", "full").where(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) >= tolerance)
        if moved.isEmpty():
            break
    return rank


def transitions(edges: DataFrame) -> DataFrame:
    """``src, dst, p, own``: edges ``src, dst, weight`` with weights normalised per source, and for every vertex a row of its own.

    To be written before it is pushed along, best in the order of ``src``, as every step reads it again.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = edges.join(total, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("total")).alias("p"))
    vertices = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    return e.withColumn("own", F.lit(False)).unionByName(vertices.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("p"), F.lit(True).alias("own")))


def push(graph: DataFrame, seeds: DataFrame, steps: int = 20, damping: float = 0.85, least: float = 1e-9) -> DataFrame:
    """Personalised PageRank of many seed sets at once, ``query, id, score``: seeds ``query, id`` over a graph of :func:`transitions`.

    Each query's mass starts at those of its seeds that are vertices and is pushed along edges: a vertex keeps ``1 - damping``
    of what it holds and passes the rest on, after ``steps`` steps it keeps all. So only vertices within ``steps`` of the
    seeds are ever touched, and what is passed on in pieces below ``least`` is dropped. With ``least`` 0 the scores are those of
    ``steps`` full steps; otherwise a query's scores are too small by what is dropped, in all ``1 - sum(score)`` at most,
    where vertices without edges, whose mass is dropped too, count in.

    Scores meet the edges by broadcast while they are few: always, if vertices times queries are; otherwise each step's are
    written and counted, and edges are dealt out once by their ends: by ``dst`` for scores that are broadcast, whose sums then need no
    shuffle, by ``src`` for those that are not.
    """
    own = graph.where("own").select(F.col("src").alias("id"))
    valid = seeds.select("query", "id").distinct().join(own, "id", "left_semi")
    state = _cut(valid.join(valid.groupBy("query").agg((1 / F.count(F.lit(1))).alias("held")), "query").select("query", "id", "held", F.lit(0.0).alias("kept")))
    if own.count() * max(1, state.select("query").distinct().count()) > BROADCAST_SCORES:
        return _pushed_far(graph.where("not own").select("src", "dst", "p"), state.select("query", "id", "held"), steps, damping, least)
    with _as_planned(graph.sparkSession):
        for i in range(1, steps + 1):
            met = graph.join(F.broadcast(state), F.col("src") == F.col("id"))
            flow = F.coalesce(F.sum(F.when(~F.col("own"), damping * F.col("held") * F.col("p"))), F.lit(0.0))
            kept = F.coalesce(F.sum(F.when(F.col("own"), F.col("kept") + (1 - damping) * F.col("held"))), F.lit(0.0))
            state = met.groupBy("query", F.col("dst").alias("id")).agg(flow.alias("held"), kept.alias("kept"))
            state = state.withColumn("held", F.when(F.col("held") >= least, F.col("held")).otherwise(0.0)).where("held > 0 or kept > 0")
            if i % (2 * CUT_EVERY) == 0 or i == steps:
                state = _cut(state)
    return state.select("query", "id", (F.col("kept") + F.col("held")).alias("score"))


def _pushed_far(edges: DataFrame, front: DataFrame, steps: int, damping: float, least: float) -> DataFrame:
    """:func:`push` of scores that may be many: what vertices keep of each step is summed at the end, so a step passes on only what moves."""
    spark, dealt, kept = edges.sparkSession, {}, []

    def by(column: str) -> DataFrame:
        if column not in dealt:
            with _as_planned(spark):  # or the partitions would not be known to be dealt by the column
                dealt[column] = edges.repartition(dealt_to(spark), column).persist(StorageLevel.DISK_ONLY)
        return dealt[column]

    try:
        rows = front.count()
        for _ in range(steps):
            if not rows:
                break
            kept.append(front.select("query", "id", ((1 - damping) * F.col("held")).alias("score")))
            if rows <= LISTED_SOURCES:  # files without edges of these vertices are skipped
                near = edges.where(F.col("src").isin([r["id"] for r in front.select("id").distinct().collect()]))
            else:
                near = edges if rows < DEALT_FROM else by("dst" if rows <= BROADCAST_SCORES else "src")
            met = near.join(F.broadcast(front) if rows <= BROADCAST_SCORES else front.hint("shuffle_hash"), F.col("src") == F.col("id"))
            flow = met.select("query", F.col("dst").alias("id"), (damping * F.col("held") * F.col("p")).alias("part"))
            front = _cut(flow.groupBy("query", "id").agg(F.sum("part").alias("held")).where((F.col("held") >= least) & (F.col("held") > 0)))
            rows = front.count()
    finally:
        for d in dealt.values():
            d.unpersist()
    kept.append(front.select("query", "id", F.col("held").alias("score")))
    return _cut(reduce(DataFrame.unionByName, kept).groupBy("query", "id").agg(F.sum("score").alias("score")))


@contextlib.contextmanager
def _as_planned(spark):
    """Without planning anew after every stage, for loops of steps whose sizes are known beforehand."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def strongest_way(edges: DataFrame, targets: DataFrame, seeds: DataFrame, hops: int = 5) -> DataFrame:
    """``target, way``: back from each target by its heaviest incoming edge from a vertex not yet on the way (ties: smallest
    source), until a seed, a vertex without one, or ``hops``. A target that is a seed stays where it is.

    Only the targets' ways go from step to step; the edges into their ends are combined to one row a target before the shuffle.
    """
    stop = seeds.select(F.col("id").alias("seed")).distinct()
    way = targets.select(F.col("id").alias("target"), F.array("id").alias("way")).join(stop, F.col("target") == F.col("seed"), "left")
    way = way.select("target", "way", F.col("seed").isNotNull().alias("done"))
    into = edges.select("src", "dst", "weight")
    for _ in range(hops):
        ends = way.where("not done").withColumn("at", F.element_at("way", -1))
        near = ends.join(into, F.col("at") == F.col("dst")).where(~F.array_contains("way", F.col("src")))
        best = near.groupBy("target").agg(F.max_by("src", F.struct("weight", -F.col("src"))).alias("prev")).withColumnRenamed("target", "t")
        step = way.join(best, F.col("target") == F.col("t"), "left").join(stop, F.col("prev") == F.col("seed"), "left")
        grown = F.when(F.col("prev").isNull(), F.col("way")).otherwise(F.concat("way", F.array("prev")))
        way = _cut(step.select("target", grown.alias("way"), (F.col("prev").isNull() | F.col("seed").isNotNull()).alias("done")))
    return way.select("target", "way")


def module_clique(symbols: DataFrame, most: int = 50, weight: float = 0.3) -> DataFrame:
    """Edges both ways between symbols of a module, for modules of at most ``most`` symbols."""
    small = symbols.groupBy("module").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= most)
    kept = symbols.join(small, "module", "left_semi").select("module", "symbol_id")
    return kept.join(kept.withColumnRenamed("symbol_id", "other"), "module").where("symbol_id <> other").select(F.col("symbol_id").alias("src"), F.col("other").alias("dst"), F.lit(weight).alias("weight"))


def stats(edges: DataFrame) -> DataFrame:
    """Vertices, edges and mean out-degree, 0 without vertices."""
    v = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    return v.crossJoin(F.broadcast(e)).select("nodes", "edges", F.round(F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes").cast("double")), F.lit(0.0)), 6).alias("mean_out"))  # one row each
