"""Stable identities: parsing, fingerprints, aliases and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_symbol(sid: Column) -> dict[str, Column]:
    """Fields of ``scheme manager package version descriptor`` and the descriptor's kind by its ending."""
    part = lambda i: F.get(F.split(sid, " "), F.lit(i))
    last = F.element_at(F.split(sid, " "), -1)
    kind = F.when(last.endswith("()."), "method").when(last.endswith("#"), "type").when(last.endswith("/"), "namespace").when(last.endswith("."), "term").otherwise("unknown")
    name = F.regexp_extract(last, r"([A-Za-z0-9_]+)(?:\(\)\.|[#./])?$", 1)
    return {"scheme": part(0), "manager": part(1), "package": part(2), "version": part(3), "kind": kind, "name": name}


def roles(bits: Column) -> Column:
    """The first role whose bit is set: definition 1, import 2... in the order the format gives them priority."""
    hit = lambda b: bits.bitwiseAND(b) > 0
    return F.when(hit(1), "definition").when(hit(64), "implementation").when(hit(4), "write").when(hit(8), "read").when(hit(2), "import").otherwise("reference")


def fingerprint(**fields: Column) -> Column:
    """SHA-256 over ``name:value`` parts, sorted and joined by bars, without white space."""
    parts = [F.concat(F.lit(f"{k}:"), F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), r"\s+", "")) for k, v in fields.items()]
    return F.sha2(F.array_join(F.array_sort(F.array(*parts)), "|"), 256)


def arity(signature: Column) -> Column:
    """Commas between the first ``(`` and the last ``)`` plus one; 0 for empty parentheses or none."""
    inner = F.trim(F.regexp_extract(signature, r"\((.*)\)", 1))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ","))).cast("int")


def resolve_aliases(ids: DataFrame, aliases: DataFrame, depth: int = 3) -> DataFrame:
    """``id, target, hops, cycle``: the end of each id's alias chain (``old, new``), followed at most ``depth`` times."""
    out = ids.select("id", F.col("id").alias("target"), F.lit(0).alias("hops"), F.lit(False).alias("cycle"))
    for _ in range(depth):
        step = out.join(aliases, F.col("target") == F.col("old"), "left")
        move = F.col("new").isNotNull() & ~F.col("cycle")
        out = step.select("id", F.when(move, F.col("new")).otherwise(F.col("target")).alias("target"), (F.col("hops") + move.cast("int")).alias("hops"), (F.col("cycle") | (move & (F.col("new") == F.col("id")))).alias("cycle"))
    return out


#: What two symbols have in common, by how much of the confidence it earns: an equal name or one that is equal in lower case
#: without underscores, an equal container or one below the same root, an equal path or one in the same directory.
KIND, NAME, LIKE_NAME, CONTAINER, ROOT, PATH, FOLDER = 0.3, 0.4, 0.2, 0.2, 0.1, 0.1, 0.05
_EARNS = {"kind": KIND, "name": NAME, "like_name": LIKE_NAME, "container": CONTAINER, "root": ROOT, "path": PATH, "folder": FOLDER}


def _shared_sets(least: float) -> list[tuple[str, ...]]:
    """The sets of shared fields that reach ``least``."""
    found = []
    for kind in ((), ("kind",)):
        for name in ((), ("like_name",), ("name",)):
            for container in ((), ("root",), ("container",)):
                for path in ((), ("folder",), ("path",)):
                    fields = (*kind, *name, *container, *path)
                    if round(sum(_EARNS[f] for f in fields), 6) >= least:
                        found.append(fields)
    return found


def _traits(df: DataFrame) -> DataFrame:
    """The fields that symbols are compared by. Missing ones are empty, but for paths; an empty container has no root, a missing path no folder."""
    filled = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("kind", "name", "container")})
    return filled.withColumns(
        {
            "like_name": F.lower(F.replace("name", F.lit("_"))),
            "root": F.when(F.col("container") != "", F.substring_index("container", ".", 1)),
            "folder": F.regexp_replace("path", "[^/]*$", ""),
        }
    )


def reconcile(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """What became of symbols that vanished: ``old_id, new_id, confidence, reason``.

    ``old`` and ``new`` have ``sid, backend, kind, name, container, path``. An equal backend id is a rename at 0.95; else the
    most similar new symbol of all, from ``least`` up, by smallest id; else a tombstone. The confidence depends on shared
    fields alone, so of the new symbols that share a set of fields the first stands for all, and every set that reaches
    ``least`` is one equi-join of distinct old values with single rows: no product of two groups is made.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    gone = _traits(old.join(new.select("sid"), "sid", "left_anti"))
    came = _traits(new.join(old.select("sid"), "sid", "left_anti"))
    sets = _shared_sets(least)
    traits = list(_EARNS)

    def keys(df: DataFrame, cols: list) -> DataFrame:
        """A row for each set whose fields are all there: its number and its values."""
        every = F.array(*[F.struct(F.lit(i).alias("level"), F.array(*[F.col(f) for f in fields]).alias("values")) for i, fields in enumerate(sets)])
        return df.select(*cols, F.explode(F.filter(every, lambda x: F.forall(x["values"], lambda v: v.isNotNull()))).alias("k")).select(*cols, "k.level", "k.values")

    g = gone.select(*[F.col(c).alias(f"o_{c}") for c in ("sid", "backend", *traits)])
    by_backend = g.join(came.groupBy("backend").agg(F.min("sid").alias("new_id")), F.col("o_backend") == F.col("backend"), "left")
    first = keys(came, ["sid", *traits]).groupBy("level", "values").agg(F.min(F.struct("sid", *traits)).alias("c"))
    wanted = keys(gone.select(*traits).distinct(), traits)
    both = wanted.join(first, ["level", "values"])
    part = lambda f, other=None: F.when(F.col(f) == F.col(f"c.{f}"), _EARNS[f]).otherwise(0.0 if other is None else other)
    score = F.round(part("kind") + part("name", part("like_name")) + part("container", part("root")) + part("path", part("folder")), 6)
    best = both.select(*traits, score.alias("score"), F.col("c.sid").alias("like_id")).groupBy(*traits).agg(F.min_by("like_id", F.struct(-F.col("score"), "like_id")).alias("like_id"), F.max("score").alias("score"))
    best = best.select(*[F.col(f).alias(f"b_{f}") for f in traits], "like_id", "score")
    same = F.lit(True)
    for f in traits:
        same = same & F.col(f"o_{f}").eqNullSafe(F.col(f"b_{f}"))
    out = by_backend.join(best, same, "left")
    renamed = F.col("new_id").isNotNull()
    return out.select(
        F.col("o_sid").alias("old_id"),
        F.coalesce("new_id", "like_id").alias("new_id"),
        F.when(renamed, 0.95).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"),
        F.when(renamed, "renamed").when(F.col("like_id").isNotNull(), "similar").otherwise("deleted").alias("reason"),
    )


def merge_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of sources, earlier ones preferred field by field: the first non-null value of each column, with the number of
    sources that disagree with it."""
    cols = [c for c in parts[0].columns if c != key]
    union = parts[0].withColumn("__p", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        union = union.unionByName(p.withColumn("__p", F.lit(i)))
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__p"))).alias(c) for c in cols]
    differ = sum((F.greatest(F.countDistinct(c) - 1, F.lit(0)) for c in cols), F.lit(0))
    return union.groupBy(key).agg(*pick, F.count(F.lit(1)).alias("sources"), differ.cast("long").alias("conflicts"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (nulls first): a minimum, which combines before the shuffle, so a key of any size costs a row a task."""
    rest = [c for c in df.columns if c not in key]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(least.alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def keep_last_in_place(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The last value of each key, at the place of its first."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias(seq))
