"""Service state as tables: schedules, queues, index state, caches with a time to live, health and answers' envelopes.

Times are columns (``now``), never the clock, so that every result can be made again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that an error is remembered, by kind, those that call for a warm-up, and seconds for other kinds.
ERROR_SECONDS = {"symbol-not-found": 60, "backend-unavailable": 15, "workspace-not-ready": 10, "timeout": 5, "index-not-found": 60, "parse-error": 60}
WARMING = ("workspace-not-ready",)
OTHER_SECONDS = 60
#: Share of changed files, in percent, above which an index is built anew.
FULL_ABOVE = 50

_INTERVAL = r"^every\s+(\d+)\s*(s|m|h|d|seconds?|minutes?|hours?|days?)$"
_DAILY = r"^daily\s+at\s+(\d{1,2}):(\d{2})$"
_CRON = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)$"
_CRON_PART = r"^(?:\*(?:/[1-9]\d*)?|\d+|\d+-\d+(?:/[1-9]\d*)?)$"


def _cron_field(text: Column, low: int, high: int) -> Column:
    """Values that a schedule field allows, sorted; null if it is not one."""
    def values(x: Column) -> Column:
        first = F.when(x.startswith("*"), F.lit(low)).otherwise(F.try_to_number(F.regexp_extract(x, r"^(\d+)", 1), F.lit("99999")).cast("int"))
        last = F.when(x.startswith("*"), F.lit(high)).when(x.contains("-"), F.try_to_number(F.regexp_extract(x, r"-(\d+)", 1), F.lit("99999")).cast("int")).otherwise(first)
        step = F.when(x.contains("/"), F.try_to_number(F.regexp_extract(x, r"/(\d+)", 1), F.lit("99999")).cast("int")).otherwise(F.lit(1))
        good = x.rlike(_CRON_PART) & (first >= low) & (last <= high) & (first <= last)
        return F.when(good, F.sequence(first, F.greatest(first, last), F.greatest(step, F.lit(1))))

    parts = F.transform(F.split(text, ","), values)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_sort(F.array_distinct(F.flatten(parts))))


def _parsed(expressions: DataFrame) -> DataFrame:
    """Schedules ``expression`` taken apart, a row each: ``seconds`` of an interval, ``daily`` minute of the day, or what cron fields
    allow: ``times`` (minutes of the day), ``days``, ``months`` and ``weekdays``. All null: no schedule."""
    text = F.lower(F.trim("expression"))
    of = lambda pattern, i: F.regexp_extract(text, pattern, i)
    unit = F.substring(of(_INTERVAL, 2), 1, 1)
    wide = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    seconds = F.try_to_number(of(_INTERVAL, 1), F.lit("999999999")).cast("long") * wide
    hour, minute = (F.try_to_number(of(_DAILY, i), F.lit("99")).cast("int") for i in (1, 2))
    names = ("minutes", "hours", "days", "months", "weekdays")
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
    out = expressions.select(
        "expression",
        F.when(text.rlike(_INTERVAL) & (seconds >= 60), seconds).alias("seconds"),
        F.when(text.rlike(_DAILY) & (hour <= 23) & (minute <= 59), hour * 60 + minute).alias("daily"),
        *[F.when(text.rlike(_CRON) & ~text.rlike(_INTERVAL) & ~text.rlike(_DAILY), _cron_field(of(_CRON, i + 1), *b)).alias(n) for i, (n, b) in enumerate(zip(names, bounds, strict=True))],
    )
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    times = F.array_sort(F.flatten(F.transform("hours", lambda h: F.transform("minutes", lambda m: h * 60 + m))))
    return out.select("expression", "seconds", "daily", F.when(whole, times).alias("times"), "days", "months", "weekdays")


def next_run(schedules: DataFrame, after: str, name: str = "next") -> DataFrame:
    """``schedules`` with the time that each ``expression`` runs next after the column ``after``.

    ``every <n> <unit>`` (a minute at least), ``daily at HH:MM``, or five cron fields, where a day fits by its number or its
    weekday; without a fit within a year, an hour on. Null if the expression is none of these. Each distinct expression is
    taken apart once.
    """
    known = _parsed(schedules.select("expression").distinct()).withColumnRenamed("expression", "__expression")
    rows = schedules.join(known, F.col("expression") == F.col("__expression"), "left")
    t = F.col(after)
    plus = lambda t, s: F.timestamp_micros(F.unix_micros(t) + s.cast("long") * 1_000_000)
    at = lambda d, m: plus(d.cast("timestamp"), m * 60)
    day, now = t.cast("date"), F.hour(t) * 60 + F.minute(t)
    fits = lambda d: F.array_contains("months", F.month(d)) & (F.array_contains("days", F.day(d)) | F.array_contains("weekdays", F.dayofweek(d) - 1))
    # Most schedules run again within some days, so the rest of the year is looked through only for the others.
    first = lambda a, b: F.get(F.filter(F.sequence(F.date_add(day, a), F.date_add(day, b)), fits), F.lit(0))
    left = F.get(F.filter("times", lambda m: m > now), F.lit(0))
    rows = rows.withColumn("__left", F.when(F.col("times").isNotNull() & fits(day), left))
    later = F.coalesce(first(1, 7), first(8, 62), first(63, 366))
    rows = rows.withColumn("__day", F.when(F.col("times").isNotNull() & F.col("__left").isNull(), later))
    found = F.when(F.col("__left").isNotNull(), at(day, F.col("__left"))).otherwise(at(F.col("__day"), F.get("times", F.lit(0))))
    cron = F.when(found < F.add_months(day, 12).cast("timestamp"), found).otherwise(plus(t, F.lit(3600)))
    daily = F.when(F.col("daily") > now, at(day, F.col("daily"))).otherwise(at(F.date_add(day, 1), F.col("daily")))
    out = F.when(F.col("seconds").isNotNull(), plus(t, F.col("seconds"))).when(F.col("daily").isNotNull(), daily).when(F.col("times").isNotNull(), cron)
    return rows.select(*schedules.columns, out.alias(name))


def pending(jobs: DataFrame, limit: int) -> DataFrame:
    """The oldest queued jobs (``id, status, created``) with their place, ties by id."""
    first = jobs.where("status = 'queued'").orderBy("created", "id").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("created", "id")))  # at most ``limit`` rows


def refresh_decision(changed: DataFrame, files: DataFrame, full_above: int = FULL_ABOVE) -> DataFrame:
    """``changed, total, percent, decision``: unchanged, incremental, or full where more than ``full_above`` percent of the files changed."""
    one = changed.agg(F.count(F.lit(1)).alias("changed")).crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("total"))))  # one row each
    percent = F.when(F.col("total") > 0, F.call_function("div", F.col("changed") * 100, F.col("total"))).otherwise(F.lit(0).cast("long"))
    say = F.when(F.col("changed") == 0, "unchanged").when(F.col("percent") > full_above, "full").otherwise("incremental")
    return one.withColumn("percent", percent).withColumn("decision", say)


def index_state(meta: DataFrame, rescans: DataFrame) -> DataFrame:
    """One row a repository from its ``repo, key, value`` marks: ``state, last_full, last_incremental, files_since_full, pending``.

    Pending rescans outrank all; uncommitted changes mark a partial or full index as dirty.
    """
    mark = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    by = meta.groupBy("repo").agg(mark("state").alias("state"), mark("last_full").cast("long").alias("last_full"), mark("last_incremental").cast("long").alias("last_incremental"), mark("files_since_full").cast("long").alias("files_since_full"), mark("dirty").alias("dirty"))
    wait = rescans.groupBy(F.col("repo").alias("r")).agg(F.count(F.lit(1)).alias("pending"))
    out = by.join(wait, F.col("repo") == F.col("r"), "left").withColumn("pending", F.coalesce("pending", F.lit(0).cast("long")))
    base = F.coalesce("state", F.lit("unknown"))
    dirty = (F.col("dirty") == "true") & base.isin("partial", "full")
    said = F.when(F.col("pending") > 0, "pending").when(dirty, F.concat(base, F.lit("_dirty"))).otherwise(base)
    return out.select("repo", said.alias("state"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("last_full", "last_incremental", "files_since_full")], "pending")


def state_id(head: Column, staged: Column, working: Column, untracked: Column) -> tuple[Column, Column]:
    """Digest of a working copy's state, and whether it is dirty: the head and the digests of three texts, null as empty."""
    digests = [F.sha2(F.coalesce(c, F.lit("")), 256) for c in (staged, working, untracked)]
    empty = F.sha2(F.lit(""), 256)
    dirty = digests[0] != empty
    for d in digests[1:]:
        dirty = dirty | (d != empty)
    return F.sha2(F.concat_ws(":", head, *digests), 256), dirty


def health(backends: DataFrame) -> DataFrame:
    """One row: backends, available ones, broken ones (available, not healthy) and whether all is well."""
    broken = F.count_if(F.col("available") & ~F.col("healthy"))
    return backends.agg(F.count(F.lit(1)).alias("backends"), F.count_if("available").alias("available"), broken.alias("broken"), (broken == 0).alias("healthy"))


def diagnose(checks: DataFrame) -> DataFrame:
    """``status, n, names`` of checks (``name, status``), the worst first, and the advice to act on each."""
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).otherwise(2)
    by = checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return by.withColumn("rank", rank)


def cache_put(cache: DataFrame, entries: DataFrame, ttl: Column) -> DataFrame:
    """``cache`` with ``entries`` put in: a key's newest entry by ``created`` replaces all others and lives for ``ttl`` seconds. Both have
    ``key, state, value, created``; ``cache`` has ``expires`` too."""
    fresh = entries.withColumn("expires", F.timestamp_micros(F.unix_micros("created") + ttl.cast("long") * 1_000_000))
    every = cache.select("key", "state", "value", "created", "expires").unionByName(fresh.select("key", "state", "value", "created", "expires"))
    return every.groupBy("key").agg(F.max_by(F.struct("state", "value", "created", "expires"), F.struct("created", "state", "value")).alias("e")).select("key", "e.*")


def cache_get(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """``key, state, hit, value`` for wanted keys and states: an entry counts if its state is the wanted one and it has not expired."""
    live = cache.where(F.col("expires") >= now).select(F.col("key").alias("k"), F.col("state").alias("s"), "value")
    out = wanted.join(live, (F.col("key") == F.col("k")) & (F.col("state") == F.col("s")), "left")
    return out.select("key", "state", F.col("k").isNotNull().alias("hit"), "value")


def cache_drop(cache: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """``cache`` without entries of the given states and without expired ones."""
    return cache.where(F.col("expires") >= now).join(states.select("state").distinct(), "state", "left_anti")


def error_seconds(kind: Column) -> Column:
    """How long an error is remembered."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ERROR_SECONDS.items() for x in kv])[kind], F.lit(OTHER_SECONDS))


def coalesced(requests: DataFrame, window: str) -> DataFrame:
    """Requests of one key within a window as one: ``key, start, leader, shared`` (the first request, and how many share its answer)."""
    by = requests.groupBy("key", F.window("ts", window).alias("w"))
    return by.agg(F.min_by("id", F.struct("ts", "id")).alias("leader"), F.count(F.lit(1)).alias("shared")).select("key", F.col("w.start").alias("start"), "leader", "shared")


def shed(requests: DataFrame, window: str, most: int, spared: Column) -> DataFrame:
    """Requests over ``most`` a window, in order of arrival, are turned away, unless ``spared``: ``id, accepted``."""
    w = Window.partitionBy(F.window("ts", window), spared).orderBy("ts", "id")
    return requests.select("id", (spared | (F.row_number().over(w) <= most)).alias("accepted"))


def match_query(text: Column) -> Column:
    """A search text with the signs of the match syntax escaped."""
    doubled = F.regexp_replace(text, '"', '""')
    return F.regexp_replace(doubled, r"([*()])", r"\\$1")


def page_cursor(preset: Column, offset: Column, digest: Column) -> Column:
    """A page's place as URL-safe base64 of JSON without padding."""
    body = F.concat(F.lit('{"v":1,"p":"'), preset, F.lit('","o":'), offset.cast("string"), F.lit(',"h":"'), digest, F.lit('"}'))
    return F.regexp_replace(F.translate(F.base64(F.encode(body, "utf-8")), "+/\r\n", "-_"), "=+$", "")


def read_cursor(cursor: Column, preset: Column, digest: Column) -> Column:
    """The offset of a cursor; 0 without one; null if it is broken, of another version or preset, or of an older list."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), F.ceil(F.length(cursor) / 4).cast("int") * 4, F.lit("="))
    body = F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8")
    part = lambda k: F.get_json_object(body, f"$.{k}")
    good = (part("v") == "1") & (part("p") == preset) & (part("h") == digest) & (part("o").cast("long") >= 0)
    return F.when(F.coalesce(cursor, F.lit("")) == "", F.lit(0).cast("long")).when(good, part("o").cast("long"))


def hmac_sha256(secret: bytes, body: Column) -> Column:
    """HMAC with SHA-256 of a binary column, as bytes: the hash of the key's outer pad and the hash of its inner pad and the body."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(k ^ byte for k in key).hex()))
    return F.unhex(F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), body), 256))), 256))


def _url_base64(body: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(body), "+/\r\n", "-_"), "=+$", "")


def _from_url_base64(text: Column) -> Column:
    return F.try_to_binary(F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))


def signed_cursor(entity: Column, last: Column, secret: bytes) -> Column:
    """A keyset page's end, signed: URL-safe base64 of JSON, a dot, and that of its HMAC. An empty or null key is left out."""
    body = F.encode(F.to_json(F.struct(entity.alias("e"), F.nullif(last, F.lit("")).alias("pk"))), "utf-8")
    return F.concat(_url_base64(body), F.lit("."), _url_base64(hmac_sha256(secret, body)))


def read_signed_cursor(cursor: Column, entity: Column, secret: bytes) -> Column:
    """The last key of a cursor; '' without a cursor, which is the first page; null if it is broken, of another entity, or signed by another secret."""
    parts = F.split(cursor, "\\.", 2)
    body, mark = _from_url_base64(F.get(parts, 0)), _from_url_base64(F.get(parts, 1))
    text = F.decode(body, "utf-8")
    good = (mark == hmac_sha256(secret, body)) & (F.get_json_object(text, "$.e") == entity)
    return F.when(F.coalesce(cursor, F.lit("")) == "", F.lit("")).when(good, F.coalesce(F.get_json_object(text, "$.pk"), F.lit("")))


def envelope(rows: DataFrame, limit: int, behind: Column, tier: Column, warnings: Column) -> DataFrame:
    """One row that wraps an answer: ``shown, total, truncated, behind, tier, warnings``. An index more than five commits behind lowers a high tier."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.max(behind), F.lit(0)).alias("behind"), F.min(tier).alias("t"), F.array_sort(F.collect_set(warnings)).alias("w"))
    lowered = F.when((F.col("behind") > 5) & (F.col("t") == "high"), "medium").otherwise(F.col("t"))
    return one.select(F.least("total", F.lit(limit).cast("long")).alias("shown"), "total", (F.col("total") > limit).alias("truncated"), "behind", lowered.alias("tier"), F.array_join("w", ",").alias("warnings"))
