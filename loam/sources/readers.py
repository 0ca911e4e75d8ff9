"""Sources of software-engineering data: text formats parsed into relations.

Line-oriented formats are parsed by column expressions over ``path, text`` tables (``spark.read.text(wholetext=True)`` or any
other source of them); index documents come as nested columns.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = "path string, language string, occurrences array<struct<range:array<int>,symbol:string,roles:int,enclosing:array<int>>>, symbols array<struct<symbol:string,name:string,kind:int,docs:array<string>,relationships:array<struct<symbol:string,reference:boolean,implementation:boolean>>>>"
TELEMETRY_SCHEMA = "calls array<struct<service_name:string,service_version:string,function_name:string,namespace:string,file_path:string,line_number:int,call_count:bigint,error_count:bigint>>"


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, hash`` of files, for change detection."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def index_documents(spark: SparkSession, path: str) -> DataFrame:
    """Symbol-index documents as JSON lines; Parquet with the same columns needs no parsing."""
    return spark.read.schema(INDEX_SCHEMA).json(path)


def hashed_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``path, bytes, hash`` of texts that are rows of a table, as :func:`hashed_files` has them of files."""
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(key).alias("path"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("hash"))


def changed_files(seen: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change`` between two listings with ``path, hash``: created, removed or changed; what is equal is left out."""
    a, b = seen.select("path", F.col("hash").alias("was")), now.select("path", F.col("hash").alias("is"))
    say = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full").select("path", say.alias("change")).where("change is not null")


def occurrences(documents: DataFrame) -> DataFrame:
    """``path, symbol, roles, line, start_col, end_line, end_col``; ranges of three numbers stay on one line."""
    o = documents.select("path", F.explode("occurrences").alias("o")).select("path", "o.symbol", "o.roles", F.col("o.range").alias("r"))
    long = F.size("r") == 4
    at = lambda i: F.get("r", F.lit(i))
    return o.select("path", "symbol", "roles", at(0).alias("line"), at(1).alias("start_col"), F.when(long, at(2)).otherwise(at(0)).alias("end_line"), F.when(long, at(3)).otherwise(at(2)).alias("end_col"))


def references(occurrences_: DataFrame, symbol: str, definitions: bool = True, limit: int | None = None) -> DataFrame:
    """Occurrences of one symbol by place, without definitions if asked."""
    kept = occurrences_.where(F.col("symbol") == symbol)
    kept = kept if definitions else kept.where(F.col("roles").bitwiseAND(1) == 0)
    kept = kept.dropDuplicates(["path", "line", "start_col"]).orderBy("path", "line", "start_col")
    return kept.limit(limit) if limit else kept


def relationships(documents: DataFrame) -> DataFrame:
    """``symbol, related, reference, implementation``."""
    s = documents.select(F.explode("symbols").alias("s")).select("s.symbol", F.explode("s.relationships").alias("r"))
    return s.select("symbol", F.col("r.symbol").alias("related"), "r.reference", "r.implementation")


def document_hash(documents: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over path, occurrences and symbols in document order."""
    occ = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(",", o["symbol"], F.array_join(F.transform(o["range"], lambda x: x.cast("string")), ":"), o["roles"].cast("string"))), ";")
    sym = F.array_join(F.transform("symbols", lambda s: s["symbol"]), ";")
    return documents.select("path", F.substring(F.sha2(F.concat_ws("|", "path", occ, sym), 256), 1, 16).alias("hash"))


def commit_log(lines: DataFrame) -> DataFrame:
    """``hash, author, ts, message`` from ``%H|%an|%at|%s`` lines (column ``value``); other lines are dropped."""
    f = lambda i: F.regexp_extract("value", r"^([0-9a-f]{7,40})\|([^|]*)\|(\d+)\|(.*)$", i)
    return lines.where(F.col("value").rlike(r"^[0-9a-f]{7,40}\|[^|]*\|\d+\|")).select(f(1).alias("hash"), f(2).alias("author"), F.timestamp_seconds(f(3).cast("long")).alias("ts"), f(4).alias("message"))


def numstat(lines: DataFrame) -> DataFrame:
    """``path, old_path, additions, deletions, binary`` from numstat lines; ``{a => b}`` renames are expanded."""
    f = lambda i: F.regexp_extract("value", r"^(\d+|-)\t(\d+|-)\t(.+)$", i)
    r = lines.where(F.col("value").rlike(r"^(\d+|-)\t(\d+|-)\t")).select(f(1).alias("a"), f(2).alias("d"), f(3).alias("p"))
    side = lambda n: F.regexp_replace(F.when(F.col("p").contains("{"), F.regexp_replace("p", r"\{(.*) => (.*)\}", f"${n}")).otherwise(F.regexp_replace("p", r"^(.*) => (.*)$", f"${n}")), "//", "/")
    renamed = F.col("p").contains(" => ")
    return r.select(F.when(renamed, side(2)).otherwise(F.col("p")).alias("path"), F.when(renamed, side(1)).alias("old_path"), F.coalesce(F.expr("try_cast(a as long)"), F.lit(0)).alias("additions"), F.coalesce(F.expr("try_cast(d as long)"), F.lit(0)).alias("deletions"), (F.col("a") == "-").alias("binary"))


def adr(files: DataFrame) -> DataFrame:
    """Decision records from Markdown: ``path, id, title, status, date, context, decision, consequences, affected_modules``."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    section = lambda name: strip(F.regexp_extract("text", rf"(?ims)^##\s*{name}\s*\n(.*?)(?=^##\s|\z)", 1))
    bullets = lambda body: F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1))
    number = F.regexp_extract("text", r"(?im)^#\s*(?:ADR[- ]?)?(\d+)", 1)
    field = lambda name: F.trim(F.regexp_extract("text", rf"(?im)^\W*{name}\W*:\W*(.+?)\W*$", 1))
    status = F.lower(F.when(section("Status") != "", section("Status")).otherwise(field("Status")))
    day = F.coalesce(*[F.try_to_timestamp(field("Date"), F.lit(p)) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "MMMM d, yyyy")]).cast("date")
    return files.select("path", F.concat(F.lit("ADR-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))).alias("id"), F.trim(F.regexp_extract("text", r"(?im)^#\s*(?:ADR[- ]?)?\d+[:.\s-]*(.+?)\s*$", 1)).alias("title"), status.alias("status"), day.alias("date"), section("Context").alias("context"), section("Decision").alias("decision"), bullets(section("Consequences")).alias("consequences"), bullets(section("Affected Modules")).alias("affected_modules"))


def render_adr(records: DataFrame) -> DataFrame:
    """``id, text``: decision records as Markdown, in the form that :func:`adr` reads."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    head = F.concat(F.lit("# "), "id", F.lit(": "), "title", F.lit("\n\n**Status:** "), "status", F.lit("\n**Date:** "), F.date_format("date", "yyyy-MM-dd"))
    body = [F.concat(F.lit(f"\n\n## {name}\n"), c) for name, c in (("Context", F.col("context")), ("Decision", F.col("decision")), ("Consequences", bullets(F.col("consequences"))), ("Affected Modules", bullets(F.col("affected_modules"))))]
    return records.select("id", F.concat(head, *body, F.lit("\n")).alias("text"))


def next_adr(records: DataFrame) -> DataFrame:
    """The next record number."""
    return records.agg((F.coalesce(F.max(F.regexp_extract("id", r"(\d+)", 1).cast("int")), F.lit(0)) + 1).alias("next"))


#: Import statements by language: the first group is the module.
IMPORTS = {"go": r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$', "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "javascript": r"""(?m)(?:from\s+|require\(\s*|import\s+)['"]([^'"\n]+)['"]""", "rust": r"(?m)^\s*use\s+([\w:]+)", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"}
IMPORTS["typescript"] = IMPORTS["javascript"]
IMPORTS["kotlin"] = r"(?m)^\s*import\s+([\w.]+)"


def imports(files: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """``path, module`` of import statements in ``path, language, text``; patterns may be added or replaced by language."""
    found = F.array().cast("array<string>")
    for name, regex in ({**IMPORTS, **(patterns or {})}).items():
        got = F.regexp_extract_all("text", F.lit(regex), F.lit(1))
        if name == "python":
            got = F.filter(F.concat(got, F.regexp_extract_all("text", F.lit(regex), F.lit(2))), lambda x: x != "")
        found = F.when(F.col("language") == name, got).otherwise(found)
    return files.where(~F.col("text").contains("\0")).select("path", F.explode(F.array_distinct(found)).alias("module"))


def proto_contract(files: DataFrame) -> DataFrame:
    """``path, package, services, messages, imports`` of protocol definitions."""
    every = lambda r: F.regexp_extract_all("text", F.lit(r), F.lit(1))
    return files.select("path", F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), every(r"(?m)^\s*service\s+(\w+)").alias("services"), every(r"(?m)^\s*message\s+(\w+)").alias("messages"), every(r'(?m)^\s*import\s+(?:public\s+)?"([^"]+)"').alias("imports"))


def openapi_contract(files: DataFrame) -> DataFrame:
    """``path, version, paths`` of API descriptions in JSON, or in YAML with one key a line; other texts have nulls.

    Of YAML, the version is a top-level key, and the paths are the keys that start with a slash one level below ``paths:``.
    """
    version = F.coalesce(F.get_json_object("text", "$.openapi"), F.get_json_object("text", "$.swagger"))
    yaml = F.regexp_extract("text", r"""(?m)^(?:openapi|swagger):\s*["']?([\w.]+)["']?\s*$""", 1)
    block = F.regexp_extract("text", r"(?ms)^paths:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z)|\n)*)", 1)
    lead = r"""^([ \t]+)["']?/"""
    indent = F.regexp_extract(block, lead, 1)
    keys = F.filter(F.transform(F.split(block, "\n"), lambda x: F.when(F.regexp_extract(x, lead, 1) == indent, F.regexp_extract(x, r"""^[ \t]+["']?(/[^:\s"']*)["']?:""", 1))), lambda x: x.isNotNull() & (x != ""))
    paths = F.json_object_keys(F.get_json_object("text", "$.paths"))
    return files.select("path", F.coalesce(version, F.when(yaml != "", yaml)).alias("version"), F.when(version.isNotNull(), paths).when(yaml != "", keys).alias("paths"))


def telemetry(bodies: DataFrame) -> DataFrame:
    """Call aggregates from JSON bodies (column ``body``); a missing file falls back to the namespace."""
    rows = bodies.select(F.explode(F.from_json("body", TELEMETRY_SCHEMA)["calls"]).alias("c")).select("c.*")
    return rows.withColumn("origin", F.coalesce("file_path", "namespace")).withColumn("call_count", F.coalesce("call_count", F.lit(0))).withColumn("error_count", F.coalesce("error_count", F.lit(0)))


def otlp(bodies: DataFrame, keys: tuple[str, ...] = ("code.function", "rpc.method", "http.route")) -> DataFrame:
    """``service, function, calls`` from metric points: the first attribute key that is there and not empty names the function."""
    point = "struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>,asInt:string>"
    shape = f"resourceMetrics array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeMetrics:array<struct<metrics:array<struct<name:string,sum:struct<dataPoints:array<{point}>>>>>>>>"
    value = lambda attrs, key: F.get(F.filter(attrs, lambda a: (a["key"] == key) & (a["value"]["stringValue"] != "")), F.lit(0))["value"]["stringValue"]
    r = bodies.select(F.explode(F.from_json("body", shape)["resourceMetrics"]).alias("r"))
    r = r.select(value(F.col("r.resource.attributes"), "service.name").alias("service"), F.explode("r.scopeMetrics").alias("s")).select("service", F.explode("s.metrics").alias("m")).select("service", F.explode("m.sum.dataPoints").alias("p"))
    return r.groupBy("service", F.coalesce(*[value(F.col("p.attributes"), k) for k in keys]).alias("function")).agg(F.sum(F.col("p.asInt").cast("long")).alias("calls"))


MODULE_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("root", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def declared_modules(spark: SparkSession, toml: str) -> DataFrame:
    """Modules declared in a TOML text: tables under ``module``; a reviewed file of bounded size."""
    rows = [(m.get("name"), m.get("root", m.get("path")), m.get("owner"), list(m.get("tags", []))) for m in tomllib.loads(toml).get("module", [])]
    return spark.createDataFrame(rows, MODULE_SCHEMA)


#: Definitions and decision words by language, for sources without an index. An approximation: no syntax tree is built.
DEFINITIONS = {"go": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", "javascript": r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "java": r"(?m)^\s*(?:public|private|protected)[\w\s<>\[\]]*\s(\w+)\s*\([^;]*\{"}
DECISIONS = r"\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\||\band\b|\bor\b|\?"


def source_symbols(files: DataFrame) -> DataFrame:
    """``path, line, name``: function definitions by line; the language picks the pattern."""
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    name = F.lit("")
    for language, regex in DEFINITIONS.items():
        name = F.when(F.col("language") == language, F.regexp_extract("body", regex, 1)).otherwise(name)
    return lines.withColumn("name", name).where("name <> ''").select("path", (F.col("i") + 1).alias("line"), "name")


def complexity(files: DataFrame) -> DataFrame:
    """``path, cyclomatic``: one plus the decision words of the text."""
    return files.select("path", (F.regexp_count("text", F.lit(DECISIONS)) + 1).alias("cyclomatic"))


def context(files: DataFrame, places: DataFrame, around: int = 2) -> DataFrame:
    """``path, line, context``: the lines around a place."""
    cut = F.slice(F.split("text", "\n"), F.greatest(F.col("line") - around, F.lit(1)), F.lit(2 * around + 1) - F.greatest(F.lit(1 + around) - F.col("line"), F.lit(0)))
    return places.join(files.select("path", "text"), "path").select("path", "line", F.array_join(cut, "\n").alias("context"))


#: An entry of annotated text: commit, its line then and now, lines of facts, and the line itself behind a tab.
_ENTRY = r"(?m)^[0-9a-fA-F]{40} \d+ \d+(?: \d+)?\n(?:[^\t\n][^\n]*\n|\n)*+\t[^\n]*$"


def blame(files: DataFrame) -> DataFrame:
    """``path, line, commit, author, email, ts, text`` of annotated files (porcelain form) ``path, text``.

    A commit's author, address and time stand at its first entry only, later entries are short headers: they get them from the
    file's record of the commit. Facts that are nowhere in the file are null. What is no entry is passed over; a line's own
    text begins behind its tab and is never taken for a header.
    """
    e = files.select("path", F.explode(F.regexp_extract_all(F.regexp_replace(F.col("text"), "\r\n", "\n"), F.lit(_ENTRY), F.lit(0))).alias("e"))
    e = e.select("path", F.substring_index("e", "\n\t", 1).alias("head"), F.regexp_extract("e", r"\n\t([^\n]*)$", 1).alias("text"))
    fact = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name} (.*)$", 1), F.lit(""))
    e = e.select("path", F.split("head", "[ \n]").alias("h"), fact("author").alias("author"), F.regexp_replace(fact("author-mail"), "^<|>$", "").alias("email"), fact("author-time").cast("long").alias("at"), "text")
    e = e.select("path", F.get("h", 2).cast("long").alias("line"), F.get("h", 0).alias("commit"), "author", "email", "at", "text")
    # One row a file and commit.
    known = e.groupBy("path", "commit").agg(*[F.max(c).alias(f"of_{c}") for c in ("author", "email", "at")])
    out = e.join(known, ["path", "commit"])
    return out.select("path", "line", "commit", F.col("of_author").alias("author"), F.col("of_email").alias("email"), F.timestamp_seconds("of_at").alias("ts"), "text")
