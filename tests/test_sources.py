"""Text sources and sinks."""

import json
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loam.sources import index_format, readers, source_code, writers


def test_index_documents_and_references(spark, tmp_path):
    doc = {"path": "a.go", "language": "go", "occurrences": [{"range": [1, 2, 5], "symbol": "s", "roles": 1}, {"range": [3, 0, 4, 1], "symbol": "s", "roles": 8}, {"range": [3, 0, 4, 1], "symbol": "s", "roles": 8}], "symbols": [{"symbol": "s", "name": "s", "kind": 12, "relationships": [{"symbol": "t", "implementation": True}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    d = readers.index_documents(spark, str(tmp_path))
    o = readers.occurrences(d)
    assert [(r["line"], r["end_line"], r["end_col"]) for r in readers.references(o, "s", definitions=False).collect()] == [(3, 4, 1)]
    assert readers.references(o, "s").count() == 2
    assert readers.relationships(d).first()["related"] == "t"
    assert len(readers.document_hash(d).first()["hash"]) == 16


def test_commit_log_and_numstat(spark):
    lines = spark.createDataFrame([("0123456789|Ann|86400|fix: a|b",), ("junk",)], "value string")
    r = readers.commit_log(lines).first()
    assert (r["author"], r["message"], r["ts"].day) == ("Ann", "fix: a|b", 2)
    n = spark.createDataFrame([("3\t1\ta.go",), ("-\t-\tx.png",), ("1\t0\tsrc/{old => new}/f.go",), ("0\t0\ta => b",), ("",)], "value string")
    got = [(r["path"], r["old_path"], r["additions"], r["binary"]) for r in readers.numstat(n).collect()]
    assert got == [("a.go", None, 3, False), ("x.png", None, 0, True), ("src/new/f.go", "src/old/f.go", 1, False), ("b", "a", 0, False)]


def test_adr(spark):
    text = "# ADR-7: Use tables\n\n**Status:** Accepted\n**Date:** 2024-03-01\n\n## Context\nwhy\n\n## Decision\nwhat\n\n## Consequences\n- one\n- two\n\n## Affected Modules\n* core\n"
    d = spark.createDataFrame([("p", text)], "path string, text string")
    r = readers.adr(d).first()
    assert (r["id"], r["title"], r["status"], str(r["date"]), r["context"], r["consequences"], r["affected_modules"]) == ("ADR-007", "Use tables", "accepted", "2024-03-01", "why", ["one", "two"], ["core"])
    assert readers.next_adr(readers.adr(d)).first()["next"] == 8


def test_imports(spark):
    f = spark.createDataFrame([("a.py", "python", "import os\nfrom x.y import z\n"), ("a.go", "go", 'import (\n\t"fmt"\n\tq "a/b"\n)\n'), ("a.js", "javascript", "import a from './x'\nconst b = require('y')"), ("b.rs", "rust", "use std::io;\n"), ("bin", "go", '"x"\0')], "path string, language string, text string")
    got = sorted((r["path"], r["module"]) for r in readers.imports(f).collect())
    assert got == [("a.go", "a/b"), ("a.go", "fmt"), ("a.js", "./x"), ("a.js", "y"), ("a.py", "os"), ("a.py", "x.y"), ("b.rs", "std::io")]


def test_contracts(spark):
    p = spark.createDataFrame([("a.proto", 'package x.v1;\nimport "b.proto";\nservice S {}\nmessage M {}\nmessage N {}')], "path string, text string")
    r = readers.proto_contract(p).first()
    assert (r["package"], r["services"], r["messages"], r["imports"]) == ("x.v1", ["S"], ["M", "N"], ["b.proto"])
    o = spark.createDataFrame([("a.json", '{"openapi": "3.0.1", "paths": {"/a": {}, "/b": {}}}'), ("b", "no")], "path string, text string")
    assert [(r["version"], r["paths"]) for r in readers.openapi_contract(o).collect()] == [("3.0.1", ["/a", "/b"]), (None, None)]


def test_telemetry(spark):
    b = spark.createDataFrame([('{"calls": [{"service_name": "s", "function_name": "f", "namespace": "n", "call_count": 3}]}',), ("broken",)], "body string")
    r = readers.telemetry(b).collect()
    assert [(x["origin"], x["call_count"], x["error_count"]) for x in r] == [("n", 3, 0)]
    point = {"asInt": "4", "attributes": [{"key": "rpc.method", "value": {"stringValue": "get"}}, {"key": "code.function", "value": {"stringValue": ""}}]}
    body = {"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeMetrics": [{"metrics": [{"name": "calls", "sum": {"dataPoints": [point, point]}}]}]}]}
    o = readers.otlp(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()
    assert [tuple(x) for x in o] == [("api", "get", 8)]


def test_modules_and_definitions(spark):
    m = readers.declared_modules(spark, '[[module]]\nname = "core"\nroot = "src/core"\ntags = ["a"]\n')
    assert m.first()["root"] == "src/core"
    f = spark.createDataFrame([("a.go", "go", "package a\nfunc (x T) Run(a int) {\n if a > 1 && b {\n }\n}\n"), ("b.py", "python", "def f(x):\n    return 1 if x else 2\n")], "path string, language string, text string")
    assert sorted((r["path"], r["line"], r["name"]) for r in readers.source_symbols(f).collect()) == [("a.go", 2, "Run"), ("b.py", 1, "f")]
    assert sorted((r["path"], r["cyclomatic"]) for r in readers.complexity(f).collect()) == [("a.go", 3), ("b.py", 2)]
    c = readers.context(f, spark.createDataFrame([("a.go", 1), ("a.go", 4)], "path string, line int"), 1)
    assert sorted((r["line"], r["context"]) for r in c.collect()) == [(1, "package a\nfunc (x T) Run(a int) {"), (4, " if a > 1 && b {\n }\n}")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("x\ny")
    assert readers.texts(spark, str(tmp_path / "in"), "*.md").first()["text"] == "x\ny"
    assert readers.hashed_files(spark, str(tmp_path / "in")).first()["bytes"] == 3


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "term string, doc int, tf int")
    writers.postings_table(p, f"{tmp_path}/post", 4)
    assert [r["tf"] for r in writers.lookup_postings(spark, f"{tmp_path}/post", ["b", "zz"], 4).collect()] == [2]
    s = p.withColumn("snapshot_date", F.lit("2024-01-01"))
    writers.append_series(s, f"{tmp_path}/series")
    writers.append_series(s, f"{tmp_path}/series")
    assert spark.read.parquet(f"{tmp_path}/series").count() == 4
    writers.overwrite(p, f"{tmp_path}/series")
    writers.compact(spark, f"{tmp_path}/series", f"{tmp_path}/one", 1)
    assert spark.read.parquet(f"{tmp_path}/one").count() == 2
    writers.delta_artifact(p, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_functions_with_ranges_and_complexities(spark):
    go = 'package a\n// func no() {\nfunc (x *T) Run(a int) error {\n\ts := "{ if"\n\tif a > 1 && a < 9 {\n\t\tfor _, v := range x {\n\t\t\tuse(v)\n\t\t}\n\t} else if a == 2 {\n\t}\n\treturn nil\n}\nfunc Plain() {}\n'
    py = 'class A:\n    def f(self, x):\n        """def no(): if"""\n        if x and self:\n            for i in x:\n                pass\n        elif x:\n            return 1\n        return [y for y in x if y]\n\n    def g(self):\n        return 2\n'
    js = "export async function go(a) {\n  while (a) {\n    if (a || b) { c() }\n  }\n  return a ? 1 : 2;\n}\nfunction open( {"
    f = spark.createDataFrame([("a.go", "go", go), ("b.py", "python", py), ("c.js", "javascript", js), ("d", "cobol", "IF"), ("e", "go", None), ("f", "go", "")], "path string, language string, text string")
    got = sorted(tuple(r) for r in source_code.functions(f).collect())
    assert got == [
        ("a.go", "Plain", 13, 13, "func Plain()", 1, 0),
        ("a.go", "Run", 3, 12, "func (x *T) Run(a int) error", 6, 1 + 2 + 2 + 3 + 2),
        ("b.py", "f", 2, 9, "def f(self, x)", 7, 1 + 2 + 2 + 2 + 1 + 1),
        ("b.py", "g", 11, 12, "def g(self)", 1, 0),
        ("c.js", "go", 1, 6, "export async function go(a)", 5, 1 + 2 + 3 + 1),
    ]


def test_index_files_in_their_own_format(spark, tmp_path):
    o = {"range": [1, 2, 300], "symbol": "s é", "roles": 1, "enclosing": [1, 0, 4, 1]}
    d = {"path": "a.go", "language": "go", "occurrences": [o, {"range": [], "symbol": "", "roles": 0, "enclosing": None}], "symbols": [{"symbol": "s", "name": "S", "kind": 12, "docs": ["x", ""], "relationships": [{"symbol": "t", "reference": False, "implementation": True}]}]}
    df = spark.createDataFrame([json.dumps(d), json.dumps({**d, "path": "b.go", "symbols": []})], "string").select(F.from_json("value", readers.INDEX_SCHEMA).alias("d")).select("d.*")
    back = index_format.decode(index_format.encode(df))
    assert sorted(r.asDict(True)["path"] for r in back.collect()) == ["a.go", "b.go"]
    assert back.where("path = 'a.go'").first().asDict(True) == d
    # An occurrence whose range comes unpacked, a field of fixed width and an unknown one.
    raw = bytes([0x12, 20, 0x0A, 1, ord("p"), 0x12, 11, 0x08, 5, 0x08, 6, 0x08, 7, 0x12, 1, ord("q"), 0x18, 8, 0x4D, 1, 2])
    (tmp_path / "x.scip").write_bytes(raw + b"")
    short = spark.createDataFrame([(bytearray(raw),)], "content binary")
    try:
        index_format.decode(short).collect()
        raise AssertionError("a message that is cut must not pass")
    except Exception as e:
        assert "longer than its message" in str(e)
    whole = bytes([0x12, 16, 0x0A, 1, ord("p"), 0x12, 11, 0x08, 5, 0x08, 6, 0x08, 7, 0x12, 1, ord("q"), 0x18, 8])
    (tmp_path / "x.scip").write_bytes(whole)
    got = index_format.read_index(spark, str(tmp_path)).first()
    assert (got["path"], list(got["occurrences"][0]["range"]), got["occurrences"][0]["symbol"], got["occurrences"][0]["roles"]) == ("p", [5, 6, 7], "q", 8)


def test_many_documents_in_the_index_format(spark):
    """Negative and long numbers, long lists, empty and null parts, texts that are not UTF-8: as plain readers of the wire format have them."""
    o = [{"range": [(-1) ** j * 7 ** (j % 11) for j in range(i % 5)], "symbol": "é" * (i % 3), "roles": i % 4 << 20, "enclosing": None if i % 2 else [i] * (i % 3)} for i in range(400)]
    rel = [{"symbol": f"r{i}", "reference": i % 2 == 0, "implementation": i % 3 == 0} for i in range(7)]
    docs = [{"path": f"p{i}", "language": "", "occurrences": o[: i % 30], "symbols": [{"symbol": "s" * 200, "name": "", "kind": i, "docs": ["x"] * (i % 4), "relationships": rel[: i % 8]}] * (i % 3)} for i in range(60)]
    docs.append({"path": "long", "language": "go", "occurrences": [*o, {"range": list(range(500)), "symbol": "", "roles": 0, "enclosing": []}], "symbols": []})
    df = spark.createDataFrame([json.dumps(d) for d in docs], "string").select(F.from_json("value", readers.INDEX_SCHEMA).alias("d")).select("d.*")
    files = index_format.encode(df).cache()
    assert files.count() < len(docs)
    assert sorted((r.asDict(True) for r in index_format.decode(files).collect()), key=lambda d: d["path"]) == sorted(docs, key=lambda d: d["path"])
    bad = bytes([0x12, 4, 0x0A, 2, 0xFF, ord("p")])
    assert index_format.decode(spark.createDataFrame([(bytearray(bad),), (None,), (bytearray(),)], "content binary")).first()["path"] == "\ufffdp"
    # Read side by side, so a column of a batch's occurrences takes the time of a few array operations.
    many = pa.RecordBatch.from_pylist([{"path": "p", "language": "", "occurrences": o, "symbols": []}] * 500, schema=pa.schema(list(to_arrow_type(StructType.fromDDL(readers.INDEX_SCHEMA)))))
    began = time.process_time()
    raw = index_format._encoded(many)
    assert len(raw) > 1_000_000 and time.process_time() - began < 1.5


def test_yaml_contracts_and_long_record_numbers(spark):
    o = spark.createDataFrame([("a", "openapi: '3.1.0'\npaths:\n  '/a/{x}':\n    get: {}\n  /b:\n    /no: 1\nx:\n  /c: 1\n"), ("b", "paths:\n  /a: 1\n")], "path string, text string")
    assert [(r["version"], r["paths"]) for r in readers.openapi_contract(o).collect()] == [("3.1.0", ["/a/{x}", "/b"]), (None, None)]
    d = spark.createDataFrame([("p", "# ADR-12345: Long\n")], "path string, text string")
    assert readers.adr(d).first()["id"] == "ADR-12345"
