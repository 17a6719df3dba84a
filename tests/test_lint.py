import random

import pytest

from sparrowlint.operators import rules
from sparrowlint.plans import sinks
from sparrowlint.plans.config import Config
from sparrowlint.plans.lint import ScanError, lint
from sparrowlint.sources import files as src

CASES = [
    ("VG001", ["SELECT * FROM u", "SELECT u.* FROM u"], ["SELECT id FROM u", "SELECT COUNT(*) FROM u"]),
    ("VG002", ["UPDATE u SET a=1", "UPDATE u SET a=1 WHERE 0 = 0"], ["UPDATE u SET a=1 WHERE id IN (SELECT id FROM i)", "UPDATE u SET a=1 WHERE 1 = 1 AND id = 1"]),
    ("VG004", ["SELECT COUNT(*) FROM u GROUP BY s"], ["SELECT COUNT(*), MAX(id) FROM u", "SELECT (COUNT(*)) FROM u", "SELECT 1"]),
    ("VG005", ["SELECT a FROM u WHERE n ILIKE '%a'", "SELECT a FROM u WHERE n NOT LIKE '%a'"], ["SELECT a FROM u WHERE n LIKE 'a%'"]),
    ("VG006", ["SELECT id FROM u /* c */ FOR UPDATE", "SELECT id FROM u WHERE TRUE FOR UPDATE"], ["SELECT id FROM u FOR SHARE", "SELECT id FROM u -- FOR UPDATE", "SELECT 'FOR UPDATE' FROM u", "SELECT id FROM u FOR UPDATE LIMIT 1"]),
    ("VG008", ["CREATE UNIQUE INDEX i ON u (a)"], ["CREATE INDEX CONCURRENTLY i ON u (a)", "DROP INDEX i"]),
]


def test_query_rules(spark):
    rows = [(f"{r}/{k}/{n}.sql", s) for r, *sides in CASES for k, side in enumerate(sides) for n, s in enumerate(side)]
    files = spark.createDataFrame(rows, "path string, content string")
    found = rules.query_findings(src.statements(files, Config()), src.directives(files, Config()), Config()).select("rule_id", "file").collect()
    got = {r.file for r in found if r.file.startswith(r.rule_id)}
    assert got == {p for p, _ in rows if p.split("/")[1] == "0"}


def test_ddl_fold_is_sequential(spark):
    rng, rows, expect = random.Random(2), [], {}
    for n in range(40):
        state, sql = {}, []
        for _ in range(rng.randrange(1, 9)):
            t, c = f"t{n}_{rng.randrange(2)}", f"c{rng.randrange(3)}"
            kind = rng.choice(["create", "drop", "add", "dropcol"])
            if kind == "create":
                sql.append(f"CREATE TABLE {t} ({c} int)")
                state[t] = {c}
            elif kind == "drop":
                sql.append(f"DROP TABLE {t}")
                state.pop(t, None)
            elif kind == "add":
                sql.append(f"ALTER TABLE {t} ADD COLUMN {c} int")
                state.get(t, set()).add(c)
            else:
                sql.append(f"ALTER TABLE {t} DROP COLUMN {c}")
                state.get(t, set()).discard(c)
        rows.append((f"migrations/{n}.sql", ";\n".join(sql)))
        expect |= state
    files = spark.createDataFrame(rows, "path string, content string")
    tables, cols = rules.migration_snapshot(src.statements(files, Config()), Config())
    assert {r.table_key for r in tables.collect()} == set(expect)
    got = {}
    for r in cols.collect():
        got.setdefault(r.table_key, set()).add(r.col_key)
    assert got == {k: v for k, v in expect.items() if v}


def test_unreadable_source_ends_the_run(spark):
    files = spark.createDataFrame([("a.go", "package a\nfunc f( {")], "path string, content string")
    with pytest.raises(ScanError):
        lint(files)


def test_reports(spark):
    files = spark.createDataFrame([("a.sql", "-- x\nSELECT * FROM u LIMIT 1")], "path string, content string")
    found = lint(files).findings
    assert sinks.report(found, "terminal").startswith("a.sql:2: warning [VG001] avoid SELECT *; project only required columns\n    SELECT * FROM u LIMIT 1\n\n1 finding\n")
    assert '"total": 1' in sinks.report(found, "json") and '"ruleId": "VG001"' in sinks.report(found, "sarif")
    assert sinks.report(found.limit(0), "terminal") == "0 findings\n" and sinks.exit_code(found) == 1


def test_stream(spark, tmp_path):
    from sparrowlint.streaming.lint_stream import lint_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sql").write_text("DELETE FROM t")
    lint_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["VG003"]


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_statements_that_repeat_are_parsed_once(monkeypatch):
    from sparrowlint.sources import files

    seen = []
    monkeypatch.setattr(files, "parse", lambda sql: seen.append(sql) or {"tables": [], "usages": []})
    long = "SELECT '" + "x" * files.REMEMBERED + "'"
    for sql in ("SELECT 1 -- repeats", "SELECT 2 -- repeats", "SELECT 1 -- repeats", long, long):
        files.parsed_struct(sql)
    assert seen == ["SELECT 1 -- repeats", "SELECT 2 -- repeats", long, long]
    files._remembered.cache_clear()


def test_batches_are_taken_apart_by_bytes(monkeypatch):
    import pyarrow as pa

    from sparrowlint.sources import files

    monkeypatch.setattr(files, "SLICE", 100)
    for sizes in ([30] * 12, [250, 1, 1, 300], [None, 99, 2], [0, 0], []):
        batch = pa.RecordBatch.from_pydict({"content": pa.array([None if n is None else "x" * n for n in sizes], pa.string())})
        parts = [b.column("content").to_pylist() for b in files.slices(iter([batch]))]
        assert sum(parts, []) == batch.column("content").to_pylist()
        assert all(sum(len(x or "") for x in p) <= 100 + max(len(x or "") for x in p) for p in parts)
        assert len(parts) > 1 or sum(n or 0 for n in sizes) <= 100


def test_written_reports_scan_their_files_once(spark, tmp_path):
    from sparrowlint.plans import sinks

    made = spark.sparkContext.accumulator(0)
    schema = "rule_id string, severity string, message string, file string, line int, column int, end_line int, end_column int, sql string"

    def found(it):
        for b in it:
            made.add(len(b))
            yield b

    rows = [("VG001", "warning", "m", f"q/{k}.sql", 1, 1, 1, 2, "SELECT *") for k in range(200)]
    sinks.write_lines(spark.createDataFrame(rows, schema).repartition(4).mapInPandas(found, schema), "rdjsonl", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 200
    assert made.value == 200
