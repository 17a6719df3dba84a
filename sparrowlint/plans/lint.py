"""The whole run: files to ordered findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlint.operators import rules
from sparrowlint.plans.config import RULES, Config, migration_regex
from sparrowlint.runtime import Workspace
from sparrowlint.sources import files as src

ORDER = ("file", "line", "column", "end_line", "end_column", "rule_id", "message")


class ScanError(RuntimeError):
    """A source file that cannot be read at all."""


@dataclass
class Result:
    findings: DataFrame
    statements: DataFrame
    skipped: DataFrame


def lint(files: DataFrame, config: Config | None = None, strict: bool = True) -> Result:
    """Findings of all rules over ``files(path, content)``.

    The files are read once, into the shared folder; each is then split and parsed once, and
    all rules read its statements and models from there. With strict, an unreadable Go or
    Python file ends the run.
    """
    config = config or Config()
    ws = Workspace(files.sparkSession, "lint")
    files = ws.table(src.usable_files(files, config), "files")
    found = ws.table(src.statements(files, config), "statements")
    if strict and (bad := found.where("fatal").orderBy("file").select("file", "parsed.error").first()):
        raise ScanError(f"{bad.file}: {bad.error}")
    marks = src.directives(files, config)
    out = rules.query_findings(found, marks, config)
    if any(config.enabled(r) for r in RULES if RULES[r].kind != "query"):
        models = ws.table(src.models(files, config), "models")
        tables, columns = rules.migration_snapshot(rules.migration_statements(found, migration_regex(config.migration_paths)), config)
        tables, columns = ws.table(tables, "tables"), ws.table(columns, "columns")
        out = out.unionByName(rules.drift_findings(models, tables, columns, config))
        mt, mc = rules.model_snapshot(models)
        all_tables = tables.select(F.lit("migration").alias("source"), "table_key", "table_name").unionByName(mt.select("source", "table_key", "table_name"))
        all_columns = columns.select(F.lit("migration").alias("source"), "table_key", "col_key").unionByName(mc.select("source", "table_key", "col_key"))
        out = out.unionByName(rules.query_schema_findings(found, marks, ws.table(all_tables, "all_tables"), ws.table(all_columns, "all_columns"), config))
    skipped = found.where("not fatal and parsed.error is not null").select("file", "line", "sql", "parsed.error")
    return Result(out.orderBy(*ORDER), found, skipped)
