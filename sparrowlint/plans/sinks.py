"""Findings as terminal text, JSON, rdjsonl and SARIF, as columns or files; exit codes."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparrowlint.functions import sqltext
from sparrowlint.plans.config import HELP_URL, NAME, RULES
from sparrowlint.plans.lint import ORDER
from sparrowlint.runtime import Workspace


@F.pandas_udf(StringType())
def snippet(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: sqltext.snippet(s or ""))


@F.pandas_udf(StringType())
def preview(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: sqltext.preview(s or ""))


def origin(sql: Column) -> Column:
    kind = F.lower(F.regexp_extract(sql, r"(?i)^\s*/\*\s*[a-z-]+:synthetic\s+([a-z0-9_-]+)\s*\*/", 1))
    return F.when(kind == "", "").when(kind == "sqlalchemy-ast", sqltext.ORIGINS["sqlalchemy-ast"]).when(kind == "goqu-ast", sqltext.ORIGINS["goqu-ast"]).otherwise("synthetic query builder")


def terminal_lines(findings: DataFrame) -> DataFrame:
    """The order columns and ``text``: one line, and an indented snippet where there is SQL."""
    head = F.format_string("%s:%d: %s [%s] %s", "file", "line", "severity", "rule_id", "message")
    return findings.select(*ORDER, F.when(F.coalesce("sql", F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n    "), snippet("sql"))).alias("text"))


def rdjsonl_lines(findings: DataFrame) -> DataFrame:
    """``text``: one diagnostic per finding."""
    line, col = F.greatest("line", F.lit(1)), F.greatest("column", F.lit(1))
    end = F.when(F.col("end_line") >= 1, F.greatest("end_line", line)).otherwise(line)
    end_col = F.when(F.col("end_column") >= 1, F.col("end_column")).when(end > line, 1).otherwise(col + 1)
    level = F.when(F.col("severity") == "error", "ERROR").when(F.col("severity") == "warning", "WARNING").otherwise("INFO")
    sql = F.coalesce("sql", F.lit(""))
    parts = F.array(F.concat("rule_id", F.lit(": "), "message"), F.when(origin(sql) != "", F.concat(F.lit("Origin: "), origin(sql))), F.when(preview(sql) != "", F.concat(F.lit("Query: `"), preview(sql), F.lit("`"))))
    place = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("int").alias("column"))
    doc = F.struct(
        F.struct(F.lit(NAME).alias("name"), F.lit(HELP_URL).alias("url")).alias("source"),
        level.alias("severity"),
        F.struct(F.col("rule_id").alias("value")).alias("code"),
        F.array_join(parts, " | ").alias("message"),
        F.struct(F.col("file").alias("path"), F.struct(place(line, col).alias("start"), place(end, end_col).alias("end")).alias("range")).alias("location"),
    )
    return findings.select(*ORDER, F.to_json(doc).alias("text"))


def json_entries(findings: DataFrame) -> DataFrame:
    """``text``: one entry of the report per finding; empty end positions and SQL are left out."""
    some = lambda c, none: F.when(F.col(c) != none, F.col(c)).alias(c)
    doc = F.struct("rule_id", "severity", "message", "file", "line", "column", some("end_line", 0), some("end_column", 0), some("sql", ""))
    return findings.select(*ORDER, F.to_json(doc).alias("text"))


def sarif_level(c: Column) -> Column:
    return F.when(c == "error", "error").when(c == "warning", "warning").when(c == "info", "note").otherwise("none")


def sarif_results(findings: DataFrame) -> DataFrame:
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.when(F.col("end_line") > 0, F.col("end_line")).alias("endLine"), F.when(F.col("end_column") > 0, F.col("end_column")).alias("endColumn"))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    doc = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(where).alias("locations"))
    return findings.select(*ORDER, F.to_json(doc).alias("text"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``(rule_id, first)``: the rules in order of their first finding."""
    return findings.groupBy("rule_id").agg(F.min(F.struct(*[c for c in ORDER if c != "rule_id"])).alias("first")).orderBy("first", "rule_id")


LINES = {"terminal": terminal_lines, "rdjsonl": rdjsonl_lines, "json": json_entries, "sarif": sarif_results}


def write_lines(findings: DataFrame, kind: str, path: str) -> None:
    """Text files under ``path`` whose names give the report's order: a diagnostic a line, of any number of findings.

    Rows are ordered by range partitions, so that no task and no driver holds the report;
    a retried task replaces its own file. They are written once before, as ranges are drawn
    from a sample, for which all files would be scanned once more.
    """
    ws = Workspace(findings.sparkSession, "findings")
    ordered = LINES[kind](ws.table(findings, "found")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered.select("text").write.mode("overwrite").option("lineSep", "\n").text(path)
    ws.drop("found")


def report(findings: DataFrame, kind: str, version: str = "", tag: str = NAME) -> str:
    """A whole report on the driver, for findings of a size that is read by people or review tools."""
    rows = lambda df: [r.text for r in df.orderBy(*ORDER).select("text").toLocalIterator()]
    if kind == "terminal":
        lines = rows(terminal_lines(findings))
        if not lines:
            return "0 findings\n"
        marks = "".join(f"  {n}: {' ' * (4 - len(n) - 1)}{c} {tag}:disable <RULE_ID>\n" for n, c in (("SQL", "--"), ("Go", "//"), ("Py", "#")))
        return "\n".join(lines) + f"\n\n{len(lines)} finding{'s' * (len(lines) != 1)}\nSuppress findings with:\n{marks}"
    if kind == "rdjsonl":
        return "".join(x + "\n" for x in rows(rdjsonl_lines(findings)))
    if kind == "json":
        entries = [json.loads(x) for x in rows(json_entries(findings))]
        return json.dumps({"version": version or "1.0.0", "findings": entries, "summary": {"total": len(entries)}}, indent=2, ensure_ascii=False) + "\n"
    if kind == "sarif":
        known = [{"id": r.rule_id, "shortDescription": {"text": RULES[r.rule_id].name}, "fullDescription": {"text": RULES[r.rule_id].name}, "defaultConfiguration": {"level": {"error": "error", "warning": "warning", "info": "note"}[RULES[r.rule_id].severity]}} for r in sarif_rules(findings).collect()]
        results = [json.loads(x) for x in rows(sarif_results(findings))]
        run = {"tool": {"driver": {"name": NAME, "version": version or "dev", "rules": known}}, "results": results}
        return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=2, ensure_ascii=False) + "\n"
    raise ValueError(f"unknown format {kind!r}")


def write_text(path: str, content: str) -> None:
    """The file appears whole or not at all."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".report")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(tmp, path)


def exit_code(findings: DataFrame) -> int:
    return 0 if findings.isEmpty() else 1
