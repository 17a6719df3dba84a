"""From source files to statements and models: one Python pass per kind, all else as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlint.functions.pgparse import parse
from sparrowlint.functions.sqltext import bare_identifier, split_statements
from sparrowlint.plans.config import Config, exclude_regex
from sparrowlint.runtime import ship
from sparrowlint.sources import gosrc, pysrc

SKIPPED_DIRS = (".git", "node_modules", ".hg", ".svn")
PARSED = (
    "struct<command string, columns array<string>, tables array<struct<name string, kind string, key string, keys array<string>>>, "
    "`where` array<string>, having array<string>, join_conditions array<string>, group_by array<string>, `limit` string, "
    "usages array<struct<usage string, alias string, col string>>, "
    "ddl array<struct<type string, object_name string, columns array<string>, flags array<string>, details array<struct<name string, type string, nullable boolean, has_default boolean>>>>, "
    "restrictive boolean, stripped string, error string>"
)
STATEMENTS = f"file string, engine string, stmt_idx int, sql string, line int, `column` int, end_line int, end_column int, fatal boolean, parsed {PARSED}"
_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_strs = pa.list_(_S)
ARROW_PARSED = pa.struct(
    [
        ("command", _S), ("columns", _strs), ("tables", pa.list_(pa.struct([("name", _S), ("kind", _S), ("key", _S), ("keys", _strs)]))), ("where", _strs), ("having", _strs), ("join_conditions", _strs), ("group_by", _strs), ("limit", _S),
        ("usages", pa.list_(pa.struct([("usage", _S), ("alias", _S), ("col", _S)]))),
        ("ddl", pa.list_(pa.struct([("type", _S), ("object_name", _S), ("columns", _strs), ("flags", _strs), ("details", pa.list_(pa.struct([("name", _S), ("type", _S), ("nullable", _B), ("has_default", _B)])))]))),
        ("restrictive", _B), ("stripped", _S), ("error", _S),
    ]
)
ARROW_STATEMENTS = pa.schema([("file", _S), ("engine", _S), ("stmt_idx", _I), ("sql", _S), ("line", _I), ("column", _I), ("end_line", _I), ("end_column", _I), ("fatal", _B), ("parsed", ARROW_PARSED)])
MODELS = "file string, source string, idx int, `table` string, table_explicit boolean, table_kind string, table_source string, line int, columns array<struct<name string, field string, type string, line int, kind string, mapping_source string>>, error string"
ARROW_MODELS = pa.schema([("file", _S), ("source", _S), ("idx", _I), ("table", _S), ("table_explicit", _B), ("table_kind", _S), ("table_source", _S), ("line", _I), ("columns", pa.list_(pa.struct([("name", _S), ("field", _S), ("type", _S), ("line", _I), ("kind", _S), ("mapping_source", _S)]))), ("error", _S)])


#: Bytes of content that a worker takes apart at a time; statements of up to so many characters that it remembers, and how many of them.
SLICE, REMEMBERED, MOST = 1 << 20, 1000, 1 << 12


def parsed_struct(sql: str) -> dict:
    """What the rules read of a statement. Those that repeat in a worker's files are parsed once; the result is not to be changed."""
    return _remembered(sql) if len(sql) <= REMEMBERED else _parsed(sql)


def _parsed(sql: str) -> dict:
    p = parse(sql)
    p["tables"] = [{"name": t["name"], "kind": t["type"], "key": (k := bare_identifier(t["name"])), "keys": sorted({k, bare_identifier(t["raw"]), bare_identifier(t["alias"])} - {""})} for t in p["tables"]]
    p["usages"] = [{"usage": u["usage_type"], "alias": bare_identifier(u["table_alias"]), "col": "" if (c := bare_identifier(u["column"])) == "*" else c} for u in p["usages"]]
    return p


_remembered = lru_cache(MOST)(_parsed)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE bytes of content, so that what a worker holds does not follow the rows of a batch."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.unique(np.searchsorted(size, np.arange(SLICE, int(size[-1]) + SLICE, SLICE), side="right")) if len(size) else ()
        at = 0
        for end in (*ends, b.num_rows):
            if end > at:
                yield b.slice(at, end - at)
                at = int(end)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def read_files(spark: SparkSession, roots: list[str], config: Config) -> DataFrame:
    """``(path, content)`` of the .sql, .go and .py files under the roots, skipped folders and excluded paths aside.

    Extensions are found in any case; scanners later take .sql in any, .go and .py in lower case only.
    """
    raw = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{[sS][qQ][lL],[gG][oO],[pP][yY]}")
    files = raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("content"))
    dirs = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    return usable_files(files.where(~F.col("path").rlike(f"(^|/)({dirs})/")), config)


def usable_files(files: DataFrame, config: Config) -> DataFrame:
    """One row per path, without excluded ones.

    The one shuffle by path also spreads the files: scanning them is work for Python, of
    which a scan of few row groups, or a shuffle coalesced by bytes, would use one core.
    """
    out = files.select("path", "content").where("path is not null and content is not null")
    if pattern := exclude_regex(config.exclude):
        out = out.where(~F.col("path").rlike(pattern))
    spark = files.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.repartition(parts, "path").dropDuplicates(["path"])


def class_tables(files: DataFrame) -> DataFrame:
    """``(path, tables map)``: for each Python file the table names of the model classes it names, the last file's if several define one.

    Definitions meet uses in an equi-join on the class, so no task holds all classes.
    """
    py = files.where((extension(F.col("path")) == ".py") & F.regexp_like("content", F.lit("|".join(map(re.escape, pysrc.QUERY_MARKERS)))))

    def defined(it):
        for b in slices(it):
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows += [(k, v, p) for k, v in pysrc.tablenames(c).items()]
                except (SyntaxError, ValueError, RecursionError):
                    pass
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("cls", "tbl", "path"), r)) for r in rows], pa.schema([("cls", _S), ("tbl", _S), ("path", _S)]))

    named = py.where(F.contains("content", F.lit("__tablename__"))).mapInArrow(defined, "cls string, tbl string, path string").groupBy("cls").agg(F.max_by("tbl", "path").alias("tbl"))
    used = py.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))).alias("cls"))
    return used.join(named, "cls").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("cls", "tbl"))).alias("tables"))


def statements(files: DataFrame, config: Config, parsed: bool = True) -> DataFrame:
    """All statements of the files with their parsed form, or a null one where that is not asked for. Unreadable files give one row with ``fatal``."""
    ship(files.sparkSession)
    tag = config.tag

    def run(it):
        for b in slices(it):
            rows = []
            for path, content, tables in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("tables").to_pylist()):
                ext = path.rsplit(".", 1)[-1] if "." in path else ""
                try:
                    if ext.lower() == "sql":
                        found = [("sql", s, line, 1, el, ec) for s, line, el, ec in split_statements(content)]
                    elif ext == "go":
                        found = gosrc.statements(content, tag)
                    elif ext == "py" and any(m in content for m in pysrc.QUERY_MARKERS):
                        found = pysrc.statements(content, dict(tables or ()), tag)
                    else:
                        found = []
                except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                    rows.append({"file": path, "engine": ext, "stmt_idx": 0, "fatal": True, "parsed": {"error": str(e)}})
                    continue
                for k, (engine, sql, line, col, el, ec) in enumerate(found):
                    rows.append({"file": path, "engine": engine, "stmt_idx": k, "sql": sql, "line": line, "column": col, "end_line": el, "end_column": ec, "fatal": False, "parsed": parsed_struct(sql) if parsed else None})
            yield pa.RecordBatch.from_pylist(rows, ARROW_STATEMENTS)

    with_tables = files.join(class_tables(files), "path", "left") if _has(files, ".py") else files.withColumn("tables", F.lit(None).cast("map<string,string>"))
    return with_tables.select("path", "content", "tables").mapInArrow(run, STATEMENTS)


def _has(files: DataFrame, ext: str) -> bool:
    return not files.where(F.lower("path").endswith(ext)).isEmpty()


def models(files: DataFrame, config: Config) -> DataFrame:
    """Models of Go structs and declarative Python classes, with their place in the file."""
    ship(files.sparkSession)
    mode = config.mapping_mode

    def run(it):
        for b in slices(it):
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                source = "go" if path.endswith(".go") else "sqlalchemy"
                try:
                    found = gosrc.models(content, mode) if source == "go" else pysrc.models(content)
                except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                    rows.append({"file": path, "source": source, "error": str(e)})
                    continue
                rows += [{"file": path, "source": source, "idx": k, **m} for k, m in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, ARROW_MODELS)

    marked = F.col("path").endswith(".go") & F.contains("content", F.lit("struct")) | F.col("path").endswith(".py") & F.regexp_like("content", F.lit("|".join(map(re.escape, pysrc.MODEL_MARKERS))))
    return files.where(marked).select("path", "content").mapInArrow(run, MODELS).where("error is null").drop("error")


def directives(files: DataFrame, config: Config) -> DataFrame:
    """``(file, line, rule)``: what comments disable, on their own line and the next; * is every rule."""
    lines = files.where(F.contains("content", F.lit(f"{config.tag}:disable"))).select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    m = F.regexp_extract("text", rf"^\s*(?:--|//|#) {re.escape(config.tag)}:disable(.*)$", 1)
    hit = lines.where(F.col("text").rlike(rf"^\s*(?:--|//|#) {re.escape(config.tag)}:disable")).withColumn("rest", F.trim(F.regexp_replace(m, r"[\r\t]", " ")))
    ids = F.filter(F.transform(F.split("rest", ","), lambda x: F.trim(x)), lambda x: x != "")
    each = hit.select("file", "n", F.explode(F.when(F.col("rest") == "", F.array(F.lit("*"))).otherwise(ids)).alias("rule"))
    return each.select("file", F.explode(F.array(F.col("n") + 1, F.col("n") + 2)).alias("line"), "rule").distinct()
