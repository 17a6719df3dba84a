"""The rules as relational plans: query rules in one pass, schema rules as anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlint.plans.config import RULES, Config

AGGREGATES = "count|sum|avg|min|max|bool_and|bool_or|every|array_agg|json_agg|jsonb_agg|string_agg"
LEADING_WILDCARD = r"(?i)\bI?LIKE\s+'%"
TYPES = {
    "integer": ("integer int int8 int16 int32 int64 smallint bigint serial bigserial nullint64 nullint32 nullint16", "integer,bigint,smallint,serial,bigserial,int,int2,int4,int8"),
    "string": ("string str char text nullstring", "varchar,text,char,character,character varying"),
    "float": ("float float32 float64 double numeric decimal real nullfloat64", "float,double precision,real,numeric,decimal"),
    "boolean": ("bool boolean nullbool", "boolean,bool"),
    "timestamp": ("datetime timestamp time.time nulltime", "timestamp,timestamp with time zone,timestamp without time zone,timestamptz"),
}
CONTEXTS = {"projection": "projection", "filter": "filter", "join": "join", "group_by": "group-by", "order_by": "order-by"}
FINDING = ("rule_id", "severity", "message", "file", "line", "column", "end_line", "end_column", "sql")


_NAMED = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r", 34: '"', 92: "\\"}
_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(c: Column) -> Column:
    """As Go's %q: in double quotes, with its escapes for quotes, backslashes, control and other unprintable characters."""

    def escaped(x: Column) -> Column:
        code = F.ascii(x)
        out = F.when(code < 128, F.format_string("\\x%02x", code)).when(code < 65536, F.format_string("\\u%04x", code)).otherwise(F.format_string("\\U%08x", code))
        named = F.create_map(*[F.lit(v) for k, e in _NAMED.items() for v in (k, "\\" + e)])
        return F.coalesce(named[code], F.when(x.rlike(_HIDDEN), out), x)

    plain = ~c.rlike(r'[\\"]|' + _HIDDEN)
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), escaped), "")), F.lit('"'))


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def is_wildcard(e: Column) -> Column:
    return (F.trim(e) == "*") | F.trim(e).endswith(".*")


def is_aggregate(e: Column) -> Column:
    return F.lower(F.trim(e)).rlike(rf"^[(\s]*(?:{AGGREGATES}) ?\(")


def canonical_type(kind: Column) -> Column:
    """The canonical name of a model's type, or null: pointers, slices and arguments aside, then without its package."""
    alias = F.create_map(*[F.lit(x) for canon, (names, _) in TYPES.items() for n in names.split() for x in (n, canon)])
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(kind)), r"^(?:\*|\[\])+", ""), r"\(.*$", ""))
    return F.coalesce(alias[bare], F.when(bare.contains("."), alias[F.regexp_extract(bare, r"\.([^.]*)$", 1)]))


def query_candidates(p: str = "parsed", on: list[str] | None = None) -> Column:
    """An array of (rule_id, message) of what the query rules, or those that are on, find in one parsed statement."""
    c = lambda name: F.col(f"{p}.{name}")
    kind = "struct<rule_id:string,message:string>"
    cmd, no = c("command"), F.lit(None).cast(kind)
    hit = lambda rid, msg, cond: F.when(cond, F.struct(F.lit(rid).alias("rule_id"), F.lit(msg).alias("message"))).otherwise(no)
    free = ~c("restrictive")
    limited = F.trim(F.coalesce(c("limit"), F.lit(""))) != ""
    single = (F.size(c("columns")) > 0) & (F.size(c("group_by")) == 0) & F.forall(c("columns"), is_aggregate)
    like = F.exists(F.concat(c("where"), c("having"), c("join_conditions")), lambda x: x.rlike(LEADING_WILDCARD))
    fixed = {
        "VG001": ("avoid SELECT *; project only required columns", (cmd == "SELECT") & F.exists(c("columns"), is_wildcard)),
        "VG002": ("UPDATE without WHERE may affect all rows; add a WHERE clause", (cmd == "UPDATE") & free),
        "VG003": ("DELETE without WHERE may affect all rows; add a WHERE clause", (cmd == "DELETE") & free),
        "VG004": ("SELECT without LIMIT may return unbounded rows; add LIMIT or FETCH FIRST", (cmd == "SELECT") & (F.size(c("tables")) > 0) & ~single & ~limited),
        "VG005": ("LIKE/ILIKE with leading wildcard may prevent index usage; use a suffix pattern or full-text search", cmd.isin("SELECT", "UPDATE", "DELETE") & like),
        "VG006": ("SELECT FOR UPDATE without WHERE may lock too many rows; add a WHERE clause", (cmd == "SELECT") & c("stripped").rlike(r"(?i)\bFOR\s+UPDATE\b") & free & ~limited),
    }
    fixed = [hit(rid, *x) for rid, x in fixed.items() if on is None or rid in on]

    def action(a):
        name = lambda what, v: F.concat(F.lit(f"destructive DDL detected: {what}"), F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(" "), v)).otherwise(F.lit("")))
        row = lambda rid, m: F.struct(F.lit(rid).alias("rule_id"), m.alias("message"))
        bare = ~F.exists(a["flags"], lambda f: F.upper(F.trim(f)) == "CONCURRENTLY")
        index = F.concat(F.lit("CREATE INDEX "), F.when(F.coalesce(a["object_name"], F.lit("")) != "", F.concat(a["object_name"], F.lit(" "))).otherwise(F.lit("")), F.lit("without CONCURRENTLY may block writes; add CONCURRENTLY"))
        return (
            F.when(a["type"] == "DropTable", row("VG007", name("DROP TABLE", a["object_name"])))
            .when(a["type"] == "DropColumn", row("VG007", name("DROP COLUMN", F.array_join(a["columns"], ", "))))
            .when(a["type"] == "Truncate", row("VG007", name("TRUNCATE", a["object_name"])))
            .when((a["type"] == "CreateIndex") & bare, row("VG008", index))
            .otherwise(no)
        )

    parts = [F.array(*fixed)] if fixed else []
    if on is None or {"VG007", "VG008"} & {*on}:
        parts.append(F.transform(c("ddl"), action))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(f"array<{kind}>")


def configured(found: DataFrame, config: Config, kinds: tuple[str, ...]) -> DataFrame:
    """Drops disabled rules and engines a rule is not for, and sets severities; the choice is folded into literals."""
    on = [r for r in RULES if RULES[r].kind in kinds and config.enabled(r)]
    out = found.where(F.col("rule_id").isin(on)) if on else found.where(F.lit(False))
    for r in on:
        if (engines := config.engines(r)) is not None:
            out = out.where((F.col("rule_id") != r) | F.col("engine").isin(engines))
    severity = F.create_map(*[F.lit(x) for r in on for x in (r, config.severity(r))]) if on else F.create_map(F.lit(""), F.lit(""))
    return out.withColumn("severity", severity[F.col("rule_id")])


def suppressed(found: DataFrame, directives: DataFrame) -> DataFrame:
    """Without what a directive on the statement's line or the line before disables."""
    off = directives.groupBy("file", "line").agg(F.collect_set("rule").alias("off"))
    return found.join(off, ["file", "line"], "left").where(F.col("off").isNull() | ~(F.array_contains("off", F.col("rule_id")) | F.array_contains("off", "*"))).drop("off")


def ranged(found: DataFrame) -> DataFrame:
    """Finding columns with the statement's range, 1-based and never empty."""
    line = F.greatest("line", F.lit(1))
    col = F.greatest("column", F.lit(1))
    end = F.greatest(F.coalesce("end_line", F.lit(0)), line)
    end_col = F.when(F.coalesce("end_column", F.lit(0)) >= 1, F.col("end_column")).when(end > line, 1).otherwise(col + 1)
    return found.select("rule_id", "severity", "message", "file", line.cast("int").alias("line"), col.cast("int").alias("column"), end.cast("int").alias("end_line"), end_col.cast("int").alias("end_column"), "sql")


def query_findings(statements: DataFrame, directives: DataFrame, config: Config) -> DataFrame:
    base = statements.where("not fatal and parsed.error is null")
    on = [r for r in RULES if RULES[r].kind == "query" and config.enabled(r)]
    found = base.select("file", "engine", "sql", "line", "column", "end_line", "end_column", F.explode(query_candidates(on=on)).alias("f")).select("*", "f.rule_id", "f.message").drop("f")
    return ranged(suppressed(configured(found, config, ("query",)), directives))


# Schema snapshots


def ddl_events(statements: DataFrame, config: Config) -> DataFrame:
    """``(seq, table_key, table_name, kind, file, line, col...)``: the DDL actions in order of file, line, statement and action."""
    acts = statements.where("not fatal and parsed.error is null and size(parsed.ddl) > 0").select("file", "line", "stmt_idx", F.posexplode("parsed.ddl").alias("k", "a"))
    key = F.lower(F.col("a.object_name"))
    seq = lambda c: F.struct("file", "line", "stmt_idx", "k", c.alias("c")).alias("seq")
    tables = acts.where("a.type in ('CreateTable', 'DropTable')").select(seq(F.lit(-1)), key.alias("table_key"), F.col("a.object_name").alias("table_name"), F.col("a.type").alias("kind"), "file", "line")
    add = F.exists("a.flags", lambda f: F.upper(F.trim(f)) == "ADD_COLUMN")
    cols = acts.where((F.col("a.type") == "CreateTable") | (F.col("a.type") == "AlterTable") & add).select("*", F.posexplode("a.details").alias("c", "d"))
    bare = (F.col("a.type") == "AlterTable") & F.lit(config.bare_add_column)
    cols = cols.select(seq(F.col("c")), key.alias("table_key"), F.lower("d.name").alias("col_key"), F.lit("add").alias("kind"), F.col("d.name").alias("col_name"), F.when(bare, F.lit("")).otherwise(F.col("d.type")).alias("type"), (~bare & F.col("d.nullable")).alias("nullable"), (~bare & F.col("d.has_default")).alias("has_default"))
    drops = acts.where("a.type = 'DropColumn'").select("*", F.posexplode("a.columns").alias("c", "d"))
    drops = drops.select(seq(F.col("c")), key.alias("table_key"), F.lower("d").alias("col_key"), F.lit("drop").alias("kind"), F.col("d").alias("col_name"), F.lit("").alias("type"), F.lit(True).alias("nullable"), F.lit(False).alias("has_default"))
    return tables, cols.unionByName(drops)


def migration_snapshot(statements: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """``tables(table_key, table_name, file, line)`` and ``columns(table_key, col_key, col_name, type, nullable, has_default)``.

    The last CREATE or DROP of a table is its epoch; the last event of each column since
    the epoch decides. Both are maxima, so they combine before the shuffle.
    """
    events, cols = ddl_events(statements, config)
    last = events.groupBy("table_key").agg(F.max_by(F.struct("kind", "table_name", "file", "line"), "seq").alias("e"), F.max("seq").alias("epoch")).where("e.kind = 'CreateTable'")
    tables = last.select("table_key", "e.table_name", "e.file", "e.line")
    live = cols.join(last.select("table_key", "epoch"), "table_key").where("seq >= epoch")
    final = live.groupBy("table_key", "col_key").agg(F.max_by(F.struct("kind", "col_name", "type", "nullable", "has_default"), "seq").alias("c")).where("c.kind = 'add'")
    return tables, final.select("table_key", "col_key", "c.col_name", "c.type", "c.nullable", "c.has_default")


def migration_statements(statements: DataFrame, pattern: str) -> DataFrame:
    """The raw SQL statements under migration paths; all of them if there are none."""
    sql = statements.where("engine = 'sql'")
    mine = sql.where(F.col("file").rlike(pattern))
    return sql if mine.isEmpty() else mine


def model_snapshot(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables and columns of models by source: a table's first model names it, the last column of a name counts."""
    pos = F.struct("file", "idx")
    tables = models.groupBy("source", F.lower("table").alias("table_key")).agg(F.min_by(F.struct(F.col("table").alias("table_name"), "file", "line"), pos).alias("t")).select("source", "table_key", "t.table_name", "t.file", "t.line")
    cols = models.select("source", "file", "idx", F.lower("table").alias("table_key"), F.posexplode("columns").alias("k", "c"))
    cols = cols.groupBy("source", "table_key", F.lower("c.name").alias("col_key")).agg(F.max_by("c.name", F.struct("file", "idx", "k")).alias("col_name"), F.max_by("c.type", F.struct("file", "idx", "k")).alias("type"))
    return tables, cols


# Query-schema rules


def query_schema_findings(statements: DataFrame, directives: DataFrame, snap_tables: DataFrame, snap_columns: DataFrame, config: Config) -> DataFrame:
    """VG105 to VG108. snap_tables has (source, table_key, table_name), snap_columns (source, table_key, col_key).

    A statement meets the migration snapshot and that of the models of its engine, each if
    it has tables; equal findings of one statement count once.
    """
    sources = snap_tables.select("source").distinct().withColumnRenamed("source", "src")
    fits = (F.col("src") == "migration") | (F.col("src") == "go") & F.col("engine").isin("go", "goqu") | (F.col("src") == "sqlalchemy") & (F.col("engine") == "sqlalchemy")
    base = statements.where("not fatal and parsed.error is null and size(parsed.tables) > 0")
    # At most three sources exist.
    met = base.join(F.broadcast(sources), fits).select("file", "stmt_idx", "engine", "src", "parsed")
    one = ["file", "stmt_idx", "engine", "src"]
    refs = met.select(*one, F.col("parsed.command").alias("command"), F.posexplode("parsed.tables").alias("pos", "t")).where("t.key <> ''")
    known = snap_tables.select(F.col("source").alias("src"), F.col("table_key").alias("key"), "table_name")
    refs = refs.select(*one, "command", "pos", F.col("t.key").alias("key"), F.col("t.keys").alias("keys"), F.col("t.kind").alias("kind"))
    joined = refs.join(known, ["src", "key"], "left")
    missing = joined.where("table_name is null and kind = 'base'").select(*one, F.lit("VG107").alias("rule_id"), text("table ", quoted(F.col("key")), " referenced in query not found in schema").alias("message"))

    tables = joined.where("table_name is not null")
    by_alias = tables.select(*one, "pos", "key", "table_name", F.explode("keys").alias("alias")).groupBy(*one, "alias").agg(F.max_by(F.struct("key", "table_name"), "pos").alias("t"))
    alone = tables.groupBy(*one).agg(F.min(F.struct("key", "table_name")).alias("t"), F.max("key").alias("other"), F.min("key").alias("lone"))
    uses = met.select(*one, F.col("parsed.command").alias("command"), F.explode("parsed.usages").alias("u")).select(*one, "command", F.col("u.usage").alias("usage"), F.col("u.alias").alias("alias"), F.col("u.col").alias("col")).where("col <> ''").distinct()
    qualified = uses.where("alias <> ''").join(by_alias, [*one, "alias"])
    single = uses.where("alias = ''").join(alone.where("lone = other").drop("lone", "other"), one)
    resolved = qualified.unionByName(single).select(*one, "command", "usage", "col", F.col("t.key").alias("key"), F.col("t.table_name").alias("table_name"))
    columns = snap_columns.select(F.col("source").alias("src"), F.col("table_key").alias("key"), F.col("col_key").alias("col"))
    unknown = resolved.join(columns, ["src", "key", "col"], "left_anti")
    ctx = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])
    vg105 = unknown.where("command = 'SELECT' and usage = 'projection'").select(*one, F.lit("VG105").alias("rule_id"), text("projection column ", quoted(F.col("col")), " not found in table ", quoted(F.col("table_name")), " schema; check SELECT list and schema/model mappings").alias("message"))
    vg106 = unknown.where("command in ('SELECT', 'UPDATE', 'DELETE') and usage in ('filter', 'join', 'group_by', 'order_by')").select(*one, F.lit("VG106").alias("rule_id"), text(ctx[F.col("usage")], " predicate column ", quoted(F.col("col")), " not found in table ", quoted(F.col("table_name")), " schema; check predicate/group/order columns in schema/model mappings").alias("message"))
    distinct = tables.select(*one, "key", "table_name").distinct()
    owned = uses.where(F.col("usage").isin(*CONTEXTS) & (F.col("alias") == "")).join(distinct, one).join(columns, ["src", "key", "col"])
    owners = owned.groupBy(*one, "usage", "col").agg(F.array_sort(F.collect_list("table_name")).alias("names"), F.countDistinct("key").alias("n")).where("n >= 2")
    vg108 = owners.select(*one, F.lit("VG108").alias("rule_id"), text(ctx[F.col("usage")], " column ", quoted(F.col("col")), " is ambiguous across tables ", F.array_join("names", ", "), "; qualify it with a table alias").alias("message"))
    found = vg105.unionByName(vg106).unionByName(missing).unionByName(vg108).drop("src").distinct()
    spots = base.select("file", "stmt_idx", "engine", "sql", "line", "column", "end_line", "end_column")
    full = found.join(spots, ["file", "stmt_idx", "engine"])
    return ranged(suppressed(configured(full, config, ("query_schema",)), directives))


# Drift rules


def drift_findings(models: DataFrame, tables: DataFrame, columns: DataFrame, config: Config) -> DataFrame:
    """VG101 to VG104 and VG109 to VG111, from models and the migration snapshot; none if either is empty. Directives do not apply."""
    go_only = lambda r: [s for s, e in (("go", "go"), ("sqlalchemy", "sqlalchemy")) if config.engines(r) is None or e in config.engines(r)]

    def mine(rule):
        return models.where(F.col("source").isin(go_only(rule))) if config.engines(rule) is not None else models

    def cols(rule):
        return mine(rule).select("file", "idx", "table", F.lower("table").alias("table_key"), F.posexplode("columns").alias("pos", "c")).select("*", F.lower("c.name").alias("col_key"))

    def out(df, rule, message, line="line", file="file"):
        return df.select(F.lit(rule).alias("rule_id"), F.lit(config.severity(rule)).alias("severity"), message.alias("message"), F.col(file).alias("file"), F.col(line).cast("int").alias("line"), F.lit(1).alias("column"), F.lit(0).alias("end_line"), F.lit(0).alias("end_column"), F.lit("").alias("sql"))

    q = lambda c: quoted(F.col(c))
    named = tables.select("table_key", "table_name")
    plans = {}
    plans["VG101"] = lambda: out(cols("VG101").join(named, "table_key").join(columns.select("table_key", "col_key"), ["table_key", "col_key"], "left_anti"), "VG101", text("model ", q("table"), " references column ", q("c.name"), " not found in table ", q("table_name"), " schema; check migration DDL or update model mapping"), "c.line")

    def vg102():
        need = columns.where("not nullable and not has_default").select("table_key", "col_key", "col_name")
        m = mine("VG102").select("file", "idx", "table", "line", F.lower("table").alias("table_key"))
        lack = m.join(named, "table_key").join(need, "table_key").join(cols("VG102").select("file", "idx", "col_key"), ["file", "idx", "col_key"], "left_anti")
        return out(lack, "VG102", text("table ", q("table_name"), " has NOT NULL column ", q("col_name"), " but model ", q("table"), " does not define it; add the field or make the migration column nullable/defaulted"))

    plans["VG102"] = vg102

    def vg103():
        fits = F.create_map(*[x for canon, (_, sql) in TYPES.items() for x in (F.lit(canon), F.array(*map(F.lit, sql.split(","))))])
        kind = F.trim(F.regexp_replace(F.regexp_replace(F.lower("type"), r"\(.*$", ""), r"\s+", " "))
        both = cols("VG103").where("c.type <> ''").join(columns.select("table_key", "col_key", "type"), ["table_key", "col_key"]).withColumn("canon", canonical_type(F.col("c.type")))
        return out(both.where(F.col("canon").isNotNull() & ~F.array_contains(fits[F.col("canon")], kind)), "VG103", text("column ", q("c.name"), " type mismatch: model has ", q("c.type"), " but migration has ", q("type"), "; align model type or migration column type"), "c.line")

    plans["VG103"] = vg103
    plans["VG104"] = lambda: out(mine("VG104").where("table_explicit").withColumn("table_key", F.lower("table")).join(named, "table_key", "left_anti"), "VG104", text("table ", q("table"), " referenced by model has no CREATE TABLE in migrations; add migration DDL or fix TableName()"))

    def vg109():
        m = mine("VG109")
        lone = tables.join(m.select(F.lower("table").alias("table_key")).distinct(), "table_key", "left_anti")
        return out(lone if not m.isEmpty() else lone.where(F.lit(False)), "VG109", text("migration table ", q("table_name"), " has no matching model mapping"))

    plans["VG109"] = vg109

    def vg110():
        w = Window.partitionBy("file", "idx", F.lower(F.trim("c.name"))).orderBy("pos")
        seen = cols("VG110").withColumn("first", F.first("c.field").over(w)).withColumn("nth", F.row_number().over(w))
        return out(seen.where("nth > 1"), "VG110", text("model ", q("table"), " maps column ", q("c.name"), " multiple times (fields ", q("first"), " and ", q("c.field"), ")"), "c.line")

    plans["VG110"] = vg110
    plans["VG111"] = lambda: out(mine("VG111").where("source = 'go' and not table_explicit").where(F.exists("columns", lambda c: c["kind"] == "inferred")), "VG111", text("go model ", q("table"), " uses inferred table/column mapping; prefer explicit TableName()/column mapping"))
    parts = [make() for rule, make in plans.items() if config.enabled(rule)]
    empty = models.sparkSession.createDataFrame([], "rule_id string, severity string, message string, file string, line int, column int, end_line int, end_column int, sql string")
    if not parts or models.isEmpty() or tables.isEmpty():
        return empty
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
