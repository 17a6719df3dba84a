"""Queries over generated lint corpora, and SQL that derives the same rows from the keys without reading any text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from sparrowlint.functions import sqltext
from sparrowlint.operators import rules
from sparrowlint.plans import sinks
from sparrowlint.plans.config import RULES, Config, RuleConfig, exclude_regex, migration_regex
from sparrowlint.plans.lint import ORDER, lint
from sparrowlint.runtime import Workspace
from sparrowlint.sources import files as src

T = "sparrowlint"
QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(files: DataFrame, config: Config | None = None, parsed: bool = True) -> DataFrame:
    config = config or Config()
    return src.statements(src.usable_files(files, config), config, parsed)


def modelled(files: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return src.models(src.usable_files(files, config), config)


# One statement per order, its kind given by the key

TEMPLATES = [
    "SELECT * FROM users WHERE id = {k} LIMIT 5", "SELECT id, email FROM users WHERE id = {k} LIMIT 1", "UPDATE users SET active = false", "UPDATE users SET active = false WHERE 1 = 1", "UPDATE users SET active = false WHERE id = {k}",
    "DELETE FROM users", "DELETE FROM users WHERE (TRUE)", "SELECT id FROM users -- {k}", "SELECT COUNT(*) FROM users", "SELECT COUNT(*) FROM users GROUP BY status",
    "SELECT id FROM users WHERE name LIKE '%{p}' FETCH FIRST 10 ROWS ONLY", "SELECT id FROM users /* {p} */ FOR UPDATE", "SELECT id FROM users WHERE id = {k} FOR UPDATE SKIP LOCKED", "DROP TABLE t_{k}", "ALTER TABLE users DROP COLUMN email",
    "TRUNCATE TABLE users", "CREATE INDEX idx_{k} ON users (email)", "CREATE INDEX CONCURRENTLY i ON users (email)", "-- sparrowlint:disable VG001\nSELECT * FROM users LIMIT 1", "SELECT u.* FROM users u INNER JOIN orders o ON u.id = o.user_id WHERE o.note LIKE '%x'",
]


def filled(templates: list[str], k, p=None):
    """The template that the key picks, its marks replaced."""
    out = F.element_at(F.array(*map(F.lit, templates)), F.pmod(k, F.lit(len(templates))).cast("int") + 1)
    out = F.replace(out, F.lit("{k}"), k.cast("string"))
    return F.replace(out, F.lit("{p}"), p) if p is not None else out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.select(F.concat(F.lit("q/"), F.col("o_orderkey").cast("string"), F.lit(".sql")).alias("path"), filled(TEMPLATES, F.col("o_orderkey"), F.col("o_orderpriority")).alias("content"))


def findings(spark: SparkSession, sf_dir: str, config: Config | None = None) -> DataFrame:
    config, files = config or Config(), corpus(spark, sf_dir)
    return rules.query_findings(scanned(files, config), src.directives(files, config), config)


SHORT = ("rule_id", "severity", "message", "file", "line")
_HITS = [
    ("VG001", "warning", "(0, 19)", "'avoid SELECT *; project only required columns'"),
    ("VG002", "error", "(2, 3)", "'UPDATE without WHERE may affect all rows; add a WHERE clause'"),
    ("VG003", "error", "(5, 6)", "'DELETE without WHERE may affect all rows; add a WHERE clause'"),
    ("VG004", "warning", "(7, 9, 11, 12, 19)", "'SELECT without LIMIT may return unbounded rows; add LIMIT or FETCH FIRST'"),
    ("VG005", "warning", "(10, 19)", "'LIKE/ILIKE with leading wildcard may prevent index usage; use a suffix pattern or full-text search'"),
    ("VG006", "error", "(11)", "'SELECT FOR UPDATE without WHERE may lock too many rows; add a WHERE clause'"),
    ("VG007", "error", "(13, 14, 15)", "'destructive DDL detected: ' || case k % 20 when 13 then 'DROP TABLE t_' || k when 14 then 'DROP COLUMN email' else 'TRUNCATE users' end"),
    ("VG008", "warning", "(16)", "'CREATE INDEX idx_' || k || ' without CONCURRENTLY may block writes; add CONCURRENTLY'"),
]


def _expected(only: str | None = None) -> str:
    parts = [f"select '{r}' rule_id, '{s}' severity, {m} message, 'q/' || k || '.sql' file, 1 line from (select o_orderkey k from orders) where k % 20 in {keys}" for r, s, keys, m in _HITS if only in (None, r)]
    return " union all ".join(parts)


for _r, *_ in _HITS:

    def _one(spark, sf_dir, r=_r):
        config = Config(rules={x: RuleConfig(enabled=False) for x in RULES if x != r})
        return findings(spark, sf_dir, config).select(*SHORT)

    _one.__name__ = f"{_r.lower()}_{RULES[_r].name.replace('-', '_')}"
    query(_expected(_r))(_one)


@query(f"select rule_id, severity, count(*) n from ({_expected()}) group by rule_id, severity")
def findings_summary(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("select 'q/' || o_orderkey || '.sql' file, line, 'VG001' rule from orders, (values (1), (2)) v(line) where o_orderkey % 20 = 18")
def directive_suppression(spark, sf_dir):
    return src.directives(corpus(spark, sf_dir), Config())


@query(f"select rule_id, case when rule_id = 'VG001' then 'info' else severity end severity, count(*) n from ({_expected()}) where rule_id <> 'VG004' group by 1, 2")
def severity_override(spark, sf_dir):
    config = Config(rules={"VG001": RuleConfig(severity="info"), "VG004": RuleConfig(enabled=False)})
    return findings(spark, sf_dir, config).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"select rule_id, count(*) n from ({_expected()}) where rule_id not in ('VG001', 'VG005') group by 1")
def engine_scope(spark, sf_dir):
    config = Config(rules={"VG001": RuleConfig(engines=["go"]), "VG005": RuleConfig(engines=["goqu", "sqlalchemy"]), "VG002": RuleConfig(engines=["sql"]), "VG003": RuleConfig(engines=["all"])})
    return findings(spark, sf_dir, config).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"select rule_id, file, row_number() over (order by file, line, rule_id, message) n from ({_expected()})")
def finding_order(spark, sf_dir):
    # The place in each range partition plus the rows before it: a total order without one task for all rows.
    ws = Workspace(spark, "order")
    # Ranges are drawn from a sample, for which all files would be scanned once more.
    ranged = ws.table(findings(spark, sf_dir).select(*ORDER), "found").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*ORDER, F.spark_partition_id().alias("p"))
    rows = ws.table(ranged, "ranged")
    ws.drop("found")
    before = rows.groupBy("p").agg(F.count("*").alias("c")).withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*ORDER))).join(before, "p").select("rule_id", "file", (F.col("b") + F.col("i")).alias("n"))


# Paths


def _paths(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ["vendor/a/{k}.sql", "src/{k}_gen.sql", "src/{k}.sql", "db/migrations/{k}.sql", "pkg/vendor/x/{k}.go", "migration/{k}.SQL"])), (k % 6).cast("int") + 1)
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.replace(name, F.lit("{k}"), k.cast("string")).alias("path"))


@query("select c_custkey k from customer where c_custkey % 6 in (2, 3, 5)")
def exclude_globs(spark, sf_dir):
    return _paths(spark, sf_dir).where(~F.col("path").rlike(exclude_regex(["vendor/**", "*_gen.sql"]))).select("k")


@query("select c_custkey k from customer where c_custkey % 6 in (3, 5)")
def migration_path_select(spark, sf_dir):
    return _paths(spark, sf_dir).where(F.col("path").rlike(migration_regex([]))).select("k")


# Text functions


@query("""with d as (select doc_id, coalesce(text, '') t from documents), e as (select doc_id, length(t) - length(replace(t, chr(10), '')) nl from d)
  select 'd/' || doc_id || '.sql' file, 0 stmt_idx, 1 line, cast(1 + nl as integer) end_line from e union all
  select 'd/' || doc_id || '.sql', 1, cast(2 + nl as integer), cast(2 + 2 * nl as integer) from e union all
  select 'd/' || doc_id || '.sql', 2, cast(2 + 3 * nl as integer), cast(2 + 3 * nl as integer) from e""")
def split_statements(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit("SELECT $d$"), F.replace(t, F.lit("$"), F.lit("")), F.lit("$d$; -- it's; a comment\nSELECT '"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'; /* ; "), F.regexp_replace(t, "[*/]", ""), F.lit(" */ UPDATE t SET a = 1"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"), body.alias("content"))
    return scanned(files, parsed=False).select("file", "stmt_idx", "line", "end_line")


@F.pandas_udf(StringType())
def _stripped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: sqltext.strip_sql(x, True))


@F.pandas_udf(BooleanType())
def _true(s: pd.Series) -> pd.Series:
    return s.map(sqltext.constant_true)


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    return s.map(sqltext.bare_identifier)


@query("select p_partkey k, 'SELECT  , ' || p_partkey || chr(10) || 'FROM t ' s from part")
def strip_sql(spark, sf_dir):
    ship_first(spark)
    text = F.concat(F.lit("SELECT /* "), F.col("p_name"), F.lit(" /* nested */ */ '"), F.col("p_brand"), F.lit("', "), F.col("p_partkey").cast("string"), F.lit(" -- "), F.col("p_type"), F.lit("\nFROM t $a$ ' $a$"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace(_stripped(text), " +\n", "\n").alias("s"))


@query("select p_partkey k, p_partkey % 7 in (0, 1, 2, 5) hit from part")
def constant_true(spark, sf_dir):
    ship_first(spark)
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("k"), _true(filled(["WHERE {k} = 0{k}", "((TRUE)) -- x", "NOT /* {k} */ FALSE", "id = id", "{k} = {k}1", "HAVING (00{k} = {k})", "FALSE"], p)).alias("hit"))


@query("select n_nationkey k, 'col_' || n_nationkey s from nation")
def identifier_normalize(spark, sf_dir):
    ship_first(spark)
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), _bare(filled(["COL_{k}", ' public."Col_{k}" ', "`col_{k}`", '"a.b".COL_{k}', 'db.s."col_{k}"'], k)).alias("s"))


@query("select o_orderkey k, o_orderkey % 6 in (0, 1, 2) hit from orders")
def looks_like_sql(spark, sf_dir):
    from sparrowlint.sources.gosrc import LOOKS_LIKE_SQL

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), filled([" select {k}", "-- {k}", "WITH x", "selected {k}", "hello", "update_{k}"], k).rlike(LOOKS_LIKE_SQL).alias("hit"))


@query("""select l_orderkey k, l_linenumber n, greatest(l_linenumber - 2, 1) line, greatest(l_linenumber - 4, 1) col,
  greatest(l_linenumber % 3, greatest(l_linenumber - 2, 1)) end_line, case when l_linenumber % 3 > greatest(l_linenumber - 2, 1) then 1 else greatest(l_linenumber - 4, 1) + 1 end end_col from lineitem""")
def range_normalize(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (n - 2).alias("line"), (n - 4).alias("column"), (n % 3).alias("end_line"), F.lit(0).alias("end_column"), F.lit("").alias("sql"), *(F.lit("").alias(c) for c in ("rule_id", "severity", "message")), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("file"))
    out = rules.ranged(rows)
    at = F.split("file", "/")
    return out.select(at[0].cast("long").alias("k"), at[1].cast("int").alias("n"), "line", F.col("column").alias("col"), "end_line", F.col("end_column").alias("end_col"))


def ship_first(spark):
    src.ship(spark)


# Sinks

_SINK = Config(rules={r: RuleConfig(enabled=False) for r in RULES if r not in ("VG002", "VG008")})
_SINK_ROWS = """select k, case when k % 20 = 16 then 'VG008' else 'VG002' end r, case when k % 20 = 16 then 'warning' else 'error' end s,
  case when k % 20 = 16 then 'CREATE INDEX idx_' || k || ' without CONCURRENTLY may block writes; add CONCURRENTLY' else 'UPDATE without WHERE may affect all rows; add a WHERE clause' end m,
  case when k % 20 = 16 then 'CREATE INDEX idx_' || k || ' ON users (email)' when k % 20 = 2 then 'UPDATE users SET active = false' else 'UPDATE users SET active = false WHERE 1 = 1' end q
  from (select o_orderkey k from orders) where k % 20 in (2, 3, 16)"""


@query(f"select 'q/' || k || '.sql:1: ' || s || ' [' || r || '] ' || m || chr(10) || '    ' || q as text from ({_SINK_ROWS})")
def terminal_sink(spark, sf_dir):
    ship_first(spark)
    return sinks.terminal_lines(findings(spark, sf_dir, _SINK)).select("text")


@query(f"""select '{{"source":{{"name":"sparrowlint","url":""}},"severity":"' || upper(s) || '","code":{{"value":"' || r || '"}},"message":"' || r || ': ' || m || ' | Query: `' || q || '`","location":{{"path":"q/' || k
  || '.sql","range":{{"start":{{"line":1,"column":1}},"end":{{"line":1,"column":' || (length(q) + 1) || '}}}}}}}}' as text from ({_SINK_ROWS})""")
def rdjsonl_sink(spark, sf_dir):
    ship_first(spark)
    return sinks.rdjsonl_lines(findings(spark, sf_dir, _SINK)).select("text")


@query(f"""select '{{"rule_id":"' || r || '","severity":"' || s || '","message":"' || m || '","file":"q/' || k || '.sql","line":1,"column":1,"end_line":1,"end_column":' || (length(q) + 1) || ',"sql":"' || q || '"}}' as text from ({_SINK_ROWS})""")
def json_sink(spark, sf_dir):
    return sinks.json_entries(findings(spark, sf_dir, _SINK)).select("text")


@query(f"""select '{{"ruleId":"' || r || '","level":"' || s || '","message":{{"text":"' || m || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"q/' || k
  || '.sql","uriBaseId":"%SRCROOT%"}},"region":{{"startLine":1,"startColumn":1,"endLine":1,"endColumn":' || (length(q) + 1) || '}}}}}}]}}' as text from ({_SINK_ROWS})""")
def sarif_sink(spark, sf_dir):
    return sinks.sarif_results(findings(spark, sf_dir, _SINK)).select("text")


@query(f"select rule_id, row_number() over (order by min(file)) n from ({_expected()}) where rule_id not in ('VG004', 'VG006') group by rule_id")
def sarif_rule_order(spark, sf_dir):
    config = Config(rules={r: RuleConfig(enabled=False) for r in ("VG004", "VG006")})
    return sinks.sarif_rules(findings(spark, sf_dir, config)).select("rule_id", F.row_number().over(Window.orderBy("first")).alias("n"))


# Query-schema rules

_SCHEMA = [
    "SELECT users.id, users.eitam FROM users LIMIT {k}", "SELECT id, eitam FROM users", "SELECT id FROM users WHERE users.eitam = {k}", "SELECT users.id FROM users JOIN orders ON users.eitam = orders.user_id WHERE users.bad > {k}",
    "SELECT users.id FROM users JOIN ghost_{k} g ON g.id = users.id", "SELECT id FROM users u INNER JOIN orders o ON u.id = o.user_id WHERE u.id = {k}", "WITH q AS (SELECT id FROM users) SELECT id FROM q", "UPDATE users SET email = 'x' WHERE nope = {k} AND nope > 0",
]
_MIGRATION = "CREATE TABLE users (id INT PRIMARY KEY, email TEXT NOT NULL);\nCREATE TABLE orders (id INT, user_id INT);"
_SCHEMA_HITS = {
    "VG105": ("error", [("(0, 1)", "'projection column \"eitam\" not found in table \"users\" schema; check SELECT list and schema/model mappings'")]),
    "VG106": ("error", [(k, f"'{ctx} predicate column \"{c}\" not found in table \"users\" schema; check predicate/group/order columns in schema/model mappings'") for k, ctx, c in (("(2)", "filter", "eitam"), ("(3)", "join", "eitam"), ("(3)", "filter", "bad"), ("(7)", "filter", "nope"))]),
    "VG107": ("error", [("(4)", "'table \"ghost_' || k || '\" referenced in query not found in schema'")]),
    "VG108": ("warning", [("(5)", "'projection column \"id\" is ambiguous across tables orders, users; qualify it with a table alias'")]),
}


def _schema_files(spark, sf_dir):
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("s/"), k.cast("string"), F.lit(".sql")).alias("path"), filled(_SCHEMA, k).alias("content"))
    return own.unionByName(spark.createDataFrame([("migrations/1.sql", _MIGRATION)], "path string, content string"))


def _schema_sql(rule: str) -> str:
    sev, hits = _SCHEMA_HITS[rule]
    return " union all ".join(f"select '{rule}' rule_id, '{sev}' severity, {m} message, 's/' || k || '.sql' file, 1 line from (select c_custkey k from customer) where k % 8 in {keys}" for keys, m in hits)


for _r in _SCHEMA_HITS:

    def _schema(spark, sf_dir, r=_r):
        config = Config(rules={x: RuleConfig(enabled=False) for x in RULES if x != r})
        return lint(_schema_files(spark, sf_dir), config).findings.select(*SHORT)

    _schema.__name__ = f"{_r.lower()}_{RULES[_r].name.replace('-', '_')}"
    query(_schema_sql(_r))(_schema)


@query("select 'VG106' rule_id, 's/' || c_custkey || '.sql' file, count(*) n from customer, (values (1), (2)) v(x) where c_custkey % 8 = 3 or c_custkey % 8 in (2, 7) and x = 1 group by 1, 2")
def finding_dedup(spark, sf_dir):
    config = Config(rules={x: RuleConfig(enabled=False) for x in RULES if x != "VG106"})
    return lint(_schema_files(spark, sf_dir), config).findings.groupBy("rule_id", "file").agg(F.count("*").alias("n"))


@query("""select 's/' || k || '.sql' file, replace(t.alias, '#', k::varchar) alias, replace(t.tbl, '#', k::varchar) tbl from (select c_custkey k from customer), (values
    (0, 'users', 'users'), (1, 'users', 'users'), (2, 'users', 'users'), (3, 'users', 'users'), (3, 'orders', 'orders'), (4, 'users', 'users'), (4, 'ghost_#', 'ghost_#'), (4, 'g', 'ghost_#'),
    (5, 'u', 'users'), (5, 'users', 'users'), (5, 'o', 'orders'), (5, 'orders', 'orders'), (6, 'q', 'q'), (7, 'users', 'users')) t(m, alias, tbl) where k % 8 = m""")
def alias_resolution(spark, sf_dir):
    st = scanned(_schema_files(spark, sf_dir)).where("file like 's/%'").select("file", F.posexplode("parsed.tables").alias("pos", "t"))
    return st.select("file", F.explode("t.keys").alias("alias"), F.col("t.key").alias("tbl"), "pos").groupBy("file", "alias").agg(F.max_by("tbl", "pos").alias("tbl"))


# DDL snapshots

_DDL = """select k, k % 2 <> 0 or k % 4 = 0 alive, k % 4 = 0 again from (select c_custkey k from customer)"""


def _ddl(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda cond, s: F.when(cond, F.replace(F.lit(s), F.lit("{k}"), k.cast("string"))).otherwise("")
    body = F.concat(part(F.lit(True), "CREATE TABLE A{k} (x int NOT NULL, y varchar(20) DEFAULT 'a');\n"), part(k % 2 == 0, "DROP TABLE a{k};\n"), part(k % 4 == 0, "CREATE TABLE IF NOT EXISTS public.a{k} (z bigserial PRIMARY KEY);\n"), part(k % 3 == 0, "ALTER TABLE a{k} ADD COLUMN W int;\n"), part(k % 5 == 0, "ALTER TABLE a{k} DROP COLUMN X;\n"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("migrations/"), k.cast("string"), F.lit(".sql")).alias("path"), body.alias("content"))
    return rules.migration_snapshot(scanned(files), Config(bare_add_column=False))


@query(f"select 'a' || k table_key, case when again then 'a' else 'A' end || k table_name, 'migrations/' || k || '.sql' file, case when again then 3 else 1 end line from ({_DDL}) where alive")
def ddl_snapshot_tables(spark, sf_dir):
    return _ddl(spark, sf_dir)[0]


@query(f"""select 'a' || k table_key, c.n col_key, c.t "type", c.nu nullable, c.d has_default from ({_DDL}) d,
  (values ('x', 'int', false, false), ('y', 'varchar(20)', true, true), ('z', 'bigserial', false, false), ('w', 'int', true, false)) c(n, t, nu, d)
  where alive and (c.n = 'z' and again or c.n = 'w' and k % 3 = 0 or c.n = 'y' and not again or c.n = 'x' and not again and k % 5 <> 0)""")
def ddl_snapshot_columns(spark, sf_dir):
    return _ddl(spark, sf_dir)[1].select("table_key", "col_key", "type", "nullable", "has_default")


# Drift rules: a migration and a Go model per supplier


def _lines(k, parts) -> F.Column:
    return F.concat(*[F.when(cond, F.replace(F.lit(s), F.lit("{k}"), k.cast("string"))).otherwise("") for cond, s in parts])


def _drift_files(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    sql = s.where(k % 10 != 9).select(F.concat(F.lit("migrations/"), k.cast("string"), F.lit(".sql")).alias("path"), F.replace(F.lit("CREATE TABLE t{k} (id bigint PRIMARY KEY, name text NOT NULL, amount numeric(10,2), extra timestamptz NOT NULL DEFAULT now())"), F.lit("{k}"), k.cast("string")).alias("content"))
    yes = F.lit(True)
    go = s.where(k % 10 != 8).select(F.concat(F.lit("m/"), k.cast("string"), F.lit(".go")).alias("path"), _lines(k, [(yes, "package m\n\ntype T{k} struct {\n\tID int64 `db:\"id\"`\n"), (k % 4 == 2, '\tName int `db:"name"`\n'), ((k % 4 != 2) & (k % 4 != 1), '\tName *string `gorm:"column:name;size:9"`\n'), (k % 5 == 0, '\tGone string `db:"gone"`\n'), (k % 7 == 0, '\tLegacyID int64 `db:"id"`\n'), (k % 6 == 0, "\tAmount float64\n"), (yes, "}\n"), (k % 3 != 0, 'func (t *T{k}) TableName() string {\n\treturn "t{k}"\n}\n')]).alias("content"))
    return sql.unionByName(go)


_HAS = "k % 10 <> 8"
_BOTH = "k % 10 not in (8, 9)"
_DRIFT = {
    "VG101": ("error", f"{_BOTH} and k % 5 = 0", "'model \"' || t || '\" references column \"gone\" not found in table \"t' || k || '\" schema; check migration DDL or update model mapping'"),
    "VG102": ("warning", f"{_BOTH} and k % 4 = 1", "'table \"t' || k || '\" has NOT NULL column \"name\" but model \"' || t || '\" does not define it; add the field or make the migration column nullable/defaulted'"),
    "VG103": ("warning", f"{_BOTH} and k % 4 = 2", "'column \"name\" type mismatch: model has \"int\" but migration has \"text\"; align model type or migration column type'"),
    "VG104": ("error", "k % 10 = 9 and k % 3 <> 0", "'table \"' || t || '\" referenced by model has no CREATE TABLE in migrations; add migration DDL or fix TableName()'"),
    "VG109": ("warning", "k % 10 = 8", "'migration table \"t' || k || '\" has no matching model mapping'"),
    "VG110": ("warning", f"{_HAS} and k % 7 = 0", "'model \"' || t || '\" maps column \"id\" multiple times (fields \"ID\" and \"LegacyID\")'"),
    "VG111": ("warning", f"{_HAS} and k % 6 = 0", "'go model \"' || t || '\" uses inferred table/column mapping; prefer explicit TableName()/column mapping'"),
}


for _r, (_s, _w, _m) in _DRIFT.items():

    def _drift(spark, sf_dir, r=_r):
        config = Config(mapping_mode="balanced", rules={x: RuleConfig(enabled=False) for x in RULES if x != r})
        return lint(_drift_files(spark, sf_dir), config).findings.select("rule_id", "severity", "message", "file")

    _drift.__name__ = f"{_r.lower()}_{RULES[_r].name.replace('-', '_')}"
    _f = "'migrations/' || k || '.sql'" if _r == "VG109" else "'m/' || k || '.go'"
    query(f"select '{_r}' rule_id, '{_s}' severity, {_m} message, {_f} file from (select s_suppkey k, 't' || s_suppkey t from supplier) where {_w}")(_drift)


@query("""select 'go' source, 't' || k table_key, c.n col_key, case when c.n = 'id' then 'int64' when c.n = 'name' and k % 4 = 2 then 'int' when c.n in ('name', 'gone') then 'string' else 'float64' end "type"
  from (select s_suppkey k from supplier), (values ('id'), ('name'), ('gone'), ('amount')) c(n)
  where k % 10 <> 8 and (c.n = 'id' or c.n = 'name' and k % 4 <> 1 or c.n = 'gone' and k % 5 = 0 or c.n = 'amount' and k % 6 = 0)""")
def model_snapshot_merge(spark, sf_dir):
    found = modelled(_drift_files(spark, sf_dir), Config(mapping_mode="balanced"))
    return rules.model_snapshot(found)[1].select("source", "table_key", "col_key", "type")


@query("""select 'm/' || k || '.go' file, 't' || k "table", k % 3 <> 0 table_explicit, c.n name, c.f field, case when c.n = 'amount' then 'inferred' else 'explicit' end kind
  from (select s_suppkey k from supplier), (values ('id', 'ID'), ('name', 'Name'), ('gone', 'Gone'), ('id', 'LegacyID'), ('amount', 'Amount')) c(n, f)
  where k % 10 <> 8 and (c.f = 'ID' or c.f = 'Name' and k % 4 <> 1 or c.f = 'Gone' and k % 5 = 0 or c.f = 'LegacyID' and k % 7 = 0 or c.f = 'Amount' and k % 6 = 0)""")
def go_models(spark, sf_dir):
    found = modelled(_drift_files(spark, sf_dir), Config(mapping_mode="balanced"))
    return found.select("file", "table", "table_explicit", F.explode("columns").alias("c")).select("file", "table", "table_explicit", "c.name", "c.field", "c.kind")


# Source extractors


def _supplier_file(spark, sf_dir, folder, ext, parts):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit(folder), k.cast("string"), F.lit(ext)).alias("path"), _lines(k, parts).alias("content"))


@query("""select 'g/' || s_suppkey || '.go' file, 'go' engine, line, sql from supplier, (values (6, 'SELECT * FROM t WHERE id = ')) v(line, sql0), lateral (select sql0 || s_suppkey as sql)
  union all select 'g/' || s_suppkey || '.go', 'go', 7, 'DELETE FROM t' from supplier where s_suppkey % 2 = 0""")
def go_dbcall_extract(spark, sf_dir):
    yes, k = F.lit(True), F.col("s_suppkey")
    files = _supplier_file(spark, sf_dir, "g/", ".go", [(yes, 'package g\n\nimport "database/sql"\n\nfunc f(db *sql.DB) {\n\tdb.Query("SELECT * FROM t WHERE id = {k}", 1)\n'), (k % 2 == 0, "\tdb.ExecContext(ctx, `DELETE FROM t`)\n"), (yes, '\tdb.Exec("not sql {k}")\n\tdb.Query(q, "SELECT 1")\n}\n')])
    return scanned(files, parsed=False).select("file", "engine", "line", "sql")


@query(f"""select 'g/' || s_suppkey || '.go' file, 'goqu' engine, '/* {T}:synthetic goqu-ast */ SELECT id, name FROM t' || s_suppkey || ' LEFT JOIN o ON 1=1 WHERE email LIKE ''%x'' AND a = ' || s_suppkey || ' LIMIT 7' as sql from supplier
  union all select 'g/' || s_suppkey || '.go', 'goqu', '/* {T}:synthetic goqu-ast */ UPDATE t SET synthetic_col = 1 WHERE 1=1' from supplier where s_suppkey % 3 = 0
  union all select 'g/' || s_suppkey || '.go', 'goqu', 'DROP TABLE x' || s_suppkey from supplier where s_suppkey % 2 = 0""")
def goqu_extract(spark, sf_dir):
    yes, k = F.lit(True), F.col("s_suppkey")
    files = _supplier_file(spark, sf_dir, "g/", ".go", [(yes, 'package g\n\nimport gq "github.com/doug-martin/goqu/v9"\n\nfunc f() {\n\tgq.From("t{k}").Select("id", gq.C("name")).LeftJoin(gq.T("o"), gq.On(x)).Where(gq.C("email").Like("%x"), gq.Ex{"a": {k}}).Limit(7).ToSQL()\n'), (k % 3 == 0, '\tgq.Update("t").Where(gq.Or(a, b))\n'), (k % 2 == 0, '\tgq.L("DROP TABLE x{k}")\n'), (yes, "}\n")])
    return scanned(files, parsed=False).select("file", "engine", "sql")


@query(f"""select 'p/' || s_suppkey || '.py' file, 2 line, '/* {T}:synthetic sqlalchemy-ast */ SELECT * FROM "users" WHERE "users"."email" LIKE ''%x' || s_suppkey || ''' LIMIT ' || s_suppkey as sql from supplier
  union all select 'p/' || s_suppkey || '.py', 3, 'DELETE FROM t' || s_suppkey from supplier where s_suppkey % 2 = 0
  union all select 'p/' || s_suppkey || '.py', 4, '/* {T}:synthetic sqlalchemy-ast */ DELETE FROM "users" WHERE ("users"."id" = ' || s_suppkey || ' OR "users"."n" <> NULL)' from supplier where s_suppkey % 2 = 0""")
def sqlalchemy_extract(spark, sf_dir):
    yes, k = F.lit(True), F.col("s_suppkey")
    files = _supplier_file(spark, sf_dir, "p/", ".py", [(yes, "import sqlalchemy\nsession.query(User).filter(User.email.endswith('x{k}')).limit({k}).all()\n"), (k % 2 == 0, 'conn.execute(text("DELETE FROM t{k}"))\nsession.query(User).filter(or_ or (User.id == {k} or User.n != None)).delete()\n')])
    files = files.withColumn("content", F.replace("content", F.lit("or_ or "), F.lit("")))
    model = spark.createDataFrame([("p/models.py", "import sqlalchemy\nclass User(Base):\n    __tablename__ = 'users'\n")], "path string, content string")
    return scanned(files.unionByName(model), parsed=False).select("file", "line", "sql")


@query("""select 'p/' || s_suppkey || '.py' file, 't' || s_suppkey "table", c.n name, c.t "type", c.l line from supplier, (values ('id', 'Integer', 3), ('mail', 'String(255)', 4), ('nick', 'str', 5)) c(n, t, l) where c.n <> 'nick' or s_suppkey % 2 = 0""")
def sqlalchemy_models(spark, sf_dir):
    yes, k = F.lit(True), F.col("s_suppkey")
    files = _supplier_file(spark, sf_dir, "p/", ".py", [(yes, 'class A(Base):\n    __tablename__ = "t{k}"\n    id = Column(Integer, primary_key=True)\n    email = mapped_column("mail", String(255))\n'), (k % 2 == 0, "    nick: Mapped[str] = mapped_column()\n")])
    return modelled(files).select("file", "table", F.explode("columns").alias("c")).select("file", "table", "c.name", "c.type", "c.line")


@query("select p_partkey k, case p_partkey % 7 when 0 then 'string' when 1 then 'integer' when 2 then 'float' when 3 then 'timestamp' when 4 then 'boolean' when 5 then null else 'integer' end canon from part")
def type_normalize(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), rules.canonical_type(filled(["String({k})", "*int64", "[]float64", "time.Time", "sql.NullBool", "Blob{k}", " BigInt "], k)).alias("canon"))



# Files, engines and what falls back


@query("select 'd/' || c_custkey || '.sql' file, count(*) n from customer group by 1")
def file_dedup(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("d/"), k, F.lit(".sql")).alias("path"), F.concat(F.lit("SELECT "), k).alias("content"))
    return scanned(files.unionByName(files), parsed=False).groupBy("file").agg(F.count("*").alias("n"))


@query("""select 'x/' || s_suppkey || e.ext file, e.engine, e.n from supplier, (values ('.sql', 'sql', 1), ('.SQL', 'sql', 1), ('.go', 'go', 1), ('.py', 'sqlalchemy', 1)) e(ext, engine, n)""")
def scanner_selection(spark, sf_dir):
    kinds = [(".sql", "SELECT {k}"), (".SQL", "SELECT {k}"), (".go", 'package g\n\nfunc f() {\n\tdb.Query("SELECT {k}")\n}\n'), (".py", 'import sqlalchemy\nconn.execute(text("SELECT {k}"))\n'), (".txt", "SELECT {k}"), (".GO", 'package g\n\nfunc f() {\n\tdb.Query("SELECT {k}")\n}\n'), ("", "SELECT {k}")]
    k = F.col("s_suppkey").cast("string")
    each = table(spark, sf_dir, "supplier").select(k.alias("k"), F.explode(F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(c).alias("body")) for e, c in kinds])).alias("e"))
    files = each.select(F.concat(F.lit("x/"), "k", "e.ext").alias("path"), F.replace("e.body", F.lit("{k}"), F.col("k")).alias("content"))
    return scanned(files, parsed=False).groupBy("file", "engine").agg(F.count("*").cast("int").alias("n"))


@query("""select 'e/' || c_custkey || '.sql' file, s.i stmt_idx, replace(s.t, '#', c_custkey::varchar) as sql from customer, (values (0, 'SELECT E''it\\''s; ' || chr(92) || chr(92) || '#'''), (1, 'SELECT ''back\\'''), (2, 'SELECT #')) s(i, t)""")
def escape_strings(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    body = F.replace(F.lit("SELECT E'it\\'s; \\\\#'; SELECT 'back\\'; SELECT #;"), F.lit("#"), k)
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("e/"), k, F.lit(".sql")).alias("path"), body.alias("content"))
    return scanned(files, parsed=False).select("file", "stmt_idx", "sql")


@query("""select 'r/' || c_custkey || '.sql' file, 2 line, 1 "column", 4 end_line, 13 + length(c_custkey::varchar) end_column from customer""")
def range_fill(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("r/"), k, F.lit(".sql")).alias("path"), F.concat(F.lit("\nUPDATE users\n\nSET score = "), k, F.lit(" ;\nSELECT 1")).alias("content"))
    config = Config()
    return rules.query_findings(scanned(files), src.directives(files, config), config).select("file", "line", "column", "end_line", "end_column")


@query("""select 'g/' || s_suppkey || '.go' file, 'goqu query builder' origin from supplier union all
  select 'p/' || s_suppkey || '.py', 'SQLAlchemy query builder' from supplier union all select 'q/' || s_suppkey || '.sql', 'synthetic query builder' from supplier union all select 'r/' || s_suppkey || '.sql', '' from supplier""")
def origin_labels(spark, sf_dir):
    yes = F.lit(True)
    files = _supplier_file(spark, sf_dir, "g/", ".go", [(yes, 'package g\n\nimport gq "github.com/doug-martin/goqu/v9"\n\nfunc f() {\n\tgq.Delete("t{k}")\n}\n')])
    files = files.unionByName(_supplier_file(spark, sf_dir, "p/", ".py", [(yes, "import sqlalchemy\nsession.query(User{k}).delete()\n")]))
    files = files.unionByName(_supplier_file(spark, sf_dir, "q/", ".sql", [(yes, "/* other:synthetic some-builder */ DELETE FROM t{k}")])).unionByName(_supplier_file(spark, sf_dir, "r/", ".sql", [(yes, "DELETE FROM t{k}")]))
    lines = sinks.rdjsonl_lines(rules.query_findings(scanned(files), src.directives(files, Config()), Config()))
    message = F.get_json_object("text", "$.message")
    return lines.select("file", F.regexp_extract(message, r"\| Origin: ([^|]*) \|", 1).alias("origin"))


def _engine_files(spark, sf_dir):
    yes, k = F.lit(True), F.col("s_suppkey")
    files = _supplier_file(spark, sf_dir, "g/", ".go", [(yes, 'package g\n\nfunc f() {\n\tdb.Query("SELECT id FROM t{k} LIMIT 1")\n}\n')])
    files = files.unionByName(_supplier_file(spark, sf_dir, "p/", ".py", [(yes, 'import sqlalchemy\nconn.execute(text("SELECT id FROM t{k} LIMIT 1"))\n')]))
    files = files.unionByName(_supplier_file(spark, sf_dir, "q/", ".sql", [(yes, "SELECT id FROM t{k} LIMIT 1")]))
    go = _supplier_file(spark, sf_dir, "m/", ".go", [(yes, 'package m\n\ntype T{k} struct {\n\tID int64 `db:"id"`\n}\n\nfunc (T{k}) TableName() string { return "t{k}" }\n')])
    py = _supplier_file(spark, sf_dir, "o/", ".py", [(yes, "class T{k}(Base):\n    __tablename__ = 't{k}'\n    id = Column(Integer)\n")])
    number = lambda c: F.regexp_extract(c, r"/(\d+)\.", 1).cast("long")
    return files.unionByName(go.where(number("path") % 2 == 0)).unionByName(py.where(number("path") % 3 == 0))


@query("select 'VG107' rule_id, 'g/' || s_suppkey || '.go' file from supplier where s_suppkey % 2 <> 0 union all select 'VG107', 'p/' || s_suppkey || '.py' from supplier where s_suppkey % 3 <> 0")
def engine_snapshots(spark, sf_dir):
    # Statements meet the models of their own engine only; plain SQL meets migrations, of which there are none.
    config = Config(rules={r: RuleConfig(enabled=False) for r in RULES if r != "VG107"})
    return lint(_engine_files(spark, sf_dir), config).findings.select("rule_id", "file")


@query("select 'm/' || s_suppkey || '.go' file, 'go' source, 't' || s_suppkey \"table\" from supplier where s_suppkey % 2 = 0 union all select 'o/' || s_suppkey || '.py', 'sqlalchemy', 't' || s_suppkey from supplier where s_suppkey % 3 = 0")
def models_of_both_sources(spark, sf_dir):
    return modelled(_engine_files(spark, sf_dir)).select("file", "source", "table")


@query("select 'a' || c_custkey table_key from customer union all select 'b' || c_custkey from customer where c_custkey % 2 = 0")
def migration_fallback(spark, sf_dir):
    k = F.col("c_custkey")
    body = F.concat(F.lit("CREATE TABLE a"), k.cast("string"), F.lit(" (x int);"), F.when(k % 2 == 0, F.concat(F.lit("\nCREATE TABLE b"), k.cast("string"), F.lit(" (x int)"))).otherwise(""))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("schema/"), k.cast("string"), F.lit(".sql")).alias("path"), body.alias("content"))
    ws = Workspace(spark, "fallback")
    found = ws.table(scanned(files), "statements")
    return rules.migration_snapshot(rules.migration_statements(found, migration_regex([])), Config())[0].select("table_key")


@query("select 'drift without models' kind, 0 n union all select 'drift without migrations', 0")
def drift_guards(spark, sf_dir):
    files, config = _drift_files(spark, sf_dir), Config(mapping_mode="balanced", rules={r: RuleConfig(enabled=RULES[r].kind == "drift") for r in RULES})
    sides = (("drift without models", ".sql"), ("drift without migrations", ".go"))
    counts = [lint(files.where(F.col("path").endswith(ext)), config).findings.agg(F.lit(kind).alias("kind"), F.count("*").cast("int").alias("n")) for kind, ext in sides]
    return counts[0].unionByName(counts[1])


@query("select 'p/' || s_suppkey || '.py' file, 2 line, 'SELECT ' || s_suppkey as sql from supplier")
def statement_dedup(spark, sf_dir):
    files = _supplier_file(spark, sf_dir, "p/", ".py", [(F.lit(True), 'import sqlalchemy\na.execute(text("SELECT {k}")), a.execute(text("SELECT {k}"))\n')])
    return scanned(files, parsed=False).select("file", "line", "sql")


@query(ORACLES["rdjsonl_sink"])
def rdjsonl_files(spark, sf_dir):
    ship_first(spark)
    path = Workspace(spark, "report").at("rdjsonl")
    sinks.write_lines(findings(spark, sf_dir, _SINK), "rdjsonl", path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query("""select p_partkey k, '"' || replace(replace(replace(replace(p_name, ' ', '\\t'), 'a', '\\"'), 'e', '\\x01'), 'o', '\\u200b') || p_partkey || '\\\\"' q from part""")
def go_quoting(spark, sf_dir):
    text = F.concat(F.replace(F.replace(F.replace(F.replace("p_name", F.lit(" "), F.lit("\t")), F.lit("a"), F.lit('"')), F.lit("e"), F.lit("\x01")), F.lit("o"), F.lit("​")), F.col("p_partkey").cast("string"), F.lit("\\"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rules.quoted(text).alias("q"))
