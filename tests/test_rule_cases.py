"""What each rule finds: the published behaviour, case by case, all statements in one run per rule set."""

import pytest

from sparrowlint.plans.config import RULES, Config, RuleConfig
from sparrowlint.plans.lint import lint
from sparrowlint.sources import files as src

M = "members"
QUERY = {
    "VG001": [(f"SELECT * FROM {M} LIMIT 1", 1), (f"SELECT m.* FROM {M} m LIMIT 1", 1), (f"SELECT id, mail FROM {M} LIMIT 1", 0), (f"SELECT COUNT(*) FROM {M}", 0), (f"SELECT * FROM (SELECT id FROM {M}) s LIMIT 1", 1)],
    "VG002": [(f"UPDATE {M} SET a = 1{w}", n) for w, n in (("", 1), (" WHERE id = 1", 0), (" WHERE 1 = 1", 1), (" WHERE (TRUE)", 1), (" WHERE id IN (SELECT id FROM gone)", 0), (" WHERE 0 = 0", 1), (" WHERE 1 = 1 AND id = 1", 0))],
    "VG003": [(f"DELETE FROM {M}{w}", n) for w, n in (("", 1), (" WHERE id = 1", 0), (" WHERE 1 = 1", 1), (" WHERE (TRUE)", 1), (" WHERE id IN (SELECT id FROM gone)", 0), (" WHERE 1 = 1 AND id = 1", 0))],
    "VG004": [(f"SELECT {c} FROM {M}{t}", n) for c, t, n in (("id", "", 1), ("id", " LIMIT 10", 0), ("id", " FETCH FIRST 10 ROWS ONLY", 0), ("COUNT(*)", "", 0), ("COUNT(*), MAX(id)", "", 0), ("COUNT(*)", " GROUP BY kind", 1), ("(COUNT(*))", "", 0))] + [("SELECT 1", 0)],
    "VG005": [(f"SELECT id FROM {M} WHERE nick {p} LIMIT 1", n) for p, n in (("LIKE '%abc'", 1), ("ILIKE '%abc'", 1), ("NOT LIKE '%abc'", 1), ("LIKE 'abc%'", 0), ("LIKE 'abc'", 0))],
    "VG006": [
        (f"SELECT id FROM {M} FOR UPDATE", 1), (f"SELECT id FROM {M} WHERE id = 1 FOR UPDATE", 0), (f"SELECT id FROM {M} FOR SHARE", 0), (f"SELECT id FROM {M} -- FOR UPDATE", 0), (f"SELECT id FROM {M} /* FOR UPDATE */", 0), (f'SELECT 1 AS "FOR UPDATE" FROM {M}', 0), (f"SELECT 'FOR UPDATE' FROM {M}", 0),
        (f"SELECT id FROM {M} /* why */ FOR UPDATE", 1), (f"SELECT id FROM {M} FOR UPDATE LIMIT 1", 0), (f"SELECT id FROM {M} FOR UPDATE SKIP LOCKED LIMIT 1", 0), (f"SELECT id FROM {M} FOR UPDATE SKIP LOCKED", 1), (f"SELECT id FROM {M} WHERE 1 = 1 FOR UPDATE", 1), (f"SELECT id FROM {M} WHERE TRUE FOR UPDATE", 1), (f"SELECT id FROM {M} WHERE 1 = 1 AND id = 5 FOR UPDATE", 0),
    ],
    "VG007": [(f"DROP TABLE {M}", 1), (f"TRUNCATE TABLE {M}", 1), (f"ALTER TABLE {M} DROP COLUMN mail", 1), (f"CREATE INDEX i ON {M} (mail)", 0)],
    "VG008": [(f"CREATE INDEX i ON {M} (mail)", 1), (f"CREATE INDEX CONCURRENTLY i ON {M} (mail)", 0), (f"CREATE UNIQUE INDEX CONCURRENTLY i ON {M} (mail)", 0), ("DROP INDEX i", 0)],
}
TABLES = "CREATE TABLE members (id integer, mail text);\nCREATE TABLE bills (id integer, member_id integer);"
JOIN = "FROM members m INNER JOIN bills b ON m.id = b.member_id"
SCHEMA = {
    "VG105": [("SELECT members.id, members.liam FROM members", 1), ("SELECT id, liam FROM members", 1), (f"SELECT liam {JOIN}", 0), ("SELECT * FROM members", 0), ('SELECT "Member".liam FROM "Member"', 0), ("UPDATE members SET mail = 'x' WHERE id = 1", 0)],
    "VG106": [
        ("SELECT id FROM members WHERE members.liam = 1", 1), ("SELECT members.id FROM members JOIN bills ON members.liam = bills.member_id", 1), ("SELECT members.id FROM members JOIN bills ON members.liam = bills.member_id WHERE members.bad = 1", 2), (f"SELECT m.id {JOIN} WHERE liam = 1", 0),
        ("SELECT id FROM members WHERE mail = 'x'", 0), ("UPDATE members SET mail = 'x' WHERE liam = 1", 1), ("DELETE FROM members WHERE liam = 1", 1), ("INSERT INTO members (id) VALUES (1)", 0),
    ],
    "VG107": [("SELECT members.id FROM members JOIN phantom p ON p.id = members.id", 1), ("SELECT id FROM members", 0), ("WITH q AS (SELECT id FROM members) SELECT id FROM q", 0), ('SELECT id FROM "Member"', 1)],
    "VG108": [(f"SELECT id {JOIN}", 1), (f"SELECT m.id {JOIN}", 0), (f"SELECT m.id {JOIN} WHERE mail = 'x'", 0), ("SELECT id FROM members WHERE id = 1", 0)],
}


def only(rule):
    return Config(mapping_mode="balanced", rules={r: RuleConfig(enabled=r == rule) for r in RULES})


def counted(spark, cases, more=(), config=None):
    rows = [(f"{n:03d}.sql", sql) for n, (sql, _) in enumerate(cases)] + list(more)
    found = lint(spark.createDataFrame(rows, "path string, content string"), config, strict=False).findings.groupBy("rule_id", "file").count().collect()
    return {(r.rule_id, r.file): r["count"] for r in found}


def test_query_rules(spark):
    cases = [(rule, sql, n) for rule, some in QUERY.items() for sql, n in some]
    got = counted(spark, [c[1:] for c in cases], config=Config(rules={r: RuleConfig(enabled=RULES[r].kind == "query") for r in RULES}))
    assert [(rule, sql, got.get((rule, f"{k:03d}.sql"), 0)) for k, (rule, sql, _) in enumerate(cases)] == cases


def test_query_schema_rules(spark):
    cases = [(rule, sql, n) for rule, some in SCHEMA.items() for sql, n in some]
    got = counted(spark, [c[1:] for c in cases], [("migrations/1.sql", TABLES)], Config(rules={r: RuleConfig(enabled=RULES[r].kind == "query_schema") for r in RULES}))
    assert [(rule, sql, got.get((rule, f"{k:03d}.sql"), 0)) for k, (rule, sql, _) in enumerate(cases)] == cases


def test_unknown_table_is_named_in_lower_case(spark):
    files = spark.createDataFrame([("a.sql", 'SELECT id FROM "Member"'), ("migrations/1.sql", TABLES)], "path string, content string")
    assert [r.message for r in lint(files, only("VG107")).findings.collect()] == ['table "member" referenced in query not found in schema']


def go(fields, name="Member", table="members"):
    body = "".join(f"\t{f}\n" for f in fields)
    return f"package m\n\ntype {name} struct {{\n{body}}}\n" + (f'\nfunc ({name}) TableName() string {{ return "{table}" }}\n' if table else "")


FULL = "CREATE TABLE members (id bigint NOT NULL, mail varchar(90) NOT NULL, seen timestamptz, score numeric(4,1) NOT NULL DEFAULT 0)"
ALL = ['ID int64 `db:"id"`', 'Mail string `db:"mail"`', 'Seen time.Time `db:"seen"`', 'Score float64 `db:"score"`']
DRIFT = [
    ("VG101", FULL, go(ALL), 0), ("VG101", FULL, go([*ALL, 'Old string `db:"old"`', 'Odd int `gorm:"column:odd"`']), 2), ("VG101", FULL, go(['Old string `db:"old"`'], table="elsewhere"), 0), ("VG101", FULL, go(['ID int64 `db:"ID"`', 'Mail string `db:"MAIL"`'], table="Members"), 0),
    ("VG102", FULL, go(ALL), 0), ("VG102", FULL, go(ALL[:1]), 1), ("VG102", FULL, go(ALL[:2]), 0), ("VG102", FULL, go(ALL[:1], table="elsewhere"), 0),
    ("VG103", FULL, go(ALL), 0), ("VG103", FULL, go(['Mail int `db:"mail"`']), 1), ("VG103", FULL, go(['Mail *string `db:"mail"`', 'ID sql.NullInt64 `db:"id"`']), 0), ("VG103", FULL, go(['Seen Strange `db:"seen"`']), 0), ("VG103", FULL, go(['Seen bool `db:"seen"`', 'Score time.Time `db:"score"`']), 2), ("VG103", FULL, go(['Old int `db:"old"`']), 0),
    ("VG104", FULL, go(ALL), 0), ("VG104", FULL, go(ALL, table="member"), 1), ("VG104", FULL, go(ALL, table=None), 0),
    ("VG109", FULL + ";\nCREATE TABLE bills (id int)", go(ALL), 1), ("VG109", FULL, go(ALL), 0),
    ("VG110", FULL, go(['ID int `db:"id"`', 'LegacyID int `db:"id"`']), 1), ("VG110", FULL, go(ALL), 0), ("VG110", FULL, go(['A, B string `db:"mail"`']), 1),
    ("VG111", FULL, go([ALL[0], "Mail string"], table=None), 1), ("VG111", FULL, go([ALL[0], "Mail string"]), 0), ("VG111", FULL, go(ALL, table=None), 0),
]


@pytest.mark.parametrize("rule", sorted({d[0] for d in DRIFT}))
def test_drift_rules(spark, rule):
    for _, sql, model, n in [d for d in DRIFT if d[0] == rule]:
        files = spark.createDataFrame([("migrations/1.sql", sql), ("m/member.go", model)], "path string, content string")
        assert lint(files, only(rule)).findings.count() == n, (sql, model)


def test_drift_needs_both_sides(spark):
    alone = [[("m/member.go", go(ALL))], [("migrations/1.sql", FULL)]]
    assert all(lint(spark.createDataFrame(rows, "path string, content string"), Config(rules={r: RuleConfig(enabled=RULES[r].kind == "drift") for r in RULES})).findings.isEmpty() for rows in alone)


GO = 'package g\n\nimport (\n\t"database/sql"\n\tgq "github.com/doug-martin/goqu/v9"\n)\n\nfunc f() {\n\t%s\n}\n'
PY = "import sqlalchemy\nclass Member(Base):\n    __tablename__ = 'members'\n%s\n"
MARK = "/* sparrowlint:synthetic {}-ast */ "
BUILT = [
    # An unknown predicate alone becomes one that is always true.
    ("a.go", GO % 'gq.Update("t").Where(gq.Or(a, b))', ["UPDATE t SET synthetic_col = 1 WHERE 1=1"]),
    # A chain that ends in a method outside the lists is told twice.
    ("b.go", GO % 'gq.From("t").Select("a").Executor()', ["SELECT a FROM t"] * 2),
    # A function of the package as a column gives the package's name.
    ("c.go", GO % 'gq.From("t").Select(gq.COUNT("*")).ToSQL()', ["SELECT gq FROM t"]),
    # Chains on variables are none of the package's.
    ("d.go", GO % 'ds.Where(gq.C("a").Eq(1))', []),
    # Links without meaning for the rules are accepted and left out.
    ("e.go", GO % 'gq.From("t").Select("a").GroupBy("a").Order(gq.C("a").Asc()).Offset(3).Limit(2).ToSQL()', ["SELECT a FROM t LIMIT 2"]),
    ("f.py", PY % "session.query(Member).filter(Member.id == [1, 2]).all()", ['SELECT * FROM "members" WHERE "members"."id" = \'synthetic_value\'']),
    # The core functions are no roots, and unknown methods alone are always true.
    ("g.py", PY % "session.execute(update(Member).values(a=1))", []),
    ("h.py", PY % "session.query(Member).filter(Member.on.is_(True)).delete()", ['DELETE FROM "members" WHERE 1=1']),
]


def test_built_statements(spark):
    files = spark.createDataFrame([(p, c) for p, c, _ in BUILT], "path string, content string")
    got = {}
    for r in src.statements(src.usable_files(files, Config()), Config()).orderBy("file", "stmt_idx").collect():
        got.setdefault(r.file, []).append(r.sql)
    for path, _, want in BUILT:
        mark = MARK.format("goqu" if path.endswith("go") else "sqlalchemy")
        assert got.get(path, []) == [mark + w for w in want], path


def test_db_call_with_a_variable_is_skipped(spark):
    files = spark.createDataFrame([("a.go", GO % 'db.Query(q, "SELECT 1")\n\tdb.Query("SELECT 2")')], "path string, content string")
    assert [r.sql for r in src.statements(files, Config()).collect()] == ["SELECT 2"]


def test_models(spark):
    fields = ["Base", 'A, B string `db:"ab"`', 'Off int `db:"-"`', "C int"]
    py = "class P(Base):\n    __tablename__ = 'p'\n    owner = mapped_column(ForeignKey('m.id'))\n    n = Column(sa.Integer)\n"
    files = spark.createDataFrame([("m.go", go(fields)), ("p.py", py), ("Q.GO", go(ALL)), ("R.PY", py)], "path string, content string")
    got = {(r.file, c.name, c.field, c.type) for r in src.models(files, Config(mapping_mode="balanced")).collect() for c in r.columns}
    assert got == {("m.go", "ab", "A", "string"), ("m.go", "ab", "B", "string"), ("m.go", "c", "C", "int"), ("p.py", "owner", "owner", "ForeignKey('m.id')"), ("p.py", "n", "n", "")}


def test_discovery(spark, tmp_path):
    for name in ("a.sql", "b.sQL", "c.GO", "d.txt", "node_modules/e.sql", ".git/f.sql", "vendor/g.sql", "sub/h.py"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("SELECT * FROM t LIMIT 1")
    config = Config(exclude=["vendor/**"])
    got = {r.path.rsplit("/", 1)[1] for r in src.read_files(spark, [str(tmp_path), str(tmp_path / "sub")], config).collect()}
    assert got == {"a.sql", "b.sQL", "c.GO", "h.py"}
    assert {r.file.rsplit("/", 1)[1] for r in lint(src.read_files(spark, [str(tmp_path)], config), config).findings.collect()} == {"a.sql", "b.sQL"}
