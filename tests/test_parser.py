import pytest

from sparrowlint.functions import sqltext
from sparrowlint.functions.pgparse import parse
from sparrowlint.plans import config as cfg


@pytest.mark.parametrize("sql", ["SELECT FROM;", "NOT VALID SQL !!!", "SELECT a FROM t WHERE a IN 'x'", "", "SELECT (1", "UPDATE t", "DELETE t"])
def test_errors(sql):
    assert parse(sql)["error"]


@pytest.mark.parametrize("clause,true", [("WHERE 1 = 1", 1), ("(TRUE)", 1), ("not false", 1), ("0 = 00", 1), ("id = id", 0), ("FALSE", 0), ("not not false", 0), ("1 = 1 AND id = 1", 0), ("(1=1) and (2=2)", 0)])
def test_constant_true(clause, true):
    assert sqltext.constant_true(clause) == bool(true)


def test_limits_and_tables():
    assert parse("SELECT id FROM users FETCH FIRST 10 ROWS ONLY")["limit"]
    assert parse("SELECT id FROM users FOR UPDATE SKIP LOCKED LIMIT 1")["limit"] == "1"
    assert parse("WITH q AS (SELECT id FROM users) SELECT id FROM q")["tables"][0]["type"] == "cte"
    p = parse("CREATE TABLE p(id SERIAL PRIMARY KEY, n VARCHAR(255) NOT NULL, c NUMERIC(10,2) DEFAULT 0.00)")
    assert [(d["type"], d["nullable"], d["has_default"]) for d in p["ddl"][0]["details"]] == [("serial", False, False), ("varchar(255)", False, False), ("numeric(10,2)", True, True)]


def test_split():
    s = "-- c\n/* a /* b */ ; */\nSELECT 'a;''b' ;\n\nSELECT $x$ ; $x$, E'\\'' , \"q;\"; -- end"
    got = sqltext.split_statements(s)
    assert [(x[1], x[2]) for x in got] == [(3, 3), (5, 5)]
    assert got[0][0].startswith("-- c")


def test_globs():
    import re

    ex = lambda p, path: bool(re.search(cfg.glob_regex(p), path))
    assert ex("vendor/**", "a/vendor/x/y.go") and ex("*_gen.sql", "src/a_gen.sql") and not ex("src/*.sql", "src/a/b.sql") and ex("**/x/*.py", "q/x/a.py")
    mig = lambda path: bool(re.search(cfg.migration_regex([]), path))
    assert mig("db/migrations/1.sql") and mig("migration/2.SQL") and not mig("db/migrations/1.py") and not mig("x/immigrations/1.sql")


def test_config():
    with pytest.raises(ValueError):
        cfg.Config(rules={"VG001": cfg.RuleConfig(severity="bad")})
    with pytest.raises(ValueError):
        cfg.Config(rules={"VG001": cfg.RuleConfig(engines=["java"])})
    assert cfg.parse_yaml("format: json\nexclude:\n  - 'a/**'\nrules:\n  VG001:\n    enabled: false\n    engines: [sql, go]\n") == {"format": "json", "exclude": ["a/**"], "rules": {"VG001": {"enabled": False, "engines": ["sql", "go"]}}}
    with pytest.raises(ValueError):
        cfg.register(cfg.Rule("VG001", "x", "error", "query"))
