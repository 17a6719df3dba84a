"""Python sources: SQL in execute() and text(), SQL for query builder chains, and declarative models."""

from __future__ import annotations

import ast
import re

_JOIN = {"join": "JOIN", "outerjoin": "LEFT JOIN", "leftouterjoin": "LEFT JOIN"}
_OPS = {ast.Eq: "=", ast.NotEq: "<>", ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.In: "IN", ast.NotIn: "NOT IN"}
_LIKE = {"like": ("LIKE", None), "ilike": ("ILIKE", None), "contains": ("LIKE", "%{}%"), "startswith": ("LIKE", "{}%"), "endswith": ("LIKE", "%{}")}
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_*][A-Za-z0-9_]*)*$")
QUERY_MARKERS = (".execute(", "text(", ".query(", "select(", ".filter(", ".where(", ".filter_by(", ".join(", "sqlalchemy", "SQLAlchemy")
MODEL_MARKERS = ("__tablename__", "Column(", "mapped_column(")


def _string(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _called(node, name: str) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == name


def tablenames(source: str) -> dict[str, str]:
    """Class name to __tablename__, for one file."""
    out = {}
    for cls in ast.walk(ast.parse(source)):
        if isinstance(cls, ast.ClassDef):
            for s in cls.body:
                if isinstance(s, ast.Assign) and _string(s.value) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets):
                    out[cls.name] = s.value.value
    return out


def _dotted(node) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]] if isinstance(node, ast.Name) else parts[::-1])


def _quote(name: str) -> str:
    return name if name == "*" else ".".join(f'"{p}"' for x in name.split(".") if (p := x.strip().strip('"`')))


def _safe(raw: str | None, fallback: str) -> str:
    words = (raw or "").strip().strip('"`').split()
    word = words[0].rstrip(",") if words else ""
    return word if word == "*" else _quote(word if _IDENT.match(word) else fallback)


class _Chains:
    def __init__(self, tables: dict[str, str]):
        self.tables = tables

    def table(self, node, fallback: str) -> str:
        if isinstance(node, (ast.Name, ast.Attribute)):
            name = node.id if isinstance(node, ast.Name) else node.attr
            return _safe(self.tables.get(name, name), fallback)
        if _string(node) is not None:
            return _safe(node.value, fallback)
        return self.table(node.args[0], fallback) if isinstance(node, ast.Call) and node.args else fallback

    def column(self, node, fallback: str) -> str:
        if isinstance(node, ast.Name):
            return _safe(node.id, fallback)
        if isinstance(node, ast.Attribute):
            head, sep, rest = _dotted(node).partition(".")
            return _safe(self.tables.get(head, head) + sep + rest, fallback)
        if _string(node) is not None:
            return _safe(node.value, fallback)
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute):
                return self.column(node.func.value, fallback)
            if node.args:
                return self.column(node.args[0], fallback)
        return fallback

    @staticmethod
    def value(node) -> str:
        if node is None:
            return "NULL"
        if isinstance(node, ast.Constant):
            v = node.value
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            if v is None or isinstance(v, bool):
                return {True: "TRUE", False: "FALSE", None: "NULL"}[v]
            if isinstance(v, (int, float)):
                return str(v)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float)):
            return f"-{node.operand.value}"
        return "'synthetic_value'"

    def predicate(self, node) -> str | None:
        if _called(node, "text") and node.args and (_string(node.args[0]) or "").strip():
            return node.args[0].value.strip()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr.lower() in _LIKE:
            op, shape = _LIKE[node.func.attr.lower()]
            arg = node.args[0] if node.args else None
            if shape is None:
                right = self.value(arg)
            else:
                right = "'%synthetic%'" if _string(arg) is None else "'" + shape.format(arg.value.replace("'", "''")) + "'"
            return f"{self.column(node.func.value, 'synthetic_col')} {op} {right}"
        if isinstance(node, ast.Compare) and type(node.ops[0]) in _OPS:
            return f"{self.column(node.left, 'synthetic_col')} {_OPS[type(node.ops[0])]} {self.value(node.comparators[0])}"
        if isinstance(node, ast.BoolOp):
            parts = [p for v in node.values if (p := self.predicate(v))]
            return "(" + (" AND " if isinstance(node.op, ast.And) else " OR ").join(parts) + ")" if parts else None
        return None

    def conditions(self, link: ast.Call, name: str) -> list[str]:
        out = [f"{_safe(k.arg, 'synthetic_col')} = {self.value(k.value)}" for k in link.keywords if k.arg] if name == "filter_by" else []
        return out + [p for a in link.args if (p := self.predicate(a))] or ["1=1"]

    def root(self, args) -> tuple[str, list[str]]:
        if len(args) == 1 and isinstance(args[0], (ast.Name, ast.Attribute)) and (args[0].id if isinstance(args[0], ast.Name) else args[0].attr)[:1].isupper():
            return self.table(args[0], "synthetic_model"), ["*"]
        cols = [c for a in args if (c := self.column(a, ""))]
        if not cols:
            return "synthetic_model", ["*"]
        return next((_safe(c.split(".")[0], "synthetic_model") for c in cols if "." in c), "synthetic_model"), cols

    def sql(self, call: ast.Call) -> str | None:
        links, node = [], call
        while isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute):
                links.append((node.func.attr, node, True))
                node = node.func.value
            elif isinstance(node.func, ast.Name):
                links.append((node.func.id, node, False))
                break
            else:
                return None
        if not links:
            return None
        links.reverse()
        name, first, method = links[0]
        if not (method and name == "query" or not method and name == "select"):
            return None
        table, cols = self.root(first.args)
        rest = [(n.lower(), c) for n, c, _ in links[1:]]
        write = next((k for k, (n, _) in enumerate(rest) if n in ("update", "delete")), None) if method else None
        joins, where, limit, lock = [], [], None, False
        for n, c in rest[:write]:
            if n in _JOIN:
                joins.append((_JOIN[n], self.table(c.args[0], "synthetic_join") if c.args else "synthetic_join"))
            elif n in ("filter", "filter_by", "where"):
                where += self.conditions(c, n)
            elif n == "limit":
                v = self.value(c.args[0]) if c.args else "1"
                limit = v if re.fullmatch(r"-?\d+", v) else "1"
            elif n == "with_for_update":
                lock = True
        cond = f" WHERE {' AND '.join(where)}" if where else ""
        others = ", ".join(t for _, t in joins)
        if write is None:
            return f"SELECT {', '.join(cols)} FROM {table}" + "".join(f" {k} {t} ON 1=1" for k, t in joins) + cond + (f" LIMIT {limit}" if limit else "") + (" FOR UPDATE" if lock else "")
        if rest[write][0] == "update":
            return f"UPDATE {table} SET synthetic_col = 1" + (f" FROM {others}" if joins else "") + cond
        return f"DELETE FROM {table}" + (f" USING {others}" if joins else "") + cond


def statements(source: str, project: dict[str, str], tag: str) -> list[tuple[str, str, int, int, int, int]]:
    """(engine, sql, line, column, end_line, end_column), in order of (line, column, sql)."""
    tree = ast.parse(source)
    chains = _Chains({**project, **tablenames(source)})
    inner, handled, found = set(), set(), []
    nodes = list(ast.walk(tree))
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Call):
            inner.add(id(n.func.value))
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "execute" and n.args:
            a = n.args[0]
            if _called(a, "text"):
                handled.add(id(a))
                a = a.args[0] if a.args else None
            if (_string(a) or "").strip():
                found.append((a.value.strip(), n))
    for n in nodes:
        v = n.value if isinstance(n, (ast.Assign, ast.Expr)) else None
        if _called(v, "text") and id(v) not in handled and v.args and (_string(v.args[0]) or "").strip():
            found.append((v.args[0].value.strip(), v))
    for n in nodes:
        if isinstance(n, ast.Call) and id(n) not in inner and (sql := chains.sql(n)):
            found.append((f"/* {tag}:synthetic sqlalchemy-ast */ {sql}", n))
    out, seen = [], set()
    for sql, n in found:
        if (n.lineno, sql) not in seen:
            seen.add((n.lineno, sql))
            out.append(("sqlalchemy", sql, n.lineno, n.col_offset + 1, n.end_lineno, n.end_col_offset + 1))
    return sorted(out, key=lambda r: (r[2], r[3], r[1]))


def _type(node) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Call):
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
        args = [repr(a.value) if isinstance(a, ast.Constant) else a.id for a in node.args if isinstance(a, (ast.Constant, ast.Name))]
        return f"{name}({', '.join(args)})" if name else ""
    return ""


def models(source: str) -> list[dict]:
    """Classes with __tablename__ and at least one Column or mapped_column."""
    out = []
    for cls in ast.walk(ast.parse(source)):
        if not isinstance(cls, ast.ClassDef):
            continue
        table, cols = None, []
        for s in cls.body:
            if isinstance(s, ast.Assign) and _string(s.value) is not None and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets):
                table = table or s.value.value
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            call = getattr(s, "value", None)
            if not isinstance(target, ast.Name) or target.id.startswith("_") or not isinstance(call, ast.Call):
                continue
            if (call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else "") not in ("Column", "mapped_column"):
                continue
            args = list(call.args)
            name = args.pop(0).value if args and _string(args[0]) is not None else target.id
            kind = next((k for a in args if (k := _type(a))), "")
            note = getattr(s, "annotation", None)
            if not kind and isinstance(note, ast.Subscript) and (note.value.id if isinstance(note.value, ast.Name) else getattr(note.value, "attr", "")) == "Mapped":
                kind = _type(note.slice)
            cols.append({"name": name, "field": target.id, "type": kind, "line": s.lineno, "kind": "explicit", "mapping_source": "sqlalchemy"})
        if table and cols:
            out.append({"table": table, "table_explicit": True, "table_kind": "explicit", "table_source": "tablename", "line": cls.lineno, "columns": cols})
    return out
