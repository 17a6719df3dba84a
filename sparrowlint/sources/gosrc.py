"""Go sources read without Go: a lexer, the call chains of expressions, struct types.

Brackets and literals are checked; other syntax errors pass unnoticed.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r]+|//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<nl>\n)
    |(?P<raw>`[^`]*`)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<rune>'(?:\\.[^']*|[^'\\\n])')
    |(?P<float>\d[\d_]*\.[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)
    |(?P<int>0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*)
    |(?P<ident>[A-Za-z_\u0080-￿][\w\u0080-￿]*)
    |(?P<op><-|:=|\.\.\.|&&|\|\||[-+*/%&|^<>=!]=|\+\+|--|<<|>>|[-+*/%&|^<>=!.,;:(){}\[\]~])""",
    re.X | re.S,
)
_ESC = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
DB_CALLS = {"Query": 0, "QueryRow": 0, "Exec": 0, "Prepare": 0, "MustExec": 0, "NamedExec": 0, "NamedQuery": 0, "QueryContext": 1, "ExecContext": 1, "QueryRowContext": 1, "Get": 1, "Select": 1}
_SQL_WORDS = "SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|TRUNCATE|WITH|GRANT|REVOKE|BEGIN|COMMIT|ROLLBACK|SET|COPY|VACUUM|ANALYZE|EXPLAIN|MERGE"
LOOKS_LIKE_SQL = rf"(?i)^\s*(?:--|/\*|(?:{_SQL_WORDS})(?![A-Za-z0-9_]))"
_SQL = re.compile(LOOKS_LIKE_SQL)
BUILDER_PATHS = ("github.com/doug-martin/goqu", "github.com/doug-martin/goqu/v9")
_LINKS = frozenset("From Select Where Limit Offset Order GroupBy Having Join InnerJoin LeftJoin RightJoin FullJoin Update Delete Set Prepared Union UnionAll Intersect IntersectAll ClearSelect ClearWhere ClearOrder ClearLimit ClearOffset Distinct ForUpdate ForShare Returning With WithRecursive ToSQL".split())
_COMPARE = {"Like": "LIKE", "ILike": "ILIKE", "Eq": "=", "Neq": "<>", "Gt": ">", "Gte": ">=", "Lt": "<", "Lte": "<="}
_JOINS = {"Join": "JOIN", "InnerJoin": "JOIN", "LeftJoin": "LEFT JOIN", "RightJoin": "RIGHT JOIN", "FullJoin": "FULL JOIN"}


class GoSyntax(ValueError):
    pass


def unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1].replace("\r", "")

    def sub(m):
        e = m[1]
        if e[0] in "xuU":
            return chr(int(e[1:], 16))
        return chr(int(e, 8)) if e[0].isdigit() else _ESC.get(e, e)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", sub, text[1:-1])


class Node:
    """kind: lit, ident, sel, call, comp, neg, other."""

    __slots__ = ("kind", "value", "x", "args", "start", "end", "inner")

    def __init__(self, kind, value=None, x=None, args=(), start=0, end=0):
        self.kind, self.value, self.x, self.args, self.start, self.end, self.inner = kind, value, x, list(args), start, end, False


class GoFile:
    def __init__(self, source: str):
        self.source, self.t = source, []
        i, stack = 0, []
        while i < len(source):
            m = _TOKEN.match(source, i)
            if not m:
                raise GoSyntax(f"unexpected character at offset {i}")
            kind, text = m.lastgroup, m.group()
            if kind not in ("skip", "block", "nl"):
                self.t.append((kind, text, i, m.end()))
                if text in "([{" and kind == "op":
                    stack.append((")]}"["([{".index(text)], len(self.t) - 1))
                elif text in ")]}" and kind == "op":
                    if not stack or stack.pop()[0] != text:
                        raise GoSyntax(f"unbalanced {text} at offset {i}")
            i = m.end()
        if stack:
            raise GoSyntax("unclosed bracket")
        if self.t and self.t[0][1] != "package":
            raise GoSyntax("package clause expected")
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for k, x in enumerate(self.t):
            if x[0] == "op" and x[1] in "([{":
                open_.append(k)
            elif x[0] == "op" and x[1] in ")]}":
                self.match[open_.pop()] = k
        self.calls: list[Node] = []
        self.walk(0, len(self.t))
        self.calls.sort(key=lambda c: (c.start, -c.end))

    def at(self, offset: int) -> tuple[int, int]:
        """1-based line and byte column."""
        begin = self.source.rfind("\n", 0, offset) + 1
        return self.source.count("\n", 0, offset) + 1, len(self.source[begin:offset].encode()) + 1

    def walk(self, i: int, end: int) -> list[Node]:
        out = []
        while i < end:
            kind, text = self.t[i][:2]
            if kind in ("ident", "raw", "string", "int", "float", "rune") and text not in _KEYWORDS:
                node, i = self.primary(i, end)
                out.append(node)
            elif kind == "op" and text in "([{":
                self.walk(i + 1, self.match[i])
                i = self.match[i] + 1
            else:
                i += 1
        return out

    def primary(self, i: int, end: int) -> tuple[Node, int]:
        kind, text, a, z = self.t[i]
        node = Node("ident", text, start=a, end=z) if kind == "ident" else Node("lit", (kind, text), start=a, end=z)
        i += 1
        while i < end:
            op = self.t[i][1] if self.t[i][0] == "op" else ""
            if op == "." and i + 1 < end and self.t[i + 1][0] == "ident":
                node = Node("sel", self.t[i + 1][1], node, start=a, end=self.t[i + 1][3])
                i += 2
            elif op == "." and i + 1 < end and self.t[i + 1][1] == "(":
                node = Node("other", start=a, end=self.t[self.match[i + 1]][3])
                i = self.match[i + 1] + 1
            elif op == "(":
                close = self.match[i]
                args = self.arguments(i + 1, close)
                if node.kind == "sel" and node.x.kind == "call" and node.value in _LINKS:
                    node.x.inner = True
                node = Node("call", None, node, args, a, self.t[close][3])
                self.calls.append(node)
                i = close + 1
            elif op == "[":
                self.walk(i + 1, self.match[i])
                node = Node("other", start=a, end=self.t[self.match[i]][3])
                i = self.match[i] + 1
            elif op == "{" and node.kind in ("ident", "sel") and self.literal_here(i):
                close = self.match[i]
                elts = self.arguments(i + 1, close)
                node = Node("comp", None, node, elts, a, self.t[close][3])
                i = close + 1
            else:
                break
        return node, i

    def literal_here(self, i: int) -> bool:
        """Whether a brace after a name opens a composite literal: it is empty or holds ``key: value`` or commas."""
        close, k = self.match[i], i + 1
        if close == k:
            return True
        while k < close:
            text = self.t[k][1]
            if self.t[k][0] == "op":
                if text in (",", ":"):
                    return True
                if text in (":=", ";", "=", "++", "--"):
                    return False
                if text in "([{":
                    k = self.match[k]
            elif text in _KEYWORDS:
                return False
            k += 1
        return False

    def arguments(self, i: int, end: int) -> list[Node]:
        out, begin = [], i
        k = i
        while k <= end:
            if k == end or self.t[k][1] == "," and self.t[k][0] == "op":
                if k > begin:
                    out.append(self.argument(begin, k))
                begin = k + 1
            elif self.t[k][0] == "op" and self.t[k][1] in "([{":
                k = self.match[k]
            k += 1
        return out

    def argument(self, i: int, end: int) -> Node:
        k = i
        while k < end:
            if self.t[k][0] == "op" and self.t[k][1] == ":":
                key, value = self.argument(i, k), self.argument(k + 1, end)
                return Node("pair", None, key, [value], key.start, value.end)
            k = self.match[k] + 1 if self.t[k][0] == "op" and self.t[k][1] in "([{" else k + 1
        a, z = self.t[i][2], self.t[end - 1][3]
        if self.t[i][1] == "-" and end == i + 2 and self.t[i + 1][0] in ("int", "float"):
            return Node("neg", self.t[i + 1][1], start=a, end=z)
        if self.t[i][0] in ("ident", "raw", "string", "int", "float", "rune") and self.t[i][1] not in _KEYWORDS:
            node, k = self.primary(i, end)
            if k == end:
                return node
            self.walk(k, end)
        else:
            self.walk(i, end)
        return Node("other", start=a, end=z)

    def imports(self) -> dict[str, str]:
        """Path to name in use."""
        out = {}
        for k, (kind, text, _, _) in enumerate(self.t):
            if kind == "ident" and text == "import":
                stop = self.match[k + 1] if self.t[k + 1][1] == "(" else k + 3
                j = k + 1
                while j < min(stop, len(self.t)):
                    if self.t[j][0] in ("string", "raw"):
                        path = unquote(self.t[j][1])
                        named = self.t[j - 1][0] == "ident" and self.t[j - 1][1] != "import" or self.t[j - 1][1] == "."
                        plain = re.sub(r"/v\d+$", "", path).rsplit("/", 1)[-1]
                        out[path] = self.t[j - 1][1] if named else plain
                    j += 1
        return out


def _text(n: Node) -> str | None:
    return unquote(n.value[1]) if n.kind == "lit" and n.value[0] in ("string", "raw") else None


def _name(n: Node) -> str:
    if n.kind == "lit":
        return _text(n) if n.value[0] in ("string", "raw") else n.value[1]
    if n.kind == "ident":
        return n.value
    if n.kind == "sel":
        return f"{n.x.value}.{n.value}" if n.x.kind == "ident" else n.value
    return ""


_IDENT = re.compile(r"^[A-Za-z_*][A-Za-z0-9_.*]*$")


def _safe(raw: str | None, fallback: str) -> str:
    words = (raw or "").strip().strip('"`').split()
    word = words[0].rstrip(",").strip('"`') if words else ""
    return word if _IDENT.match(word) else fallback


def _table(n: Node, alias: str, fallback: str) -> str:
    if n.kind == "lit" and _text(n) is not None:
        return _safe(_text(n), fallback)
    if n.kind in ("ident", "sel"):
        return _safe(n.value, fallback)
    if n.kind == "call" and n.x.kind == "sel" and n.x.x.kind == "ident" and n.x.x.value == alias and n.args and n.x.value in ("T", "I"):
        return _safe(_name(n.args[0]), fallback)
    return fallback


def _column(n: Node, alias: str, fallback: str) -> str:
    if n.kind == "lit" and _text(n) is not None:
        return _safe(_text(n), fallback)
    if n.kind in ("ident", "sel"):
        return _safe(_name(n), fallback)
    if n.kind == "call" and n.x.kind == "sel":
        if n.x.x.kind == "ident" and n.x.x.value == alias:
            if n.x.value == "Star":
                return "*"
            if n.x.value in ("C", "I") and n.args:
                return _safe(_name(n.args[0]), fallback)
        return _column(n.x.x, alias, fallback)
    return fallback


def _value(n: Node | None) -> str:
    if n is None:
        return "NULL"
    if n.kind == "lit":
        if (s := _text(n)) is not None:
            return "'" + s.replace("'", "''") + "'"
        if n.value[0] in ("int", "float"):
            return n.value[1]
    if n.kind == "ident" and n.value.lower() in ("true", "false", "nil"):
        return {"true": "TRUE", "false": "FALSE", "nil": "NULL"}[n.value.lower()]
    return f"-{n.value}" if n.kind == "neg" else "'synthetic_value'"


def _predicate(n: Node, alias: str) -> str:
    if n.kind == "call" and n.x.kind == "sel" and n.x.value in _COMPARE:
        return f"{_column(n.x.x, alias, 'synthetic_col')} {_COMPARE[n.x.value]} {_value(n.args[0] if n.args else None)}"
    if n.kind == "comp":
        return " AND ".join(f"{_safe(_name(e.x), 'synthetic_col')} = {_value(e.args[0])}" for e in n.args if e.kind == "pair")
    return ""


def synthesize(call: Node, alias: str) -> str:
    """SQL for a builder chain that starts at the alias, or nothing."""
    links, n = [], call
    while n.kind == "call" and n.x.kind == "sel":
        links.append((n.x.value, n.args))
        n = n.x.x
    if n.kind != "ident" or n.value != alias or not links:
        return ""
    links.reverse()
    root, args = links[0]
    if root not in ("From", "Update", "Delete"):
        return ""
    if not args:
        table, rest = "", []
    else:
        table, rest = _table(args[0], alias, "synthetic_table"), links[1:]
    columns, joins, where, limit, lock = ["*"], [], [], "", False
    for name, a in rest:
        if name == "Select":
            columns = [c for x in a if (c := _column(x, alias, ""))] or ["*"]
        elif name in _JOINS:
            joins.append((_JOINS[name], _table(a[0], alias, "synthetic_join") if a else "synthetic_join"))
        elif name == "Where":
            where += [p for x in a if (p := _predicate(x, alias))] or ["1=1"]
        elif name == "Limit":
            value = a[0] if a else None
            digits = (_text(value) if _text(value) is not None else value.value[1] if value.value[0] == "int" else "") if value is not None and value.kind == "lit" else ""
            limit = digits if re.fullmatch(r"[+-]?\w*\d\w*", digits or "") else "1"
        elif name == "ForUpdate":
            lock = True
    cond = f" WHERE {' AND '.join(where)}" if where else ""
    others = ", ".join(t for _, t in joins)
    if root == "From":
        return f"SELECT {', '.join(columns)} FROM {table}" + "".join(f" {k} {t} ON 1=1" for k, t in joins) + cond + (f" LIMIT {limit}" if limit else "") + (" FOR UPDATE" if lock else "")
    if root == "Update":
        return f"UPDATE {table} SET synthetic_col = 1" + (f" FROM {others}" if joins else "") + cond
    return f"DELETE FROM {table}" + (f" USING {others}" if joins else "") + cond


def statements(source: str, tag: str) -> list[tuple[str, str, int, int, int, int]]:
    """(engine, sql, line, column, end_line, end_column) of database calls and of builder literals and chains."""
    f = GoFile(source)
    out = []

    def add(engine, sql, call):
        out.append((engine, sql, *f.at(call.start), *f.at(call.end)))

    alias = next((v for p, v in f.imports().items() if p in BUILDER_PATHS), None)
    for c in f.calls:
        if c.x.kind != "sel":
            continue
        spot = DB_CALLS.get(c.x.value)
        if spot is not None and spot < len(c.args) and (s := _text(c.args[spot])) and _SQL.match(s):
            add("go", s, c)
    for c in f.calls if alias and alias not in ("_", ".") else ():
        if c.x.kind != "sel":
            continue
        if c.x.x.kind == "ident" and c.x.x.value == alias and c.x.value == "L":
            if c.args and (s := _text(c.args[0])):
                add("goqu", s, c)
        elif not c.inner and (sql := synthesize(c, alias)):
            add("goqu", f"/* {tag}:synthetic goqu-ast */ {sql}", c)
    return out


def snake_case(s: str) -> str:
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "_", s.strip())
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), s)


def _tags(raw: str) -> dict[str, str]:
    return {k: unquote(f'"{v}"') for k, v in re.findall(r'([^\s":]+):"((?:\\.|[^"\\])*)"', raw)}


def _gorm(raw: str) -> tuple[str, bool]:
    column, ignored = "", False
    for part in map(str.strip, raw.split(";")):
        if part == "-" or part.lower().startswith("-:"):
            ignored = True
        key, sep, value = part.partition(":")
        if sep and key.strip().lower() == "column" and value.strip() not in ("", "-"):
            column = value.strip()
    return column, ignored


def _type(tokens: list) -> str:
    k = 0
    while k < len(tokens) and tokens[k][1] in ("*", "[", "]") or k < len(tokens) and k and tokens[k - 1][1] == "[":
        k += 1
    if k >= len(tokens) or tokens[k][0] != "ident" or tokens[k][1] in _KEYWORDS:
        return ""
    name = tokens[k][1]
    return f"{name}.{tokens[k + 2][1]}" if k + 2 < len(tokens) and tokens[k + 1][1] == "." else name


def models(source: str, mode: str = "strict") -> list[dict]:
    """Struct types with mapped columns. mode is strict, balanced or permissive."""
    f = GoFile(source)
    t, out, methods = f.t, [], {}
    for k in range(len(t) - 6):
        if t[k][1] == "func" and t[k + 1][1] == "(":
            close = f.match[k + 1]
            if [x[1] for x in t[close + 1 : close + 5]] == ["TableName", "(", ")", "string"] and t[close + 5][1] == "{":
                names = [x[1] for x in t[k + 2 : close] if x[0] == "ident"]
                body = t[close + 6 : f.match[close + 5]]
                lits = [body[i + 1][1] for i in range(len(body) - 1) if body[i][1] == "return" and body[i + 1][0] in ("string", "raw")]
                if names and lits:
                    methods[names[-1]] = unquote(lits[0]).strip()
    for k in range(1, len(t) - 2):
        if t[k][0] != "ident" or t[k + 1][1] != "struct" or t[k + 2][1] != "{" or t[k - 1][1] not in ("type", "(", ")", "}", ";") and f.at(t[k - 1][2])[0] == f.at(t[k][2])[0]:
            continue
        name, i, close, fields = t[k][1], k + 3, f.match[k + 2], []
        while i < close:
            line, j, at = [], i, f.at(t[i][2])[0]
            while j < close:
                if t[j][1] == ";":
                    break
                if line and f.at(t[j][2])[0] != f.at(line[-1][3])[0] and line[-1][1] not in (",",):
                    break
                line.append(t[j])
                if t[j][0] == "op" and t[j][1] in "([{":
                    line += t[j + 1 : f.match[j] + 1]
                    j = f.match[j]
                j += 1
            i = j + (j < close and t[j][1] == ";")
            tag = unquote(line[-1][1]) if line and line[-1][0] in ("raw", "string") else ""
            line = line[:-1] if tag or line and line[-1][0] in ("raw", "string") else line
            names, p = [], 0
            while p < len(line) and line[p][0] == "ident" and p + 1 < len(line) and line[p + 1][1] == ",":
                names.append(line[p])
                p += 2
            if p < len(line) and line[p][0] == "ident" and p + 1 < len(line) and line[p + 1][1] != ".":
                names.append(line[p])
                fields.append((names, _type(line[p + 1 :]), _tags(tag), at))
        seed = any("db" in g or "gorm" in g for _, _, g, _ in fields) or name in methods
        active = mode if seed else "strict"
        cols = []
        for names, kind, tags, _ in fields:
            for x in names:
                db = tags.get("db", "").split(",")[0].strip()
                gorm, _ = _gorm(tags.get("gorm", ""))
                if db and db != "-":
                    col = (db, "explicit", "db_tag")
                elif gorm:
                    col = (gorm, "explicit", "gorm_tag")
                elif active != "strict" and not ("db" in tags or "gorm" in tags) and (active != "balanced" or x[1][:1].isupper()):
                    col = (snake_case(x[1]), "inferred", "field_name")
                else:
                    continue
                cols.append({"name": col[0], "field": x[1], "type": kind, "line": f.at(x[2])[0], "kind": col[1], "mapping_source": col[2]})
        if cols:
            found = methods.get(name, "")
            out.append({"table": found or name.lower(), "table_explicit": bool(found), "table_kind": "explicit" if found else "inferred", "table_source": "table_name_method" if found else "type_name", "line": f.at(t[k][2])[0], "columns": cols})
    return out
