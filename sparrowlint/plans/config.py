"""Configuration, its checks, path globs compiled to regular expressions, and the rule registry."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field
from pathlib import Path

ENGINES = ("sql", "go", "goqu", "sqlalchemy")
FORMATS = ("terminal", "json", "rdjsonl", "sarif")
DEFAULT_MIGRATIONS = ("migrations", "migration", "migrate")
NAME, HELP_URL = "sparrowlint", ""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    kind: str  # query, drift or query_schema
    commands: tuple[str, ...] = ()


RULES = {
    r.id: r
    for r in (
        Rule("VG001", "select-star", "warning", "query", ("SELECT",)),
        Rule("VG002", "missing-where-update", "error", "query", ("UPDATE",)),
        Rule("VG003", "missing-where-delete", "error", "query", ("DELETE",)),
        Rule("VG004", "unbounded-select", "warning", "query", ("SELECT",)),
        Rule("VG005", "like-leading-wildcard", "warning", "query", ("SELECT", "UPDATE", "DELETE")),
        Rule("VG006", "select-for-update-no-where", "error", "query", ("SELECT",)),
        Rule("VG007", "destructive-ddl", "error", "query", ("DDL",)),
        Rule("VG008", "non-concurrent-index", "warning", "query", ("DDL",)),
        Rule("VG101", "dropped-column", "error", "drift"),
        Rule("VG102", "missing-not-null", "warning", "drift"),
        Rule("VG103", "type-mismatch", "warning", "drift"),
        Rule("VG104", "table-not-found", "error", "drift"),
        Rule("VG105", "unknown-projection-column", "error", "query_schema"),
        Rule("VG106", "unknown-filter-column", "error", "query_schema"),
        Rule("VG107", "unknown-table-reference", "error", "query_schema"),
        Rule("VG108", "ambiguous-unqualified-column", "warning", "query_schema"),
        Rule("VG109", "orphan-migration-table", "warning", "drift"),
        Rule("VG110", "duplicate-model-column-mapping", "warning", "drift"),
        Rule("VG111", "go-inferred-table-name-risk", "warning", "drift"),
    )
}


def register(rule: Rule) -> None:
    """Add a rule; an id may be taken once across all kinds."""
    if rule.id in RULES:
        raise ValueError(f"rule {rule.id} is registered already")
    RULES[rule.id] = rule


@dataclass
class RuleConfig:
    enabled: bool | None = None
    severity: str = ""
    engines: list[str] = field(default_factory=list)


@dataclass
class Config:
    format: str = "terminal"
    exclude: list[str] = field(default_factory=list)
    migration_paths: list[str] = field(default_factory=list)
    rules: dict[str, RuleConfig] = field(default_factory=dict)
    mapping_mode: str = "strict"
    #: The word before ":disable" in directives and before ":synthetic" in the mark of built SQL.
    tag: str = NAME
    #: Whether ADD COLUMN loses type and nullability (as some parsers report it), which makes the column mandatory.
    bare_add_column: bool = True

    def __post_init__(self) -> None:
        if self.format and self.format not in FORMATS:
            raise ValueError(f"invalid format {self.format!r}")
        self.mapping_mode = (self.mapping_mode or "strict").strip().lower()
        if self.mapping_mode not in ("strict", "balanced", "permissive"):
            raise ValueError(f"invalid mapping mode {self.mapping_mode!r}")
        for rid, rc in self.rules.items():
            if rc.severity not in ("", "error", "warning", "info"):
                raise ValueError(f"invalid severity {rc.severity!r} for rule {rid}")
            rc.engines = list(dict.fromkeys(e.strip().lower() for e in rc.engines))
            for e in rc.engines:
                if e != "all" and e not in ENGINES:
                    raise ValueError(f"invalid engine {e!r} for rule {rid}")
        self.migration_paths = list(dict.fromkeys(q for p in self.migration_paths if (q := _clean(p.strip())) and q != "."))

    def unknown_rules(self) -> list[str]:
        return sorted(set(self.rules) - set(RULES))

    def enabled(self, rid: str) -> bool:
        rc = self.rules.get(rid)
        return rc is None or rc.enabled is None or rc.enabled

    def severity(self, rid: str) -> str:
        rc = self.rules.get(rid)
        return rc.severity if rc and rc.severity else RULES[rid].severity

    def engines(self, rid: str) -> list[str] | None:
        """The engines a rule is for; None for all."""
        rc = self.rules.get(rid)
        return None if rc is None or not rc.engines or "all" in rc.engines else rc.engines


def load(path: str | None = None) -> Config:
    """From the file given, else .sparrowlint.yaml or .yml, else defaults. JSON and the subset of YAML that settings need."""
    found = path or next((p for p in (f".{NAME}.yaml", f".{NAME}.yml") if Path(p).exists()), None)
    if not found:
        return Config()
    text = Path(found).read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        raw = parse_yaml(text)
    raw = raw or {}
    unknown = set(raw) - {"format", "exclude", "migration_paths", "rules", "go_model", "tag"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = {k: RuleConfig(v.get("enabled"), v.get("severity") or "", list(v.get("engines") or [])) for k, v in (raw.get("rules") or {}).items() for v in [v or {}]}
    return Config(raw.get("format") or "terminal", list(raw.get("exclude") or []), list(raw.get("migration_paths") or []), rules, (raw.get("go_model") or {}).get("mapping_mode") or "strict", raw.get("tag") or NAME)


def parse_yaml(text: str):
    """Nested mappings, block and flow lists, quoted and plain scalars."""
    lines = []
    for raw in text.split("\n"):
        body = re.sub(r"(^|\s)#.*$", "", raw) if not re.search(r"""["'].*#.*["']""", raw) else raw
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def scalar(s: str):
        s = s.strip()
        if s[:1] == "[":
            return [scalar(x) for x in re.findall(r"""(?:"[^"]*"|'[^']*'|[^,\[\]])+""", s[1:-1]) if x.strip()]
        if s[:1] in "\"'" and s[:1]:
            return s[1:-1]
        low = s.lower()
        return {"true": True, "false": False, "null": None, "~": None, "": None, "{}": {}}.get(low, int(s) if re.fullmatch(r"-?\d+", s) else s)

    def block(i: int, indent: int):
        if lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                out.append(scalar(lines[i][1][2:]))
                i += 1
            return out, i
        table = {}
        while i < len(lines) and lines[i][0] == indent:
            key, sep, rest = lines[i][1].partition(":")
            if not sep:
                raise ValueError(f"mapping expected: {lines[i][1]}")
            i += 1
            if rest.strip():
                table[scalar(key)] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("- ")):
                table[scalar(key)], i = block(i, lines[i][0])
            else:
                table[scalar(key)] = None
        if i < len(lines) and lines[i][0] > indent:
            raise ValueError(f"bad indentation: {lines[i][1]}")
        return table, i

    return block(0, lines[0][0])[0] if lines else {}


def _clean(p: str) -> str:
    p = posixpath.normpath(p.replace("\\", "/")) if p else ""
    return p[2:] if p.startswith("./") else p


def _segment(glob: str) -> str:
    """A regular expression for a glob whose * and ? stay within one path segment."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += f"[{body}]"
            i = j
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """Matches a clean path if the pattern matches it, its last segment (without **), or what follows any of its slashes."""
    pattern = pattern.replace("\\", "/")
    if "**" not in pattern:
        return rf"^(?:.*/)?{_segment(pattern)}$"
    parts = pattern.split("**")
    parts = [p.removeprefix("/") if i else p for i, p in enumerate(parts)]
    parts = [p.removesuffix("/") if i < len(parts) - 1 else p for i, p in enumerate(parts)]
    body = re.escape(parts[0]) + "/?" if parts[0] else ""
    for i, p in enumerate(parts[1:], 1):
        last = i == len(parts) - 1
        if not p:
            body += ".*" if last else "(?:.*/)?"
        else:
            body += "(?:.*/)?" + _segment(p) + ("" if last else "(?:/|$)")
            if last:
                body += "(?:/.*)?"
    return rf"^(?:.*/)?{body}$"


def exclude_regex(patterns: list[str]) -> str | None:
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns) or None


def migration_regex(patterns: list[str]) -> str:
    """For clean paths of .sql files: globs, or a path that equals a plain pattern or lies under it, on any suffix."""
    parts = []
    for p in patterns or DEFAULT_MIGRATIONS:
        p = _clean(p)
        parts.append(glob_regex(p) if re.search(r"[*?\[]", p) else rf"^(?:.*/)?{re.escape(p.strip('/'))}(?:/.*)?$")
    return rf"(?=.*\.(?i:sql)$)(?:{'|'.join(parts)})"

