"""SQL and Cypher texts: declared tables and columns, and which tables statements read and write."""

from __future__ import annotations

import re

#: Words that open a clause in which no tables are listed.
LISTLESS = ["select", "where", "set", "values", "group", "having", "order", "limit", "offset", "window", "union", "except", "intersect", "returning", "when", "for", "fetch"]
#: Words between tables, or before one.
BETWEEN = ["inner", "left", "right", "full", "outer", "cross", "natural", "on", "as", "only", "lateral", "by", "all", "distinct", "and", "or", "not", "null", "case", "then", "else", "end", "exists", "in", "is", "like", "between"]
#: Words that a table can't be called without quotes.
KEYWORDS = {*LISTLESS, *BETWEEN, "from", "join", "using", "into", "update", "insert", "delete", "merge", "with"}
#: Words that a statement which reads or writes rows begins with.
VERBS = ["select", "with", "insert", "replace", "update", "delete", "merge", "values"]
CONSTRAINTS = {"primary", "foreign", "unique", "check", "constraint", "key", "exclude", "index", "like"}

_NOISE = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", re.S)
_TOKEN = re.compile(r'(?:"[^"]*"|`[^`]*`|\[[^\]]*\]|[\w$]+)(?:\.(?:"[^"]*"|`[^`]*`|[\w$]+))*|[(),;]')


def clean(sql: str) -> str:
    """SQL without comments and string contents, of the same length."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), sql)


def unquoted(name: str) -> str:
    return ".".join(part.strip('"`[]') for part in name.split("."))


def table_name(name: str) -> str:
    """A table's identity: dotted parts without quotes, lower case."""
    return unquoted(name).lower()


def tables(sql: str) -> list[dict]:
    """Tables and views that SQL declares: name, kind, line, columns (name, type) and the tables they refer to."""
    text, out = clean(sql), []
    for m in re.finditer(r"\bcreate\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+|foreign\s+)?(table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?", text, re.I):
        name = _TOKEN.match(text, m.end())
        if not name:
            continue
        kind = "view" if "view" in m[1].lower() else "table"
        found = {"name": table_name(name[0]), "kind": kind, "line": text.count("\n", 0, m.start()) + 1, "columns": [], "refers": []}
        body_at = name.end()
        if kind == "view":
            stop = text.find(";", body_at)
            found["refers"] = sorted({t for a, t in access("select * " + text[body_at : stop if stop >= 0 else None]) if a == "read"})
        elif (b := re.match(r"\s*\(", text[body_at:])) is not None:
            parts, depth, start = [], 1, body_at + b.end()
            at = start
            while at < len(text) and depth:
                c = text[at]
                depth += (c == "(") - (c == ")")
                if (c == "," and depth == 1) or depth == 0:
                    parts.append(text[start:at])
                    start = at + 1
                at += 1
            for part in parts:
                words = _TOKEN.findall(part)
                found["refers"] += [table_name(r) for r in re.findall(r"\breferences\s+([\w.\"`]+)", part, re.I)]
                if words and words[0].lower() not in CONSTRAINTS and words[0] not in "(),;":
                    found["columns"].append({"name": unquoted(words[0]), "type": words[1].lower() if len(words) > 1 and words[1] not in "(),;" else None})
            found["refers"] = sorted(set(found["refers"]))
        out.append(found)
    for m in re.finditer(r"\balter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?([\w.\"`]+)[^;]*?\breferences\s+([\w.\"`]+)", text, re.I):
        for t in out:
            if t["name"] == table_name(m[1]):
                t["refers"] = sorted({*t["refers"], table_name(m[2])})
    return out


def _statements(sql: str) -> list[list]:
    """The statements' tokens; what is in parentheses is a list of its own."""
    out: list[list] = [[]]
    inside = [out[0]]
    for token in _TOKEN.findall(clean(sql)):
        if token == ";":
            out.append([])
            inside = [out[-1]]
        elif token == "(":
            inside[-1].append([])
            inside.append(inside[-1][-1])
        elif token != ")":
            inside[-1].append(token)
        elif len(inside) > 1:
            inside.pop()
    return out


def _word(tokens: list, at: int) -> str:
    """The token as a lower-case word; empty for parentheses and beyond the ends."""
    return tokens[at].lower() if 0 <= at < len(tokens) and isinstance(tokens[at], str) else ""


class _Access:
    """Tables by the clauses of SQL's grammar: FROM, JOIN and USING list tables that are read; INTO, UPDATE and DELETE FROM name the written one."""

    def __init__(self):
        self.found: dict[tuple[str, str], None] = {}

    def expression(self, tokens: list, local: set[str]) -> None:
        """Parentheses: a query of their own, or terms that may hold queries (FROM is part of a term there)."""
        if _word(tokens, 0) in VERBS:
            return self.statement(tokens, local)
        for t in tokens:
            if isinstance(t, list):
                self.expression(t, local)

    def common(self, tokens: list, local: set[str]) -> tuple[int, set[str]]:
        """WITH name (columns) AS (query), ...: where the main query begins, and the names that are no tables in it."""
        at = 2 if _word(tokens, 1) == "recursive" else 1
        local = set(local)
        while _word(tokens, at):
            local.add(table_name(tokens[at]))
            at += 1
            if _word(tokens, at) != "as" and at < len(tokens) and isinstance(tokens[at], list):
                at += 1
            while _word(tokens, at) in ("as", "not", "materialized"):
                at += 1
            if at < len(tokens) and isinstance(tokens[at], list):
                self.statement(tokens[at], local)
                at += 1
            if _word(tokens, at) != ",":
                break
            at += 1
        return at, local

    def statement(self, tokens: list, local: set[str]) -> None:
        at = next((i for i in range(len(tokens)) if _word(tokens, i) in VERBS), len(tokens))  # CREATE TABLE t AS SELECT, EXPLAIN SELECT
        if _word(tokens, at) == "with":
            skip, local = self.common(tokens[at:], local)
            at += skip
        verb = _word(tokens, at)
        # how the tables of the present list are used, and the next name
        listed, wanted = ("read", "write") if verb == "update" else (None, None)
        for i in range(at + (verb == "update"), len(tokens)):
            word = _word(tokens, i)
            if not word:
                listed, wanted = listed if listed or not wanted else wanted, None
                self.expression(tokens[i], local)
            elif word == "from" and _word(tokens, i - 1) == "distinct" and _word(tokens, i - 2) in ("is", "not"):
                continue
            elif word in ("from", "join", "using"):
                written = word == "from" and verb == "delete" and _word(tokens, i - 1) == "delete"
                listed = wanted = "write" if written else "read"
            elif word == "into":
                listed, wanted = None, "write"
            elif word in LISTLESS:
                listed = wanted = None
                if word == "select" and verb != "select":
                    verb = word
            elif word == ",":
                wanted = listed
            elif wanted and word not in BETWEEN:
                name = table_name(tokens[i])
                call = wanted == "read" and i + 1 < len(tokens) and isinstance(tokens[i + 1], list)  # a function of tables, but for t (alias)
                if word not in KEYWORDS and not call and not (wanted == "read" and name in local):
                    self.found.setdefault((wanted, name))
                listed = "read" if wanted == "write" and listed else listed
                wanted = None


def access(sql: str) -> list[tuple[str, str]]:
    """(read or write, table) of every statement, each once, in order of appearance; names that WITH defines are no tables."""
    out = _Access()
    for tokens in _statements(sql):
        if tokens:
            out.expression(tokens, set()) if isinstance(tokens[0], list) else out.statement(tokens, set())
    return list(out.found)


def cypher_labels(query: str) -> list[tuple[str, str]]:
    """(read or write, label or relation) of a Cypher text: patterns after CREATE and MERGE write, others read; DDL tables are writes."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " ", query, flags=re.S)
    out: dict[tuple[str, str], None] = {}
    for m in re.finditer(r"\bcreate\s+(?:node|rel)\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)", text, re.I):
        out.setdefault(("write", m[1]))
    text = re.sub(r"\bcreate\s+(?:node|rel)\s+table[^;]*", " ", text, flags=re.I)
    clause = "read"
    for m in re.finditer(r"\b(create|merge|match|where|return|with|set|delete|unwind|call)\b|[(\[]\s*\w*\s*:\s*(\w+(?:\s*[|:]\s*:?\w+)*)", text, re.I):
        if m[1]:
            clause = "write" if m[1].lower() in ("create", "merge") else "read"
        else:
            for label in re.split(r"[|:\s]+", m[2]):
                if label:
                    out.setdefault((clause, label))
    return list(out)
