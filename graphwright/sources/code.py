"""Source code to graph facts: definitions, calls, imports, base types and comments, nested by span.

A language is a table of patterns, which read the text as a lexer leaves it: without comments and the contents of strings.
Definitions end where their braces close, or at the closing word of the same indentation.  Python is read by its own parser.
Extraction is a mapInArrow stage over files(path, language, text), a file at a time; resolution across files is left to joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions.hashing import node_id
from graphwright.functions.text import MARKERS
from graphwright.plans.scratch import stable
from graphwright.sources.dialects import DIALECTS
from graphwright.sources.sqltext import access, cypher_labels, tables

FACTS = "path string, language string, fact string, kind string, name string, qualified_name string, method string, api_path string, target string, scope string, start_line int, end_line int, doc string, signature string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in FACTS.split(", ")])

#: Facts, and characters of text they are read from, after which a batch leaves the worker; a file is never split.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 20

#: Patterns by language: (fact kind, pattern with the name as group 1).
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)\s*\{"), ("constant", r"\b(?:const|static)\s+([A-Z]\w*)"), ("import", r"\buse\s+([^;]+);"), ("implements", r"\bimpl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\b")],
    "go": [("function", r"\bfunc\s+(\w+)\s*\("), ("method", r"\bfunc\s+\([^)]*\)\s*(\w+)"), ("struct", r"\btype\s+(\w+)\s+struct"), ("interface", r"\btype\s+(\w+)\s+interface"), ("import", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"(?:public|private|protected|static|final|\s)[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)\s*(?:throws[\w, ]+)?\{"), ("import", r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;"), ("extends", r"\bextends\s+(\w+)"), ("implements", r"\bimplements\s+(\w+)")],
    "javascript": [("function", r"\bfunction\s*\*?\s*(\w+)"), ("function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("class", r"\bclass\s+(\w+)"), ("import", r"\bfrom\s+[\"']([^\"']+)"), ("import", r"\brequire\(\s*[\"']([^\"']+)"), ("extends", r"\bextends\s+(\w+)")],
    "c": [("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{"), ("struct", r"\bstruct\s+(\w+)\s*\{"), ("enum", r"\benum\s+(\w+)"), ("import", r"#\s*include\s*[<\"]([^>\"]+)")],
    "csharp": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"(?:public|private|protected|internal|static)[\w<>\[\], ?]+\s+(\w+)\s*\([^)]*\)\s*(?:\{|=>)"), ("import", r"\busing\s+([\w.]+)\s*;")],
    "ruby": [("class", r"\bclass\s+(\w+)"), ("module", r"\bmodule\s+(\w+)"), ("function", r"\bdef\s+(?:self\.)?(\w+[?!]?)"), ("import", r"\brequire(?:_relative)?\s+[\"']([^\"']+)"), ("extends", r"\bclass\s+\w+\s*<\s*(\w+)")],
    "kotlin": [("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", r"\b(?:class|object)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("import", r"^\s*import\s+([\w.*]+)")],
    "php": [("function", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("import", r"\buse\s+([\w\\]+)\s*;"), ("extends", r"\bextends\s+(\w+)"), ("implements", r"\bimplements\s+(\w+)")],
    "bash": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"), ("import", r"^\s*(?:source|\.)\s+(\S+)")],
    "scala": [("function", r"\bdef\s+(\w+)"), ("class", r"\b(?:class|object)\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("import", r"^\s*import\s+([\w.{}, ]+)"), ("extends", r"\bextends\s+(\w+)")],
    "swift": [("function", r"\bfunc\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("interface", r"\bprotocol\s+(\w+)"), ("import", r"^\s*import\s+(\w+)")],
    "lua": [("function", r"\bfunction\s+([\w.:]+)"), ("import", r"\brequire\s*\(?\s*[\"']([^\"']+)")],
    "elixir": [("module", r"\bdefmodule\s+([\w.]+)"), ("function", r"\bdefp?\s+(\w+[?!]?)"), ("import", r"\b(?:alias|import|use)\s+([\w.]+)")],
    "haskell": [("function", r"^(\w+)\s*::"), ("class", r"\bclass\s+(\w+)"), ("struct", r"\b(?:data|newtype)\s+(\w+)"), ("import", r"^import\s+(?:qualified\s+)?([\w.]+)")],
    "ocaml": [("function", r"\blet\s+(?:rec\s+)?(\w+)"), ("module", r"\bmodule\s+(\w+)"), ("import", r"\bopen\s+([\w.]+)")],
    "zig": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bconst\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?struct"), ("import", r"@import\(\"([^\"]+)\"")],
    "r": [("function", r"(\w[\w.]*)\s*<-\s*function"), ("import", r"\b(?:library|require)\(\s*(\w+)")],
    "dart": [("class", r"\bclass\s+(\w+)"), ("function", r"^\s*[\w<>?]+\s+(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{"), ("import", r"\bimport\s+[\"']([^\"']+)")],
    "pascal": [("function", r"\b(?:function|procedure)\s+([\w.]+)"), ("class", r"\b(\w+)\s*=\s*class\b"), ("import", r"\buses\s+([\w., ]+);")],
    "vb6": [("function", r"(?<!End )(?<!Exit )\b(?:Function|Sub)[ \t]+(\w+)")],
    "vbnet": [("function", r"(?<!End )(?<!Exit )\b(?:Function|Sub)[ \t]+(\w+)"), ("class", r"(?<!End )\bClass[ \t]+(\w+)"), ("import", r"^\s*Imports\s+([\w.]+)")],
    "merlin6502": [("function", r"^(\w+)(?=\s|$)"), ("import", r"^\s+(?:PUT|USE)\s+(\S+)")],
}
PATTERNS["typescript"] = PATTERNS["tsx"] = [*PATTERNS["javascript"], ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("implements", r"\bimplements\s+(\w+)")]
PATTERNS["cpp"] = [*PATTERNS["c"], ("class", r"\bclass\s+(\w+)"), ("module", r"\bnamespace\s+(\w+)")]
#: Languages whose definitions nothing closes: a site belongs to the last one above it.
LINE_ORIENTED = {"merlin6502", "haskell", "ocaml"}
#: What closes a definition, at its own indentation, in languages without braces.
CLOSERS = {"ruby": r"end\b", "lua": r"end\b", "elixir": r"end\b", "vb6": r"End\s+(?:Function|Sub)\b", "vbnet": r"End\s+(?:Function|Sub|Class)\b", "pascal": r"end\b"}
CONTAINERS = {"class", "struct", "interface", "enum", "trait", "module"}
_NOT_CALLS = set([
    "if", "for", "while", "switch", "match", "return", "catch", "fn", "func", "function", "def", "class", "struct", "enum", "impl", "loop", "do",
    "else", "elif", "and", "or", "not", "in", "is", "lambda", "with", "assert", "sizeof", "typeof", "new", "await", "async", "yield", "print", "super",
])
#: How comments begin to the end of a line (// elsewhere), how others begin and end (/* */ elsewhere), and the quotes of strings.
_COMMENT = {"python": "#", "ruby": "#", "bash": "#", "r": "#", "elixir": "#", "lua": "--", "haskell": "--", "vbnet": "'", "vb6": "'", "merlin6502": "*"}
_BLOCKS = {"lua": ("--[[", "]]"), "haskell": ("{-", "-}"), "ocaml": ("(*", "*)"), "pascal": ("{", "}"), "ruby": None, "bash": None, "r": None, "elixir": None, "vbnet": None, "vb6": None, "merlin6502": None}
_QUOTES = {"rust": '"', "haskell": '"', "ocaml": '"', "vbnet": '"', "vb6": '"', "merlin6502": '"', "pascal": "'", "go": "\"`'", "javascript": "\"'`", "typescript": "\"'`", "tsx": "\"'`"}


@cache
def _lexer(language: str) -> re.Pattern:
    """One pattern for a language's comments (group c) and strings."""
    line, block = _COMMENT.get(language, "//"), _BLOCKS.get(language, ("/*", "*/"))
    comments = [rf"^[ \t]*{re.escape(line)}[^\n]*" if language == "merlin6502" else re.escape(line) + r"[^\n]*"]
    if block:
        comments.insert(0, rf"{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\Z)")
    if language == "php":
        comments.append(r"#(?!\[)[^\n]*")
    strings = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'", "`": r"`(?:[^`\\]|\\.)*`"}
    if language in ("vb6", "vbnet", "pascal"):  # quotes are doubled
        strings = {'"': r'"(?:[^"\n]|"")*"', "'": r"'(?:[^'\n]|'')*'"}
    found = [strings[q] for q in _QUOTES.get(language, "\"'")]
    if language == "rust":
        found = [r'r(#*)".*?"(?P=raw)'.replace("(#*)", "(?P<raw>#*)"), *found, r"'(?:[^'\\\n]|\\[^\n]{1,10})'"]
    if language in ("python", "kotlin", "scala", "swift", "elixir", "dart", "java", "csharp"):
        found.insert(0, r'""".*?"""')
    if language in ("python", "dart"):
        found.insert(0, r"'''.*?'''")
    return re.compile(f"(?P<c>{'|'.join(comments)})|{'|'.join(found)}", re.S | re.M)


@lru_cache(maxsize=2)  # the two forms of one text, which patterns and dialects read
def masked(language: str, text: str, strings: bool = True) -> str:
    """The text with blanks instead of comments and, if asked, of what is in strings; of the same length, lines kept."""
    blank = lambda x: re.sub(r"[^\n]", " ", x)

    def shown(m: re.Match) -> str:
        x = m[0]
        return blank(x) if m["c"] is not None else x if not strings else x[0] + blank(x[1:-1]) + x[-1]

    return _lexer(language).sub(shown, text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def signature(lines: list[str], start: int, end: str = r"[{;]") -> str:
    """The header of a definition: up to its end (an opening brace), at most three lines and 4096 characters; else the first line."""
    head = []
    for line in lines[start - 1 : start + 2]:
        cut = re.search(end, line)
        head.append(line[: cut.start()] if cut else line)
        if cut:
            break
    else:
        head = head[:1]
    return re.sub(r"\s+", " ", " ".join(head))[:4096].strip()


def _closing(text: str, at: int, limit: int) -> int:
    """Where the braces close that open behind a definition's name; its own place if none open before its end or the limit."""
    opening = text.find("{", at, limit)
    stop = text.find(";", at)
    if opening < 0 or 0 <= stop < opening:
        return at
    depth = 0
    for m in re.finditer(r"[{}]", text[opening:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return opening + m.start()
    return len(text)


def _closing_line(lines: list[str], start: int, closer: str) -> int:
    """The line that closes a definition: the first one of the same indentation with the closing word."""
    indent = re.match(r"\s*", lines[start - 1])[0]
    shape = re.compile(re.escape(indent) + f"(?:{closer})", re.I)
    if re.search(rf"\b{closer}", lines[start - 1], re.I):
        return start
    for i in range(start, len(lines)):
        if shape.match(lines[i]):
            return i + 1
        if lines[i].strip() and len(re.match(r"\s*", lines[i])[0]) < len(indent):
            break
    return start


#: What a call looks like: scope, name and an opening parenthesis; arguments may follow without one in Ruby and Elixir.
_CALL = re.compile(r"(?:\b([A-Za-z_]\w*)(?:::|->|\?\.|\.|:))?(?<![\w$])([A-Za-z_$][\w$]*[?!]?)\s*(?:::<[^>()]*>|<[\w, ]+>)?\(")
_HASKELL_CALL = re.compile(r"(?<=[=$(])\s*()([a-z_]\w*)\s+(?=[\w(\"])")
_MERLIN_CALL = re.compile(r"^\s+(?:JSR|JMP)\s+()(\w+)", re.M)
_CALLS = {"haskell": _HASKELL_CALL, "merlin6502": _MERLIN_CALL, "ocaml": re.compile(r"(?<=[=;(])\s*()([a-z_]\w*)\s+(?=[\w(\"])"), "bash": re.compile(r"^\s+()([A-Za-z_]\w*)(?=\s|$)", re.M)}


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.M)


def by_patterns(language: str, text: str) -> Iterator[dict]:
    lines = text.split("\n")
    code, quoted = masked(language, text), masked(language, text, strings=False)
    code_lines = code.split("\n")
    found = []
    for kind, pattern in PATTERNS.get(language, []):
        for m in _compiled(pattern).finditer(quoted if kind == "import" else code):
            start = _line(text, m.start(1))
            if kind in ("import", "extends", "implements"):
                yield {"fact": kind, "name": m[1].strip(), "start_line": start, "at": m.start()}
            else:
                found.append((m.start(), m.end(1), start, kind, m[1]))
    found.sort()
    defs = []
    for i, (_, end, start, kind, name) in enumerate(found):
        limit = next((x[0] for x in found[i + 1 :] if x[0] > end), len(text))
        if language in LINE_ORIENTED:
            last = start
        elif language in CLOSERS:
            last = _closing_line(code_lines, start, CLOSERS[language])
        else:
            last = _line(text, _closing(code, end, limit))
        defs.append({"fact": "def", "kind": kind, "name": name, "start_line": start, "end_line": last, "signature": signature(lines, start)})
    spots = {(d["name"].rsplit(".", 1)[-1], d["start_line"]) for d in defs}
    yield from defs
    for m in _CALLS.get(language, _CALL).finditer(code):
        line = _line(text, m.start(2))
        if m[2] not in _NOT_CALLS and (m[2], line) not in spots:
            yield {"fact": "call", "name": m[2].rstrip("!") if language == "rust" else m[2], "scope": m[1] or None, "start_line": line}
    mark = _COMMENT.get(language, "//")
    for i, line in enumerate(lines, 1):
        if line.strip().startswith(mark):
            yield {"fact": "comment", "name": line.strip().lstrip(mark + "/!* ").strip(), "start_line": i}


def by_ast(language: str, text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            yield {"fact": "def", "kind": kind, "name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "doc": ast.get_docstring(n), "signature": signature(lines, n.lineno, r":\s*(?:#.*)?$")}
            for base in getattr(n, "bases", []):
                name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
                if name:
                    yield {"fact": "extends", "name": name, "start_line": n.lineno}
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                yield {"fact": "call", "name": f.id, "start_line": n.lineno}
            elif isinstance(f, ast.Attribute):
                yield {"fact": "call", "name": f.attr, "scope": f.value.id if isinstance(f.value, ast.Name) else None, "start_line": n.lineno}
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield {"fact": "import", "name": a.name, "start_line": n.lineno}
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            yield {"fact": "import", "name": module, "start_line": n.lineno}
            for a in n.names:
                yield {"fact": "symbol_import", "name": a.asname or a.name, "target": module, "start_line": n.lineno}
    for i, line in enumerate(lines, 1):
        if line.strip().startswith("#"):
            yield {"fact": "comment", "name": line.strip().lstrip("# ").strip(), "start_line": i}


def _use_tree(text: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(local name, module) of a tree of paths like a::{b, c::d as e}; wildcards bind no names."""
    depth, part, parts = 0, "", []
    for c in text + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    for part in filter(None, parts):
        head, brace, rest = part.partition("{")
        if brace:
            yield from _use_tree(rest.rsplit("}", 1)[0], prefix + head.strip())
            continue
        path, _, alias = (x.strip() for x in part.partition(" as "))
        full = prefix + path if path != "self" else prefix.removesuffix("::")
        module, _, name = full.rpartition("::")
        if (alias or name) not in ("*", "_", ""):
            yield alias or name, module


def symbol_imports(language: str, text: str) -> Iterator[dict]:
    """Names that an import binds in a file, with the module; Python's are read with the rest of it."""

    def fact(name: str, target: str, at: int) -> dict:
        return {"fact": "symbol_import", "name": name, "target": target, "start_line": _line(text, at)}

    if language in ("javascript", "typescript", "tsx"):
        for m in re.finditer(r"\bimport\s+(?:type\s+)?([^;\"']+?)\s+from\s+[\"']([^\"']+)", text):
            for name in re.findall(r"(?:\b\w+\s+as\s+)?(\w+)", re.sub(r"\*\s+as\s+", "", m[1])):
                if name != "as":
                    yield fact(name, m[2], m.start())
    elif language == "java":
        for m in re.finditer(r"\bimport\s+static\s+([\w.]+)\.(\w+)\s*;", text):
            yield fact(m[2], m[1], m.start())
    elif language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", text):
            for name, module in _use_tree(re.sub(r"\s+", " ", m[1])):
                yield fact(name, module, m.start())
    elif language == "php":
        for m in re.finditer(r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)\\(\w+)(?:\s+as\s+(\w+))?\s*;", text):
            yield fact(m[3] or m[2], m[1], m.start())
    elif language == "kotlin":
        for m in re.finditer(r"(?m)^\s*import\s+([\w.]+)\.(\w+)(?:\s+as\s+(\w+))?\s*$", text):
            yield fact(m[3] or m[2], m[1], m.start())
    elif language == "scala":
        for m in re.finditer(r"(?m)^\s*import\s+([\w.]+)\.(?:\{([^}]*)\}|(\w+))\s*$", text):
            for part in (m[2] or m[3]).split(","):
                name, _, alias = (x.strip() for x in part.partition("=>"))
                if name != "_":
                    yield fact(alias or name, m[1], m.start())


def sql_facts(language: str | None, path: str, text: str) -> Iterator[dict]:
    if path.endswith(".sql"):
        for t in tables(text):
            yield {"fact": "def", "kind": "table", "name": t["name"], "qualified_name": t["name"], "start_line": t["line"], "end_line": t["line"]}
            for c in t["columns"]:
                yield {"fact": "def", "kind": "column", "name": c["name"], "qualified_name": f"{t['name']}.{c['name']}", "signature": c["type"], "scope": t["name"], "start_line": t["line"], "end_line": t["line"]}
            for r in t["refers"]:
                yield {"fact": "table_reference", "name": t["name"], "target": r, "start_line": t["line"]}
        for kind, table in access(text):
            yield {"fact": f"db_{kind}", "target": table, "start_line": 1}
    elif path.endswith((".cypher", ".cql")):
        for kind, label in cypher_labels(text):
            yield {"fact": f"db_{kind}", "target": label, "start_line": 1}


#: Extractors that users add: language to a function from (path, text) to fact rows.
EXTRACTORS: dict[str, Callable[[str, str], Iterator[dict]]] = {}


def register(language: str, extractor: Callable[[str, str], Iterator[dict]]) -> None:
    EXTRACTORS[language] = extractor


def _nest(rows: list[dict]) -> None:
    """Scopes and qualified names of definitions by the innermost container around them; functions in types become methods."""
    defs = sorted((r for r in rows if r["fact"] == "def" and r.get("kind") not in ("table", "column")), key=lambda r: (r["start_line"], -r["end_line"]))
    stack: list[dict] = []
    for d in defs:
        while stack and not (stack[-1]["start_line"] <= d["start_line"] and d["end_line"] <= stack[-1]["end_line"] and stack[-1] is not d):
            stack.pop()
        outer = stack[-1] if stack else None
        d["qualified_name"] = f"{outer['qualified_name']}::{d['name']}" if outer else d["name"]
        if outer and d["kind"] == "function" and outer["kind"] in CONTAINERS - {"module"}:
            d["kind"] = "method"
        stack.append(d)


def _document(rows: list[dict]) -> None:
    """Comments that end on the line above a definition, with those right above them, are its doc; marked ones stay rationale."""
    comments = {r["start_line"]: r["name"] for r in rows if r["fact"] == "comment"}
    for d in rows:
        if d["fact"] == "def" and not d.get("doc"):
            above, line = [], d["start_line"] - 1
            while line in comments:
                above.append(comments[line])
                line -= 1
            if above:
                d["doc"] = "\n".join(reversed(above))


def extract_file(path: str, language: str | None, text: str, extra: dict | None = None, dialects: dict | None = None) -> list[dict]:
    """All facts of one file."""
    rows: list[dict] = list(sql_facts(language, path, text))
    own = (extra if extra is not None else EXTRACTORS).get(language or path.rsplit(".", 1)[-1])
    if own:
        rows += list(own(path, text))
    elif language and not path.endswith((".sql", ".cypher", ".cql")):
        rows += list(by_ast(language, text) if language == "python" else by_patterns(language, text))
        rows += list(symbol_imports(language, text))
        said = masked(language, text, strings=False)
        for dialect in (DIALECTS if dialects is None else dialects).values():
            for f in dialect(language, said):
                rows.append({"fact": f["fact"], "name": f["name"], "method": f["method"], "api_path": f["path"], "target": f["target"], "start_line": f["line"]})
    _nest(rows)
    _document(rows)
    rows = [r for r in rows if r["fact"] != "comment" or any(m in (r["name"] or "").upper() for m in MARKERS)]
    return [{"path": path, "language": language} | r for r in rows]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW.field(c).type) for c in COLUMNS], schema=_ARROW)


def facts(files: DataFrame) -> DataFrame:
    """Facts of files(path, language, text)."""
    extra, dialects = dict(EXTRACTORS), dict(DIALECTS)  # what is registered now goes along to the workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, read = [], 0  # of several files, as a batch for each costs more than many a file
            for p, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t is not None:
                    rows += extract_file(p, g, t, extra, dialects)
                    read += len(t)
                    if len(rows) >= BATCH_ROWS or read >= BATCH_CHARS:
                        yield _batch(rows)
                        rows, read = [], 0
            if rows:
                yield _batch(rows)

    return files.select("path", "language", "text").mapInArrow(run, FACTS)


def graph_of(rows: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts to nodes, edges inside files, and pending links (link, anchor, anchor_file, name, scope, kind) to be resolved.

    All three read the facts several times, so facts that are still to be extracted are settled first.  Joins ask for a merge:
    the planner takes the size of what comes out of an extractor for that of what goes in, and would broadcast all definitions.
    """
    rows = stable(rows)
    path = F.col("path")
    file_node = node_id(F.lit(repo), F.lit("file"), path)
    defs = rows.filter("fact = 'def'").withColumn("id", node_id(F.lit(repo), F.col("kind"), path, F.col("qualified_name"), F.col("start_line")))
    base = [F.lit(repo).alias("repo"), "id", "kind", "name", "qualified_name", F.col("path").alias("file"), "language", "start_line", "end_line", "doc", "signature"]
    files = rows.select("path", "language").distinct()
    none = F.lit(None)
    file_rows = files.select(F.lit(repo).alias("repo"), file_node.alias("id"), F.lit("file").alias("kind"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), path.alias("qualified_name"), path.alias("file"), "language", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("doc"), none.cast("string").alias("signature"))
    notes = rows.filter("fact = 'comment'").withColumn("id", node_id(F.lit(repo), F.lit("comment"), path, F.col("start_line")))
    note_rows = notes.select(F.lit(repo).alias("repo"), "id", F.lit("comment").alias("kind"), F.substring("name", 1, 80).alias("name"), F.substring("name", 1, 80).alias("qualified_name"), path.alias("file"), "language", "start_line", F.col("start_line").alias("end_line"), F.col("name").alias("doc"), none.cast("string").alias("signature"))
    nodes = defs.select(*base).unionByName(file_rows).unionByName(note_rows)

    edge = lambda a, b, kind: (a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), F.lit("extracted").alias("confidence"))
    scope = F.when(F.col("qualified_name").contains("::"), F.regexp_extract("qualified_name", "^(.*)::", 1))
    child, parent = defs.withColumn("outer", scope).alias("c"), defs.alias("p")
    within = child.join(parent.hint("merge"), (F.col("c.path") == F.col("p.path")) & (F.col("c.outer") == F.col("p.qualified_name")) & (F.col("p.start_line") <= F.col("c.start_line")) & (F.col("c.end_line") <= F.col("p.end_line")), "left")
    contains = within.groupBy("c.id", "c.path").agg(F.min_by("p.id", F.col("p.end_line") - F.col("p.start_line")).alias("p")).select(*edge(F.coalesce(F.col("p"), node_id(F.lit(repo), F.lit("file"), F.col("path"))), F.col("id"), "contains"))

    sites = rows.filter("fact in ('call', 'extends', 'implements')").select("path", "language", "fact", "name", "scope", F.col("start_line").alias("at"))
    callers = defs.filter("kind not in ('table', 'column', 'constant')").select(F.col("path").alias("dp"), F.col("id").alias("anchor"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    line = F.col("language").isin(list(LINE_ORIENTED))
    covers = (F.col("path") == F.col("dp")) & (F.col("s") <= F.col("at")) & (line | (F.col("at") <= F.col("e")))
    best = F.min_by("anchor", F.when(line, F.col("at") - F.col("s")).otherwise(F.col("e") - F.col("s")))
    owned = sites.join(callers.hint("merge"), covers, "left").groupBy("path", "fact", "name", "scope", "at").agg(best.alias("anchor"))
    owned = owned.withColumn("anchor", F.coalesce("anchor", node_id(F.lit(repo), F.lit("file"), F.col("path"))))
    kinds = F.when(F.col("fact") == "call", "calls").otherwise(F.col("fact"))
    local = defs.groupBy(F.col("path").alias("dp"), F.col("name").alias("dn")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).filter("n = 1")
    linked = owned.withColumn("kind", kinds).join(local.hint("merge"), (F.col("path") == F.col("dp")) & (F.col("name") == F.col("dn")), "left")
    inside = linked.filter("target is not null and target <> anchor").select(F.col("anchor").alias("src"), F.col("target").alias("dst"), "kind", F.lit("extracted").alias("confidence"))
    documents = notes.select(*edge(F.col("id"), file_node, "documents"))
    edges = contains.unionByName(inside).unionByName(documents).distinct()
    pending = linked.filter("target is null").select(node_id(F.col("anchor"), F.col("name"), F.col("kind"), F.col("scope")).alias("link"), "anchor", F.col("path").alias("anchor_file"), "name", "scope", "kind").distinct()
    return nodes, edges, pending


def operations_of(rows: DataFrame, repo: str) -> DataFrame:
    """Endpoints and client calls among the facts, as operations; an endpoint is one per file, method and path, a call one per site."""
    protocol = F.when(F.col("fact").startswith("grpc"), "grpc").when(F.col("fact").startswith("graphql"), "graphql").when(F.col("fact").startswith("ws"), "websocket").otherwise("rest")
    server = F.col("fact").isin("endpoint", "grpc_server", "graphql_server", "ws_receive")
    client = F.col("fact").isin("client_call", "grpc_client", "graphql_client", "ws_send", "ws_connect")
    kind = F.when(server, "endpoint").when(client, "client_call")
    ops = rows.withColumn("op", kind).filter("op is not null and api_path is not null")
    site = F.when(F.col("op") == "client_call", F.col("start_line"))
    return ops.select(node_id(F.lit(repo), F.col("op"), F.col("path"), F.col("method"), F.col("api_path"), site).alias("node_id"), F.lit(repo).alias("repo"), F.col("op").alias("kind"), protocol.alias("protocol"), "method", F.col("api_path").alias("path"), F.col("path").alias("file"), F.col("name").alias("handler")).distinct()
