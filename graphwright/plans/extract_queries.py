"""Queries of the extractors: texts in every language and dialect, made from the driver's tables, with the facts they hold.

A sample is a text with {n} in it; one file of every sample is made for each row of a table, n being its key.  What a sample
says was written down by hand, so that DuckDB lists the facts without reading any code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.plans.queries import query
from graphwright.sources import code

#: By language: file ending, text, definitions (kind, qualified name, first and last line), calls (caller or None for the file, callee), imports, and base types (fact, name).
LANGUAGES: dict[str, dict] = {
    "rust": {
        "ending": "rs",
        "text": "use std::fmt;\n/// Adds.\npub fn add{n}(a: u8) -> u8 {\n    helper{n}(\"}\"); // gone{n}(\n    a\n}\npub struct S{n} {\n    x: u8,\n}\nimpl Show for S{n} {\n}\ntrait T{n} {\n    fn m{n}(&self);\n}\n",
        "defs": [("function", "add{n}", 3, 6), ("struct", "S{n}", 7, 9), ("trait", "T{n}", 12, 14), ("method", "T{n}::m{n}", 13, 13)],
        "calls": [("add{n}", "helper{n}")], "imports": ["std::fmt"], "bases": [("implements", "Show")],
    },
    "python": {
        "ending": "py",
        "text": "import os\nfrom .lib{n} import tool\n\nclass A{n}(Base{n}):\n    \"\"\"Doc.\"\"\"\n    def m{n}(self):\n        return tool(\"f(\")\n\ndef f{n}(): # g{n}()\n    A{n}()\n",
        "defs": [("class", "A{n}", 4, 7), ("method", "A{n}::m{n}", 6, 7), ("function", "f{n}", 9, 10)],
        "calls": [("m{n}", "tool"), ("f{n}", "A{n}")], "imports": ["os", ".lib{n}"], "bases": [("extends", "Base{n}")],
    },
    "go": {
        "ending": "go",
        "text": "package p\nimport \"fmt\"\ntype S{n} struct {\n  x int\n}\nfunc (s S{n}) M{n}() {\n  fmt.Println(`}`)\n}\nfunc F{n}() { h{n}() }\n",
        "defs": [("struct", "S{n}", 3, 5), ("method", "M{n}", 6, 8), ("function", "F{n}", 9, 9)],
        "calls": [("M{n}", "Println"), ("F{n}", "h{n}")], "imports": ["fmt"], "bases": [],
    },
    "java": {
        "ending": "java",
        "text": "import a.B{n};\npublic class C{n} extends D{n} implements E{n} {\n  public int run(int x) {\n    return go{n}(\"{\");\n  }\n}\n",
        "defs": [("class", "C{n}", 2, 6), ("method", "C{n}::run", 3, 5)],
        "calls": [("run", "go{n}")], "imports": ["a.B{n}"], "bases": [("extends", "D{n}"), ("implements", "E{n}")],
    },
    "javascript": {
        "ending": "js",
        "text": "import x from './m{n}';\nclass K{n} extends L{n} {\n}\nfunction f{n}(a) {\n  /* no{n}( */\n  g{n}('}');\n}\nconst h{n} = (b) => {\n  f{n}(b);\n};\n",
        "defs": [("class", "K{n}", 2, 3), ("function", "f{n}", 4, 7), ("function", "h{n}", 8, 10)],
        "calls": [("f{n}", "g{n}"), ("h{n}", "f{n}")], "imports": ["./m{n}"], "bases": [("extends", "L{n}")],
    },
    "typescript": {
        "ending": "ts",
        "text": "import { y } from \"../t{n}\";\ninterface I{n} {\n  a: string;\n}\nenum E{n} { A }\nexport class K{n} implements I{n} {\n}\nexport async function f{n}(): Promise<void> {\n  await y<string>(`)`);\n}\n",
        "defs": [("interface", "I{n}", 2, 4), ("enum", "E{n}", 5, 5), ("class", "K{n}", 6, 7), ("function", "f{n}", 8, 10)],
        "calls": [("f{n}", "y")], "imports": ["../t{n}"], "bases": [("implements", "I{n}")],
    },
    "tsx": {
        "ending": "tsx",
        "text": "import React from 'react';\nexport function View{n}() {\n  return render{n}();\n}\n",
        "defs": [("function", "View{n}", 2, 4)], "calls": [("View{n}", "render{n}")], "imports": ["react"], "bases": [],
    },
    "c": {
        "ending": "c",
        "text": "#include \"l{n}.h\"\nstruct s{n} {\n  int x;\n};\nint f{n}(int a) {\n  return g{n}(a);\n}\n",
        "defs": [("struct", "s{n}", 2, 4), ("function", "f{n}", 5, 7)], "calls": [("f{n}", "g{n}")], "imports": ["l{n}.h"], "bases": [],
    },
    "cpp": {
        "ending": "cpp",
        "text": "#include <v{n}>\nnamespace n{n} {\nclass C{n} {\n};\nint f{n}(int a) {\n  return ::g{n}(a);\n}\n}\n",
        "defs": [("module", "n{n}", 2, 8), ("class", "n{n}::C{n}", 3, 4), ("function", "n{n}::f{n}", 5, 7)], "calls": [("f{n}", "g{n}")], "imports": ["v{n}"], "bases": [],
    },
    "csharp": {
        "ending": "cs",
        "text": "using Sys.N{n};\npublic interface I{n} {\n}\npublic class C{n} {\n  public int Run(int x) {\n    return Go{n}(x);\n  }\n}\n",
        "defs": [("interface", "I{n}", 2, 3), ("class", "C{n}", 4, 8), ("method", "C{n}::Run", 5, 7)], "calls": [("Run", "Go{n}")], "imports": ["Sys.N{n}"], "bases": [],
    },
    "ruby": {
        "ending": "rb",
        "text": "require 'l{n}'\nclass A{n} < B{n}\n  def m{n}\n    f{n}(1) # g{n}(\n  end\nend\n",
        "defs": [("class", "A{n}", 2, 6), ("method", "A{n}::m{n}", 3, 5)], "calls": [("m{n}", "f{n}")], "imports": ["l{n}"], "bases": [("extends", "B{n}")],
    },
    "kotlin": {
        "ending": "kt",
        "text": "import a.b{n}\ninterface I{n} {\n}\nclass K{n} {\n  fun m{n}(x: Int) {\n    go{n}(x)\n  }\n}\n",
        "defs": [("interface", "I{n}", 2, 3), ("class", "K{n}", 4, 8), ("method", "K{n}::m{n}", 5, 7)], "calls": [("m{n}", "go{n}")], "imports": ["a.b{n}"], "bases": [],
    },
    "bash": {
        "ending": "sh",
        "text": "source ./l{n}.sh\nf{n}() {\n  g{n}\n}\n",
        "defs": [("function", "f{n}", 2, 4)], "calls": [("f{n}", "g{n}")], "imports": ["./l{n}.sh"], "bases": [],
    },
    "php": {
        "ending": "php",
        "text": "<?php\nuse A\\B{n};\nclass K{n} extends L{n} implements M{n} {\n  function f{n}($x) {\n    return $this->g{n}($x); # no{n}(\n  }\n}\n",
        "defs": [("class", "K{n}", 3, 7), ("method", "K{n}::f{n}", 4, 6)], "calls": [("f{n}", "g{n}")], "imports": ["A\\B{n}"], "bases": [("extends", "L{n}"), ("implements", "M{n}")],
    },
    "scala": {
        "ending": "scala",
        "text": "import a.b{n}\ntrait T{n} {\n}\nclass K{n} extends T{n} {\n  def m{n}(x: Int) = {\n    go{n}(x)\n  }\n}\n",
        "defs": [("trait", "T{n}", 2, 3), ("class", "K{n}", 4, 8), ("method", "K{n}::m{n}", 5, 7)], "calls": [("m{n}", "go{n}")], "imports": ["a.b{n}"], "bases": [("extends", "T{n}")],
    },
    "ocaml": {
        "ending": "ml",
        "text": "open M{n}\nlet f{n} x = g{n} x\n",
        "defs": [("function", "f{n}", 2, 2)], "calls": [("f{n}", "g{n}")], "imports": ["M{n}"], "bases": [],
    },
    "haskell": {
        "ending": "hs",
        "text": "import qualified Data.M{n}\ndata D{n} = D\nf{n} :: Int -> Int\nf{n} x = g{n} x\n",
        "defs": [("struct", "D{n}", 2, 2), ("function", "f{n}", 3, 3)], "calls": [("f{n}", "g{n}")], "imports": ["Data.M{n}"], "bases": [],
    },
    "lua": {
        "ending": "lua",
        "text": "local l = require('l{n}')\nfunction f{n}(x)\n  g{n}(x) -- no{n}(\nend\n",
        "defs": [("function", "f{n}", 2, 4)], "calls": [(None, "require"), ("f{n}", "g{n}")], "imports": ["l{n}"], "bases": [],
    },
    "swift": {
        "ending": "swift",
        "text": "import L{n}\nprotocol P{n} {\n}\nstruct S{n} {\n  func m{n}() {\n    go{n}()\n  }\n}\n",
        "defs": [("interface", "P{n}", 2, 3), ("struct", "S{n}", 4, 8), ("method", "S{n}::m{n}", 5, 7)], "calls": [("m{n}", "go{n}")], "imports": ["L{n}"], "bases": [],
    },
    "elixir": {
        "ending": "ex",
        "text": "defmodule M{n} do\n  alias A.B{n}\n  def f{n}(x) do\n    g{n}(x)\n  end\nend\n",
        "defs": [("module", "M{n}", 1, 6), ("function", "M{n}::f{n}", 3, 5)], "calls": [("f{n}", "g{n}")], "imports": ["A.B{n}"], "bases": [],
    },
    "zig": {
        "ending": "zig",
        "text": "const l = @import(\"l{n}.zig\");\nconst S{n} = struct {\n  x: u8,\n};\nfn f{n}() void {\n  g{n}();\n}\n",
        "defs": [("struct", "S{n}", 2, 4), ("function", "f{n}", 5, 7)], "calls": [(None, "import"), ("f{n}", "g{n}")], "imports": ["l{n}.zig"], "bases": [],
    },
    "r": {
        "ending": "r",
        "text": "library(l{n})\nf{n} <- function(x) {\n  g{n}(x) # no{n}(\n}\n",
        "defs": [("function", "f{n}", 2, 4)], "calls": [(None, "library"), ("f{n}", "g{n}")], "imports": ["l{n}"], "bases": [],
    },
    "dart": {
        "ending": "dart",
        "text": "import 'l{n}.dart';\nclass C{n} {\n}\nvoid f{n}(int x) {\n  g{n}(x);\n}\n",
        "defs": [("class", "C{n}", 2, 3), ("function", "f{n}", 4, 6)], "calls": [("f{n}", "g{n}")], "imports": ["l{n}.dart"], "bases": [],
    },
    "pascal": {
        "ending": "pas",
        "text": "uses l{n};\nprocedure f{n};\nbegin\n  g{n}('(');\nend;\n",
        "defs": [("function", "f{n}", 2, 5)], "calls": [("f{n}", "g{n}")], "imports": ["l{n}"], "bases": [],
    },
    "vb6": {
        "ending": "bas",
        "text": "Sub f{n}()\n  g{n}(1) ' no{n}(\nEnd Sub\n",
        "defs": [("function", "f{n}", 1, 3)], "calls": [("f{n}", "g{n}")], "imports": [], "bases": [],
    },
    "vbnet": {
        "ending": "vb",
        "text": "Imports L.M{n}\nClass C{n}\n  Function f{n}()\n    g{n}(1)\n  End Function\nEnd Class\n",
        "defs": [("class", "C{n}", 2, 6), ("method", "C{n}::f{n}", 3, 5)], "calls": [("f{n}", "g{n}")], "imports": ["L.M{n}"], "bases": [],
    },
    "merlin6502": {
        "ending": "S",
        "text": "* no{n}\n        PUT l{n}\nstart{n} LDA #1\n        JSR g{n}\n        RTS\n",
        "defs": [("function", "start{n}", 3, 3)], "calls": [("start{n}", "g{n}")], "imports": ["l{n}"], "bases": [],
    },
}


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def facts_sql(names: list[str], rows: list[tuple], key: str = "s_suppkey", table: str = "supplier") -> str:
    """SQL for rows with {n} in their texts, once for each row of a table."""
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    columns = ", ".join(f"replace({c}, '{{n}}', CAST({key} AS VARCHAR)) AS {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(names))
    return f"SELECT {columns} FROM {table}, (VALUES {values}) v({', '.join(names)})"


def texts(t, rows: list[tuple], columns: list[str], key: str = "s_suppkey", table: str = "supplier") -> DataFrame:
    """The rows' texts for each row of a table; every one of the few rows meets them all."""
    one = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, r, strict=True)]) for r in rows])
    made = getattr(t, table).select(F.col(key).cast("string").alias("n"), F.explode(one).alias("r")).repartition(F.col("n"))
    return made.select(*[F.replace(F.col(f"r.{c}"), F.lit("{n}"), F.col("n")).alias(c) for c in columns])


PLACE = "src/f{n}."
FILES = [(PLACE + x["ending"], name, x["text"]) for name, x in LANGUAGES.items()]


def _files(t) -> DataFrame:
    return texts(t, FILES, ["path", "language", "text"])


def _said(what: str, names: list[str], row) -> str:
    return facts_sql(["path", *names], [(PLACE + x["ending"], *row(r)) for x in LANGUAGES.values() for r in x[what]])


@query(_said("defs", ["kind", "name", "qualified_name", "start_line", "end_line"], lambda r: (r[0], r[1].rsplit("::", 1)[-1], r[1], r[2], r[3])))
def s7_definitions_by_language(t):
    return code.facts(_files(t)).filter("fact = 'def'").select("path", "kind", "name", "qualified_name", "start_line", "end_line")


@query(_said("calls", ["callee"], lambda r: (r[1],)))
def s7_calls_by_language(t):
    return code.facts(_files(t)).filter("fact = 'call'").select("path", F.col("name").alias("callee")).distinct()


@query(facts_sql(["path", "fact", "name"], [(PLACE + x["ending"], "import", r) for x in LANGUAGES.values() for r in x["imports"]] + [(PLACE + x["ending"], *r) for x in LANGUAGES.values() for r in x["bases"]]))
def s7_imports_and_bases(t):
    return code.facts(_files(t)).filter("fact in ('import', 'extends', 'implements')").select("path", "fact", "name").distinct()


@query(_said("calls", ["caller", "callee"], lambda r: ((r[0] or None), r[1])))
def x1_callers_by_language(t):
    nodes, edges, pending = code.graph_of(code.facts(_files(t)), "r")
    anchors = nodes.select(F.col("id").alias("anchor"), F.col("file").alias("path"), F.when(F.col("kind") != "file", F.col("name")).alias("caller"))
    open_ = pending.filter("kind = 'calls'").select("anchor", F.col("name").alias("callee"))
    closed = edges.filter("kind = 'calls'").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("callee")).hint("merge"), "dst").select(F.col("src").alias("anchor"), "callee")
    return open_.unionByName(closed).join(anchors.hint("merge"), "anchor").select("path", "caller", "callee").distinct()


@query(facts_sql(["path", "name", "outer_name"], [(PLACE + x["ending"], r[1].rsplit("::", 1)[-1], r[1].rsplit("::", 1)[0].rsplit("::", 1)[-1] if "::" in r[1] else None) for x in LANGUAGES.values() for r in x["defs"]]))
def g11_containment(t):
    nodes, edges, _ = code.graph_of(code.facts(_files(t)), "r")
    outer = nodes.select(F.col("id").alias("src"), F.when(F.col("kind") != "file", F.col("name")).alias("outer_name"))
    inner = nodes.filter("kind not in ('file', 'comment')").select(F.col("id").alias("dst"), F.col("file").alias("path"), "name")
    return edges.filter("kind = 'contains'").join(outer.hint("merge"), "src").join(inner.hint("merge"), "dst").select("path", "name", "outer_name")


DOCUMENTED = "// First {n}.\n// Second.\nfn f{n}(\n    a: u8,\n) -> u8 { a }\n\n// TODO: alone {n}\n\nstruct S{n};\n"


@query(facts_sql(["name", "doc", "signature"], [("f{n}", "First {n}.\nSecond.", "fn f{n}( a: u8, ) -> u8"), ("S{n}", None, "struct S{n}")]))
def x2_docs_and_signatures(t):
    rows = code.facts(texts(t, [("a{n}.rs", "rust", DOCUMENTED)], ["path", "language", "text"])).filter("fact = 'def'")
    return rows.select("name", "doc", "signature")


@query(facts_sql(["name", "start_line"], [("TODO: alone {n}", 7)]))
def w7_rationale_comments(t):
    rows = code.facts(texts(t, [("a{n}.rs", "rust", DOCUMENTED)], ["path", "language", "text"])).filter("fact = 'comment'")
    return rows.select("name", "start_line")


IMPORTED = [
    ("python", "py", "from a.b{n} import c{n} as d, e{n}\nfrom .x import y{n}\n", [("d", "a.b{n}"), ("e{n}", "a.b{n}"), ("y{n}", ".x")]),
    ("typescript", "ts", "import { p{n}, q as r{n} } from './m{n}';\nimport * as s{n} from 't';\nimport u{n} from \"v\";\n", [("p{n}", "./m{n}"), ("r{n}", "./m{n}"), ("s{n}", "t"), ("u{n}", "v")]),
    ("java", "java", "import static a.b.C{n}.d{n};\n", [("d{n}", "a.b.C{n}")]),
    ("rust", "rs", "use a::b{n}::C{n};\nuse d::{E{n}, f::G{n} as H{n}};\nuse i::*;\n", [("C{n}", "a::b{n}"), ("E{n}", "d"), ("H{n}", "d::f")]),
    ("php", "php", "<?php\nuse A\\B{n};\nuse C\\D{n} as E{n};\n", [("B{n}", "A"), ("E{n}", "C")]),
    ("kotlin", "kt", "import a.b.C{n}\nimport d.e.F{n} as G{n}\nimport h.*\n", [("C{n}", "a.b"), ("G{n}", "d.e")]),
    ("scala", "scala", "import a.b.C{n}\nimport d.{E{n}, F{n} => G{n}}\n", [("C{n}", "a.b"), ("E{n}", "d"), ("G{n}", "d")]),
]


@query(facts_sql(["path", "name", "target"], [("i{n}." + e, *r) for _, e, _, rows in IMPORTED for r in rows]))
def x15_x18_symbol_imports(t):
    files = texts(t, [("i{n}." + e, g, x) for g, e, x, _ in IMPORTED], ["path", "language", "text"])
    return code.facts(files).filter("fact = 'symbol_import'").select("path", "name", "target").distinct()


@query(facts_sql(["word", "n"], [("alpha{n}", 1), ("beta{n}", 2)]))
def e1_registered_extractor(t):
    """A language that a user adds: a name and a function."""

    def words(path: str, text: str):
        for i, line in enumerate(text.splitlines(), 1):
            yield {"fact": "def", "kind": "constant", "name": line.strip(), "start_line": i, "end_line": i}

    code.register("wordlist", words)
    try:
        rows = code.facts(texts(t, [("w{n}.words", "wordlist", "alpha{n}\n beta{n}\n")], ["path", "language", "text"]))
    finally:
        code.EXTRACTORS.pop("wordlist")
    return rows.select(F.col("name").alias("word"), F.col("start_line").alias("n"))


#: By query: samples (language, ending, text, facts); a fact is (fact, name, method, path, target).
DIALECTS: dict[str, list[tuple]] = {
    "x3a_builder_routes": [
        ("rust", "rs", "fn api{n}() -> Router {\n  Router::new().route(\"/u{n}/:id\", get(show{n}).delete(h::gone{n}))\n  // .route(\"/no\", get(no))\n}\nfn app() -> Router {\n  Router::new().route(\"/up\", get(up)).nest(\"/v{n}\", api{n}())\n}\n",
         [("endpoint", "show{n}", "GET", "/v{n}/u{n}/:id", None), ("endpoint", "gone{n}", "DELETE", "/v{n}/u{n}/:id", None), ("endpoint", "up", "GET", "/up", None), ("mount", "app", None, "/v{n}", "api{n}")]),
    ],
    "x3b_attribute_routes": [
        ("rust", "rs", "#[utoipa::path(post, path = \"/a{n}/{id}\", responses((status = 200)))]\nasync fn make{n}() {}\n", [("endpoint", "make{n}", "POST", "/a{n}/{id}", None)]),
    ],
    "x3c_filter_routes": [
        ("rust", "rs", "fn f() {\n  let r = warp::path(\"a{n}\").and(warp::path::param::<u32>()).and(warp::post()).and_then(h{n});\n  let s = warp::path!(\"b{n}\" / u32 / \"c\").map(k{n});\n}\n", [("endpoint", "h{n}", "POST", "/a{n}/{*}", None), ("endpoint", "k{n}", "GET", "/b{n}/{*}/c", None)]),
    ],
    "x3d_mapping_annotations": [
        ("java", "java", "@RestController\n@RequestMapping(\"/base{n}\")\npublic class C {\n  @GetMapping(\"/x/{id}\")\n  public A show{n}(int id) { return null; }\n  @RequestMapping(value = \"/y\", method = {RequestMethod.POST, RequestMethod.PUT})\n  public A put{n}() { return null; }\n  // @DeleteMapping(\"/no\")\n}\n",
         [("endpoint", "show{n}", "GET", "/base{n}/x/{id}", None), ("endpoint", "put{n}", "POST", "/base{n}/y", None), ("endpoint", "put{n}", "PUT", "/base{n}/y", None)]),
        ("kotlin", "kt", "@RequestMapping(\"/k{n}\")\nclass C {\n  @DeleteMapping(\"/z\")\n  fun gone{n}() {}\n}\n", [("endpoint", "gone{n}", "DELETE", "/k{n}/z", None)]),
    ],
    "x3e_verb_methods": [
        ("go", "go", "package p\nfunc f() {\n  r.GET(\"/u{n}/:id\", auth, h.Show{n})\n  r.POST(\"/u{n}\", Make{n})\n  // r.PUT(\"/no\", No)\n}\n", [("endpoint", "Show{n}", "GET", "/u{n}/:id", None), ("endpoint", "Make{n}", "POST", "/u{n}", None)]),
    ],
    "x3f_decorators": [
        ("python", "py", "bp = Blueprint('b', __name__, url_prefix='/b{n}')\n@bp.route('/x/<int:id>', methods=['GET', 'POST'])\ndef show{n}(id):\n    pass\nrouter = APIRouter(prefix='/r{n}')\n@router.delete('/y/{id}')\nasync def gone{n}(id):\n    pass\napp.add_url_rule('/z{n}', view_func=v.rule{n})\n# @app.get('/no')\n",
         [("endpoint", "show{n}", "GET", "/b{n}/x/<int:id>", None), ("endpoint", "show{n}", "POST", "/b{n}/x/<int:id>", None), ("endpoint", "gone{n}", "DELETE", "/r{n}/y/{id}", None), ("endpoint", "rule{n}", "GET", "/z{n}", None)]),
    ],
    "x3g_controllers": [
        ("csharp", "cs", "[ApiController]\n[Route(\"api/[controller]\")]\npublic class Item{n}Controller : ControllerBase {\n  [HttpGet(\"{id}\")]\n  public Item Show{n}(int id) { return null; }\n  [HttpPost]\n  public Item Make{n}() { return null; }\n}\n",
         [("endpoint", "Show{n}", "GET", "/api/Item{n}/{id}", None), ("endpoint", "Make{n}", "POST", "/api/Item{n}", None)]),
        ("csharp", "min.cs", "app.MapGet(\"/m{n}/{id}\", Show{n});\n", [("endpoint", "Show{n}", "GET", "/m{n}/{id}", None)]),
    ],
    "x3h_verb_calls": [
        ("typescript", "ts", "app.use('/v{n}', users{n});\nusers{n}.get('/u/:id', auth, show{n});\napp.post(`/p{n}`, make{n});\n// app.get('/no', no);\n", [("endpoint", "show{n}", "GET", "/v{n}/u/:id", None), ("endpoint", "make{n}", "POST", "/p{n}", None)]),
    ],
    "x4_grpc": [
        ("rust", "rs", "impl user::User{n} for Server {\n  async fn get_user{n}(&self, r: Request<A>) -> Result<Response<B>, Status> { Err(x) }\n}\nfn f() {\n  let mut c{n} = pb::Order{n}Client::connect(a);\n  c{n}.list_orders(q);\n}\n",
         [("grpc_server", "get_user{n}", None, "User{n}/get_user{n}", None), ("grpc_client", "c{n}", None, "Order{n}/list_orders", None)]),
    ],
    "x5_graphql": [
        ("rust", "rs", "#[Object]\nimpl Mutation{n} {\n  async fn make{n}(&self) -> i32 { 1 }\n}\n", [("graphql_server", "make{n}", None, "Mutation.make{n}", None)]),
        ("javascript", "js", "const q = gql`mutation M($a: Int) { run{n}(a: $a) { id } }`;\n", [("graphql_client", None, None, "Mutation.run{n}", None)]),
    ],
    "x6_websockets": [
        ("typescript", "ts", "const w = new WebSocket('wss://h{n}/live');\nsocket.on('chat{n}', f);\nsocket.emit('typing{n}', x);\nsocket.on('disconnect', f);\n", [("ws_connect", None, None, "wss://h{n}/live", None), ("ws_receive", "socket", None, "event:chat{n}", None), ("ws_send", "socket", None, "event:typing{n}", None)]),
        ("elixir", "ex", "defmodule C do\n  def handle_in(\"ping{n}\", _, s) do\n    push(s, \"pong{n}\", %{})\n  end\nend\n", [("ws_receive", "handle_in", None, "event:ping{n}", None), ("ws_send", None, None, "event:pong{n}", None)]),
    ],
    "x7_http_clients": [
        ("python", "py", "def f():\n    requests.post('https://a{n}.example/x', json={})\n    httpx.get(f'/y/{i}')\n", [("client_call", None, "POST", "https://a{n}.example/x", None), ("client_call", None, "GET", "/y/{i}", None)]),
        ("go", "go", "package p\nfunc f() {\n  http.Get(\"https://a{n}/x\")\n  http.NewRequest(\"PUT\", \"/y{n}\", nil)\n}\n", [("client_call", None, "GET", "https://a{n}/x", None), ("client_call", None, "PUT", "/y{n}", None)]),
        ("rust", "rs", "fn f() {\n  client.get(\"https://a{n}/x\").send();\n  c.delete(format!(\"/z{n}/{}\", i));\n}\n", [("client_call", None, "GET", "https://a{n}/x", None), ("client_call", None, "DELETE", "/z{n}/{}", None)]),
        ("typescript", "ts", "const BASE = '/api{n}';\nfetch(BASE + '/x', { method: 'POST' });\naxios.get('/y{n}/' + id);\nclass S { constructor(private http: HttpClient) {}\n  f() { return this.http.put<A>('/z{n}', b); } }\n",
         [("client_call", "fetch", "POST", "/api{n}/x", None), ("client_call", "axios", "GET", "/y{n}/${dyn}", None), ("client_call", "this.http", "PUT", "/z{n}", None), ("constant", "BASE", None, None, "/api{n}")]),
        ("java", "java", "interface A {\n  @GET(\"users{n}/{id}\")\n  Call<U> user(int id);\n}\n", [("client_call", None, "GET", "/users{n}/{id}", None)]),
    ],
    "x8_string_constants": [
        ("typescript", "ts", "export const URL{n}: string = \"/a{n}\";\nconst API{n} = {\n  USERS: '/u{n}',\n  ITEMS: `/i`,\n};\n", [("constant", "URL{n}", None, None, "/a{n}"), ("constant", "API{n}.USERS", None, None, "/u{n}"), ("constant", "API{n}.ITEMS", None, None, "/i")]),
    ],
    "x9_embedded_sql": [
        ("rust", "rs", "fn f() {\n  sqlx::query!(\"INSERT INTO a{n} SELECT * FROM b{n}\");\n}\n", [("db_write", None, None, None, "a{n}"), ("db_read", None, None, None, "b{n}")]),
        ("python", "py", "def f(c):\n    c.execute(\"\"\"\n      WITH x AS (SELECT * FROM t{n}) -- # no\n      UPDATE u{n} SET a = 1\"\"\")\n", [("db_read", None, None, None, "t{n}"), ("db_write", None, None, None, "u{n}")]),
        ("typescript", "ts", "await db.query(`DELETE FROM d{n} WHERE x = 1`);\n", [("db_write", None, None, None, "d{n}")]),
    ],
    "x11_embedded_cypher": [
        ("rust", "rs", "fn f() {\n  conn.query(\"MATCH (a:Person{n})-[:KNOWS]->(b) CREATE (c:Event{n})\");\n}\n", [("db_read", None, None, None, "Person{n}"), ("db_read", None, None, None, "KNOWS"), ("db_write", None, None, None, "Event{n}")]),
    ],
    "x12_jpa": [
        ("java", "java", "@Entity\npublic class OrderItem{n} {\n}\n", [("entity", "OrderItem{n}", None, None, "order_item{n}")]),
        ("java", "named.java", "@Entity\n@Table(name = \"people{n}\")\nclass Person {\n}\ninterface PersonRepository extends JpaRepository<Person, Long> {\n  Person findByName(String n);\n  void deleteByName(String n);\n}\n",
         [("entity", "Person", None, None, "people{n}"), ("db_read", "PersonRepository.findByName", None, None, "Person"), ("db_write", "PersonRepository.deleteByName", None, None, "Person")]),
    ],
    "x13_table_macros": [
        ("rust", "rs", "diesel::table! {\n  users{n} (id) {\n    id -> Integer,\n    name -> Text,\n  }\n}\nfn f() {\n  diesel::insert_into(users{n}::table).values(x);\n  users{n}::table.filter(y).load(c);\n}\n",
         [("entity", "users{n}", None, None, "users{n}"), ("column", "id", None, None, "users{n}"), ("column", "name", None, None, "users{n}"), ("db_write", None, None, None, "users{n}"), ("db_read", None, None, None, "users{n}")]),
    ],
    "x14_declarative_models": [
        ("python", "py", "class User(Base):\n    __tablename__ = 'users{n}'\n    id = Column(Integer)\n    name: Mapped[str] = mapped_column('full_name')\n", [("entity", "User", None, None, "users{n}"), ("column", "id", None, None, "users{n}"), ("column", "full_name", None, None, "users{n}")]),
    ],
}
SAID = ["endpoint", "mount", "client_call", "grpc_server", "grpc_client", "graphql_server", "graphql_client", "ws_connect", "ws_receive", "ws_send", "constant", "entity", "column", "db_read", "db_write"]


def _dialect(name: str, samples: list[tuple]) -> None:
    columns = ["path", "fact", "name", "method", "api_path", "target"]

    @query(facts_sql(columns, [(f"d{{n}}.{ending}", f, n, m, p, x) for _, ending, _, facts in samples for f, n, m, p, x in facts]), name=name)
    def run(t):
        files = texts(t, [(f"d{{n}}.{ending}", language, text) for language, ending, text, _ in samples], ["path", "language", "text"])
        return code.facts(files).filter(F.col("fact").isin(SAID)).select(*columns).distinct()


for _name, _samples in DIALECTS.items():
    _dialect(_name, _samples)
