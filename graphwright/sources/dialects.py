"""What source code says about APIs and data: routes, client calls, queries and entities, by framework.

Each dialect is a function from (language, text) to facts (fact, name, method, path, line, target); they read the text by
patterns, as a lexer would, and leave out what needs evaluation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from graphwright.sources.sqltext import access, cypher_labels

Fact = dict
VERBS = ["get", "post", "put", "delete", "patch", "head", "options"]
_STR = r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)"""


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _string(m: re.Match, first: int) -> str | None:
    return next((m[i] for i in (first, first + 1, first + 2) if m[i] is not None), None)


def _fact(fact: str, text: str, at: int, name=None, method=None, path=None, target=None) -> Fact:
    return {"fact": fact, "name": name, "method": method, "path": path, "line": line_of(text, at), "target": target}


def _next_function(text: str, at: int, pattern: str) -> str | None:
    m = re.compile(pattern).search(text, at)
    return m[1] if m else None


def rust_routes(language: str, text: str) -> Iterator[Fact]:
    """Builder chains: .route("/p", get(h).post(h2)), .nest("/p", f()) prefixes functions of the file, attribute paths, filter chains."""
    if language != "rust":
        return
    bodies = {m[1]: m.start() for m in re.finditer(r"\bfn\s+(\w+)[^{;]*->[^{;]*Router[^{]*\{", text)}
    spans = sorted(bodies.items(), key=lambda x: x[1])
    inside = lambda at: next((n for n, s in reversed(spans) if s < at), None)
    nested: dict[str, list[tuple[str | None, str]]] = {}
    for m in re.finditer(r"\.(nest|merge)\(\s*(?:\"([^\"]*)\"\s*,\s*)?(\w+)\s*\(", text):
        nested.setdefault(m[3], []).append((inside(m.start()), m[2] or ""))
        if (outer := inside(m.start())) and outer != m[3] and m[3] in bodies:
            yield _fact("mount", text, m.start(), name=outer, target=m[3], path=m[2] or "")

    def prefixes(name: str | None, seen: frozenset = frozenset()) -> list[str]:
        if name is None or name not in nested or name in seen:
            return [""]
        return [p + prefix for outer, prefix in nested[name] for p in prefixes(outer, seen | {name})]

    for m in re.finditer(r"\.route(?:_service)?\(\s*\"([^\"]*)\"\s*,", text):
        for v in re.finditer(rf"\b({'|'.join(VERBS)})\(\s*([\w:]+)", text[m.end() : _close(text, text.index("(", m.start()), "()")]):
            for prefix in dict.fromkeys(prefixes(inside(m.start()))):
                yield _fact("endpoint", text, m.start(), v[2].rsplit("::", 1)[-1], v[1].upper(), prefix + m[1])
    for m in re.finditer(r"#\[utoipa::path\((.*?)\)\]", text, re.S):
        verb, path = re.search(rf"\b({'|'.join(VERBS)})\b", m[1]), re.search(r"path\s*=\s*\"([^\"]*)\"", m[1])
        if verb and path:
            yield _fact("endpoint", text, m.start(), _next_function(text, m.end(), r"\bfn\s+(\w+)"), verb[1].upper(), path[1])
    for m in re.finditer(r"\blet\s+\w+\s*=\s*(warp::[^;]*);", text, re.S):
        parts = re.findall(r"\bpath\(\s*\"([^\"]*)\"|\bpath!\(([^)]*)\)|\bparam(?:::<\w+>)?\(", m[1])
        segments = [x for lit, macro in parts for x in ([lit] if lit else [s.strip().strip('"') if '"' in s else "{*}" for s in macro.split("/")] if macro else ["{*}"])]
        if segments:
            verbs = re.findall(rf"warp::({'|'.join(VERBS)})\(\)", m[1]) or ["get"]
            handler = re.search(r"\.(?:and_then|map|then)\(\s*([\w:]+)", m[1])
            for v in dict.fromkeys(verbs):
                yield _fact("endpoint", text, m.start(), handler and handler[1].rsplit("::", 1)[-1], v.upper(), "/" + "/".join(segments))


def spring_routes(language: str, text: str) -> Iterator[Fact]:
    if language not in ("java", "kotlin"):
        return
    head = re.search(r"@(\w*Mapping)\s*\(([^)]*)\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+|open\s+|abstract\s+)*class\b", text)
    path_of = lambda args: (m := re.search(r"(?:^|value\s*=|path\s*=)\s*[{\[]?\s*\"([^\"]*)\"", args.strip())) and m[1]
    base = (head and path_of(head[2])) or ""
    for m in re.finditer(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(([^)]*)\))?", text):
        if head and m.start() == head.start():
            continue
        args = m[2] or ""
        verbs = [m[1].upper()] if m[1] != "Request" else re.findall(r"RequestMethod\.(\w+)", args)
        handler = _next_function(text, m.end(), r"\b(?:fun\s+)?(\w+)\s*\(")
        for v in verbs:
            yield _fact("endpoint", text, m.start(), handler, v, base.rstrip("/") + "/" + (path_of(args) or "").lstrip("/"))


def gin_routes(language: str, text: str) -> Iterator[Fact]:
    if language == "go":
        for m in re.finditer(r"\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*\"([^\"]*)\"\s*,\s*(?:[^()\n]*,\s*)?([\w.]+)", text):
            yield _fact("endpoint", text, m.start(), m[3].rsplit(".", 1)[-1], m[1], m[2])


def python_routes(language: str, text: str) -> Iterator[Fact]:
    if language != "python":
        return
    own = {m[1]: m[2] for m in re.finditer(r"(\w+)\s*=\s*(?:Blueprint|APIRouter)\([^)]*?(?:url_prefix|prefix)\s*=\s*[\"']([^\"']*)", text)}
    mounted = {m[1]: m[2] for m in re.finditer(r"\.(?:include_router|register_blueprint)\(\s*([\w.]+)[^)]*?(?:url_prefix|prefix)\s*=\s*[\"']([^\"']*)", text)}
    methods_of = lambda args: [x.upper() for x in re.findall(r"[\"'](\w+)[\"']", m[1])] if (m := re.search(r"methods\s*=\s*[\[(]([^\])]*)", args)) else ["GET"]
    prefix = lambda router: mounted.get(router, "") + own.get(router, "")
    for m in re.finditer(rf"@(\w+)\.(route|{'|'.join(VERBS)})\(\s*[\"']([^\"']*)[\"']([^)]*)\)", text):
        handler = _next_function(text, m.end(), r"\bdef\s+(\w+)")
        for v in methods_of(m[4]) if m[2] == "route" else [m[2].upper()]:
            yield _fact("endpoint", text, m.start(), handler, v, prefix(m[1]) + m[3])
    for m in re.finditer(r"(\w+)\.add_url_rule\(\s*[\"']([^\"']*)[\"']([^)]*)\)", text):
        view = re.search(r"view_func\s*=\s*([\w.]+)", m[3])
        for v in methods_of(m[3]):
            yield _fact("endpoint", text, m.start(), view and view[1].rsplit(".", 1)[-1], v, prefix(m[1]) + m[2])


def aspnet_routes(language: str, text: str) -> Iterator[Fact]:
    if language != "csharp":
        return
    for c in re.finditer(r"((?:\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)*)(?:public\s+|sealed\s+|abstract\s+)*class\s+(\w+)", text):
        route = re.search(r"\[Route\(\"([^\"]*)\"\)\]", c[1])
        base = (route[1] if route else "").replace("[controller]", c[2].removesuffix("Controller"))
        end = text.find("\nclass ", c.end())
        for m in re.finditer(r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\"([^\"]*)\"[^)]*\))?\]", text[c.end() : end if end >= 0 else None]):
            yield _fact("endpoint", text, c.end() + m.start(), _next_function(text, c.end() + m.end(), r"(\w+)\s*(?:<[^>]*>)?\("), m[1].upper(), f"/{base.strip('/')}/{(m[2] or '').strip('/')}".rstrip("/") or "/")
    for m in re.finditer(r"\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]*)\"\s*,\s*(?:async\s*)?(\w+)?", text):
        yield _fact("endpoint", text, m.start(), m[3], m[1].upper(), m[2])


_JS = ("javascript", "typescript", "tsx")


def express_routes(language: str, text: str) -> Iterator[Fact]:
    if language not in _JS:
        return
    mounted = {m[2]: m[1] for m in re.finditer(r"\.use\(\s*[\"'`]([^\"'`]*)[\"'`]\s*,(?:[^()\n]*,)?\s*(\w+)\s*\)", text)}
    for m in re.finditer(rf"\b(\w+)\.({'|'.join(VERBS)})\(\s*{_STR}\s*,\s*([^;\n]*)", text):
        if m[1] != "axios" and re.search(r"=>|\bfunction\b|[\w.]+\s*\)?\s*;?$", m[6]) and not re.match(r"\s*\{", m[6]):
            handler = re.search(r"([\w.]+)\s*\)\s*;?\s*$", m[6])
            yield _fact("endpoint", text, m.start(), handler and handler[1].rsplit(".", 1)[-1], m[2].upper(), mounted.get(m[1], "") + (_string(m, 3) or ""))


def js_clients(language: str, text: str) -> Iterator[Fact]:
    if language not in _JS:
        return
    constants = {m[1]: _string(m, 2) for m in re.finditer(rf"\bconst\s+(\w+)\s*=\s*{_STR}\s*;?", text)}
    clients = {"axios", *re.findall(r"\b(\w+)\s*=\s*axios\.create\(", text)}
    fields = set(re.findall(r"(\w+)\s*:\s*HttpClient\b", text))
    url = rf"((?:{_STR}|[\w.]+)(?:\s*\+\s*(?:{_STR}|[\w.()]+))*)"

    def value(expr: str) -> str | None:
        out, known = "", False
        for part in re.split(r"\s*\+\s*", expr):
            if m := re.fullmatch(_STR, part):
                out, known = out + (_string(m, 1) or ""), True
            elif part in constants:
                out, known = out + (constants[part] or ""), True
            else:
                out += "${dyn}"
        return out if known else None

    for m in re.finditer(rf"\bfetch\(\s*{url}\s*(?:,\s*\{{([^}}]*))?", text):
        method = re.search(r"method\s*:\s*[\"'`](\w+)", m[m.lastindex] or "") if m.lastindex and m.lastindex > 1 else None
        if path := value(m[1]):
            yield _fact("client_call", text, m.start(), "fetch", method[1].upper() if method else "GET", path)
    names = "|".join(map(re.escape, sorted(clients | {f"this.{f}" for f in fields})))
    for m in re.finditer(rf"(?<![\w.])({names})\.({'|'.join(VERBS)})(?:<[^>(]*>)?\(\s*{url}", text):
        if path := value(m[3]):
            yield _fact("client_call", text, m.start(), m[1], m[2].upper(), path)


def http_clients(language: str, text: str) -> Iterator[Fact]:
    """Verb-named calls on a literal URL or path in Rust, Go and Python, and annotated interfaces in Java and Kotlin."""
    if language == "rust":
        pattern = rf"(?<!\.route)\b(?:\w+\.|reqwest::)({'|'.join(VERBS)})\(\s*&?(?:format!\(\s*)?\"((?:https?://|/)[^\"]*)\""
    elif language == "go":
        pattern = r"\bhttp\.(Get|Post|Head|PostForm)\(\s*\"((?:https?://|/)[^\"]*)\""
    elif language == "python":
        pattern = rf"(?<!@)\b(?:requests|httpx|session|client|http)\.({'|'.join(VERBS)})\(\s*f?[\"']((?:https?://|/)[^\"']*)"
    elif language in ("java", "kotlin"):
        pattern = r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*\"([^\"]*)\"\s*\)"
    else:
        return
    for m in re.finditer(pattern, text):
        method = {"POSTFORM": "POST"}.get(m[1].upper(), m[1].upper())
        path = m[2] if language not in ("java", "kotlin") or re.match(r"https?://|/", m[2]) else f"/{m[2]}"
        yield _fact("client_call", text, m.start(), None, method, path)
    if language == "go":
        for m in re.finditer(r"http\.NewRequest(?:WithContext)?\([^\"\n]*\"(\w+)\"\s*,\s*\"((?:https?://|/)[^\"]*)\"", text):
            yield _fact("client_call", text, m.start(), None, m[1].upper(), m[2])


def rpc(language: str, text: str) -> Iterator[Fact]:
    """gRPC service implementations and client stubs; GraphQL resolvers and client documents."""
    if language == "rust":
        for m in re.finditer(r"\bimpl\s+(?:\w+::)*(\w+)\s+for\s+\w+\s*\{", text):
            body = text[m.end() : _close(text, m.end() - 1)]
            if "Request" in body and "Status" in body:
                for f in re.finditer(r"\basync\s+fn\s+(\w+)", body):
                    yield _fact("grpc_server", text, m.end() + f.start(), f[1], None, f"{m[1]}/{f[1]}")
        stubs = {m[1]: m[2] for m in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*=\s*(?:\w+::)*(\w+)Client(?:::|\b)", text)}
        for name, service in stubs.items():
            for f in re.finditer(rf"\b{name}\.(\w+)\(", text):
                if f[1] not in ("clone", "connect"):
                    yield _fact("grpc_client", text, f.start(), name, None, f"{service}/{f[1]}")
        for m in re.finditer(r"#\[(?:\w+::)?(Object|Subscription|MergedObject|graphql_object|graphql_subscription)[^\]]*\]\s*impl\s+(\w+)", text, re.I):
            kind = "Subscription" if "subscription" in m[1].lower() else next((k for k in ("Mutation", "Subscription") if k in m[2]), "Query")
            start = text.find("{", m.end())
            for f in re.finditer(r"\bfn\s+(\w+)", text[start : _close(text, start)]):
                yield _fact("graphql_server", text, start + f.start(), f[1], None, f"{kind}.{f[1]}")
    if language in _JS:
        for m in re.finditer(r"\b(?:gql|graphql)\s*\(?\s*`([^`]*)`", text):
            op = re.match(r"\s*(query|mutation|subscription)?\b[^{]*\{\s*(?:\w+\s*:\s*)?(\w+)", m[1])
            if op:
                yield _fact("graphql_client", text, m.start(), None, None, f"{(op[1] or 'query').capitalize()}.{op[2]}")


def _close(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at a position closes."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if depth == 0:
            return i
    return len(text)


#: Events that libraries raise themselves.
RESERVED_EVENTS = {"connect", "connection", "disconnect", "disconnecting", "connect_error", "error", "reconnect", "close", "open", "message"}


def websockets(language: str, text: str) -> Iterator[Fact]:
    if language in _JS:
        for m in re.finditer(rf"\bnew\s+WebSocket\(\s*{_STR}", text):
            yield _fact("ws_connect", text, m.start(), None, None, _string(m, 1))
        for m in re.finditer(rf"\b(socket|io|client|connection|channel|hub|sub)\.(on|once|emit|invoke|send|push|subscribe|publish)\(\s*{_STR}", text):
            event = _string(m, 3)
            if event and event not in RESERVED_EVENTS:
                yield _fact("ws_receive" if m[2] in ("on", "once", "subscribe") else "ws_send", text, m.start(), m[1], None, f"event:{event}")
    if language == "elixir":
        for m in re.finditer(r"\bdef\s+handle_in\(\s*\"([^\"]+)\"", text):
            yield _fact("ws_receive", text, m.start(), "handle_in", None, f"event:{m[1]}")
        for m in re.finditer(r"\b(?:push|broadcast!?)\(\s*\w+\s*,\s*\"([^\"]+)\"", text):
            yield _fact("ws_send", text, m.start(), None, None, f"event:{m[1]}")


def embedded_queries(language: str, text: str) -> Iterator[Fact]:
    """Query texts in strings: SQL after query-like calls, and Cypher patterns in Rust."""
    if language not in ("rust", "python", *_JS):
        return
    string = r"(?:r#\"(.*?)\"#|\"\"\"(.*?)\"\"\"|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)"
    for m in re.finditer(rf"\b(?:query\w*!?|execute\w*|raw|text|fetch\w*|prepare|sql)\s*(?:::<[^>]*>)?\(\s*(?:\w+\s*,\s*)?f?{string}", text, re.S):
        sql = next((g for g in m.groups() if g is not None), "")
        if re.match(r"\s*(select|insert|update|delete|with)\b", sql, re.I):
            for kind, table in access(sql):
                yield _fact(f"db_{kind}", text, m.start(), None, None, None, table)
        elif language == "rust" and re.search(r"\b(match|merge|create)\b\s*\(", sql, re.I):
            for kind, label in cypher_labels(sql):
                yield _fact(f"db_{kind}", text, m.start(), None, None, None, label)


def entities(language: str, text: str) -> Iterator[Fact]:
    """Classes that stand for tables: JPA, SQLAlchemy and Diesel."""
    if language in ("java", "kotlin"):
        for m in re.finditer(r"@Entity\b(?:\(([^)]*)\))?((?:\s*@\w+(?:\([^)]*\))?)*)\s*(?:public\s+|open\s+|data\s+)*class\s+(\w+)", text):
            named = re.search(r"name\s*=\s*\"(\w+)\"", m[1] or "")
            table = re.search(r"@Table\([^)]*name\s*=\s*\"([\w.]+)\"", m[2] + text[max(0, m.start() - 200) : m.start()])
            name = named[1] if named else m[3]
            yield _fact("entity", text, m.start(), m[3], None, None, table[1] if table else re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
        for m in re.finditer(r"interface\s+(\w+)\s*(?:extends|:)\s*\w*Repository\s*<\s*(\w+)", text):
            start = text.find("{", m.end())
            body = text[start : _close(text, start)] if start >= 0 else ""
            for f in re.finditer(r"(?:@Query\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*)?(?:[\w<>\[\], ?]+\s+|fun\s+)(\w+)\s*\(", body):
                if f[1]:
                    kinds = {k for k, _ in access(f[1])} or {"read"}
                else:
                    kinds = {"write"} if re.match(r"(save|delete|remove|insert|update)", f[2]) else {"read"} if re.match(r"(find|get|read|query|count|exists|search|stream)", f[2]) else set()
                for k in sorted(kinds):
                    yield _fact(f"db_{k}", text, start + f.start(), f"{m[1]}.{f[2]}", None, None, m[2])
    if language == "python":
        for m in re.finditer(r"(?m)^class\s+(\w+)[^\n]*:\n((?:[ \t]+.*\n|\s*\n)+)", text):
            if t := re.search(r"__tablename__\s*=\s*[\"'](\w+)", m[2]):
                yield _fact("entity", text, m.start(), m[1], None, None, t[1])
                for c in re.finditer(r"(?m)^\s+(\w+)\s*(?::[^=\n]*)?=\s*(?:\w+\.)?(?:Column|mapped_column)\(\s*(?:[\"'](\w+)[\"'])?", m[2]):
                    yield _fact("column", text, m.start() + c.start(), c[2] or c[1], None, None, t[1])
    if language == "rust":
        for m in re.finditer(r"\b(?:diesel::)?table!\s*\{\s*(?:\w+\.)?(\w+)\s*(?:\([^)]*\))?\s*\{", text):
            yield _fact("entity", text, m.start(), m[1], None, None, m[1])
            for c in re.finditer(r"(\w+)\s*->", text[m.end() : _close(text, m.end() - 1)]):
                yield _fact("column", text, m.end() + c.start(), c[1], None, None, m[1])
        for m in re.finditer(r"\b(insert_into|update|delete)\(\s*(\w+)::table", text):
            yield _fact("db_write", text, m.start(), None, None, None, m[2])
        for m in re.finditer(r"\b(\w+)::table\s*\.[^;]*?\b(?:load|first|get_result|get_results)\b", text):
            yield _fact("db_read", text, m.start(), None, None, None, m[1])


def constants(language: str, text: str) -> Iterator[Fact]:
    """Module-level string constants, and members of constant objects as OBJECT.MEMBER."""
    if language in _JS:
        for m in re.finditer(rf"(?m)^(?:export\s+)?const\s+(\w+)\s*(?::[^=\n]*)?=\s*{_STR}", text):
            yield _fact("constant", text, m.start(), m[1], None, None, _string(m, 2))
        for m in re.finditer(r"(?m)^(?:export\s+)?const\s+(\w+)\s*(?::[^=\n]*)?=\s*\{([^}]*)\}", text):
            for p in re.finditer(rf"(\w+)\s*:\s*{_STR}", m[2]):
                yield _fact("constant", text, m.start(), f"{m[1]}.{p[1]}", None, None, _string(p, 2))


#: Dialects by name; more can be registered.
DIALECTS: dict[str, Callable[[str, str], Iterator[Fact]]] = {
    f.__name__: f for f in (rust_routes, spring_routes, gin_routes, python_routes, aspnet_routes, express_routes, js_clients, http_clients, rpc, websockets, embedded_queries, entities, constants)
}
