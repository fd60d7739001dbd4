"""API schema artifacts as operations: OpenAPI, protobuf, GraphQL and table-tracking metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VERBS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
SCHEMA = "path string, protocol string, method string, operation string"


def _yaml(text: str):
    """JSON, or YAML where a reader is installed, or the part of YAML that schemas need."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return block_yaml(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?))\s*:(?:\s+|$)""")
_SCALAR = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^,\[\]{}]*))\s*""")


def _flow(text: str, at: int = 0) -> tuple[object, int]:
    """A flow value ([a, b], {k: v}, a scalar) and where it ends."""
    at += len(text[at:]) - len(text[at:].lstrip())
    if text[at : at + 1] in ("[", "{"):
        close, out = ("]", []) if text[at] == "[" else ("}", {})
        at += 1
        while at < len(text) and text[at:].lstrip()[:1] != close:
            if close == "}":
                m = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([^:,{}]+?))\s*:\s*""").match(text, at)
                if not m:
                    raise ValueError("a flow mapping without a key")
                out[next(x for x in m.groups() if x is not None)], at = _flow(text, m.end())
            else:
                value, at = _flow(text, at)
                out.append(value)
            at = text.index(text[at:].lstrip()[:1] or close, at)
            at += text[at] == ","
        return out, text.index(close, at) + 1
    m = _SCALAR.match(text, at)
    plain = m[3].strip() if m[3] is not None else None
    return next((x for x in (m[1], m[2]) if x is not None), None if plain in ("", "null", "~") else plain), m.end()


def block_yaml(text: str):
    """Block mappings and lists with flow values and plain or quoted scalars, which stay text; anchors, tags and block scalars aren't read."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "---"))]

    def value(rest: str, i: int, indent: int) -> tuple[object, int]:
        rest = re.sub(r"\s+#.*$", "", rest).strip()
        if rest:
            return _flow(rest)[0], i
        deeper = i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("- "))
        return block(i) if deeper else (None, i)

    def block(i: int) -> tuple[object, int]:
        indent = lines[i][0]
        if lines[i][1] == "-" or lines[i][1].startswith("- "):
            items = []
            while i < len(lines) and lines[i][0] == indent and (lines[i][1] == "-" or lines[i][1].startswith("- ")):
                inner = lines[i][1][1:].lstrip()
                if _KEY.match(inner):
                    lines[i] = (indent + len(lines[i][1]) - len(inner), inner)
                    item, i = block(i)
                else:
                    item, i = value(inner, i + 1, indent)
                items.append(item)
            return items, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == indent and (m := _KEY.match(lines[i][1])):
            key = next(x for x in m.groups() if x is not None).strip()
            found[key], i = value(lines[i][1][m.end() :], i + 1, indent)
        if not found:
            raise ValueError(f"not a mapping: {lines[i][1]!r}")
        return found, i

    return block(0)[0] if lines else None


def openapi(text: str) -> list[tuple[str, str | None, str]]:
    doc = _yaml(text)
    paths = doc.get("paths") if isinstance(doc, dict) else None
    return [("rest", key.strip().upper(), path) for path, item in (paths or {}).items() if isinstance(item, dict) for key in item if key.strip().lower() in VERBS]


def protobuf(text: str) -> list[tuple[str, str | None, str]]:
    out, package, service, depth = [], "", None, 0
    for line in re.sub(r"(?s)/\*.*?\*/", "", text).splitlines():
        line = line.split("//")[0]
        if m := re.match(r"\s*package\s+([\w.]+)\s*;", line):
            package = m[1]
        if m := re.match(r"\s*service\s+(\w+)", line):
            service, depth = m[1], 0
        if service and (m := re.search(r"\brpc\s+(\w+)", line)):
            out.append(("grpc", None, f"{package + '.' if package else ''}{service}/{m[1]}"))
        depth += line.count("{") - line.count("}")
        if service and depth <= 0 and "}" in line:
            service = None
    return out


def graphql(text: str) -> list[tuple[str, str | None, str]]:
    """Fields of the root types, by the kind of root, whatever its name."""
    try:
        doc = json.loads(text)
    except ValueError:
        doc = None
    if isinstance(doc, dict):
        schema = doc.get("__schema") or (doc.get("data") or {}).get("__schema") or {}
        types = {t.get("name"): t for t in schema.get("types") or []}
        roots = [(kind, (schema.get(key) or {}).get("name")) for kind, key in (("Query", "queryType"), ("Mutation", "mutationType"), ("Subscription", "subscriptionType"))]
        return [("graphql", None, f"{kind}.{f['name']}") for kind, name in roots for f in (types.get(name) or {}).get("fields") or []]
    text = re.sub(r'(?s)""".*?"""|"[^"\n]*"|#[^\n]*', "", text)
    names = {m[2]: m[1].capitalize() for block in re.findall(r"\bschema\b[^{]*\{([^}]*)\}", text) for m in re.finditer(r"(query|mutation|subscription)\s*:\s*(\w+)", block)}
    names = {"Query": "Query", "Mutation": "Mutation", "Subscription": "Subscription"} | names
    out = []
    for m in re.finditer(r"\b(?:extend\s+)?type\s+(\w+)[^{]*\{([^}]*)\}", text):
        if kind := names.get(m[1]):
            body = re.sub(r"\([^)]*\)", "", m[2])
            out += [("graphql", None, f"{kind}.{f}") for f in re.findall(r"(?m)^\s*(\w+)\s*:", body)]
    return out


def handler_path(url: str) -> str | None:
    """The path of a handler's URL, absolute, behind a template, or relative; null if there is none."""
    m = re.search(r"/.*", re.sub(r"^\s*[^/{]*://[^/]*", "", url).strip(), re.S)
    return m[0] if m else None


def tracked_tables(text: str) -> list[tuple[str, str | None, str]]:
    """Operations of a table-tracking GraphQL server's metadata: seven for every table, REST endpoints, actions with their handlers, remote schemas."""
    doc = _yaml(text)
    doc = {"tables": doc} if isinstance(doc, list) else doc.get("metadata", doc) if isinstance(doc, dict) else {}
    listed = [*(t for source in doc.get("sources") or [] for t in source.get("tables") or []), *(doc.get("tables") or [])]
    out = []
    for t in listed:
        table, how = t.get("table"), t.get("configuration") or {}
        name = table.get("name") if isinstance(table, dict) else table
        if not name:
            continue
        base, custom = how.get("custom_name") or name, how.get("custom_root_fields") or {}
        fields = {"select": base, "select_by_pk": f"{base}_by_pk", "select_aggregate": f"{base}_aggregate", "insert": f"insert_{base}", "update": f"update_{base}", "delete": f"delete_{base}"}
        fields |= {k: v for k, v in custom.items() if isinstance(v, str)}
        roots = {"Query": ["select", "select_by_pk", "select_aggregate"], "Mutation": ["insert", "update", "delete"], "Subscription": ["select"]}
        out += [("graphql", None, f"{root}.{fields[key]}") for root, keys in roots.items() for key in keys]
    for e in doc.get("rest_endpoints") or []:
        if e.get("url"):
            out += [("rest", m.upper(), f"/api/rest/{e['url'].lstrip('/')}") for m in e.get("methods") or ["GET"]]
    for a in doc.get("actions") or []:
        if a.get("name"):
            how = a.get("definition") or {}
            out.append(("graphql", None, f"{'Query' if how.get('type') == 'query' else 'Mutation'}.{a['name']}"))
            if path := handler_path(how.get("handler") or ""):
                out.append(("rest", "POST", path))
    out += [("graphql", None, f"RemoteSchema.{r['name']}") for r in doc.get("remote_schemas") or [] if r.get("name")]
    return out


READERS = {"openapi": openapi, "proto": protobuf, "graphql": graphql, "hasura": tracked_tables}


def reader_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".proto"):
        return "proto"
    if name.endswith((".graphql", ".graphqls", ".gql")) or "introspection" in name:
        return "graphql"
    split = re.search(r"(?i)(?:^|/)metadata/(?:.*/)?(?:tables|actions|remote_schemas|rest_endpoints)[^/]*[.]ya?ml$", path)
    if split or "metadata" in name and name.endswith((".json", ".yaml", ".yml")):
        return "hasura"
    if ("openapi" in name or "swagger" in name) and name.endswith((".json", ".yaml", ".yml")):
        return "openapi"
    return None


def schema_operations(files: DataFrame) -> DataFrame:
    """Operations that the schema artifacts among files(path, text) declare; what can't be read declares none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for path, text in zip(f["path"], f["text"], strict=True):
                if text is not None and (kind := reader_of(path)):
                    try:
                        rows += [(path, *op) for op in READERS[kind](text)]
                    except (ValueError, AttributeError, TypeError, KeyError):
                        continue
            yield pd.DataFrame(rows, columns=["path", "protocol", "method", "operation"])

    return files.select("path", "text").mapInPandas(run, SCHEMA).distinct()
