"""Package manifests: names, dependencies, descriptions and keywords."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a manifest: a package has kind package, a dependency its section.
SCHEMA = "path string, ecosystem string, kind string, name string, version string, source string, description string, keywords array<string>"


def _row(ecosystem: str, kind: str, name: str | None, version=None, source=None, description=None, keywords=()) -> dict:
    return {"ecosystem": ecosystem, "kind": kind, "name": name, "version": version if isinstance(version, str) else None, "source": source, "description": description, "keywords": [k for k in keywords or () if isinstance(k, str)]}


def cargo(text: str) -> list[dict]:
    d = tomllib.loads(text)
    out = []
    if p := d.get("package"):
        out.append(_row("cargo", "package", p.get("name"), p.get("version"), None, p.get("description"), p.get("keywords")))
    for member in (d.get("workspace") or {}).get("members", []):
        out.append(_row("cargo", "member", member))
    tables = [(k, d.get(k) or {}) for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables += [("workspace", (d.get("workspace") or {}).get("dependencies") or {})]
    for target in (d.get("target") or {}).values():
        tables += [(k, target.get(k) or {}) for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    for kind, deps in tables:
        for alias, spec in deps.items():
            spec = {"version": spec} if isinstance(spec, str) else spec
            source = next((s for s in ("git", "path", "workspace") if spec.get(s)), "registry")
            out.append(_row("cargo", kind, spec.get("package", alias), spec.get("version"), source))
    return out


def npm(text: str) -> list[dict]:
    d = json.loads(text)
    out = [_row("npm", "package", d.get("name"), d.get("version"), None, d.get("description"), d.get("keywords"))]
    return out + [_row("npm", kind, n, v, "registry") for kind in ("dependencies", "devDependencies", "peerDependencies") for n, v in (d.get(kind) or {}).items()]


def pyproject(text: str) -> list[dict]:
    d = tomllib.loads(text)
    p = d.get("project") or {}
    poetry = (d.get("tool") or {}).get("poetry") or {}
    out = [_row("python", "package", p.get("name") or poetry.get("name"), p.get("version") or poetry.get("version"), None, p.get("description") or poetry.get("description"), p.get("keywords") or poetry.get("keywords"))]
    for spec in p.get("dependencies") or []:
        if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*(.*)", spec):
            out.append(_row("python", "dependencies", m[1].lower(), m[2] or None, "registry"))
    out += [_row("python", "dependencies", n.lower(), v, "registry") for n, v in (poetry.get("dependencies") or {}).items() if n.lower() != "python"]
    return out


def gomod(text: str) -> list[dict]:
    out = [_row("go", "package", m[1]) for m in re.finditer(r"(?m)^module\s+(\S+)", text)]
    body = "\n".join(m[1] for m in re.finditer(r"(?ms)^require\s*\((.*?)\)", text)) + "\n" + "\n".join(m[1] for m in re.finditer(r"(?m)^require\s+([^(\n]+)$", text))
    for line in body.splitlines():
        if m := re.match(r"\s*(\S+)\s+(v\S+)(.*)", line):
            out.append(_row("go", "indirect" if "// indirect" in m[3] else "dependencies", m[1], m[2], "registry"))
    return out


def composer(text: str) -> list[dict]:
    d = json.loads(text)
    out = [_row("composer", "package", d.get("name"), d.get("version"), None, d.get("description"), d.get("keywords"))]
    return out + [_row("composer", kind, n, v, "registry") for kind in ("require", "require-dev") for n, v in (d.get(kind) or {}).items() if "/" in n]


def csproj(text: str, fallback: str) -> list[dict]:
    root = ET.fromstring(text.lstrip("﻿"))
    found: dict[str, str] = {}
    out = []
    for e in root.iter():
        tag = e.tag.rsplit("}", 1)[-1]
        if tag in ("PackageId", "AssemblyName", "Version", "Description") and e.text:
            found.setdefault(tag, e.text.strip())
        elif tag == "PackageReference" and e.get("Include"):
            out.append(_row("dotnet", "dependencies", e.get("Include"), e.get("Version"), "registry"))
        elif tag == "ProjectReference" and e.get("Include"):
            name = re.split(r"[\\/]", e.get("Include"))[-1].removesuffix(".csproj")
            out.append(_row("dotnet", "dependencies", name, None, "path"))
    return [_row("dotnet", "package", found.get("PackageId") or found.get("AssemblyName") or fallback, found.get("Version"), None, found.get("Description")), *out]


def parse(path: str, text: str) -> list[dict]:
    """The rows of one manifest; none for other files and for manifests that can't be read."""
    name = path.rsplit("/", 1)[-1]
    readers = {"Cargo.toml": cargo, "package.json": npm, "pyproject.toml": pyproject, "go.mod": gomod, "composer.json": composer}
    try:
        if name in readers:
            return readers[name](text)
        if name.endswith(".csproj"):
            return csproj(text, name.removesuffix(".csproj"))
    except (ValueError, AttributeError, TypeError, ET.ParseError):
        return []
    return []


def manifests(files: DataFrame) -> DataFrame:
    """Manifest rows of files(path, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = [{"path": p} | r for p, t in zip(f["path"], f["text"], strict=True) if t is not None for r in parse(p, t)]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "kind", "name", "version", "source", "description", "keywords"])

    wanted = files.filter("path rlike '(^|/)(Cargo[.]toml|package[.]json|pyproject[.]toml|go[.]mod|composer[.]json|[^/]+[.]csproj)$'")
    return wanted.select("path", "text").mapInPandas(run, SCHEMA)


def packages(rows: DataFrame) -> DataFrame:
    """One row per ecosystem and name: the manifest nearest to the root."""
    from pyspark.sql import functions as F

    named = rows.filter("kind = 'package' and name is not null")
    best = named.groupBy("ecosystem", "name").agg(F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), "path", "version")).alias("b"))
    return best.select("ecosystem", "name", F.col("b.version").alias("version"), F.regexp_extract("b.path", "^(.*)/[^/]*$", 1).alias("dir"))


def external_dependencies(rows: DataFrame) -> DataFrame:
    """Distinct dependencies that aren't packages of the same tree."""
    own = rows.filter("kind = 'package'").select("ecosystem", "name")
    return rows.filter("kind not in ('package', 'member')").select("ecosystem", "name").distinct().join(own, ["ecosystem", "name"], "left_anti")


def digest(rows: DataFrame, keywords: int = 20) -> DataFrame:
    """One row: the root manifest's description, distinct keywords in order, external dependencies sorted."""
    from pyspark.sql import functions as F

    p = rows.filter("kind = 'package'").select("path", F.size(F.split("path", "/")).alias("depth"), "description", F.posexplode_outer("keywords").alias("pos", "word"))
    about = p.filter("description is not null").agg(F.min_by("description", F.struct("depth", "path")).alias("description"))
    words = p.filter("word is not null").groupBy(F.lower("word").alias("word")).agg(F.min(F.struct("depth", "path", "pos")).alias("o")).orderBy("o").limit(keywords)
    words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "word"))), lambda x: x["word"]).alias("keywords"))
    deps = external_dependencies(rows).agg(F.sort_array(F.collect_set("name")).alias("dependencies"))
    return about.join(words).join(deps)
