"""Text, path and identifier functions as native column expressions.

Every function takes and returns Columns and stays inside Catalyst; nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of provider credentials.
SECRET_PREFIXES = ["sk-", "ghp_", "gho_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "AKIA", "ASIA", "AIza", "AccountKey="]
REDACTED = "[REDACTED]"

#: Mail domains that ignore what follows a plus sign, and of these, those that ignore dots.
PLUS_DOMAINS = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "mac.com", "fastmail.com", "fastmail.fm", "proton.me", "protonmail.com", "pm.me"]
DOT_DOMAINS = ["gmail.com", "googlemail.com"]

#: Words of commit subjects that name no topic.
TOPIC_STOPWORDS = [
    "add", "added", "adds", "fix", "fixed", "fixes", "update", "updated", "updates", "remove", "removed", "removes", "delete", "deleted", "refactor",
    "rename", "renamed", "move", "moved", "bump", "merge", "revert", "wip", "use", "used", "make", "made", "set", "get", "init", "clean", "cleanup",
    "improve", "improved", "change", "changed", "changes", "support", "implement", "handle", "allow", "avoid", "ensure", "the", "and", "for", "with",
    "from", "into", "this", "that", "when", "then", "also", "via", "not", "but", "are", "was", "has", "had", "can", "all", "new", "now", "one", "two",
    "more", "less", "some", "any", "out", "off", "per", "you", "your", "its", "their", "test", "tests", "todo",
]
#: Directories that name no topic.
GENERIC_DIRS = [
    "src", "lib", "test", "tests", "crates", "crate", "app", "apps", "pkg", "packages", "internal", "cmd", "main", "mod", "index", "bin", "dist",
    "build", "target", "node_modules", "vendor", "docs", "doc", "examples", "example", "include", "assets", "static",
]
MAX_TOPICS = 12

#: File extensions by language.
EXTENSIONS = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hh", "hxx"],
    "csharp": ["cs"],
    "ruby": ["rb"],
    "kotlin": ["kt", "kts"],
    "bash": ["sh", "bash"],
    "php": ["php"],
    "scala": ["scala", "sc"],
    "ocaml": ["ml", "mli"],
    "haskell": ["hs"],
    "lua": ["lua"],
    "swift": ["swift"],
    "elixir": ["ex", "exs"],
    "zig": ["zig"],
    "r": ["r"],
    "dart": ["dart"],
    "pascal": ["pas", "pp", "lpr", "dpr"],
    "vb6": ["bas", "cls", "frm", "ctl"],
    "vbnet": ["vb"],
}
LANGUAGE_OF = {e: name for name, es in EXTENSIONS.items() for e in es}

#: Words of a comment that mark a rationale.
MARKERS = ["NOTE", "WHY", "HACK", "TODO", "FIXME"]


def _braced(name: Column) -> Column:
    kept = F.regexp_replace(name, "[^A-Za-z0-9_]", "")
    return F.when(kept == "", F.lit("{*}")).otherwise(F.concat(F.lit("{"), kept, F.lit("}")))


def _segment(x: Column) -> Column:
    inner = F.substring(x, F.lit(2), F.length(x) - 2)
    rest = F.substring(x, F.lit(2), F.length(x))
    return (
        F.when(x.rlike(r"^\{.*\}$"), _braced(F.split_part(inner, F.lit(":"), F.lit(1))))
        .when(x.startswith(":"), _braced(rest))
        .when(x.rlike("^<.*>$"), _braced(F.split_part(inner, F.lit(":"), F.lit(-1))))
        .when(x.rlike(r"^\[.*\]$"), _braced(x))
        .when(x.startswith("*"), _braced(rest))
        .otherwise(x)
    )


def path_segments(path: Column) -> Column:
    """The canonical segments of a path or URL: no scheme, authority, query or fragment, parameters as {name}."""
    s = F.trim(path)
    s = F.when(s.contains("://"), F.regexp_extract(F.regexp_replace(s, "(?s)^.*?://", ""), "(?s)(/.*)", 1)).otherwise(s)
    s = F.regexp_extract(s, "^[^?#]*", 0)
    return F.transform(F.filter(F.split(s, "/"), lambda x: x != ""), _segment)


def normalize_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path_segments(path), "/"))


_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _is_dynamic(x: Column) -> Column:
    return x.rlike(r"^\{.*\}$") | x.contains("${") | x.rlike("^[0-9]+$") | x.rlike(_UUID)


def path_signature(path: Column) -> Column:
    """The normalised path with every dynamic segment as {}."""
    return F.concat(F.lit("/"), F.array_join(F.transform(path_segments(path), lambda x: F.when(_is_dynamic(x), F.lit("{}")).otherwise(x)), "/"))


def fold(x: Column) -> Column:
    return F.lower(F.replace(x, F.lit("_"), F.lit("")))


def operation_signature(protocol: Column, method: Column, path: Column) -> Column:
    """The key by which clients, endpoints and schema operations meet."""
    service = F.when(path.contains("/"), F.regexp_replace(F.regexp_extract(path, "(?s)^(.*)/", 1), r"(?s)^.*\.", "")).otherwise(F.lit(""))
    operation = F.when(path.contains("."), F.split_part(path, F.lit("."), F.lit(1))).otherwise(F.lit("query"))
    field = F.when(path.contains("."), F.regexp_replace(path, r"(?s)^[^.]*\.", "")).otherwise(path)
    return (
        F.when(protocol == "grpc", F.concat(F.lit("grpc|"), fold(service), F.lit("/"), fold(F.regexp_replace(path, "(?s)^.*/", ""))))
        .when(protocol == "graphql", F.concat(F.lit("graphql|"), fold(operation), F.lit("."), fold(field)))
        .when((protocol == "websocket") & path.startswith("event:"), F.concat(F.lit("ws|event|"), fold(F.substring(path, F.lit(7), F.length(path)))))
        .when(protocol == "websocket", F.concat(F.lit("rest|GET|"), path_signature(path)))
        .otherwise(F.concat(protocol, F.lit("|"), F.coalesce(method, F.lit("*")), F.lit("|"), path_signature(path)))
    )


def has_literal_segment(signature: Column) -> Column:
    return F.exists(F.split(F.element_at(F.split(signature, r"\|"), -1), "/"), lambda s: (s != "") & (s != "{}"))


def normalize_prefix(prefix: str) -> str:
    bare = prefix.strip().strip("/")
    return f"/{bare}" if bare else ""


def rewrite_prefix(path: Column, source: str, target: str) -> Column:
    """The path under a prefix rewrite on segment boundaries, or null; an empty source prepends the target."""
    p, to, start = normalize_path(path), normalize_prefix(target), normalize_prefix(source)
    if not source.strip():
        return normalize_path(F.concat(F.lit(to), p))
    if not start:
        return F.lit(None).cast("string")
    rest = F.substring(p, F.lit(len(start) + 2), F.length(p))
    return F.when(p == start, F.lit(to or "/")).when(p.startswith(f"{start}/"), normalize_path(F.concat(F.lit(f"{to}/"), rest)))


def external_candidates(path: Column, rewrites: list[tuple[str, str]], gateways: list[str], heuristic: bool = True) -> Column:
    """Array of (path, rank): the path itself and explicit rewrites (rank 2), and with gateways stripped (rank 1); the best of each path."""
    found = [F.struct(normalize_path(path).alias("path"), F.lit(2).alias("rank"))]
    found += [F.struct(rewrite_prefix(path, a, b).alias("path"), F.lit(2).alias("rank")) for a, b in rewrites]
    found += [F.struct(rewrite_prefix(path, g, "").alias("path"), F.lit(1).alias("rank")) for g in gateways if heuristic]
    there = F.filter(F.array(*found), lambda x: x["path"].isNotNull())
    return F.filter(F.array_distinct(there), lambda x: (x["rank"] == 2) | ~F.exists(there, lambda y: (y["path"] == x["path"]) & (y["rank"] == 2)))


_TOKEN = "A-Za-z0-9_./+=-"


def scrub_secrets(text: Column) -> Column:
    """Credential-like tokens replaced: a known prefix with at least 8 more characters, or three dotted parts from eyJ on."""
    alone = f"(?<![{_TOKEN}])"
    prefixes = "|".join(p.replace(".", r"\.") for p in SECRET_PREFIXES)
    out = F.regexp_replace(text, f"{alone}(?:{prefixes})(?=[_./+=-]*[A-Za-z0-9])[{_TOKEN}]{{8,}}", REDACTED)
    return F.regexp_replace(out, rf"{alone}(?=eyJ)(?=[{_TOKEN}]{{41}})[A-Za-z0-9_/+=-]+\.[A-Za-z0-9_/+=-]*\.[A-Za-z0-9_/+=-]*(?![{_TOKEN}])", REDACTED)


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob of * and ?."""
    plain = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else f"[{c}]" if c not in "^\\[]" else f"\\{c}" for c in glob)
    return f"(?is)^{plain}$"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_regex(glob))


def canonical_email(email: Column) -> Column:
    """The mailbox that an address delivers to, where the provider's rules are certain; lower case."""
    e = F.lower(F.trim(email))
    local, domain = F.regexp_extract(e, "(?s)^(.*)@[^@]*$", 1), F.regexp_extract(e, "(?s)^.*@([^@]*)$", 1)
    base = F.split_part(local, F.lit("+"), F.lit(1))
    base = F.when(domain.isin(DOT_DOMAINS), F.replace(base, F.lit("."), F.lit(""))).otherwise(base)
    return F.when(e.contains("@") & domain.isin(PLUS_DOMAINS) & (base != ""), F.concat(base, F.lit("@"), domain)).otherwise(e)


def lexical_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs of two or more characters that aren't numbers, in order."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))


def language_of(path: Column) -> Column:
    """The language of a file by its extension (case counts only for .S)."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.when(extension == "S", F.lit("merlin6502")).otherwise(F.try_element_at(table, F.lower(extension)))


def derive_topics(subject: Column, files: Column) -> Column:
    """Sorted topics of a commit: subject keywords (letters and digits of any script), directories and languages of the files, the first MAX_TOPICS."""
    words = F.filter(F.split(F.lower(F.regexp_replace(subject, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}") & ~t.isin(TOPIC_STOPWORDS))
    dirs = F.flatten(F.transform(files, lambda f: F.split(F.lower(F.regexp_extract(f, "^(.*)/[^/]*$", 1)), "/")))
    dirs = F.filter(dirs, lambda d: (F.length(d) >= 2) & d.rlike("[a-z]") & ~d.isin(GENERIC_DIRS) & ~d.isin(".."))
    languages = F.filter(F.transform(files, language_of), lambda x: x.isNotNull())
    return F.slice(F.array_sort(F.array_distinct(F.concat(words, dirs, languages))), 1, MAX_TOPICS)


def contains_identifier(text: Column, name: str) -> Column:
    """Whether the text has the name as a whole identifier."""
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])")


def table_name(name: Column) -> Column:
    """A table's identity: dotted parts without quotes, lower case."""
    return F.lower(F.array_join(F.transform(F.split(name, r"\."), lambda s: F.regexp_replace(s, '^["`]+|["`]+$', "")), "."))


def enclosing_scope(qualified: Column) -> Column:
    """The last segment before a qualified name's own; empty if there is none."""
    parts = F.split(qualified, "::")
    return F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))


#: Receivers that name the enclosing object itself.
OWN_RECEIVERS = ["self", "Self", "this", "cls", "super", "Me", "MyBase", "MyClass"]


def call_qualifier(receiver: Column) -> Column:
    """The segment of a receiver right before the called name; null for the object itself."""
    last = F.trim(F.element_at(F.split(receiver, "[.:]"), -1))
    return F.when((last != "") & ~last.isin(OWN_RECEIVERS), last)


def canonical_remote(url: Column) -> Column:
    """host/owner/repo of a git remote in lower case, without user, port, scheme, .git and slashes at the end; null if there is no owner."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")
    rest = F.regexp_replace(F.regexp_replace(u, "(?s)^.*://", ""), "^[^/@]*@", "")
    parts = F.filter(F.split(F.translate(rest, "[]", ""), "[/:]"), lambda x: x != "")
    # host:123/repo is an owner in the short form, and a port behind a scheme or in brackets
    port = (u.contains("://") | u.contains("[")) & F.coalesce(F.get(parts, F.lit(1)).rlike("^[0-9]+$"), F.lit(False))
    path = F.slice(parts, F.when(port, 3).otherwise(2), F.greatest(F.size(parts), F.lit(1)))
    return F.when(F.size(path) >= 2, F.lower(F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.array_join(path, "/"))))


def truncated(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def fitted(text: Column, n: int) -> Column:
    """At most n characters, the last of them an ellipsis if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(n - 1, 0)), F.lit("…"))).otherwise(text)


def hms(seconds: Column) -> Column:
    """Seconds as 1h 2m, or 2m below an hour."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def grouped(n: Column) -> Column:
    """A count with commas between thousands."""
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    """1.8s, or 420ms below a second."""
    return F.when(seconds >= 1, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dms", F.floor(seconds * 1000)))


def language_counts(rows: Column) -> Column:
    """An array of (language, files) in order as rust 12, python 3."""
    return F.array_join(F.transform(rows, lambda r: F.concat(r["language"], F.lit(" "), r["files"].cast("string"))), ", ")


def host_of(url: Column) -> Column:
    """The host of a URL, without user and port, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))


def is_local_url(url: Column) -> Column:
    host = host_of(url)
    return host.isin("localhost", "[::1]", "0.0.0.0") | host.startswith("127.") | host.endswith(".localhost")


def has_marker(text: Column) -> Column:
    return F.upper(text).rlike("|".join(MARKERS))


def snake_case(name: Column) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
