"""The text functions as SQL expressions for DuckDB, written from their rules, to hold results against."""

from __future__ import annotations

from graphwright.functions import text as X


def _braced(n: str) -> str:
    kept = f"regexp_replace({n}, '[^A-Za-z0-9_]', '', 'g')"
    return f"CASE WHEN {kept} = '' THEN '{{*}}' ELSE '{{' || {kept} || '}}' END"


def segments(path: str) -> str:
    s = f"trim({path})"
    s = f"CASE WHEN contains({s}, '://') THEN regexp_extract(substr({s}, strpos({s}, '://') + 3), '(/.*)', 1) ELSE {s} END"
    s = f"regexp_extract({s}, '^[^?#]*')"
    return f"""list_transform(list_filter(string_split({s}, '/'), lambda x: x <> ''), lambda x:
        CASE WHEN regexp_full_match(x, '[{{].*[}}]') THEN {_braced("split_part(substr(x, 2, length(x) - 2), ':', 1)")}
             WHEN starts_with(x, ':') THEN {_braced("substr(x, 2)")}
             WHEN regexp_full_match(x, '<.*>') THEN {_braced("list_last(string_split(substr(x, 2, length(x) - 2), ':'))")}
             WHEN starts_with(x, '[') AND ends_with(x, ']') THEN {_braced("x")}
             WHEN starts_with(x, '*') THEN {_braced("substr(x, 2)")} ELSE x END)"""


def normalized(path: str) -> str:
    return f"'/' || array_to_string({segments(path)}, '/')"


def signature(path: str) -> str:
    uuid = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    dynamic = f"(starts_with(y, '{{') AND ends_with(y, '}}')) OR contains(y, '${{') OR regexp_full_match(y, '[0-9]+') OR regexp_full_match(y, '{uuid}')"
    return f"'/' || array_to_string(list_transform({segments(path)}, lambda y: CASE WHEN {dynamic} THEN '{{}}' ELSE y END), '/')"


def folded(x: str) -> str:
    return f"lower(replace({x}, '_', ''))"


def operation(protocol: str, method: str, path: str) -> str:
    service = f"CASE WHEN contains({path}, '/') THEN list_last(string_split(regexp_extract({path}, '^(.*)/', 1), '.')) ELSE '' END"
    op = f"CASE WHEN contains({path}, '.') THEN split_part({path}, '.', 1) ELSE 'query' END"
    field = f"CASE WHEN contains({path}, '.') THEN substr({path}, strpos({path}, '.') + 1) ELSE {path} END"
    last = f"list_last(string_split({path}, '/'))"
    return f"""CASE WHEN {protocol} = 'grpc' THEN 'grpc|' || {folded(service)} || '/' || {folded(last)}
        WHEN {protocol} = 'graphql' THEN 'graphql|' || {folded(op)} || '.' || {folded(field)}
        WHEN {protocol} = 'websocket' AND starts_with({path}, 'event:') THEN 'ws|event|' || {folded(f"substr({path}, 7)")}
        WHEN {protocol} = 'websocket' THEN 'rest|GET|' || {signature(path)}
        ELSE {protocol} || '|' || coalesce({method}, '*') || '|' || {signature(path)} END"""


def scrubbed(text: str) -> str:
    token = "A-Za-z0-9_./+=-"
    rest = " OR ".join(f"(starts_with(t, '{p}') AND length(t) >= {len(p) + 8} AND regexp_matches(substr(t, {len(p) + 1}), '[A-Za-z0-9]'))" for p in X.SECRET_PREFIXES)
    jwt = "(starts_with(t, 'eyJ') AND length(t) - length(replace(t, '.', '')) = 2 AND length(t) > 40)"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[{token}]+|[^{token}]+'), lambda t: CASE WHEN {rest} OR {jwt} THEN '{X.REDACTED}' ELSE t END), '')"


def email(e: str) -> str:
    a = f"lower(trim({e}))"
    domain = f"list_last(string_split({a}, '@'))"
    local = f"regexp_extract({a}, '^(.*)@', 1)"
    plus, dots = (", ".join(f"'{d}'" for d in x) for x in (X.PLUS_DOMAINS, X.DOT_DOMAINS))
    base = f"CASE WHEN {domain} IN ({dots}) THEN replace(split_part({local}, '+', 1), '.', '') ELSE split_part({local}, '+', 1) END"
    return f"CASE WHEN contains({a}, '@') AND {domain} IN ({plus}) AND ({base}) <> '' THEN ({base}) || '@' || {domain} ELSE {a} END"


def tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace({t}, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+'))"


def language(path: str) -> str:
    e = f"regexp_extract({path}, '[^/][.]([^./]+)$', 1)"
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_OF.items())
    return f"CASE WHEN {e} = 'S' THEN 'merlin6502' ELSE CASE lower({e}) {arms} END END"


def topics(subject: str, files: str) -> str:
    stop, generic = (", ".join(f"'{w}'" for w in x) for x in (X.TOPIC_STOPWORDS, X.GENERIC_DIRS))
    words = f"list_filter(regexp_extract_all(lower({subject}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '\\p{{L}}') AND t NOT IN ({stop}))"
    dirs = f"list_filter(flatten(list_transform({files}, lambda f: string_split(lower(regexp_extract(f, '^(.*)/[^/]*$', 1)), '/'))), lambda d: length(d) >= 2 AND regexp_matches(d, '[a-z]') AND d NOT IN ({generic}))"
    languages = f"list_filter(list_transform({files}, lambda f: {language('f')}), lambda l: l IS NOT NULL)"
    return f"list_sort(list_distinct(list_concat({words}, {dirs}, {languages})))[1 : {X.MAX_TOPICS}]"


IS_TEST = """(contains('/' || lower(file), '/tests/') OR contains('/' || lower(file), '/test/') OR regexp_matches(lower(file), '([.](test|spec)[.][^/]*|_test[.](go|py|rs))$')
    OR regexp_matches(lower(file), '(^|/)test_[^/]*$') OR contains(qualified_name, 'tests::'))"""


def classified() -> str:
    return f"CASE WHEN {IS_TEST} THEN 'test' WHEN kind IN ('endpoint', 'schema_op') THEN 'api' WHEN kind IN ('function', 'method') AND (qualified_name = 'main' OR ends_with(qualified_name, '::main')) THEN 'entrypoint' ELSE 'internal' END"


def fnv1a(text: str) -> str:
    """FNV-1a of a text's UTF-8 bytes as a HUGEINT."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::HUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {data}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def uuid5(text: str) -> str:
    """The URL-namespace UUID of a text."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({text}))"
    variant = f"['8', '9', 'a', 'b'][(('0x' || substr({h}, 17, 1))::INT & 3) + 1]"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
