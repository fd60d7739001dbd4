"""Identifiers and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parameters of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def node_id(*parts: Column) -> Column:
    """16 hexadecimal digits from the parts, each closed by a zero byte; nulls count as empty."""
    closed = [F.concat(F.coalesce(p.cast("string"), F.lit("")).cast("binary"), F.unhex(F.lit("00"))) for p in parts]
    return F.substring(F.sha2(F.concat(*closed), 256), 1, 16)


def fnv1a_of(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(words: list[str]) -> np.ndarray:
    """FNV-1a of many words at once, byte by byte."""
    raw = [w.encode() for w in words]
    out = np.full(len(raw), FNV_OFFSET, np.uint64)
    sizes = np.array([len(r) for r in raw])
    for i in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > i)
        byte = np.array([raw[k][i] for k in own], np.uint64)
        out[own] = (out[own] ^ byte) * np.uint64(FNV_PRIME)
    return out


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits."""
    words = list(text.dropna().unique())
    found = {w: f"{h:016x}" for w, h in zip(words, fnv1a_many(words).tolist(), strict=True)}
    return text.map(found)


#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def repo_uuid(canonical_remote: Column) -> Column:
    """The UUID (version 5, URL namespace) of a canonical remote."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), canonical_remote.cast("binary")))
    variant = F.get(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4)
    return F.when(h.isNotNull(), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def forge_id(host: Column, number: Column) -> Column:
    return F.concat(host, F.lit("#"), number.cast("string"))
