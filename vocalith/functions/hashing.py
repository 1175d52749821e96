"""Deterministic draws, seeds, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(key: Column) -> Column:
    """The first 8 hex digits of the key's md5 as a long."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw(key: Column, n) -> Column:
    """A number below n that depends on the key alone."""
    return F.pmod(hash32(key), n if isinstance(n, Column) else F.lit(n).cast("long"))


def stable_seed(uid, seed: int) -> Column:
    """63 bits of the SHA-256 of ``seed:uid``, read from the left."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), _col(uid).cast("string")), 256), 1, 15), 16, 10).cast("long")


def content_hash(content) -> Column:
    return F.sha2(_col(content), 256)


def cache_key(path, rate: int, window: int, model: str, lang: str, offset) -> Column:
    """SHA-256 of the settings that a cached result depends on."""
    parts = [_col(path), F.lit(rate), F.lit(window), F.lit(model), F.lit(lang), _col(offset)]
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def run_name(*cols, max_len: int = 128) -> Column:
    """The settings joined by ``-``; where that is too long, its beginning and 12 hex digits of its hash."""
    name = F.concat_ws("-", *[_col(c).cast("string") for c in cols])
    return F.when(F.length(name) <= max_len, name).otherwise(F.concat(F.substring(name, 1, max_len - 13), F.lit("-"), F.substring(F.sha2(name, 256), 1, 12)))


def struct_signature(*cols) -> Column:
    return F.sha2(F.to_json(F.struct(*[_col(c) for c in cols])), 256)
