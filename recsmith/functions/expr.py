"""Shared column helpers (all JVM-side, codegen friendly).

Each helper that has a DuckDB twin used by the oracle queries exposes a
``*_sql`` function producing the same value from plain SQL text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the portable hash (integer arithmetic that Spark and
# DuckDB evaluate identically; every product stays below 2**63).
HASH_PRIME = 2147483647
HASH_MULT = 1000003
HASH_AVALANCHE = 48271


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tail(col, n: int) -> Column:
    """Keep the last ``n`` elements.  Spark's ``slice(a, -n, n)`` returns [] when
    the array is shorter than ``n``, so the short case passes through unchanged."""
    c = _c(col)
    return F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)


def tail_sql(expr: str, n: int) -> str:
    return f"(CASE WHEN len({expr}) > {n} THEN list_slice({expr}, len({expr}) - {n} + 1, len({expr})) ELSE {expr} END)"


def last(col) -> Column:
    """Last element or NULL for an empty/NULL array (``element_at(.., -1)`` raises under ANSI)."""
    return F.try_element_at(_c(col), F.lit(-1))


def strip_chars(col, chars: str) -> Column:
    """Python ``str.strip(chars)``: remove any of ``chars`` from both ends."""
    cls = "[" + re.escape(chars) + "]"
    # \z, not $: Java's $ also matches before a final line break
    return F.regexp_replace(_c(col), rf"\A{cls}+|{cls}+\z", "")


def strip_chars_sql(expr: str, chars: str) -> str:
    cls = "[" + re.escape(chars) + "]"
    cls = cls.replace("'", "''")
    return f"regexp_replace({expr}, '^{cls}+|{cls}+$', '', 'g')"


#: What Python's ``str.strip()`` takes off: code points (first, last) of Unicode white space.
WHITE_SPACE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _white(form: str) -> str:
    return "[" + "".join(form.format(a) + "-" + form.format(b) for a, b in WHITE_SPACE) + "]"


def strip_ws(col) -> Column:
    """Python ``str.strip()`` (Unicode white space), unlike Spark ``trim`` which only drops spaces."""
    w = _white(r"\x{{{:x}}}")
    return F.regexp_replace(_c(col), rf"\A{w}+|{w}+\z", "")


def strip_ws_sql(expr: str) -> str:
    """Without a regex: ``trim`` with the list of characters."""
    chars = " || ".join(f"chr({c})" for a, b in WHITE_SPACE for c in range(a, b + 1))
    return f"trim({expr}, {chars})"


def portable_hash(*cols, seed: int = 0) -> Column:
    """Deterministic non-negative hash of integer columns in ``[0, HASH_PRIME)``.

    Plain modular arithmetic so DuckDB (``portable_hash_sql``) gives the same value;
    used for seeded sampling, shuffles and variant picks instead of ``rand()``.
    """
    h = F.lit(seed % HASH_PRIME).cast("bigint")
    for c in cols:
        x = F.pmod(_c(c).cast("bigint"), F.lit(HASH_PRIME))
        h = F.pmod(h * F.lit(HASH_MULT) + x, F.lit(HASH_PRIME))
        h = F.pmod(h * F.lit(HASH_AVALANCHE), F.lit(HASH_PRIME))
    return h


def portable_hash_sql(*exprs: str, seed: int = 0) -> str:
    def pmod(e):
        return f"((({e}) % {HASH_PRIME} + {HASH_PRIME}) % {HASH_PRIME})"

    h = f"CAST({seed % HASH_PRIME} AS BIGINT)"
    for e in exprs:
        x = pmod(f"CAST({e} AS BIGINT)")
        h = pmod(f"{h} * {HASH_MULT} + {x}")
        h = pmod(f"{h} * {HASH_AVALANCHE}")
    return h


def string_key(col) -> Column:
    """Integer key of a string (first 32 bits of its MD5) for use in ``portable_hash``."""
    return F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")


def string_key_sql(expr: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


def unit_interval(h: Column) -> Column:
    """Map a portable hash to (0, 1]."""
    return (h + F.lit(1)).cast("double") / F.lit(float(HASH_PRIME))


def r6(col) -> Column:
    """Round to 6 digits (oracle comparisons are made on rounded doubles)."""
    return F.round(_c(col).cast("double"), 6)
