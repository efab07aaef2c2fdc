"""Stable node ids: the decimal text of a 128-bit MD5 digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces put in front of a key before it is hashed.
# Papers and datasets hash their URL without a namespace.
NAMESPACES = {
    "method": "method/",
    "repo": "repo/",
    "area": "area/",
    "task": "task/",
    "keyword": "keyword/",
    "author": "author/",
    "institution": "institution/",
    "fulltext": "fulltext/",
}


def _int(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def _half(digest: Column, start: int) -> Column:
    """Sixteen hex digits from `start`, as an exact decimal."""
    return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")


def hashed_id(key: Column | str, namespace: str = "") -> Column:
    """Decimal text (up to 39 digits) of md5(namespace + key), exact for all 128 bits.

    39 digits are one too many for DECIMAL(38,0), so the last ten digits are kept
    apart: with 2^64 = a * 10^10 + b the number is
    (high * a) * 10^10 + (high * b + low), and both brackets have at most 30 digits.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(namespace), key.cast("string")).cast("binary"))
    high, low = _half(digest, 1), _half(digest, 17)
    a, b = divmod(2**64, 10**10)
    lower = F.lpad((high * _int(b) + low).cast("string"), 30, "0")
    upper = high * _int(a) + F.substring(lower, 1, 20).cast("decimal(20,0)")
    digits = F.concat(upper.cast("string"), F.substring(lower, 21, 10))
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.when(key.isNotNull(), F.lit("0")))


def slug(name: Column | str) -> Column:
    """Lower case with spaces turned into dashes."""
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))
