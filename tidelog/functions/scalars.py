"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv_bytes(text: Column) -> Column:
    """What FNV-1a takes of a text that is not empty: of a UTF-16 unit above 0xFF the high byte, then the low byte; of others one byte."""
    plain, units = text.cast("binary"), F.encode(text, "UTF-16BE")
    ascii_codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.ascii(F.substring(plain, i, F.lit(1)).cast("string")).cast("long"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(units)), lambda i: F.conv(F.hex(F.substring(units, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.octet_length(text) == F.char_length(text), ascii_codes).otherwise(F.filter(codes, lambda x, i: (i % 2 == 1) | (x != 0)))


def fnv_mixed(start: Column, taken: Column) -> Column:
    """The hash that ``start`` becomes with further bytes: that of two texts in a row is got from the first one's hash."""
    return F.aggregate(taken, start, lambda h, x: (h.bitwiseXOR(x) * FNV_PRIME) % 4294967296)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 units: a unit above 0xFF feeds its high byte, then its low byte; others one byte."""
    offset = F.lit(FNV_OFFSET).cast("long")
    return F.when(F.octet_length(text) == 0, offset).otherwise(fnv_mixed(offset, fnv_bytes(text)))


def bucket(unit_id: Column, flag: Column) -> Column:
    """0 to 99 for a unit and a flag."""
    return fnv1a32(F.concat_ws(":", unit_id, flag)) % 100


def parse_long(text: Column) -> Column:
    """A decimal integer with an optional sign, or null."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding, in one line: the breaks that ``base64`` sets after 76 characters are taken out."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def unbase64url(text: Column) -> Column:
    standard = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(standard, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")))


def percent_encode(text: Column) -> Column:
    """All bytes but unreserved characters as %XX."""
    plain = F.url_encode(text)
    return F.replace(F.replace(F.replace(plain, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """%XX sequences as bytes; a plus sign stays one; null where a sequence is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def namespace_ok(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def client_ip(edge: Column, real: Column, forwarded: Column, socket: Column) -> Column:
    """First of the edge header, the real-ip header, the first forwarded address, the socket; else ``unknown``.

    An empty edge or real-ip header counts, an empty forwarded header doesn't.
    """
    first = F.trim(F.split_part(F.nullif(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(edge, real, first, socket, F.lit("unknown"))


def parse_unsigned(text: Column) -> Column:
    """A decimal integer below 2^64 without a sign, as decimal(20,0), or null."""
    n = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return F.when(n <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), n).cast("decimal(20,0)")


def ttl_of(kind: Column, n: Column, now_ms: int) -> Column:
    """Milliseconds to live of EX, PX (0 is an error: null), EXAT and PXAT (0 if past)."""
    relative = F.when(n > 0, F.when(kind == "EX", n * 1000).otherwise(n))
    until = F.when(kind == "EXAT", (n - F.lit(now_ms // 1000)) * 1000).otherwise(n - now_ms)
    return F.when(kind.isin("EX", "PX"), relative).when(kind.isin("EXAT", "PXAT"), F.greatest(F.lit(0), until)).cast("long")


def query_param(query: Column, name: str) -> Column:
    """The first value of a parameter of a query string, not decoded; null if there is none with an equals sign."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}="))
    return F.substring(F.get(pairs, F.lit(0)), len(name) + 2, 1 << 20)
