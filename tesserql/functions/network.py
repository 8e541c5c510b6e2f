"""Addresses and UUIDs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tesserql.functions.core import Arg, col, flag, text

_BYTE = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_UUID = r"^(?:\{[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9a-fA-F]{32})$"


def inet_aton(s: Arg) -> Column:
    """An IPv4 address as a number; of fewer than four parts the last is the
    low end (1.2 is 1.0.0.2)."""
    parts = F.split(text(s), r"\.")
    n = F.size(parts)
    value = lambda k: F.get(parts, F.lit(k)).try_cast("bigint")
    last = F.get(parts, n - 1).try_cast("bigint")
    head = (
        F.when(n >= 2, value(0) * (1 << 24)).otherwise(0)
        + F.when(n >= 3, value(1) * (1 << 16)).otherwise(0)
        + F.when(n >= 4, value(2) * (1 << 8)).otherwise(0)
    )
    return F.when(text(s).rlike(rf"^{_BYTE}(?:\.{_BYTE}){{0,3}}$"), head + last)


def inet_ntoa(n: Arg) -> Column:
    x = col(n).cast("bigint")
    parts = [F.shiftright(x, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(x.between(0, (1 << 32) - 1), F.concat_ws(".", *parts))


def is_ipv4(s: Arg) -> Column:
    return flag(F.coalesce(text(s).rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), F.lit(False)))


@F.pandas_udf(BinaryType())
def _to_bytes(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> bytes | None:
        try:
            return None if x is None else ipaddress.ip_address(x).packed
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def _to_text(b: pd.Series) -> pd.Series:
    def one(x: bytes | None) -> str | None:
        if x is None or len(x) not in (4, 16):
            return None
        if len(x) == 16:
            low = str(ipaddress.IPv4Address(x[12:]))
            if x[:12] == b"\0" * 10 + b"\xff\xff":
                return f"::ffff:{low}"
            if x[:12] == b"\0" * 12 and x[12:14] != b"\0\0":
                return f"::{low}"
        return str(ipaddress.ip_address(x))

    return b.map(one)


def inet6_aton(s: Arg) -> Column:
    """4 or 16 bytes; NULL for no address."""
    return _to_bytes(text(s))


def inet6_ntoa(b: Arg) -> Column:
    return _to_text(col(b))


def is_ipv6(s: Arg) -> Column:
    return flag(F.coalesce(F.octet_length(inet6_aton(s)) == 16, F.lit(False)))


def is_ipv4_compat(b: Arg) -> Column:
    h = F.hex(col(b))
    return flag(F.coalesce(h.rlike("^0{24}[0-9A-F]{8}$") & ~h.rlike("^0{31}[01]$"), F.lit(False)))


def is_ipv4_mapped(b: Arg) -> Column:
    return flag(F.coalesce(F.hex(col(b)).rlike("^0{20}FFFF[0-9A-F]{8}$"), F.lit(False)))


def is_uuid(s: Arg) -> Column:
    return flag(text(s).rlike(_UUID))


def uuid_to_bin(u: Arg, swap: bool = False) -> Column:
    h = F.regexp_replace(F.when(text(u).rlike(_UUID), text(u)), "[-{}]", "")
    if swap:  # time-high, time-mid, time-low
        h = F.concat(F.substring(h, 13, 4), F.substring(h, 9, 4), F.substring(h, 1, 8), F.substring(h, 17, 16))
    return F.unhex(h)


def bin_to_uuid(b: Arg, swap: bool = False) -> Column:
    h = F.lower(F.hex(col(b)))
    if swap:
        h = F.concat(F.substring(h, 9, 8), F.substring(h, 5, 4), F.substring(h, 1, 4), F.substring(h, 17, 16))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
