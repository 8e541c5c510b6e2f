"""Regular expressions with positions, occurrences and match types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, flag, text


def _flags(match_type: str, ignore_case: bool) -> str:
    """Letters c, i, m, n and u; the last of c and i holds."""
    low, on = ignore_case, set()
    for c in match_type:
        if c in "ci":
            low = c == "i"
        elif c == "m":
            on.add("m")
        elif c == "n":
            on.add("s")
        elif c == "u":
            on.add("d")
        else:
            raise ValueError(f"match type {c!r}")
    letters = ("iu" if low else "") + "".join(sorted(on))
    return f"(?{letters})" if letters else ""


def regexp_like(s: Arg, pattern: str, match_type: str = "", ignore_case: bool = False) -> Column:
    return flag(text(s).rlike(_flags(match_type, ignore_case) + pattern))


def _spans(s: Column, pattern: str, pos: int) -> Column:
    """Matches from a position on, each with its start."""
    rest = F.substring(s, pos, 2**31 - 1)
    gaps = F.split(rest, pattern, -1)
    hits = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    zero = F.struct(F.lit(pos).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        at = (held["at"] + F.length(x["gap"])).cast("int")
        one = F.array(F.struct(at.alias("start"), x["hit"].alias("hit")))
        return F.when(x["hit"].isNull(), held).otherwise(
            F.struct((at + F.length(x["hit"])).alias("at"), F.concat(held["out"], one).alias("out"))
        )

    return F.aggregate(both, zero, step, lambda held: held["out"])


def regexp_substr(s: Arg, pattern: str, pos: int = 1, occurrence: int = 1, match_type: str = "", ignore_case: bool = False) -> Column:
    """The n-th match from a position on; NULL if there is none."""
    full = _flags(match_type, ignore_case) + pattern
    hits = F.regexp_extract_all(F.substring(text(s), pos, 2**31 - 1), F.lit(full), F.lit(0))
    return F.get(hits, F.lit(occurrence - 1))


def regexp_instr(
    s: Arg, pattern: str, pos: int = 1, occurrence: int = 1, end: int = 0, match_type: str = "", ignore_case: bool = False
) -> Column:
    """Place of the n-th match, or (end=1) of what follows it; 0 for none."""
    found = F.get(_spans(text(s), _flags(match_type, ignore_case) + pattern, pos), F.lit(occurrence - 1))
    at = found["start"] + (F.length(found["hit"]) if end else F.lit(0))
    return F.when(text(s).isNotNull(), F.coalesce(at, F.lit(0)))


def regexp_replace(
    s: Arg, pattern: str, new: str, pos: int = 1, occurrence: int = 0, match_type: str = "", ignore_case: bool = False
) -> Column:
    """All matches from a position on, or the n-th alone; $1 names a group."""
    t, full = text(s), _flags(match_type, ignore_case) + pattern
    head = F.substring(t, 1, pos - 1) if pos > 1 else F.lit("")
    if occurrence == 0:
        return F.concat(head, F.regexp_replace(F.substring(t, pos, 2**31 - 1), full, new))
    found = F.get(_spans(t, full, pos), F.lit(occurrence - 1))
    before = F.substring(t, F.lit(1), found["start"] - 1)
    after = F.substring(t, found["start"] + F.length(found["hit"]), F.lit(2**31 - 1))
    changed = F.concat(before, F.regexp_replace(found["hit"], full, new), after)
    return F.when(found.isNull(), t).otherwise(changed)


