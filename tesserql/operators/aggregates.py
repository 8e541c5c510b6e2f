"""Aggregates with the dialect's types and empty-input values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, col
from tesserql.functions.numeric import unsigned

#: Bytes at which GROUP_CONCAT cuts its result.
CONCAT_BYTES = 1024
ALL_ONES = "18446744073709551615"


def count(x: Arg = "*") -> Column:
    return F.count("*") if isinstance(x, str) and x == "*" else F.count(col(x))


def count_distinct(*xs: Arg) -> Column:
    """Different rows without a NULL."""
    return F.count_distinct(*[col(x) for x in xs])


def sum_exact(x: Arg, scale: int = 0, distinct: bool = False) -> Column:
    """Of exact numbers: a DECIMAL, so that it cannot overflow a BIGINT."""
    v = col(x).cast(f"decimal(22,{scale})")
    return F.sum_distinct(v) if distinct else F.sum(v)


def avg_exact(x: Arg, scale: int = 0, distinct: bool = False) -> Column:
    """Of exact numbers: four digits more than they have."""
    v = col(x).cast(f"decimal(20,{scale})")
    if not distinct:
        return F.avg(v)
    return (F.sum_distinct(v) / F.count_distinct(v)).cast(f"decimal(24,{scale + 4})")


def std(x: Arg) -> Column:
    """STD and STDDEV are of the population."""
    return F.stddev_pop(col(x))


stddev = stddev_pop = std


def stddev_samp(x: Arg) -> Column:
    return F.stddev_samp(col(x))


def variance(x: Arg) -> Column:
    """VARIANCE is of the population."""
    return F.var_pop(col(x))


var_pop = variance


def var_samp(x: Arg) -> Column:
    return F.var_samp(col(x))


def bit_and(x: Arg) -> Column:
    """Of nothing: all 64 bits."""
    return F.coalesce(unsigned(F.bit_and(col(x).cast("bigint"))), F.lit(ALL_ONES).cast("decimal(20,0)"))


def bit_or(x: Arg) -> Column:
    return F.coalesce(unsigned(F.bit_or(col(x).cast("bigint"))), F.lit(0).cast("decimal(20,0)"))


def bit_xor(x: Arg) -> Column:
    return F.coalesce(unsigned(F.bit_xor(col(x).cast("bigint"))), F.lit(0).cast("decimal(20,0)"))


def group_concat(
    x: Arg, order: Sequence[Arg] = (), separator: str = ",", distinct: bool = False, most: int | None = CONCAT_BYTES
) -> Column:
    """Texts in the order of ``order`` (ascending; by the text itself without
    one), NULLs left out, cut after so many bytes; NULL of nothing.  Gathers a
    whole group first; :func:`concat_groups` suits groups of any size."""
    t = col(x).cast("string")
    if distinct:
        listed = F.array_sort(F.collect_set(t))
    elif order:
        keyed = F.struct(*[col(o).alias(f"k{k}") for k, o in enumerate(order)], t.alias("t"))
        sorted_ = F.sort_array(F.collect_list(F.when(t.isNotNull(), keyed)))
        listed = F.transform(sorted_, lambda s: s["t"])
    else:
        listed = F.sort_array(F.collect_list(t))
    if most is None:
        return F.when(F.size(listed) > 0, F.array_join(listed, separator))
    return _cut(listed, separator, most)


def concat_groups(
    df: DataFrame, keys: Sequence[str], x: Arg, order: Sequence[Arg] = (), separator: str = ",", distinct: bool = False,
    most: int = CONCAT_BYTES, name: str = "listed", salts: int = 1,
) -> DataFrame:
    """``(*keys, name)``: :func:`group_concat` of groups of any size.

    Only texts that can reach the cut are gathered: equal ones are counted
    first, with map-side combine, and of the ordered rest a running count keeps
    as many as there are bytes before the cut.  ``salts`` cut a hot group into so
    many parts that are limited by themselves before they meet.
    """
    each = max(1, len(separator.encode()))
    limit = -(-most // each) + 1
    sorts = [] if distinct else list(order)
    k_names, t, n, upto, salt = [f"k{k}" for k in range(len(keys))], "t", "n", "upto", "salt"
    o_names = [f"o{k}" for k in range(len(sorts))]
    text = F.substring(col(x).cast("string"), 1, most)
    # without a separator empty texts add nothing, but tell '' from NULL
    place = F.when(text.isNull(), 2).when((text == "") & F.lit(not separator), 1).otherwise(0)
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(keys, k_names)], place.alias("place"), *[col(o).alias(k) for o, k in zip(sorts, o_names)], text.alias(t)
    )
    whole = rows.groupBy(*rows.columns).agg((F.lit(1) if distinct else F.count("*")).cast("long").alias(n))
    by = ["place", *o_names, t]

    def limited(part: list[str], rows: DataFrame) -> DataFrame:
        running = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(upto, F.sum(n).over(running)).where(F.col(upto) - F.col(n) < limit)

    if salts > 1:
        salted = whole.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)))
        whole = limited([*k_names, salt], salted).drop(salt, upto)
    kept = limited(k_names, whole)
    copies = F.least(F.col(n), F.lit(limit) - F.col(upto) + F.col(n)).cast("int")
    gathered = F.sort_array(F.collect_list(F.when(F.col(t).isNotNull(), F.struct(*by, copies.alias("copies")))))
    listed = F.flatten(F.transform(gathered, lambda g: F.array_repeat(g[t], g["copies"])))
    out = kept.groupBy(*k_names).agg(_cut(listed, separator, most).alias("listed"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, k_names)], F.col("listed").alias(name))


def _cut(listed: Column, separator: str, most: int) -> Column:
    """Texts joined and cut after so many bytes, at a whole character."""
    joined = F.when(F.size(listed) > 0, F.array_join(listed, separator))
    cut = F.make_valid_utf8(F.substring(joined.cast("binary"), F.lit(1), F.lit(most)).cast("string"))
    return F.when(F.octet_length(joined) > most, F.regexp_replace(cut, "\ufffd+$", "")).otherwise(joined)


def json_arrayagg(x: Arg, order: Sequence[Arg] = ()) -> Column:
    """JSON text of all values, NULLs included; one value, so a group has to fit
    in a task's memory."""
    keyed = F.struct(*[col(o).alias(f"k{k}") for k, o in enumerate(order)], col(x).alias("x"))
    listed = F.sort_array(F.collect_list(keyed)) if order else F.collect_list(keyed)
    return F.when(F.size(listed) > 0, F.to_json(F.transform(listed, lambda s: s["x"])))


def json_objectagg(key: Arg, value: Arg) -> Column:
    """JSON text of members, the last of equal keys (by value) kept; a NULL key
    is an error."""
    k = col(key).cast("string")
    checked = F.when(k.isNull(), F.raise_error(F.lit("JSON documents may not contain NULL member names."))).otherwise(k)
    pairs = F.sort_array(F.collect_list(F.struct(checked.alias("k"), col(value).alias("v"))))
    last = F.filter(pairs, lambda p, i: (F.get(pairs, i + 1)["k"].isNull()) | (F.get(pairs, i + 1)["k"] != p["k"]))
    return F.to_json(F.map_from_entries(last))


def rollup(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """WITH ROLLUP: totals by falling numbers of keys, whose left-out keys are
    NULL; ``grouping_<key>`` tells these NULLs from the data's."""
    marks = [F.grouping(k).cast("int").alias(f"grouping_{k}") for k in keys]
    return df.rollup(*keys).agg(*marks, *aggregates)


def having(df: DataFrame, keys: Sequence[str], condition: Column, *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates).where(condition)
