"""Numbers: arithmetic with the dialect's result types, and its functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, col, null_if_any

#: Digits that a division adds to the dividend's scale.
DIV_INCREMENT = 4


def divide(a: Arg, b: Arg, scale: int = 0) -> Column:
    """Exact division of numbers with that scale: four more digits, rounded half
    away from zero; NULL by zero."""
    x, y = col(a).cast(f"decimal(20,{scale})"), col(b).cast("decimal(20,6)")
    return F.round(F.try_divide(x, F.when(y != 0, y)), scale + DIV_INCREMENT).cast(f"decimal(30,{scale + DIV_INCREMENT})")


def divide_double(a: Arg, b: Arg) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def div(a: Arg, b: Arg) -> Column:
    """Integer division, truncated; NULL by zero."""
    y = col(b)
    quotient = F.try_divide(col(a).cast("decimal(38,10)"), F.when(y != 0, y).cast("decimal(38,10)"))
    return quotient.cast("bigint")


def mod(a: Arg, b: Arg) -> Column:
    """Sign of the dividend; NULL by zero."""
    return F.try_mod(col(a), F.when(col(b) != 0, col(b)))


def bit_and(a: Arg, b: Arg) -> Column:
    return col(a).cast("bigint").bitwiseAND(col(b).cast("bigint"))


def bit_or(a: Arg, b: Arg) -> Column:
    return col(a).cast("bigint").bitwiseOR(col(b).cast("bigint"))


def bit_xor(a: Arg, b: Arg) -> Column:
    return col(a).cast("bigint").bitwiseXOR(col(b).cast("bigint"))


def unsigned(n: Column) -> Column:
    """A 64-bit pattern as the unsigned number it stands for."""
    d = n.cast("decimal(20,0)")
    return F.when(n < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def bit_not(a: Arg) -> Column:
    return unsigned(F.bitwise_not(col(a).cast("bigint")))


def shift_left(a: Arg, n: int) -> Column:
    """Bits beyond 64 are lost; from 64 on the result is 0."""
    x = col(a).cast("bigint")
    return unsigned(F.shiftleft(x, n) if n < 64 else x * 0)


def shift_right(a: Arg, n: int) -> Column:
    x = col(a).cast("bigint")
    return unsigned(F.shiftrightunsigned(x, n) if n < 64 else x * 0)


def abs_(x: Arg) -> Column:
    return F.abs(col(x))


def floor_(x: Arg, double: bool = False) -> Column:
    """Of exact numbers an integer; a double stays one."""
    out = F.floor(col(x))
    return out.cast("double") if double else out


def ceil_(x: Arg, double: bool = False) -> Column:
    out = F.ceil(col(x))
    return out.cast("double") if double else out


ceiling = ceil_


def round_(x: Arg, digits: int = 0) -> Column:
    """Exact numbers, half away from zero."""
    return F.round(col(x), digits)


def round_double(x: Arg, digits: int = 0) -> Column:
    """Doubles, half to even of the scaled value."""
    v = col(x).cast("double")
    if digits >= 0:
        return F.rint(v * float(10**digits)) / float(10**digits)
    return F.rint(v / float(10**-digits)) * float(10**-digits)


def truncate(x: Arg, digits: int = 0) -> Column:
    """Exact numbers, toward zero."""
    v = col(x).cast("decimal(38,10)")
    unit = F.lit(f"1e{-digits}" if digits < 0 else "1" if digits == 0 else "0." + "0" * (digits - 1) + "1").cast("decimal(20,10)")
    steps = F.floor(F.abs(v) / unit)
    return (F.signum(v).cast("int") * steps * unit).cast(f"decimal(38,{max(digits, 0)})")


def truncate_double(x: Arg, digits: int = 0) -> Column:
    v = col(x).cast("double")
    unit = float(10**digits) if digits >= 0 else 1 / float(10**-digits)
    return F.signum(v) * F.floor(F.abs(v) * unit).cast("double") / unit


def sign(x: Arg) -> Column:
    return F.signum(col(x).cast("double")).cast("bigint")


def greatest(*args: Arg) -> Column:
    """NULL if any argument is."""
    cs = [col(a) for a in args]
    return null_if_any(cs, F.greatest(*cs))


def least(*args: Arg) -> Column:
    cs = [col(a) for a in args]
    return null_if_any(cs, F.least(*cs))


def bit_count(n: Arg) -> Column:
    return F.bit_count(col(n).cast("bigint"))


def pi() -> Column:
    return F.pi()


def _finite(x: Column) -> Column:
    """NULL where a function has no value."""
    return F.when(~F.isnan(x), x)


def sqrt(x: Arg) -> Column:
    return _finite(F.sqrt(col(x).cast("double")))


def exp(x: Arg) -> Column:
    return F.exp(col(x).cast("double"))


def power(x: Arg, y: Arg) -> Column:
    return F.pow(col(x).cast("double"), col(y).cast("double"))


pow_ = power


def ln(x: Arg) -> Column:
    return F.ln(F.when(col(x) > 0, col(x).cast("double")))


def log(x: Arg, base: Arg = None) -> Column:
    """LOG(x), or LOG(base, x) with a base; NULL outside their domains."""
    if base is None:
        return ln(x)
    b = col(base).cast("double")
    return ln(x) / F.ln(F.when((b > 0) & (b != 1), b))


def log2(x: Arg) -> Column:
    return F.log2(F.when(col(x) > 0, col(x).cast("double")))


def log10(x: Arg) -> Column:
    return F.log10(F.when(col(x) > 0, col(x).cast("double")))


def sin(x: Arg) -> Column:
    return F.sin(col(x).cast("double"))


def cos(x: Arg) -> Column:
    return F.cos(col(x).cast("double"))


def tan(x: Arg) -> Column:
    return F.tan(col(x).cast("double"))


def cot(x: Arg) -> Column:
    return F.cot(col(x).cast("double"))


def asin(x: Arg) -> Column:
    return _finite(F.asin(col(x).cast("double")))


def acos(x: Arg) -> Column:
    return _finite(F.acos(col(x).cast("double")))


def atan(y: Arg, x: Arg = None) -> Column:
    return F.atan(col(y).cast("double")) if x is None else F.atan2(col(y).cast("double"), col(x).cast("double"))


def atan2(y: Arg, x: Arg) -> Column:
    return atan(y, x)


def degrees(x: Arg) -> Column:
    return F.degrees(col(x).cast("double"))


def radians(x: Arg) -> Column:
    return F.radians(col(x).cast("double"))


#: Modulus and seeding of the dialect's generator.
RAND_MODULUS, RAND_SEEDS = 0x3FFFFFFF, ((0x10001, 55555555), (0x10000001, 0))


def rand(seed: int | None = None) -> Column:
    """A number from 0 up to 1 for each row; Spark's sequence, as rows without an
    order cannot share the server's.  :func:`rand_first` is the server's."""
    return F.rand() if seed is None else F.rand(seed)


def rand_first(seed: Arg) -> Column:
    """The first number that a seed gives, as where each row has its own."""
    word = F.coalesce(F.rint(col(seed).cast("double")).cast("bigint"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = ((word * times + plus).bitwiseAND(F.lit(0xFFFFFFFF)) % RAND_MODULUS for times, plus in RAND_SEEDS)
    return ((a * 3 + b) % RAND_MODULUS).cast("double") / RAND_MODULUS


def random_bytes(n: int) -> Column:
    if not 1 <= n <= 1024:
        raise ValueError("1 to 1024 bytes")
    parts = [F.lpad(F.hex((F.rand() * 256).cast("int")), 2, "0") for _ in range(n)]
    return F.unhex(F.concat(*parts))
