"""String functions with the dialect's rules, as Column expressions.

Positions count from 1 in code points.  A function of NULL is NULL unless it
says otherwise.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, col, flag, integer_of, text


def concat(*args: Arg) -> Column:
    """NULL if any argument is."""
    return F.concat(*[text(a) for a in args])


def concat_ws(separator: Arg, *args: Arg) -> Column:
    """Skips NULL arguments; NULL for a NULL separator."""
    sep = text(separator)
    whole = F.array(*[text(a) for a in args])
    kept = F.filter(whole, lambda x: x.isNotNull())
    out = F.aggregate(
        kept, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, sep, x))
    )
    return F.when(sep.isNotNull(), F.coalesce(out, F.lit("")))


def length(s: Arg) -> Column:
    """Bytes."""
    return F.octet_length(col(s))


octet_length = length


def char_length(s: Arg) -> Column:
    """Code points."""
    return F.char_length(col(s))


character_length = char_length


def bit_length(s: Arg) -> Column:
    return F.bit_length(col(s))


def lower(s: Arg) -> Column:
    return F.lower(text(s))


def upper(s: Arg) -> Column:
    return F.upper(text(s))


lcase, ucase = lower, upper


def bin_(n: Arg) -> Column:
    """Binary digits of the integer that a text begins with; '' is NULL."""
    return F.when(text(n) != "", F.bin(integer_of(n)))


def oct_(n: Arg) -> Column:
    return F.when(text(n) != "", F.conv(integer_of(n).cast("string"), 10, 8))


def hex_number(n: Arg) -> Column:
    """Of a number: its rounded value in hexadecimal, 64 bits if negative."""
    return F.hex(F.round(col(n).cast("decimal(38,10)")).cast("bigint"))


def hex_text(s: Arg) -> Column:
    """Of a text: its bytes."""
    return F.hex(text(s).cast("binary"))


def unhex(s: Arg) -> Column:
    """NULL where the text is not hexadecimal; an odd digit comes first alone."""
    t = text(s)
    even = F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(t.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def strcmp(a: Arg, b: Arg) -> Column:
    x, y = text(a), text(b)
    return F.when(x == y, 0).when(x < y, -1).when(x > y, 1)


def substring(s: Arg, pos: Arg, n: Arg = None) -> Column:
    """Position 0 gives ''; negative ones count from the end, and before the
    beginning give ''."""
    t, p = text(s), col(pos).cast("int")
    size = F.char_length(t)
    start = F.when(p < 0, size + p + 1).otherwise(p)
    rest = F.lit(2**31 - 1) if n is None else F.greatest(col(n).cast("int"), F.lit(0))
    out = F.when((start < 1) | (start > size), "").otherwise(F.substring(t, F.greatest(start, F.lit(1)), rest))
    known = t.isNotNull() & p.isNotNull()
    return F.when(known if n is None else known & col(n).isNotNull(), out)


substr = mid = substring


def left(s: Arg, n: Arg) -> Column:
    return F.when(text(s).isNotNull() & col(n).isNotNull(), F.substring(text(s), F.lit(1), F.greatest(col(n).cast("int"), F.lit(0))))


def right(s: Arg, n: Arg) -> Column:
    k = col(n).cast("int")
    return F.when(k.isNotNull() & (k <= 0) & text(s).isNotNull(), "").otherwise(F.right(text(s), k))


def _pad(fn, s: Arg, n: Arg, pad: Arg) -> Column:
    t, k, p = text(s), col(n).cast("int"), text(pad)
    return (
        F.when(t.isNull() | p.isNull() | k.isNull() | (k < 0), None)
        .when(k <= F.char_length(t), F.substring(t, F.lit(1), k))
        .when(p == "", "")
        .otherwise(F.call_function(fn, t, k, p))
    )


def lpad(s: Arg, n: Arg, pad: Arg) -> Column:
    """NULL for a negative length; '' where an empty pad cannot fill."""
    return _pad("lpad", s, n, pad)


def rpad(s: Arg, n: Arg, pad: Arg) -> Column:
    return _pad("rpad", s, n, pad)


def repeat(s: Arg, n: Arg) -> Column:
    k = col(n).cast("int")
    return F.when(text(s).isNotNull() & k.isNotNull(), F.call_function("repeat", text(s), F.greatest(k, F.lit(0))))


def space(n: Arg) -> Column:
    return repeat(F.lit(" "), n)


def reverse(s: Arg) -> Column:
    return F.reverse(text(s))


def ltrim(s: Arg) -> Column:
    """Spaces only."""
    return F.regexp_replace(text(s), "^ +", "")


def rtrim(s: Arg) -> Column:
    return F.regexp_replace(text(s), " +$(?!\\n)", "")


def trim(s: Arg, remove: str = " ", side: str = "both") -> Column:
    """Removes a whole string, as often as it stands there."""
    if remove == "":
        return text(s)
    unit = "(?:" + "".join("\\x{%x}" % ord(c) for c in remove) + ")++"
    out = text(s)
    if side in ("both", "leading"):
        out = F.regexp_replace(out, f"^{unit}", "")
    if side in ("both", "trailing"):
        out = F.regexp_replace(out, f"{unit}\\z", "")
    return out


def replace(s: Arg, old: Arg, new: Arg) -> Column:
    """Case-sensitive; an empty search changes nothing."""
    return F.replace(text(s), text(old), text(new))


def ascii_(s: Arg) -> Column:
    """The first byte; 0 of ''."""
    first = F.substring(F.hex(text(s).cast("binary")), 1, 2)
    return F.when(text(s) == "", 0).otherwise(F.conv(first, 16, 10).cast("int"))


def ord_(s: Arg) -> Column:
    """The first character's bytes as one big-endian number; 0 of ''."""
    first = F.hex(F.substring(text(s), 1, 1).cast("binary"))
    return F.when(text(s) == "", F.lit(0).cast("bigint")).otherwise(F.conv(first, 16, 10).cast("bigint"))


def locate(sub: Arg, s: Arg, pos: Arg = 1, ignore_case: bool = False) -> Column:
    """1-based place of a substring from a position on, 0 if absent."""
    a, b = text(sub), text(s)
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    p = col(pos).cast("int")
    size = F.char_length(b)
    rest = F.substring(b, F.greatest(p, F.lit(1)), F.lit(2**31 - 1))
    at = F.call_function("instr", rest, a)
    found = F.when((p < 1) | (p > size + 1), 0).when(at == 0, 0).otherwise(at + p - 1)
    return F.when(a.isNotNull() & b.isNotNull() & p.isNotNull(), found)


def position(sub: Arg, s: Arg, ignore_case: bool = False) -> Column:
    return locate(sub, s, 1, ignore_case)


def instr(s: Arg, sub: Arg, ignore_case: bool = False) -> Column:
    return locate(sub, s, 1, ignore_case)


def insert(s: Arg, pos: Arg, n: Arg, new: Arg) -> Column:
    """Unchanged where the position is outside; a length that runs over, or is
    negative, takes the rest."""
    t, p, k = text(s), col(pos).cast("int"), col(n).cast("int")
    size = F.char_length(t)
    head = F.substring(t, F.lit(1), F.greatest(p - 1, F.lit(0)))
    after = F.when((k < 0) | (p + k > size + 1), "").otherwise(F.substring(t, F.greatest(p + k, F.lit(1)), F.lit(2**31 - 1)))
    out = F.when((p < 1) | (p > size), t).otherwise(F.concat(head, text(new), after))
    return F.when(t.isNotNull() & p.isNotNull() & k.isNotNull() & text(new).isNotNull(), out)


def substring_index(s: Arg, delimiter: str, n: int) -> Column:
    return F.substring_index(text(s), delimiter, n)


def quote(s: Arg) -> Column:
    """A literal of the text; NULL gives the word NULL."""
    t = text(s)
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\x00", "\\0"), ("\x1a", "\\Z")):
        t = F.replace(t, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), t, F.lit("'")), F.lit("NULL"))


def soundex(s: Arg) -> Column:
    """Letters A-Z only, of any length, filled up to four; letters without a
    code part nothing."""
    letters = F.upper(F.regexp_replace(text(s), "[^A-Za-z]", ""))
    # fixed values: the code of each letter from A to Z
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    first = F.substring(codes, 1, 1)
    rest = F.replace(F.substring(codes, 2, 2**30), F.lit("0"), F.lit(""))
    once = F.regexp_replace(F.concat(first, rest), r"(.)\1+", "$1")
    out = F.concat(F.substring(letters, 1, 1), F.substring(once, 2, 2**30))
    return F.when(letters == "", "").when(F.length(out) < 4, F.rpad(out, 4, "0")).otherwise(out)


def field(x: Arg, *options: Arg) -> Column:
    """Place of x among the options; 0 for none or NULL."""
    listed = F.array(*[text(o) for o in options])
    return F.coalesce(F.array_position(listed, text(x)), F.lit(0)).cast("int")


def elt(n: Arg, *options: Arg) -> Column:
    """The n-th option; NULL outside."""
    k = col(n).cast("int")
    return F.when(k >= 1, F.get(F.array(*[text(o) for o in options]), k - 1))


def make_set(bits: Arg, *options: Arg) -> Column:
    """Options whose bits are set, bit 0 first; NULL options are left out."""
    b = col(bits).cast("bigint")
    chosen = F.array(*[F.when(b.bitwiseAND(F.lit(1 << k)) != 0, text(o)) for k, o in enumerate(options)])
    return F.when(b.isNotNull(), F.array_join(chosen, ","))


def export_set(bits: Arg, on: Arg, off: Arg, separator: str = ",", n: int = 64) -> Column:
    b = col(bits).cast("bigint")
    count = 64 if n > 64 or n < 0 else n
    each = F.array(*[F.when(F.shiftrightunsigned(b, k).bitwiseAND(F.lit(1)) != 0, text(on)).otherwise(text(off)) for k in range(count)])
    known = b.isNotNull() & text(on).isNotNull() & text(off).isNotNull()
    return F.when(known, F.array_join(each, separator))


def find_in_set(s: Arg, listed: Arg) -> Column:
    return F.find_in_set(text(s), text(listed))


def char_(*codes: Arg) -> Column:
    """Each number as one to four big-endian bytes; NULLs are left out."""
    def one(c: Arg) -> Column:
        h = F.hex(col(c).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.coalesce(F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h), F.lit(""))

    return F.unhex(F.concat(*[one(c) for c in codes]))


def char_using_utf8(*codes: Arg) -> Column:
    return F.decode(char_(*codes), "UTF-8")


def format_(x: Arg, digits: int) -> Column:
    """Exact numbers: grouped by thousands, rounded half away from zero."""
    d = max(0, digits)
    return F.format_number(F.round(col(x).cast("decimal(38,10)"), d), d)


def format_double(x: Arg, digits: int) -> Column:
    """Doubles: the scaled value is rounded half away from zero; a negative
    zero keeps its sign."""
    d = min(max(0, digits), 30)
    v = col(x).cast("double")
    scaled = v * float(10**d)
    # rounding itself drops the sign of zero
    rounded = F.round(F.abs(scaled)) * F.signum(scaled) / float(10**d)
    largest = sys.float_info.max
    return F.format_number(F.when(F.abs(scaled) <= largest, rounded).when(F.abs(v) <= largest, v), d)


def conv(n: Arg, from_base: int, to_base: int) -> Column:
    return F.conv(text(n), from_base, to_base)


def to_base64(s: Arg) -> Column:
    """With a line feed after each 76 characters."""
    plain = F.replace(F.base64(text(s).cast("binary")), F.lit("\r\n"), F.lit(""))
    return F.regexp_replace(plain, "(.{76})(?=.)", "$1\n")


def from_base64(s: Arg) -> Column:
    """Bytes; NULL where malformed."""
    return F.try_to_binary(F.regexp_replace(text(s), r"\s", ""), F.lit("base64"))


def md5(s: Arg) -> Column:
    return F.md5(text(s).cast("binary"))


def sha1(s: Arg) -> Column:
    return F.sha1(text(s).cast("binary"))


sha = sha1


def sha2(s: Arg, bits: int) -> Column:
    """NULL for a size other than 0, 224, 256, 384 and 512."""
    return F.sha2(text(s).cast("binary"), bits) if bits in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def crc32(s: Arg) -> Column:
    return F.crc32(text(s).cast("binary"))


def folded(s: Arg) -> Column:
    """Case and accents folded, as the default collation compares."""
    return F.collate(text(s), "UNICODE_CI_AI")


def like(s: Arg, pattern: str, escape: str = "\\", ignore_case: bool = False) -> Column:
    """``%`` and ``_``; a backslash (or the given character) escapes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out += "\\x{%x}" % ord(pattern[k])
        else:
            out += ".*" if c == "%" else "." if c == "_" else "\\x{%x}" % ord(c)
        k += 1
    return flag(text(s).rlike(("(?s)" if not ignore_case else "(?siu)") + "\\A" + out + "\\z"))
