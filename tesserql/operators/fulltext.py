"""MATCH … AGAINST: natural language and boolean ranking.

A word is a run of letters, digits and ``_`` of 3 to 84 characters that is no
stop word, compared in lower case.  A row's rank is the sum over the query's
words of ``tf * idf ** 2`` with ``idf = log10(N / n)``, or ``log10(1.0001)`` where
every row holds the word.

Only counts of the query's own words leave the scan.  A whole word is counted by
a regular expression on texts that contain its letters; texts become lists of
words only for prefixes and phrases, and only where these can stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserql.plans.names import unused

SHORTEST, LONGEST = 3, 84
#: The words that are not indexed.
STOP_WORDS = frozenset(
    "a about an are as at be by com de en for from how i in is it la of on or that the this to und was what when"
    " where who will with www".split()
)
EVERYWHERE = 1.0001


def words(text: Column) -> Column:
    """Indexed words of a text, repeats included."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.filter(found, lambda w: F.length(w).between(SHORTEST, LONGEST) & ~F.array_contains(stop, w))


def query_words(query: str) -> list[str]:
    found = re.findall(r"[^\W]+", query.lower())
    return [w for w in found if SHORTEST <= len(w) <= LONGEST and w not in STOP_WORDS]


def occurrences(low: Column, word: str) -> Column:
    """How often a word stands in a lower-cased text, as a whole run of word
    characters.  Texts without these letters are passed over byte by byte."""
    run = r"[\p{L}\p{N}_]"
    pattern = f"(?<!{run}){word}(?!{run})"  # words have no characters with a meaning here
    return F.when(low.contains(word), F.regexp_count(low, F.lit(pattern))).otherwise(0)


def counted(df: DataFrame, text_col: str, tf: str, count: Callable[[Column], list[Column]]) -> DataFrame:
    """The rows with a column of that name: counts in their lower-cased text."""
    low = unused("_low", df)
    lowered = df.withColumn(low, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    return lowered.withColumn(tf, F.array(*count(F.col(low)))).drop(low)


def _weights(rows: DataFrame, tf: str, terms: int, name: str) -> DataFrame:
    """``idf ** 2`` of each term, in one row."""
    n = F.count("*").cast("double")
    out = []
    for k in range(terms):
        having = F.sum((F.get(tf, F.lit(k)) > 0).cast("int")).cast("double")
        idf = F.when(having >= n, F.log10(F.lit(EVERYWHERE))).otherwise(F.log10(n / having))
        out.append(F.when(having > 0, idf * idf).otherwise(0.0))
    return rows.agg(F.array(*out).alias(name))


def natural(df: DataFrame, text_col: str, query: str, rank: str = "rank") -> DataFrame:
    """Rows that hold a word of the query, with their rank; a word that the
    query repeats counts as often."""
    asked = query_words(query)
    terms = list(dict.fromkeys(asked))
    if not terms:
        return df.withColumn(rank, F.lit(0.0)).where(F.lit(False))
    tf, idf2 = unused("_tf", df), unused("_idf2", df)
    rows = counted(df, text_col, tf, lambda low: [occurrences(low, t) for t in terms])
    # one row of as many numbers as the query has words
    scored = rows.join(F.broadcast(_weights(rows, tf, len(terms), idf2)))
    parts = [F.get(tf, F.lit(k)) * F.get(idf2, F.lit(k)) * asked.count(t) for k, t in enumerate(terms)]
    return scored.withColumn(rank, sum(parts[1:], parts[0]).cast("double")).where(F.exists(tf, lambda c: c > 0)).drop(tf, idf2)


@dataclass
class Term:
    """A term of a boolean query: an operator, and a word, prefix, phrase or
    group."""

    op: str = ""
    word: str = ""
    prefix: bool = False
    phrase: list[str] | None = None
    group: list[Term] = field(default_factory=list)


_PART = re.compile(r'\s*(?P<op>[+\-><~]?)\s*(?:"(?P<phrase>[^"]*)"|(?P<open>\()|(?P<close>\))|(?P<word>\w+)(?P<star>\*?)|(?P<other>\S))')


def parse_boolean(query: str) -> list[Term]:
    """Terms of a boolean query; unknown characters are refused."""
    stack: list[list[Term]] = [[]]
    at = 0
    query = query.rstrip()
    while at < len(query):
        m = _PART.match(query, at)
        if not m or m["other"]:
            raise ValueError(f"syntax error in the boolean query near {query[at:]!r}")
        at = m.end()
        if m["close"]:
            if len(stack) == 1:
                raise ValueError("unbalanced parenthesis in the boolean query")
            stack.pop()
        elif m["open"]:
            group = Term(op=m["op"])
            stack[-1].append(group)
            stack.append(group.group)
        elif m["phrase"] is not None:
            stack[-1].append(Term(op=m["op"], phrase=query_words(m["phrase"])))
        else:
            stack[-1].append(Term(op=m["op"], word=m["word"].lower(), prefix=bool(m["star"])))
    if len(stack) > 1:
        raise ValueError("unbalanced parenthesis in the boolean query")
    return stack[0]


def leaves(terms: list[Term]) -> list[Term]:
    out = []
    for t in terms:
        out += leaves(t.group) if t.group else [t]
    return out


def count_of(term: Term, low: Column) -> Column:
    """How often a leaf stands in a lower-cased text."""
    if term.phrase is not None:
        n = len(term.phrase)
        if n == 0:
            return F.lit(0)
        joined = F.concat(F.lit(" "), F.array_join(words(low), "  "), F.lit(" "))
        needle = " " + "  ".join(term.phrase) + " "
        may = low.contains(term.phrase[0])
        for w in term.phrase[1:]:
            may = may & low.contains(w)
        return F.when(may, F.regexp_count(joined, F.lit(needle))).otherwise(0)
    if term.prefix:
        held = F.size(F.filter(words(low), lambda w: w.startswith(term.word)))
        return F.when(low.contains(term.word), held).otherwise(0)
    return occurrences(low, term.word)


def unindexed(term: Term) -> bool:
    """A word that is never indexed, and so is left out of a query."""
    return not term.phrase and not term.prefix and not term.group and (term.word in STOP_WORDS or not SHORTEST <= len(term.word) <= LONGEST)


def boolean_score(terms: list[Term], tf: list[Column], idf2: list[Column]) -> tuple[Column, Column]:
    """Whether a row matches, and its rank, from its counts of the leaves and
    their weights."""
    place = {id(t): k for k, t in enumerate(leaves(terms))}

    def of_one(t: Term) -> tuple[Column, Column]:
        if t.group:
            held, value = of_all(t.group)
        else:
            held, value = tf[place[id(t)]] > 0, tf[place[id(t)]] * idf2[place[id(t)]]
        change = {">": 1.0, "<": -1.0, "~": -1.0}.get(t.op, 0.0)
        return held, F.when(held, value + change).otherwise(0.0)

    def of_all(listed: list[Term]) -> tuple[Column, Column]:
        kept = [t for t in listed if not unindexed(t)]
        need = [of_one(t) for t in kept if t.op == "+"]
        never = [of_one(t) for t in kept if t.op == "-"]
        may = [of_one(t) for t in kept if t.op not in ("+", "-")]
        held = F.lit(bool(need or may))
        for h, _ in need:
            held = held & h
        if not need and may:
            some = F.lit(False)
            for h, _ in may:
                some = some | h
            held = held & some
        for h, _ in never:
            held = held & ~h
        total = F.lit(0.0)
        for _, v in [*need, *may]:
            total = total + v
        return held, total

    return of_all(terms)


def boolean(df: DataFrame, text_col: str, query: str, rank: str = "rank") -> DataFrame:
    """Rows that a boolean query matches, with their rank.

    ``+`` must and ``-`` must not be held; ``>`` and ``<`` add and take away 1;
    ``~`` takes 1 away from a row that holds it; a star ends a prefix; quotes
    make a phrase; parentheses a group.  A row matches if it holds every ``+``
    term, no ``-`` term and, where there is no ``+`` term, any other.
    """
    parsed = parse_boolean(query)
    flat = leaves(parsed)
    if not flat:
        return df.withColumn(rank, F.lit(0.0)).where(F.lit(False))
    tf, idf2 = unused("_tf", df), unused("_idf2", df)
    rows = counted(df, text_col, tf, lambda low: [count_of(t, low) for t in flat])
    scored = rows.join(F.broadcast(_weights(rows, tf, len(flat), idf2)))  # one row
    held, total = boolean_score(
        parsed, [F.get(tf, F.lit(k)) for k in range(len(flat))], [F.get(idf2, F.lit(k)) for k in range(len(flat))]
    )
    return scored.withColumn(rank, total.cast("double")).where(held).drop(tf, idf2)


def top(df: DataFrame, rank: str, key: str, n: int) -> DataFrame:
    """The n best rows; ties go to the smaller key."""
    return df.orderBy(F.desc(rank), key).limit(n)


def top_per(df: DataFrame, group: str, rank: str, key: str, n: int) -> DataFrame:
    """The n best rows of each group."""
    order = Window.partitionBy(group).orderBy(F.desc(rank), key)
    place = unused("_place", df)
    return df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= n).drop(place)
