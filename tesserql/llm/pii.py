"""Personal data by fixed patterns and by bootstrapped context patterns.

All of it is DataFrame functions; no Python runs on rows.

Fixed kinds (``email``, ``ip``, ``card``, ``phone``) are matched leftmost and
without overlap, each for itself; matches that fail the kind's test are
dropped.  The regular expressions are possessive forms of the stated ones, which
match the same strings in time linear in the text and without recursion.  Spark
returns matched strings, not positions; these come from the lengths of the gaps
between matches (``split`` by the same expression).

Bootstrapping: tokens that hold a digit are *instances*; the last two words
before one (of those without a digit, however far back; tokens with no word
before them are left out) are a lexical *pattern*, and together with the token's
shape another.
Instances that fixed kinds cover are seeds with confidence 1.  A round scores
each pattern by the share of confidence among its different instances, smoothed,
and each other instance by the noisy-or of its patterns.  After ``ROUNDS``
rounds, tokens of confident patterns and instances that no fixed kind covers are
added with kind ``context``.  Patterns need ``SUPPORT`` different instances, and
a pattern without any seed or confident instance scores zero.

Null texts count as empty and have no spans.  Texts are never cut; time is in
proportion to a text's length but for a share with the square of its matches
over ``BLOCK``.  Repeated rows each have their spans; an instance counts once
for each pattern, however often it occurs, and the sums that scores are have no
order, so there are no ties.  Rows are told apart by a row number, so that null and repeated ids do no harm.  An empty
table gives an empty result.  Columns other than the id and the text are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import checkpointed

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run without white space that holds a digit.
TOKEN = r"(?<![^\x20\t-\r])[^\x20\t-\r0-9]*+[0-9][^\x20\t-\r]*+"
KINDS = ("email", "ip", "card", "phone")

ROUNDS = 3
#: Different instances that a pattern needs.
SUPPORT = 3
#: Confidence that a pattern and an instance need.
SURE = 0.7
#: Matches whose places are summed at once.
BLOCK = 256
#: The last word of a text, and the one before, read from its end: letters, and
#: what follows them up to a letter or white space.
LAST = r"^(?:[^\p{L}\s]*+\s++)*+([^\p{L}\s]*+\p{L}++)(?:(?:[^\p{L}\s]*+\s++)*+([^\p{L}\s]*+\p{L}++))?"
#: Places that one cell of the join of tokens with fixed kinds covers.
CELL = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def last_words(gap: Column) -> Column:
    """The last two words, at most, of a stretch of text, in lower case."""
    back = F.reverse(gap)
    words = [F.lower(F.reverse(F.regexp_extract(back, LAST, k))) for k in (2, 1)]
    return F.filter(F.array(*words), lambda w: w != "")


def found(text: Column, pattern: str, context: bool = False) -> Column:
    """Matches as an array of ``(start, stop, hit, before)``; before holds the
    last two words between the matches before it, if there is a use for them.

    Starts are sums of the lengths before them.  A sum that appends to an array
    copies it each time, so matches are summed in blocks of ``BLOCK``.
    """
    kind = "struct<start:int,stop:int,hit:string,before:array<string>>"
    none = F.array().cast("array<string>")
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(
        F.zip_with(gaps, hits, lambda g, h: F.struct((last_words(g) if context else none).alias("words"), F.length(g).alias("gap"), h.alias("hit"))),
        lambda x: x["hit"].isNotNull(),
    )

    def latest(earlier: Column, later: Column) -> Column:
        return F.when(F.size(later) >= 2, later).otherwise(F.reverse(F.slice(F.reverse(F.concat(earlier, later)), 1, 2))) if context else none

    def summed(block: Column) -> Column:
        """(length, last words, matches) of one block."""
        start = F.struct(F.lit(0).alias("at"), none.alias("last"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(held: Column, x: Column) -> Column:
            at = held["at"] + x["gap"]
            stop = at + F.length(x["hit"])
            last = latest(held["last"], x["words"])
            one = F.struct(at.alias("start"), stop.alias("stop"), x["hit"].alias("hit"), last.alias("before"))
            return F.struct(stop.alias("at"), last.alias("last"), F.concat(held["out"], F.array(one)).alias("out"))

        return F.aggregate(block, start, step)

    def before(blocks: Column) -> Column:
        """(length, last words) of all that stands before each block."""
        zero = F.struct(F.lit(0).alias("at"), none.alias("last"))
        start = F.struct(*[zero[c].alias(c) for c in ("at", "last")], F.array().cast("array<struct<at:int,last:array<string>>>").alias("out"))

        def step(held: Column, x: Column) -> Column:
            here = F.struct(held["at"].alias("at"), held["last"].alias("last"))
            return F.struct(
                (held["at"] + x["at"]).alias("at"),
                latest(held["last"], x["last"]).alias("last"),
                F.concat(held["out"], F.array(here)).alias("out"),
            )

        return F.aggregate(blocks, start, step, lambda held: held["out"])

    def moved(block: Column, base: Column) -> Column:
        return F.transform(
            block["out"],
            lambda m: F.struct(
                (m["start"] + base["at"]).alias("start"),
                (m["stop"] + base["at"]).alias("stop"),
                m["hit"].alias("hit"),
                latest(base["last"], m["before"]).alias("before"),
            ),
        )

    def blocks(every: Column) -> Column:
        last = F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: summed(F.slice(every, k * BLOCK + 1, F.lit(BLOCK))))

    return bound(both, lambda every: bound(blocks(every), lambda bs: F.flatten(F.zip_with(bs, before(bs), moved))))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum over a string of digits."""
    values = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = digits_of(hit)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(hit)).between(9, 15)
    return F.lit(True)


def matches(kind: str, text: Column) -> Column:
    """Passing matches of a fixed kind; texts that cannot hold one are passed
    over by a cheaper test."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    may = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": text.contains("+"),
    }[kind]
    hits = F.filter(found(text, pattern), lambda m: passes(kind, m["hit"]))
    return F.when(may, F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: ``(row, doc_id, email, ip, card, phone,
    tokens)``, written to the shared folder without the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spans = "array<struct<start:int,stop:int>>"
    out = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        *[F.coalesce(matches(k, F.col("text")), F.array().cast(spans)).alias(k) for k in KINDS],
        F.when(F.col("text").rlike("[0-9]"), found(F.col("text"), TOKEN, context=True)).alias("tokens"),
    )
    return checkpointed(out)


def instances(scanned: DataFrame) -> DataFrame:
    """Digit tokens with their patterns: ``(row, start, stop, pattern,
    instance, seed)``."""
    tokens = scanned.select("row", F.explode("tokens").alias("t"))
    # punctuation at the ends does not belong to an identifier
    core = F.regexp_extract(F.col("t.hit"), r"[\p{L}0-9+].*[\p{L}0-9]|[0-9]", 0)
    lead = F.length(F.regexp_extract(F.col("t.hit"), r"^[^\p{L}0-9+]*", 0))
    start = F.col("t.start") + lead
    last = F.array_join(F.reverse("t.before"), " ")
    shape = F.regexp_replace(F.regexp_replace(core, r"\p{L}+", "a"), "[0-9]+", "9")
    named = checkpointed(
        tokens.select("row", start.alias("start"), (start + F.length(core)).alias("stop"), last.alias("last"), shape.alias("shape"), core.alias("instance"))
        .where("last <> '' and instance <> ''")
    )

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", F.explode(F.expr(f"sequence(start div {CELL}, (stop - 1) div {CELL})")))

    base = scanned.select("row", F.explode(F.concat(*KINDS)).alias("b")).select("row", F.col("b.start").alias("start"), F.col("b.stop").alias("stop"))
    met = cells(named.select("row", "start", "stop")).alias("t").join(cells(base).alias("b"), ["row", "cell"])
    covered = met.where("b.start < t.stop and b.stop > t.start").select("row", "t.start").distinct().withColumn("seed", F.lit(True))
    patterns = F.array(F.concat_ws("|", "last", "shape"), F.col("last"))
    return checkpointed(
        named.join(covered, ["row", "start"], "left")
        .select("row", "start", "stop", F.explode(patterns).alias("pattern"), "instance", F.coalesce("seed", F.lit(False)).alias("seed"))
    )


def confident(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scored links ``(pattern, instance)`` whose two ends are both sure and
    whose instance is no seed."""
    links = occurrences.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    supported = links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    seeds = links.groupBy("instance").agg(F.max("seed").alias("seed"))
    graph = checkpointed(
        links.select("pattern", "instance").join(supported, "pattern").join(seeds, "instance")
        .withColumn("sure", F.col("seed").cast("double"))
    )
    for _ in range(rounds):
        patterns = graph.groupBy("pattern").agg((F.sum("sure") / (F.first("n") + 1)).alias("strength"))
        # a certain pattern still leaves a doubt, so that logarithms are finite
        scored = graph.drop("sure", "strength").join(patterns, "pattern")
        doubt = F.log1p(-F.least(F.col("strength"), F.lit(0.999)))
        each = scored.groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("belief"))
        graph = checkpointed(
            scored.join(each, "instance")
            .withColumn("sure", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("belief")))
            .drop("belief")
        )
    return graph.where((F.col("seed") == 0) & (F.col("strength") >= SURE) & (F.col("sure") >= SURE)).select("pattern", "instance")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone, context)``: spans ``(start, stop)`` of
    every row, in code points."""
    scanned = scan(df, id_col, text_col)
    occurrences = instances(scanned)
    added = (
        occurrences.where("not seed")
        .join(confident(occurrences), ["pattern", "instance"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("context"))
    )
    return scanned.join(added, "row", "left").select(
        "doc_id", *KINDS, F.coalesce("context", F.array().cast("array<struct<start:int,stop:int>>")).alias("context")
    )


def named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the fixed kinds' spans, and all spans."""
    spans = find(df, id_col, text_col)
    base = [named(k) for k in KINDS]
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, named("context")), ",").alias("spans"),
    )
