import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from tests.llm.edge import SCHEMA, edge_documents, empty_documents
from tesserql.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def slow(text):
    """The four patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)


def test_fixed_kinds_match_brute_force(spark):
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", "x_y%z", "-", " ", "+1 (555) 010-2345", "4111 1111 1111 1111", "10.0.255.1", "256.1.1.1", "007",
             "é", "😀", "+", "(", "9", "12", "0255", "\n", " ", "4111-1111-1111-1111", "..", "a@b..c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += ["1." * 4000 + "5", "a." * 9000 + "@" + "b." * 9000 + "c", "+" + "1 " * 5000 + "1", "7" * 40000, "x" * 40000 + "@"]
    rows = pii.digests(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id][:80], want, r)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(re.findall(f"{k}:", want)) for k in pii.KINDS)


def slow_confident(rows):
    """The graph's scores by plain loops."""
    links = {(r.pattern, r.instance) for r in rows}
    seeds = {r.instance for r in rows if r.seed}
    by = {}
    for p, i in links:
        by.setdefault(p, set()).add(i)
    by = {p: s for p, s in by.items() if len(s) >= pii.SUPPORT}
    sure = {i: float(i in seeds) for s in by.values() for i in s}
    for _ in range(pii.ROUNDS):
        strength = {p: sum(sure[i] for i in s) / (len(s) + 1) for p, s in by.items()}
        for i in sure:
            rest = 1.0
            for p, s in by.items():
                if i in s:
                    rest *= 1 - min(strength[p], 0.999)
            sure[i] = 1.0 if i in seeds else 1 - rest
    return {(p, i) for p, s in by.items() for i in s if i not in seeds and strength[p] >= pii.SURE and sure[i] >= pii.SURE}


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"Please call me at +1 (555) 010-2{k:03d} soon." for k in range(40)]
    texts += [f"The card number is 4111 1111 1111 1111 or member id {k}{k}-77{k}." for k in range(5)]
    texts += [f"server address is 10.0.{k}.7 today" for k in range(30)]
    texts += ["server address is 10.300.4.7 today", "In the year 1999 all was well."]
    docs = frame(spark, texts)
    scanned = pii.scan(docs)
    occurrences = pii.instances(scanned)
    found = {(r.pattern, r.instance) for r in pii.confident(occurrences).collect()}
    assert found == slow_confident(occurrences.collect()) and found
    by = {r.doc_id: r.spans for r in pii.digests(docs).collect()}
    at = texts[-2].index("10.300")
    assert by[len(texts) - 2] == f"context:{at}:{at + 10}"
    assert by[len(texts) - 1] == ""


def test_edge_cases(spark):
    rows = pii.digests(edge_documents(spark)).collect()
    assert len(rows) == 11 and all(r.spans == "" for r in rows)
    assert pii.digests(empty_documents(spark)).collect() == []
    plan = pii.find(edge_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.found(F.lit("a"), "b") is not None


def slow_tokens(text):
    out = []
    for m in re.finditer(r"[^\x20\t-\r]*[0-9][^\x20\t-\r]*", text):
        gaps = re.sub(r"[^\x20\t-\r]*[0-9][^\x20\t-\r]*", "\0", text[: m.start()]).split("\0")
        words = [w for g in gaps for w in regex.findall(r"\p{L}+[^\p{L}\s]*", g.lower())]
        out.append((m.start(), m.end(), words[-2:]))
    return out


def test_tokens_and_the_words_before_them(spark):
    rng = random.Random(2)
    parts = ["Id", ":", " ", " ", "A12", "b-c", "7", "é", ",", "-", "(x", "\n", "9.", "no. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["IDs: A1234, B5678, C9012", "word " + "x1 " * 1500 + "last words x2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.found(F.col("text"), pii.TOKEN, context=True).alias("t"))
    for r in rows.collect():
        assert [(t.start, t.stop, t.before) for t in r.t] == slow_tokens(texts[r.i]), texts[r.i][:60]


def test_very_many_tokens_in_one_text(spark):
    text = "member id " + "a1 b2@c.de " * 40000
    r, = pii.digests(frame(spark, [text])).collect()
    want = slow(text)
    assert r.n_email == 40000 and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_recall_of_identifiers_in_a_telling_context(spark):
    """Identifiers unlike any fixed kind, in contexts that fixed kinds teach."""
    rng = random.Random(6)
    number = lambda most: f"+1-555-{rng.randrange(10**6, 10**7)}" if most else f"555-{rng.randrange(10**6, 10**7)}x{rng.randrange(9)}"
    texts = [f"{rng.choice(['Alan', 'Maria'])} can be reached, phone number {number(k % 10)} today" for k in range(2000)]
    texts += [f"It was in the year {rng.randrange(1800, 2030)} that chapter {rng.randrange(90)} came out" for _ in range(2000)]
    rows = pii.digests(frame(spark, texts)).collect()
    planted = [r for r in rows if r.doc_id < 2000 and r.doc_id % 10 == 0]
    assert all(r.spans == "" for r in rows if r.doc_id >= 2000)
    assert len(planted) == 200 and all(r.spans.startswith("context:") and r.spans.count(":") == 2 for r in planted)
