"""Secrets in texts: fixed patterns, and a linear-chain CRF that adds spans.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and without
overlap, each kind for itself; matches that fail the kind's test are dropped.

The CRF tags tokens as outside a secret (O), its begin (B) or inside (I).  A
token's score has a part from its own shape, from its left and right
neighbours' shapes, from a telling word among the ``NEAR`` tokens before it, and
from features of the whole text; labels of neighbours are scored together.  Shapes are few, so scores are kept by shape.  It is fitted
on the driver, by forward-backward gradients, on windows of a bounded sample of
documents (``TRAIN_DOCS`` with the smallest hashes of their ids), whose tokens
are labelled by the patterns.  So that it learns more than these patterns'
alphabets, each labelled secret behind a telling word also enters with the
shapes of random keys in its place.  Decoding is Viterbi over whole texts.  A token
whose advantage as B or I over O is smaller than any transitions could give
back is O on the best path; such tokens part the chain, so that the exact path
is found stretch by stretch.

Tagged spans that meet no pattern's span are added with kind ``crf``.

Null texts count as empty and have no spans.  Texts are never cut.  Without a
labelled secret in the sample nothing is added.  Repeated rows are independent,
an empty table gives an empty result, and columns other than the id and the
text are neither read nor returned, except by :func:`redact`, which returns all.
"""

from __future__ import annotations

import bisect
import random
import re
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import kept_by, map_arrow

#: Bound of the sample that the CRF is fitted on, in documents.
TRAIN_DOCS = 3000
#: Tokens on either side of a labelled secret, or in a window without one.
AROUND = 12
PLAIN = 40
#: Windows that one document of the sample gives at most.
WINDOWS = 4
#: How far before a token a telling word counts.
NEAR = 4
#: Tokens whose shapes a worker keeps.
KEEP_TOKENS = 400_000

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[\w+/.\-]+={0,2}|[^\w\s]")
#: Words that often stand before a secret.
_HINTS = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login|private|access", re.ASCII)

Span = tuple[int, int, str]


def base_spans(text: str, named: bool) -> list[tuple[Span, int]]:
    """Pattern spans, each with the start of its value; ``named``: whether the
    text holds one of the names at all."""
    out = []
    if named:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                out.append(((m.start(), m.end(), "assign"), m.start(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                out.append(((m.start(), m.end(), "access"), m.start()))
    for m in _HEX.finditer(text):
        out.append(((m.start(), m.end(), "hex"), m.start()))
    return sorted(out, key=lambda s: (s[0][0], KINDS.index(s[0][2])))


def holds_name(text: str) -> bool:
    low = text.lower()
    return any(n in low for n in _NAMES)


# ---------------------------------------------------------------- shapes

#: Sizes of the one-hot groups of a shape.
GROUPS = (12, 8, 5, 4, 2, 2)
WIDTH = sum(GROUPS) + 1
PAD = (11, 0, 0, 0, 0, 0)
_PLAIN_WORD = (0, 0, 0, 0, 0, 0)


def shape(token: str) -> tuple[int, ...]:
    """Kind, length, share of digits, variety, hint and final '='."""
    if len(token) < 20 and token.isalpha() and (token.islower() or token.istitle()):
        hint = 1 if len(token) > 2 and _HINTS.search(token.lower()) else 0
        return (0, 0, 0, 0, hint, 0) if hint else _PLAIN_WORD
    core = token.rstrip("=")
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    if n <= 1 and not token[:1].isalnum():
        kind = 9 if token in "\"'`" else 8 if token in ":=" else 10
    elif core.isdigit():
        kind = 3
    elif digits and all(c in "0123456789abcdef" for c in core):
        kind = 4
    elif core.isalpha():
        kind = 1 if core.isupper() else 0 if core.islower() or core.istitle() else 2
    elif core.isalnum():
        kind = 5
    else:
        kind = 6 if digits else 7
    length = bisect.bisect_right((1, 3, 7, 11, 15, 23, 39), n)
    share = bisect.bisect_right((0, n * 0.2, n * 0.5, n * 0.9), digits - 0.5) if digits else 0
    variety = bisect.bisect_right((4, 8, 14), len(set(core)))
    hint = 1 if _HINTS.search(token.lower()) else 0
    return (kind, length, share, variety, hint, int(token.endswith("=")))


def one_hot(s: tuple[int, ...]) -> np.ndarray:
    row = np.zeros(WIDTH)
    at = 0
    for value, size in zip(s, GROUPS):
        row[at + value] = 1
        at += size
    row[at] = 1
    return row


def text_features(text: str, named: bool) -> int:
    """One of four classes of a text: does it hold a name, an equals sign."""
    return 2 * named + ("=" in text)


def near_hint(hints: np.ndarray) -> np.ndarray:
    """Whether one of the NEAR entries before each entry (last axis) is set."""
    out = np.zeros(hints.shape, np.int64)
    for d in range(1, NEAR + 1):
        out[..., d:] |= hints[..., :-d]
    return out


Window = tuple[list[tuple[int, ...]], list[int], int]


def with_random_keys(windows: list[Window]) -> list[Window]:
    """The windows, and copies with other keys and separators behind telling
    words; half as many hold what is no key there."""
    rng, out = random.Random(0), list(windows)
    letters = string.ascii_letters + string.digits
    alphabets = (letters, string.ascii_lowercase + string.digits, letters + "_-", letters + "+/")
    separators = ("", "=", ":", '="', ':"', '":"')
    for shapes, labels, doc in windows:
        for k in [k for k, label in enumerate(labels) if label == 1]:
            hints = [j for j in range(max(0, k - NEAR), k) if shapes[j][4]]
            if not hints:
                continue
            head, tail = shapes[: hints[-1] + 1], shapes[k + 1 : k + 1 + AROUND]
            tail = [s for s in tail if s[0] != 9]
            for _ in range(6):
                between = rng.choice(separators)
                key = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(14, 44)))
                other = rng.choice(["word", "Longerword", "the", "12", "2024", "3.14", "1999-01-02", "x1", "16MB/s"])
                for token, label in ((key, 1), (other, 0))[: 1 + rng.randint(0, 1)]:
                    s = shape(token) if label == 0 else shape(token)[:4] + (0, 0)
                    new = [*head, *map(shape, between), s, *map(shape, between[-1:] if between[-1:] == '"' else ""), *tail]
                    tags = [0] * len(new)
                    tags[len(head) + len(between)] = label
                    out.append((new, tags, doc))
    return out


# ---------------------------------------------------------------- the CRF


class Crf:
    """Weights: own, left and right shape ``[WIDTH, 3]``; telling word near
    ``[2, 3]``; text class ``[4, 3]``; transitions ``[3, 3]``.  Labels: O, B, I."""

    def __init__(self, own, left, right, near, doc, moves) -> None:
        self.own, self.left, self.right, self.near = own, left, right, near
        self.doc, self.moves = doc, moves
        a, s, b = np.meshgrid([0, 1, 2], [1, 2], [0, 1, 2], indexing="ij")
        gain = moves[a, s] + moves[s, b] - moves[a, 0] - moves[0, b]
        #: What transitions can at most give to B or I over O.
        self.slack = float(gain.max())

    @classmethod
    def fit(cls, windows: list[Window], rounds: int = 60) -> Crf | None:
        """Maximise the penalised likelihood by Adam; windows hold shapes,
        labels and the text class."""
        if not any(any(labels) for _, labels, _ in windows):
            return None
        windows = with_random_keys(windows)
        shapes: dict[tuple[int, ...], int] = {PAD: 0}
        n, most = len(windows), max(len(w[1]) for w in windows)
        ids = np.zeros((n, most + 2), np.int64)
        gold = np.zeros((n, most), np.int64)
        here = np.zeros((n, most), bool)
        for k, (window, labels, _) in enumerate(windows):
            ids[k, 1 : len(window) + 1] = [shapes.setdefault(s, len(shapes)) for s in window]
            gold[k, : len(labels)] = labels
            here[k, : len(labels)] = True
        docs = np.array([w[2] for w in windows])
        x = np.stack([one_hot(s) for s in shapes])
        sizes = [(WIDTH, 3)] * 3 + [(2, 3), (4, 3), (3, 3)]
        weights = [np.zeros(s) for s in sizes]
        first = [np.zeros(s) for s in sizes]
        second = [np.zeros(s) for s in sizes]
        own, left, right = ids[:, 1:-1], ids[:, :-2], ids[:, 2:]
        near = near_hint(np.array([s[4] for s in shapes])[own])
        steps = most
        target = (gold[:, :, None] == np.arange(3)) & here[:, :, None]
        before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
        lengths = here.sum(axis=1)
        last = gold[np.arange(n), lengths - 1]
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (before[here], gold[here]), 1)
        np.add.at(pairs, (last, np.zeros(n, np.int64)), 1)
        for t in range(1, rounds + 1):
            w_own, w_left, w_right, w_near, w_doc, moves = weights
            e = (x @ w_own)[own] + (x @ w_left)[left] + (x @ w_right)[right]
            e += w_near[near] + w_doc[docs][:, None]
            m = np.exp(moves)
            f = np.exp(e - e.max(axis=2, keepdims=True))
            alpha = np.zeros((steps, n, 3))
            now = np.tile(m[0], (n, 1)) * f[:, 0]
            alpha[0] = now / now.sum(axis=1, keepdims=True)
            for i in range(1, steps):
                now = (alpha[i - 1] @ m) * f[:, i]
                now /= now.sum(axis=1, keepdims=True)
                alpha[i] = np.where(here[:, i, None], now, alpha[i - 1])
            beta = np.zeros((steps, n, 3))
            end = np.tile(m[:, 0], (n, 1))
            beta[steps - 1] = end
            for i in range(steps - 2, -1, -1):
                back = (f[:, i + 1] * beta[i + 1]) @ m.T
                back /= back.sum(axis=1, keepdims=True)
                beta[i] = np.where(here[:, i + 1, None], back, end)
            mine = alpha * beta
            mine /= mine.sum(axis=2, keepdims=True)
            mine = mine.transpose(1, 0, 2) * here[:, :, None]
            expected = np.zeros((3, 3))
            for i in range(steps):
                prior = alpha[i - 1] if i else np.tile([1.0, 0, 0], (n, 1))
                joint = prior[:, :, None] * m * (f[:, i] * beta[i])[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += joint[here[:, i]].sum(axis=0)
            tail = alpha[lengths - 1, np.arange(n)] * m[:, 0]
            expected[:, 0] += (tail / tail.sum(axis=1, keepdims=True)).sum(axis=0)
            error = (target - mine).reshape(-1, 3)
            grads = []
            for index in (own, left, right):
                by_shape = np.stack(
                    [np.bincount(index.ravel(), error[:, c], len(x)) for c in range(3)], axis=1
                )
                grads.append(x.T @ by_shape)
            grads.append(np.stack([np.bincount(near.ravel(), error[:, c], 2) for c in range(3)], axis=1))
            by_doc = error.reshape(n, -1, 3).sum(axis=1)
            grads.append(np.stack([np.bincount(docs, by_doc[:, c], 4) for c in range(3)], axis=1))
            grads.append(pairs - expected)
            for k, g in enumerate(grads):
                g = g / n - 1e-5 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
                weights[k] = weights[k] + 0.15 * step
        return cls(*weights)


class Tagger:
    """Viterbi over whole texts; keeps the shapes of tokens it has seen."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self.row_of: dict[str, int] = {}
        self.rows: dict[tuple[int, ...], int] = {}
        self.scores = np.zeros((0, 3, 3))
        self.hints = np.zeros(0, np.int64)
        self.pad = self._row(PAD)

    def _row(self, s: tuple[int, ...]) -> int:
        if s not in self.rows:
            x, c = one_hot(s), self.crf
            self.rows[s] = len(self.scores)
            self.scores = np.concatenate([self.scores, [[x @ c.own, x @ c.left, x @ c.right]]])
            self.hints = np.append(self.hints, s[4])
        return self.rows[s]

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        known = self.row_of
        try:
            ids = [known[t] for t in tokens]
        except KeyError:
            if len(known) > KEEP_TOKENS:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self._row(shape(t))
            ids = [known[t] for t in tokens]
        return np.array([self.pad, *ids, self.pad])

    def emissions(self, tokens: list[str], doc: int) -> np.ndarray:
        ids, s = self.rows_of(tokens), self.scores
        near = near_hint(self.hints[ids[1:-1]])
        return s[ids[1:-1], 0] + s[ids[:-2], 1] + s[ids[2:], 2] + self.crf.near[near] + self.crf.doc[doc]

    def runs(self, tokens: list[str], doc: int) -> list[tuple[int, int]]:
        """Tagged runs of tokens: first, and one past the last."""
        if not tokens:
            return []
        e = self.emissions(tokens, doc)
        open_ = np.flatnonzero(np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + self.crf.slack >= 0)
        if not len(open_):
            return []
        out: list[tuple[int, int]] = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            lo = int(part[0])
            labels = self.best(e[lo : int(part[-1]) + 1])
            start = None
            for k, label in enumerate([*labels, 0]):
                if start is not None and label != 2:
                    out.append((lo + start, lo + k))
                    start = None
                if label and start is None:
                    start = k
        return out

    def best(self, e: np.ndarray) -> list[int]:
        """The best labels of a stretch between two O."""
        m, back = self.crf.moves.tolist(), []
        now = [m[0][s] + x for s, x in enumerate(e[0].tolist())]
        for row in e[1:].tolist():
            from_, new = [], []
            for s in range(3):
                a = max(range(3), key=lambda a: now[a] + m[a][s])
                from_.append(a)
                new.append(now[a] + m[a][s] + row[s])
            back.append(from_)
            now = new
        s = max(range(3), key=lambda s: now[s] + m[s][0])
        labels = [s]
        for from_ in reversed(back):
            s = from_[s]
            labels.append(s)
        return labels[::-1]


#: The tagger of a worker, by its model's key.
_TAGGERS: dict[str, Tagger] = {}
kept_by(__name__, _TAGGERS.clear)


def tagger_of(key: str, crf: Crf) -> Tagger:
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(crf)
    return _TAGGERS[key]


def all_spans(text: str, tagger: Tagger | None) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and those together with the added ones, in order."""
    named = holds_name(text)
    base = [s for s, _ in base_spans(text, named)]
    if tagger is None:
        return base, base
    runs = tagger.runs(_TOKEN.findall(text), text_features(text, named))
    if not runs:
        return base, base
    places = [m.span() for m in _TOKEN.finditer(text)]
    taken = sorted((a, b) for a, b, _ in base)
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    added = []
    for i, j in runs:
        a, b = places[i][0], places[j - 1][1]
        k = bisect.bisect_left(taken, (b, 0))
        if k == 0 or reach[k - 1] <= a:
            added.append((a, b, "crf"))
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- fitting


def windows_of(text: str, pick: int) -> list[Window]:
    """Labelled windows around pattern spans, and one plain one."""
    named = holds_name(text)
    found = base_spans(text, named)
    doc = text_features(text, named)
    places = [m.span() for m in _TOKEN.finditer(text)]
    if not places:
        return []
    labels = [0] * len(places)
    starts = [a for a, _ in places]
    spots = []
    for (_, end, _), value in found:
        i = max(0, bisect.bisect_right(starts, value) - 1)
        j = bisect.bisect_left(starts, end)
        for k in range(i, j):
            labels[k] = labels[k] or (1 if k == i else 2)
        spots.append((max(0, i - AROUND), min(len(places), j + AROUND)))
    start = pick % max(1, len(places) - PLAIN + 1)
    out = []
    for a, b in [*spots[: WINDOWS - 1], (start, min(len(places), start + PLAIN))]:
        b = min(b, a + 4 * PLAIN)
        tags = labels[a:b]
        if tags[0] == 2:
            tags[0] = 1
        out.append(([shape(text[x:y]) for x, y in places[a:b]], tags, doc))
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = TRAIN_DOCS) -> Crf | None:
    """Fit on windows of ``docs`` documents: those whose id hashes, then text
    hashes, are smallest.  Rows that are equal in both count as one, so no more
    than ``docs`` times ``WINDOWS`` windows reach the driver."""
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text")
    )
    # at most ``docs`` rows of two longs
    chosen = rows.select("h", "copy").distinct().orderBy("h", "copy").limit(docs)
    texts = rows.join(F.broadcast(chosen), ["h", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, copies, at, flat, tags, classes = [], [], [], [], [], []
            for h, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for k, (window, labels, doc) in enumerate(windows_of(text.as_py() or "", h & 0x7FFFFFFF)):
                    hashes.append(h)
                    copies.append(copy)
                    at.append(k)
                    flat.append(bytes(v for s in window for v in s))
                    tags.append(bytes(labels))
                    classes.append(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes, pa.int64()), pa.array(copies, pa.int64()), pa.array(at, pa.int32()),
                    pa.array(flat, pa.binary()), pa.array(tags, pa.binary()), pa.array(classes, pa.int32()),
                ],
                ["h", "copy", "at", "shapes", "labels", "doc"],
            )

    windows = map_arrow(texts.select("h", "copy", "text"), run, "h long, copy long, at int, shapes binary, labels binary, doc int")
    found = windows.dropDuplicates(["h", "copy", "at"]).toArrow().to_pylist()
    found.sort(key=lambda r: (r["h"], r["labels"], r["shapes"]))
    width = len(GROUPS)
    return Crf.fit(
        [
            (
                [tuple(r["shapes"][k : k + width]) for k in range(0, len(r["shapes"]), width)],
                list(r["labels"]),
                r["doc"],
            )
            for r in found
        ]
    )


# ---------------------------------------------------------------- frames


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(df: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: lists of ``(start, stop, kind)`` in code points."""
    shared = df.sparkSession.sparkContext.broadcast(crf)
    key = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def rows_of(spans: list[Span]) -> list[dict]:
        return [{"start": a, "stop": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if shared.value is None else tagger_of(key, shared.value)
        for batch in batches:
            base, every = [], []
            for t in batch.column(1):
                b, e = all_spans(t.as_py() or "", tagger)
                base.append(rows_of(b))
                every.append(rows_of(e))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    of_id = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,stop:int,kind:string>>"
    return map_arrow(rows, run, f"doc_id {of_id}, base {spans}, spans {spans}")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit, find, and give counts, digest and joined spans of every document."""
    found = find(df, fit(df, id_col, text_col), id_col, text_col)

    def text_of(column: str):
        parts = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.concat_ws(",", parts)

    def count_of(name: str):
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *[count_of(k) for k in KINDS[:3]],
        F.sha2(text_of("base").cast("binary"), 256).alias("base_sha256"),
        text_of("spans").alias("spans"),
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span's place taken by its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, crf: Crf | None, text_col: str = "text") -> DataFrame:
    """All columns, with secrets in the text replaced; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(crf)
    key = uuid.uuid4().hex
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if shared.value is None else tagger_of(key, shared.value)
        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                texts.append(text if text is None else redacted(text, all_spans(text, tagger)[1]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return map_arrow(df, run, df.schema)
