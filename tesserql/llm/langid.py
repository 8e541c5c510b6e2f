"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is read from a sentencepiece model; a
language is a probability for each piece.  A word's probability under a
language is the sum, over all its segmentations into pieces, of the products
of their probabilities, which a forward algorithm gives; a text's is the
product over its words.  Words are runs of letters, lower-cased, with the
vocabulary's word mark before them.

Learning takes one expectation step from equal piece probabilities: expected
counts of pieces by forward and backward sums over the segmentations of every
training word.  Each task adds up one count for each language and piece, so
that what travels is bounded by languages times vocabulary, whatever the
corpus.  The model has that size too.

Null texts and texts without a letter are ``und`` with score 0.  Training skips
rows with a null text, language or id; without any training row all documents
are ``und``.  A null id counts as held out.  Ties go to the language that sorts
first.  Words of any length are whole, in learning and in scoring, and so are
texts.  Repeated rows are independent, an empty table gives an empty result, and
other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import itertools
import string
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import kept_by, map_arrow

MARK = "▁"
#: Widest word, with its mark, whose probability is not computed in logarithms.
WIDE = 26
#: Words that one batch of the forward algorithm holds; fewer, if they are wider.
BATCH = 4096
#: Share of probability that goes to all pieces alike.
SMOOTH = 0.02
#: Words that a worker counts at once, or keeps the scores of; fewer scores, if
#: the languages are so many that these take more than KEEP_BYTES.
KEEP_WORDS = 600_000
KEEP_BYTES = 64 << 20
#: Parts of one in which expected counts are added up, so that their sum does not
#: depend on the order of tasks.
FIXED = 1 << 16


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> dict[str, int]:
    """Lower-case pieces of letters, numbered; 0 is any other single letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        letters = p.removeprefix(MARK)
        if (letters.isalpha() and p == p.lower()) or p == MARK:
            found.add(p)
    return {p: k + 1 for k, p in enumerate(sorted(found))}


@functools.lru_cache(maxsize=1)
def matcher(path: str) -> ahocorasick.Automaton:
    """Finds all pieces in a text; a value holds the length and the number."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, k in pieces(path).items():
        found.add_word(p, len(p) << 20 | k)
    found.make_automaton()
    return found


def tokens_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased texts split at white space: where each text begins among the
    places, the token at each place, and the different tokens.  An empty token
    may stand at a text's ends."""
    lowered = pa.array([(t or "").lower() for t in texts], pa.large_string())
    split = pc.utf8_split_whitespace(lowered)
    found = pc.list_flatten(split).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return starts.astype(np.int64), found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def letter_runs(token: str) -> list[str]:
    """Runs of letters, with the marks that combine with them, in a lower-cased
    token."""
    inner = token.strip(string.punctuation)
    if inner.isalpha():
        return [inner]
    if token.isascii():
        return "".join(c if c.isalpha() else " " for c in token).split()
    runs = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in token).split()
    return [w for w in runs if any(map(str.isalpha, w))]


def lattice(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in words: word, start, stop and piece number."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n + 1) - (n + 1)
    row_of = np.repeat(np.arange(len(words)), n + 1)
    flat = itertools.chain.from_iterable(matcher(path).iter("\n".join(words)))
    found = np.fromiter(flat, np.int64).reshape(-1, 2)
    length, number = found[:, 1] >> 20, found[:, 1] & 0xFFFFF
    at = found[:, 0] + 1 - length
    known = np.zeros(len(row_of), bool)
    known[at[length == 1]] = True
    known[first + n] = True
    other = np.flatnonzero(~known)  # letters that are no piece
    at = np.concatenate([at, other])
    length = np.concatenate([length, np.ones(len(other), np.int64)])
    number = np.concatenate([number, np.zeros(len(other), np.int64)])
    row = row_of[at]
    return row, at - first[row], at - first[row] + length, number


def batches(words: list[str], wide: int = WIDE) -> Iterator[list[int]]:
    """Places of words, by length, in batches of bounded size; words up to
    ``wide`` and beyond it do not share one, so that a word's result does not
    depend on its neighbours."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    narrow = sum(len(w) <= wide for w in words)
    at = 0
    while at < len(order):
        end = min(narrow if at < narrow else len(order), at + BATCH)
        # the last word of a batch is its widest
        while end - at > 1 and (end - at) * len(words[order[end - 1]]) > BATCH * WIDE:
            end = (at + end) // 2
        yield order[at:end]
        at = end


def forward(
    n: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray, number: np.ndarray, weights: np.ndarray, logs: bool
) -> np.ndarray:
    """``[place, word, language]``: sums over the segmentations of what stands
    before a place of the products of their pieces' weights; with ``logs`` their
    logarithms, as products of many weights are too small."""
    width = int(stop.max())
    order = np.argsort(stop * n + row, kind="stable")
    row, start, number = row[order], start[order], number[order]
    cut = np.searchsorted(stop[order], np.arange(1, width + 2))
    alpha = np.full((width + 1, n, weights.shape[1]), 0.0 if logs else 1.0)
    for j in range(1, width + 1):
        here = slice(cut[j - 1], cut[j])
        r = row[here]
        part = alpha[start[here], r]
        if logs:
            part = np.exp(part - alpha[j - 1, r])
        part *= weights[number[here]]
        heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        sums = np.add.reduceat(part, heads, axis=0)
        alpha[j, r[heads]] = np.log(sums) + alpha[j - 1, r[heads]] if logs else sums
    return alpha


def expected_counts(words: list[str], times: np.ndarray, path: str, wide: int = WIDE) -> np.ndarray:
    """Expected piece counts of words that occur so often."""
    size = len(pieces(path)) + 1
    total = np.zeros(size)
    equal = np.full((size, 1), 1.0 / size)
    for places in batches(words, wide):
        part = [words[k] for k in places]
        row, start, stop, number = lattice(part, path)
        n = np.array([len(w) for w in part])
        logs = bool(n.max() > wide)
        alpha = forward(len(part), row, start, stop, number, equal, logs)[:, :, 0]
        beta = forward(len(part), row, n[row] - stop, n[row] - start, number, equal, logs)[:, :, 0]
        before, after, z = alpha[start, row], beta[n[row] - stop, row], alpha[n[row], row]
        share = np.exp(before + after - z) / size if logs else before * after / z / size
        total += np.bincount(number, weights=share * times[places][row], minlength=size)
    return total


def learn(
    df: DataFrame,
    vocab_path: str,
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities ``[piece, language]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        tokens: dict[str, Counter] = {}

        def flush() -> None:
            for lang, seen in tokens.items():
                words: Counter = Counter()
                for token, n in seen.items():
                    for w in letter_runs(token):
                        words[MARK + w] += n
                if words:
                    ordered = sorted(words, key=len)
                    times = np.array([words[w] for w in ordered], float)
                    found = expected_counts(ordered, times, vocab_path)
                    sums[lang] = sums[lang] + found if lang in sums else found
            tokens.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens.setdefault(lang, Counter()).update(text.as_py().lower().split())
            if sum(map(len, tokens.values())) > KEEP_WORDS:
                flush()
        flush()
        for lang, found in sums.items():
            k = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(np.rint(found[k] * FIXED).astype(np.int64))],
                ["lang", "piece", "n"],
            )

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = map_arrow(rows, run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    # at most languages times pieces, whatever the corpus
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    size = len(pieces(vocab_path)) + 1
    model = np.zeros((size, len(langs)))
    index = {name: k for k, name in enumerate(langs)}
    model[table.column("piece").to_numpy(), [index[x] for x in names]] = table.column("n").to_numpy() / FIXED
    model /= np.maximum(model.sum(axis=0, keepdims=True), 1e-300)
    return langs, (1 - SMOOTH) * model + SMOOTH / size


def word_scores(words: list[str], path: str, model: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """Log probability of each marked word, by language."""
    out = np.empty((len(words), model.shape[1]))
    for places in batches(words, wide):
        part = [words[k] for k in places]
        n = np.array([len(w) for w in part])
        logs = bool(n.max() > wide)
        alpha = forward(len(part), *lattice(part, path), model, logs)
        ends = alpha[n, np.arange(len(part))]
        out[places] = ends if logs else np.log(ends)
    return out


class Scorer:
    """Log probabilities of texts, one distinct word at a time.

    ``row`` gives each token's row of the table ``kept``: that of its word, if it
    has one, with or without punctuation; row 0 is that of tokens without a
    letter, and a token of several words has a row of its own.
    """

    def __init__(self, path: str, model: np.ndarray) -> None:
        self.path, self.model = path, model
        self.row: dict[str, int] = {}
        self.used = 1
        self.most = max(1, min(KEEP_WORDS, KEEP_BYTES // (8 * (model.shape[1] + 1))))
        self.kept = np.zeros((1 + self.most, model.shape[1] + 1), np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """``[text, language]`` log probabilities; the last column counts words."""
        starts, token, different = tokens_of(texts)
        row, table = self.rows_of(different)
        scores = table[np.fromiter(map(row.__getitem__, different), np.int64, len(different))]
        out = np.zeros((len(texts), table.shape[1]))
        for k, (a, b) in enumerate(itertools.pairwise(starts)):
            out[k] = scores[token[a:b]].sum(axis=0)
        return out

    def rows_of(self, tokens: Iterable[str]) -> tuple[dict[str, int], np.ndarray]:
        """Rows of tokens, and the table that they are rows of."""
        runs = {t: letter_runs(t) for t in tokens if t not in self.row}
        words, several = self.missing(runs)
        if self.used + len(words) + len(several) > len(self.kept) or len(self.row) + len(runs) > 2 * self.most:
            self.row, self.used = {}, 1
            runs = {t: letter_runs(t) for t in tokens}
            words, several = self.missing(runs)
        row, table, first = self.row, self.kept, self.used
        end = first + len(words) + len(several)
        if end > len(table):  # one batch with more words than the table holds
            row, table = {}, np.zeros((end, table.shape[1]))
        else:
            self.used = end
        row.update(zip(words, itertools.count(first)))
        cut = first + len(words)
        if words:
            table[first:cut, :-1] = word_scores([MARK + w for w in words], self.path, self.model)
            table[first:cut, -1] = 1
        for k, t in enumerate(several, cut):
            table[k] = table[[row[w] for w in runs[t]]].sum(axis=0)
            row[t] = k
        for t, own in runs.items():
            if len(own) < 2:
                row[t] = row[own[0]] if own else 0
        return row, table

    def missing(self, runs: dict[str, list[str]]) -> tuple[list[str], list[str]]:
        """Words that have no row yet, and tokens of several words."""
        words = dict.fromkeys(w for own in runs.values() for w in own if w not in self.row)
        return list(words), [t for t, own in runs.items() if len(own) > 1]


#: The scorer of a worker, by its model's key.
_SCORERS: dict[str, Scorer] = {}
for _forget in (_SCORERS.clear, pieces.cache_clear, matcher.cache_clear):
    kept_by(__name__, _forget)


def scorer_of(key: str, path: str, model: np.ndarray) -> Scorer:
    """A worker keeps its words from task to task."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(path, model)
    return _SCORERS[key]


def judged(scorer: Scorer, langs: list[str], texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """Language and posterior of each text."""
    if not langs:
        yield from [("und", 0.0)] * len(texts)
        return
    for row in scorer.score(texts):
        if row[-1] == 0:
            yield "und", 0.0
        else:
            k = int(np.argmax(row[:-1]))
            yield langs[k], float(1 / np.exp(row[:-1] - row[k]).sum())


def predict(
    df: DataFrame,
    vocab_path: str,
    langs: list[str],
    model: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] = [],  # noqa: B006
) -> DataFrame:
    """``(doc_id, lang_pred, score, *keep)``; the score is the posterior of the
    predicted language under equal priors."""
    shared = df.sparkSession.sparkContext.broadcast((langs, model))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        scorer = scorer_of(key, vocab_path, model)
        for batch in batches:
            best: list[str] = []
            score: list[float] = []
            texts = batch.column(1)
            for at in range(0, len(texts), 200):
                for lang, p in judged(scorer, langs, texts[at : at + 200].to_pylist()):
                    best.append(lang)
                    score.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]],
                names,
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [kept[0].name, "lang_pred", "score", *(f.name for f in kept[1:])]
    types = [kept[0].dataType.simpleString(), "string", "double", *(f.dataType.simpleString() for f in kept[1:])]
    return map_arrow(rows, run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def keep_known(
    df: DataFrame, vocab_path: str, langs: list[str], model: np.ndarray, text_col: str = "text", least: float = 0.0
) -> DataFrame:
    """The rows whose language can be told with that score, all columns kept."""
    shared = df.sparkSession.sparkContext.broadcast((langs, model))
    key = uuid.uuid4().hex
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        scorer = scorer_of(key, vocab_path, model)
        for batch in batches:
            keep: list[bool] = []
            texts = batch.column(at)
            for first in range(0, len(texts), 200):
                rows = judged(scorer, langs, texts[first : first + 200].to_pylist())
                keep += [lang != "und" and p >= least for lang, p in rows]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(df, run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row takes no part in learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(
    df: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Learn from the rows that are not held out and predict all:
    ``(doc_id, held_out, lang_pred, score)``."""
    training = df.where(~held_out(id_col))
    langs, model = learn(training, vocab_path, text_col, lang_col)
    named = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out")
    )
    return predict(named, vocab_path, langs, model, keep=["held_out"])
