"""Exact byte-level BPE encoding by backtracking, and table-driven decoding.

Encoding takes a text apart with the pre-tokeniser's pattern and encodes each
piece by itself.  An Aho-Corasick automaton lists the vocabulary tokens that
start at each byte; a depth-first walk takes the longest one whose pair with
its left neighbour is *compatible*, that is, whose bytes joined with the
neighbour's merge back into exactly these two tokens.  Adjacent compatibility
is enough for the whole sequence to be the one that the merges give, and a
position that was left once without success is never entered again, so the
walk takes time linear in the piece.  Compatibility is kept in a table that
fills as pairs are met; encoded pieces are kept in a bounded table.

Decoding gathers token bytes from one array through an offset table.

Null texts count as empty, empty texts have no ids, repeated rows and ties are
encoded independently, an empty table gives an empty result, and columns other
than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tesserql.llm.common import map_arrow

assert sys.byteorder == "little" and array("I").itemsize == 4

#: How many encoded pieces (of at most KEEP_BYTES bytes) a worker keeps.
KEEP_PIECES = 1_200_000
KEEP_BYTES = 64
#: How many pairs of tokens its table of compatible pairs holds.
KEEP_PAIRS = 1_000_000

#: Fixed value: the pre-tokeniser's pattern of the public byte-level vocabularies.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    table.update({chr(256 + i): b for i, b in enumerate(spare)})
    return table


@functools.cache
def unlike_characters() -> frozenset[str]:
    """Letters and numbers that the tokenizers library, of an earlier Unicode
    version, takes for neither."""
    splits = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    unknown = "".join(
        c
        for c in map(chr, [*range(0x370, 0xD800), *range(0xE000, 0x110000)])
        if unicodedata.category(c) == "Cn"
    )
    later = regex.findall(r"[\p{L}\p{N}]", unknown)
    return frozenset(c for c in later if len(splits("." + c)) == 1)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*model["vocab"].values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for text, i in model["vocab"].items():
            self.token_bytes[i] = (
                text.encode() if text in special else bytes(letters[c] for c in text)
            )
        for text, i in special.items():
            self.token_bytes[i] = text.encode()
        self.special = special
        vocab = model["vocab"]
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[left + right]
            self.merge_of[vocab[left], vocab[right]] = (rank, whole)
            self.made_from.setdefault(whole, (vocab[left], vocab[right], rank))
        self.ordinary = {
            self.token_bytes[i]: i for t, i in vocab.items() if t not in special
        }
        self.single = [self.ordinary.get(bytes([b]), -1) for b in range(256)]
        # decoding: all bytes in a row, and where each token's begin
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        lengths = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        # one compact copy serves the automaton: bytes as Latin-1 characters
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ordinary.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids that the merges give, lowest rank first; for short inputs."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min(
                (
                    (m[0], k, m[1])
                    for k in range(len(ids) - 1)
                    if (m := self.merge_of.get((ids[k], ids[k + 1])))
                ),
                default=None,
            )
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's right (1) or left (0) end while it forms:
        tokens, each with the rank of the merge that takes it up."""
        out: list[tuple[int, float]] = []
        until = float("inf")
        while True:
            out.append((token, until))
            parts = self.made_from.get(token)
            if parts is None:
                return out
            until, token = parts[2], parts[side]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: starts the piece).

        A merge uses a token only after the merge that makes it, so all merges
        of a rank happen at one time.  Two tokens stay apart if no pair that
        meets at their border has a rank at which both are still there; of
        equal ranks, the one further left comes first.
        """
        known = self.compatible.get((left, right))
        if known is None:
            if left < 0:
                known = self.merged(self.token_bytes[right]) == [right]
            else:
                heads = self.edge(right, 0)
                known = self.fits(-1, right) and not any(
                    (m := self.merge_of.get((x, y))) and m[0] < gone and m[0] <= taken
                    for x, gone in self.edge(left, 1)
                    for y, taken in heads
                )
            if len(self.compatible) >= KEEP_PAIRS:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def backtracked(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        whole = self.ordinary.get(piece, -1)
        if whole >= 0 and self.fits(-1, whole):
            return [whole]
        from_here: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            from_here[end + 1 - length].append((length, token))
        dead = bytearray(n + 1)
        taken: list[int] = []
        tried: list[int] = []
        at, k = 0, len(from_here[0]) - 1 if n else -1
        while at < n:
            options, before = from_here[at], taken[-1] if taken else -1
            while k >= 0:
                length, token = options[k]
                if not dead[at + length] and self.fits(before, token):
                    break
                k -= 1
            if k >= 0:
                taken.append(token)
                tried.append(k)
                at += length
                k = len(from_here[at]) - 1 if at < n else -1
            elif taken:
                dead[at] = 1
                at -= len(self.token_bytes[taken.pop()])
                k = tried.pop() - 1
            else:
                raise ValueError("the vocabulary lacks a byte")
        return taken

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; malformed bytes become U+FFFD."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        data = self.flat[source].tobytes()
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode("utf-8")
        return data


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def latin_findall() -> Callable[[str], list[str]]:
    """The pattern for texts below U+0370, for the faster ``re``, with the
    classes spelt out."""
    below = "".join(map(chr, range(0x370)))
    letter, number, space = (
        "".join(map(re.escape, regex.findall(c, below))) for c in (r"\p{L}", r"\p{N}", r"\s")
    )
    spelt = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    spelt = spelt.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(spelt.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")).findall


class Pieces:
    """Whole texts to packed ids, one distinct piece at a time."""

    def __init__(
        self,
        special: dict[str, int],
        encode: Callable[[list[str]], list[list[int]]],
    ) -> None:
        self.latin = latin_findall()
        self.findall = regex.compile(PATTERN).findall
        self.special = {
            t: np.array([i], "<u4").tobytes() for t, i in special.items() if t
        }
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = (
            regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
            if longest_first
            else None
        )
        self.unlike = unlike_characters()
        self.beyond = re.compile("[\u0370-\U0010ffff]")
        self.encode = encode
        self.kept: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.special):
            return self._ordinary(text)
        return b"".join(
            self.special[part] if k % 2 else self._ordinary(part)
            for k, part in enumerate(self.cut.split(text))
        )

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.latin(text)
        if self.unlike.isdisjoint(text):
            return self.findall(text)
        same = "".join(["\ue000" if c in self.unlike else c for c in text])
        ends = [0, *itertools.accumulate(map(len, self.findall(same)))]
        return [text[a:b] for a, b in itertools.pairwise(ends)]

    def _ordinary(self, text: str) -> bytes:
        pieces = self._cut(text)
        kept = self.kept
        try:
            return b"".join([kept[p] for p in pieces])
        except KeyError:
            pass
        new = [p for p in dict.fromkeys(pieces) if p not in kept]
        found = {
            p: array("I", ids).tobytes()
            for p, ids in zip(new, self.encode(new), strict=True)
        }
        out = b"".join([kept[p] if p in kept else found[p] for p in pieces])
        if len(kept) + len(found) > KEEP_PIECES:
            kept.clear()
        for p, b in found.items():
            if len(p) <= KEEP_BYTES:
                kept[p] = b
        return out


@functools.lru_cache(maxsize=2)
def backtracking_pieces(path: str) -> Pieces:
    v = vocabulary(path)
    return Pieces(v.special, lambda words: [v.backtracked(w.encode()) for w in words])


def encode_column(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every text: ``(id, ids binary)``, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = backtracking_pieces(path).packed
        for batch in batches:
            ids = [packed(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, ids binary")


def decode_column(
    df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Texts of packed ids: ``(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [
                v.decode(np.frombuffer(b or b"", "<u4")).decode()
                for b in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, text string")


def round_trip_digests(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every text, keeping counts and SHA-256 digests only.

    The ids stay inside the worker, so that they need not travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, v = backtracking_pieces(path).packed, vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = packed(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded = v.decode(np.frombuffer(ids, "<u4"))
                text_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
