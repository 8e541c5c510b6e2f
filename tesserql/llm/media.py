"""Media columns: progressive JPEG files and full-resolution RGB tensors.

:func:`decode_column` turns any column of progressive JPEG files into RGB
tensors.  :func:`store_texts` keeps texts as such files without loss: a text's
UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, become the
coefficients of an image (see :mod:`tesserql.llm.jpeg`); the unit of the format
that holds a byte is one coefficient, and a comment segment holds the number
of bytes before filling.  :func:`read_payloads` reads them back.

Null texts count as empty and make a payload of 64 bytes; null media give null
tensors and no payload.  Equal texts give equal files.  Repeated rows are
independent, an empty table gives an empty result, and other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserql.llm import jpeg
from tesserql.llm.common import map_arrow

BLOCK = 64
#: Rows of one batch of decoded tensors, which are larger than their files.
TENSOR_ROWS = 50


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled up, and their number before that."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0"), len(data)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media)``: every text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                files = []
                for t in part.column(1):
                    payload, n = payload_of(t.as_py())
                    files.append(jpeg.encode_payload(payload, b"%d" % n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, media binary")


def decode_column(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``(doc_id, height, width, rgb)``; rgb holds rows of pixels of 3 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TENSOR_ROWS):
                part = batch.slice(at, TENSOR_ROWS)
                tensors = [None if m is None else jpeg.decode(m) for m in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([None if t is None else t.shape[0] for t in tensors], pa.int32()),
                        pa.array([None if t is None else t.shape[1] for t in tensors], pa.int32()),
                        pa.array([None if t is None else t.tobytes() for t in tensors], pa.binary()),
                    ],
                    ["doc_id", "height", "width", "rgb"],
                )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, height int, width int, rgb binary")


def feature(tensor: np.ndarray) -> str:
    """Size, and mean and spread of each channel to one decimal."""
    flat = tensor.reshape(-1, 3).astype(np.int64)
    n, total, square = len(flat), flat.sum(axis=0), (flat * flat).sum(axis=0)
    spread = np.sqrt(square / n - (total / n) ** 2)
    stats = " ".join(f"{m:.1f}/{s:.1f}" for m, s in zip(total / n, spread))
    return f"{tensor.shape[1]}x{tensor.shape[0]} {stats}"


def read_payloads(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests of what the stored files hold, and features of their tensors.

    ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature)``; rows without media are left out.
    """
    longs = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for m in batch.column(1):
                media = m.as_py()
                image = jpeg.Decoder(media)
                n = int(image.comment)
                payload = image.payload(max(BLOCK, -(-n // BLOCK) * BLOCK))
                row = (
                    n,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-BLOCK:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature(image.rgb()),
                )
                for name, value in zip(names, row):
                    out[name].append(value)
            columns = [pa.array(out[n], pa.int64() if n in longs else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).where("media is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = ", ".join(f"{n} {'long' if n in longs else 'string'}" for n in names)
    return map_arrow(rows, run, f"doc_id {kind}, {types}")
