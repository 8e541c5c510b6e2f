"""Token ids as flat binary files that are read through a memory map.

A data set is a folder below the shared one.  Each partition writes

* ``NNNNNN.ids``: the ids of its documents in a row, as little-endian unsigned
  integers of 16 bits where the vocabulary allows it and of 32 otherwise;
* ``NNNNNN.idx``: 64-bit little-endian integers, the document ids followed by
  one more offset than documents (in ids, from the partition's beginning).

Partitions hold ascending ranges of document ids, so the bases of partitions
are prefix sums over one count for each partition; they stand in
``manifest.json``, which is put in place by a rename after all partitions.
A task writes under a name of its own attempt and renames at its end, so a
repeated or lost task leaves either whole files or none.

Null texts count as empty; every document gets the end id.  Null document ids
come first and are kept as null.  Rows with equal document ids stay separate
and are ordered by their texts.  An empty table makes an empty data set.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import json
import os
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.llm.bpe import Pieces, byte_letters, vocabulary
from tesserql.llm.common import fresh_dir, map_arrow

#: Stands for a null document id in the index.
NULL_ID = -(1 << 63)


@functools.lru_cache(maxsize=2)
def library_pieces(path: str) -> Pieces:
    """Pieces that the tokenizers library encodes.

    What the pre-tokeniser cuts apart never merges, so a text's ids are those
    of its pieces; the library's model gets each distinct piece once.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
    tokenize = tokenizer.model.tokenize

    def encode(words: list[str]) -> list[list[int]]:
        return [
            [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]
            for w in words
        ]

    return Pieces(special, encode)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if ":" not in uri.split("/", 1)[0]:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(fs: pafs.FileSystem, path: str, attempt: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then rename."""
    own = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(own, path)


def mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: a memory map where the file is local, else a read."""
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> str:
    """Encode and write all texts; returns the folder.

    One shuffle, of the raw rows by ranges of ids; ids are written where they
    are made.
    """
    spark = df.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    size = max(vocabulary(tokenizer_path).size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        fs, root = store(folder)
        packed = library_pieces(tokenizer_path).packed
        doc_ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def ids() -> Iterator[bytes]:
            for batch in batches:
                doc_ids.append(
                    batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                )
                n = []
                for t in batch.column(1):
                    own = np.frombuffer(packed(t.as_py() or ""), "<u4")
                    n.append(len(own) + 1)
                    yield np.append(own, end_id).astype(dtype).tobytes()
                lengths.append(np.array(n, np.int64))

        name = posixpath.join(root, f"{part:06d}")
        put(fs, name + ".ids", attempt, ids())
        each = np.concatenate([*lengths, np.empty(0, np.int64)])
        index = np.concatenate([*doc_ids, np.zeros(1, np.int64), np.cumsum(each)])
        put(fs, name + ".idx", attempt, iter([index.astype("<i8").tobytes()]))
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "docs": [len(each)], "ids": [int(each.sum())]},
            schema=pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]),
        )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    counts = map_arrow(ranged, run, "part long, docs long, ids long")
    # one row for each partition that holds rows
    parts = sorted(counts.where("docs > 0").collect())
    docs = np.cumsum([0, *(p.docs for p in parts)]).tolist()
    ids = np.cumsum([0, *(p.ids for p in parts)]).tolist()
    manifest = {
        "dtype": dtype,
        "end_id": end_id,
        "docs": docs[-1],
        "ids": ids[-1],
        "parts": [
            {"part": p.part, "docs": p.docs, "first_doc": d, "first_id": i}
            for p, d, i in zip(parts, docs, ids)
        ],
    }
    put(fs, posixpath.join(root, "manifest.json"), "driver", iter([json.dumps(manifest).encode()]))
    return folder


def read_manifest(folder: str) -> dict:
    fs, root = store(folder)
    with fs.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        return json.loads(f.read())


def parts_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    parts = manifest["parts"]
    rows = [(p["part"], p["docs"], p["first_id"]) for p in parts]
    frame = spark.createDataFrame(rows, "part long, docs long, first_id long")
    return frame.repartition(max(1, len(rows)), "part") if len(rows) > 1 else frame


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a data set: ``(doc_id, start, n_tokens, ids_crc32[, ids])``."""
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]
    kind = pa.list_(pa.int32())
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, *([("ids", kind)] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            for p in batch.to_pylist():
                name, n = posixpath.join(root, f"{p['part']:06d}"), p["docs"]
                index = mapped(fs, name + ".idx", "<i8")
                ids = mapped(fs, name + ".ids", dtype)
                for lo in range(0, n, 1000):
                    hi = min(n, lo + 1000)
                    at = index[n + lo : n + hi + 1]
                    each = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in each]
                    doc = np.asarray(index[lo:hi])
                    columns = [
                        pa.array(doc, pa.int64(), mask=doc == NULL_ID),
                        pa.array(at[:-1] + p["first_id"], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype("<i4") for x in each], kind))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(parts_frame(spark, manifest), run, names)
