"""A store of immutable shards with size-tiered compaction.

A store is a folder below the shared one: Parquet shards in ``data`` and one
manifest for each version in ``manifest``.  An append writes its rows as small
shards, where they are, without a shuffle.  Compaction puts shards of similar
size (the same power of ``TIER``) into runs of about the target size, merges
every run of two or more by one task, batch by batch, and replaces them in the
next version.  A version counts once its manifest exists, and that is put in
place by one exclusive operation; a writer that comes second retries on the
newer version.  Shards carry the task attempt in their names, and only those
that tasks report are in a manifest, so lost or repeated tasks leave nothing
that is read.

Rows keep all their columns, nulls and repeats.  An append without rows adds a
version without shards; reading a store without shards gives an empty result of
the schema of the first append.  Frames of other schemas are refused.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tesserql.llm.common import map_arrow
from tesserql.llm.tokenfile import store

#: A merged shard's size in bytes, the base of tiers, and fewest shards of a run.
TARGET = 128 << 20
TIER = 4
FAN_IN = 2

STATS = "path string, rows long, bytes long"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def writer_of(folder: str, schema: pa.Schema, target: int) -> "Writer":
    return Writer(folder, schema, target)


class Writer:
    """Writes shards that roll over at the target size."""

    def __init__(self, folder: str, schema: pa.Schema, target: int) -> None:
        from pyspark import TaskContext

        self.fs, self.root = store(folder)
        self.schema, self.target = schema, target
        self.attempt = TaskContext.get().taskAttemptId()
        self.open: pq.ParquetWriter | None = None
        self.done: list[tuple[str, int, int]] = []

    def write(self, batch: pa.RecordBatch) -> None:
        if self.open is None:
            self.name = f"data/{uuid.uuid4().hex}-{self.attempt}.parquet"
            self.sink = self.fs.open_output_stream(posixpath.join(self.root, self.name))
            self.open = pq.ParquetWriter(self.sink, self.schema, compression="zstd")
            self.rows = 0
        self.open.write_batch(batch)
        self.rows += batch.num_rows
        if self.sink.tell() >= self.target:
            self.close()

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
            size = self.sink.tell()
            self.sink.close()
            self.done.append((self.name, self.rows, size))
            self.open = None

    def stats(self) -> pa.RecordBatch:
        self.close()
        columns = zip(*self.done) if self.done else ([], [], [])
        arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["path", "rows", "bytes"])


def runs(shards: list[dict], target: int) -> list[list[dict]]:
    """Runs to merge: shards of one tier, by size, up to about the target."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if s["bytes"] < target / 2:
            tier, size = 0, s["bytes"]
            while size >= TIER:
                size //= TIER
                tier += 1
            tiers.setdefault(tier, []).append(s)
    out = []
    for tier in sorted(tiers):
        run: list[dict] = []
        total = 0
        for s in sorted(tiers[tier], key=lambda s: (s["bytes"], s["path"])):
            if run and total + s["bytes"] > target:
                out.append(run)
                run, total = [], 0
            run.append(s)
            total += s["bytes"]
        out.append(run)
    return [r for r in out if len(r) >= FAN_IN]


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET) -> None:
        self.spark, self.folder, self.target = spark, folder.rstrip("/"), target
        self.fs, self.root = store(self.folder)
        for d in ("data", "manifest"):
            self.fs.create_dir(posixpath.join(self.root, d), recursive=True)

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(posixpath.join(self.root, "manifest")))
        return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            there = self.versions()
            if not there:
                return {"version": 0, "schema": None, "shards": []}
            version = there[-1]
        with self.fs.open_input_stream(self._path(version)) as f:
            return json.loads(f.read())

    def _path(self, version: int) -> str:
        return posixpath.join(self.root, "manifest", f"v{version:010d}.json")

    def commit(self, manifest: dict) -> int:
        """Put the manifest of a new version in place, or raise Conflict."""
        path = self._path(manifest["version"])
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(manifest).encode())
        if isinstance(self.fs, pafs.LocalFileSystem):
            try:
                os.link(own, path)  # fails if the version exists
            except FileExistsError:
                raise Conflict(path) from None
            finally:
                os.unlink(own)
        else:  # such stores refuse to rename onto an existing file
            if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                self.fs.delete_file(own)
                raise Conflict(path)
            self.fs.move(own, path)
        return manifest["version"]

    def _change(self, remove: set[str], add: list[dict], schema: str | None = None) -> int:
        while True:
            now = self.manifest()
            live = {s["path"] for s in now["shards"]}
            if not remove <= live:
                raise Conflict("a shard of this run has been replaced")
            kept = [s for s in now["shards"] if s["path"] not in remove]
            new = {
                "version": now["version"] + 1,
                "schema": now["schema"] or schema,
                "shards": kept + sorted(add, key=lambda s: s["path"]),
            }
            try:
                return self.commit(new)
            except Conflict:
                continue

    # ------------------------------------------------------------ writing

    def append(self, df: DataFrame) -> int:
        """Add a frame's rows as small shards; returns the new version."""
        schema = df.schema.json()
        held = self.manifest()["schema"]
        if held and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(held))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the store has another schema")
        folder, target = self.folder, self.target

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                out = out or writer_of(folder, batch.schema, target)
                out.write(batch)
            if out is not None:
                yield out.stats()

        rows = map_arrow(df, run, STATS).collect()  # one row for each new shard
        return self._change(set(), [r.asDict() for r in rows], schema)

    def compact(self) -> list[int]:
        """Merge runs until no tier has one; returns the new versions."""
        made = []
        while todo := runs(self.manifest()["shards"], self.target):
            folder, target = self.folder, self.target
            jobs = self.spark.createDataFrame(
                [(k, [s["path"] for s in run]) for k, run in enumerate(todo)], "k int, paths array<string>"
            ).repartition(len(todo), "k")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                fs, root = store(folder)
                for batch in batches:
                    for paths in batch.column(1).to_pylist():
                        out = None
                        for path in paths:
                            with fs.open_input_file(posixpath.join(root, path)) as f:
                                shard = pq.ParquetFile(f)
                                # a merged run is one shard, if a little above the target
                                out = out or writer_of(folder, shard.schema_arrow, 2 * target)
                                for rows in shard.iter_batches(batch_size=2000):
                                    out.write(rows)
                        yield out.stats()

            rows = map_arrow(jobs, run, STATS).collect()
            old = {s["path"] for r in todo for s in r}
            made.append(self._change(old, [r.asDict() for r in rows]))
        return made

    def vacuum(self) -> int:
        """Delete shards that the newest version lacks; older versions end."""
        live = {s["path"] for s in self.manifest()["shards"]}
        gone = [
            f.path
            for f in self.fs.get_file_info(pafs.FileSelector(posixpath.join(self.root, "data")))
            if f"data/{f.base_name}" not in live
        ]
        for path in gone:
            self.fs.delete_file(path)
        for v in self.versions()[:-1]:
            self.fs.delete_file(self._path(v))
        return len(gone)

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        schema = StructType.fromJson(json.loads(m["schema"]))
        paths = [f"{self.folder}/{s['path']}" for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
