"""Files in and out: contents, binary manifests, chunk dumps, experiment descriptions."""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from corestrata.functions import fixed
from corestrata.functions.profiles import STABLE, Malformed, Profile, Unsupported
from corestrata.sources import manifests


def read_contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below path, by Spark's own reader, whatever the store."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("content").alias("bytes"))


_RECORDS = "path string, status string, flags int, manifest_id string, suite string, profile_id string, idx long, off long, len long, id string"


def _parse(source):
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in _RECORDS.split(", ")]
    for batch in source:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                m = manifests.read(data)
                head = [path, "integrity" if m.flags else "valid", m.flags, m.manifest_id.hex(), m.suite, m.profile_id]
                rows = [(*head, i, at, n, c.hex()) for i, ((c, n), at) in enumerate(zip(m.records, m.offsets, strict=True))] or [(*head, None, None, None, None)]
            except (Malformed, Unsupported) as e:
                rows = [(path, type(e).__name__.lower(), 0, None, None, None, None, None, None, None)]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), types, strict=True)], names=names)


def read_manifests(spark: SparkSession, path: str, pattern: str = "*.csm") -> DataFrame:
    """A row for each record of each manifest; a file that can't be read gives one row with its status. In batches of blocks."""
    return read_contents(spark, path, pattern).mapInArrow(_parse, _RECORDS)


def pull(records: DataFrame, most: int = 256) -> Iterator[list]:
    """Rows of a table in their order, up to most at a time, as they are asked for: one partition is fetched at once, and none before its turn."""
    rows = records.toLocalIterator(prefetchPartitions=False)
    while part := list(itertools.islice(rows, most)):
        yield part


def build_manifests(content: DataFrame, profile: Profile = STABLE, profile_id: str = fixed.STABLE_PROFILE, suite: str = fixed.BLAKE3_SUITE, index: bool = False) -> DataFrame:
    """(keys..., manifest) of (keys..., bytes)."""
    keys = [c for c in content.columns if c != "bytes"]
    types, place = dict(content.dtypes), content.columns.index("bytes")

    def run(source):
        for batch in source:
            made = [manifests.write(manifests.create(x or b"", profile, profile_id, suite), index) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != place] + [pa.array(made, pa.binary())], names=[*keys, "manifest"])

    return content.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "manifest binary"]))


def verify_manifests(pairs: DataFrame) -> DataFrame:
    """(keys..., manifest, bytes) -> (keys..., outcome, flags, failures); null bytes: the manifest alone."""
    keys = [c for c in pairs.columns if c not in ("manifest", "bytes")]
    types = dict(pairs.dtypes)

    def run(source):
        for batch in source:
            found = [manifests.verify(m or b"", c) for m, c in zip(batch.column("manifest").to_pylist(), batch.column("bytes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array([o for o, _ in found]), pa.array([f for _, f in found], pa.int32()), pa.array([manifests.names(f) for _, f in found], pa.list_(pa.string()))], names=[*keys, "outcome", "flags", "failures"])

    return pairs.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "outcome string, flags int, failures array<string>"]))


def write_dump(chunks: DataFrame, path: str) -> None:
    """Offsets, lengths and ids, tab-separated."""
    chunks.select("off", "len", "id").write.option("sep", "\t").csv(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("off long, len long, id string").csv(path)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Corpora, experiments and plans, each one JSON object a file."""
    return spark.read.option("multiLine", "true").json(path)


def publish(path: str, data: bytes, overwrite: bool = False) -> None:
    """All of a file or nothing: written beside its place, flushed, then moved there; left out on any failure."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".pending-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _FileWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        names = []
        for row in iterator:
            publish(os.path.join(self.path, os.path.basename(row["name"])), bytes(row["content"]), overwrite=True)
            names.append(row["name"])
        return _Written(names)


class _One(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_One(n) for n in sorted(os.listdir(self.path)) if not n.startswith(".")]

    def read(self, partition):
        with open(os.path.join(self.path, partition.name), "rb") as f:
            yield partition.name, f.read()


class BinaryFiles(DataSource):
    """Rows (name, content) as files of a mounted folder that driver and executors share, each published whole. A repeated task writes the same files again."""

    @classmethod
    def name(cls):
        return "binary_files"

    def schema(self):
        return "name string, content binary"

    def reader(self, schema):
        return _FileReader(self.options)

    def writer(self, schema, overwrite):
        return _FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryFiles)
