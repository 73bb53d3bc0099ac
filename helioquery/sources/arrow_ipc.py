"""Arrow IPC files and streams as sources and sinks.

Reading is a Python data source: one partition per run of record batches, batches handed to Spark as they are, columns
that are not asked for never decoded. Writing is one file per partition, from the executors.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship
from .arrow_types import readable_batch, readable_schema

_BATCHES = 16


def _open(path: str):
    store, name = pafs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _files(path: str) -> list[str]:
    """The file, or the data files of a directory."""
    store, name = pafs.FileSystem.from_uri(path)
    if store.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    listed = store.get_file_info(pafs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in listed if f.type == pafs.FileType.File and f.base_name[0] not in "._")


class _Run(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        runs = []
        for f in _files(self.path):
            with _open(f) as source:
                n = ipc.open_file(source).num_record_batches
            runs += [_Run(f, i, min(i + _BATCHES, n)) for i in range(0, n, _BATCHES)]
        return runs or [_Run("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        with _open(partition.path) as source:
            schema = ipc.open_file(source).schema
            fields = [schema.get_field_index(c) for c in self.columns]
            source.seek(0)
            data = ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=fields))
            for i in range(partition.first, partition.last):
                yield readable_batch(data.get_batch(i).select(self.columns))


class ArrowFile(DataSource):
    """``spark.read.format("arrow_ipc").option("columns", "a,b").load(path)``."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _arrow_schema(self) -> pa.Schema:
        with _open(_files(self.options["path"])[0]) as source:
            whole = ipc.open_file(source).schema
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or whole.names
        return readable_schema(pa.schema([whole.field(c) for c in wanted]))

    def schema(self):
        return from_arrow_schema(self._arrow_schema())

    def reader(self, schema: StructType):
        return _Reader(self.options["path"], schema.names)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArrowFile)
    found = spark.read.format("arrow_ipc")
    if columns:
        found = found.option("columns", ",".join(columns))
    return found.load(path)


def write(df: DataFrame, path: str, stream: bool = False, compression: str | None = None) -> list[str]:
    """One Arrow IPC file (or stream) per partition in the directory ``path``, which executors can reach; their names.

    A repeated task replaces its file whole.
    """
    ship(df.sparkSession)
    store, top = pafs.FileSystem.from_uri(path)
    store.create_dir(top)
    names = df.schema.names

    def written(batches):
        store, top = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.{'arrows' if stream else 'arrow'}"
        own, writer = f"{top}/_{name}.{task.taskAttemptId()}", None
        options = ipc.IpcWriteOptions(compression=compression)
        with store.open_output_stream(own) as out:
            for batch in batches:
                if writer is None:
                    writer = (ipc.new_stream if stream else ipc.new_file)(out, batch.schema, options=options)
                writer.write_batch(batch)
            if writer is not None:
                writer.close()
        if writer is None:
            store.delete_file(own)
            return
        store.move(own, f"{top}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name]})

    found = [r["file"] for r in df.select(*names).mapInArrow(written, "file string").collect()]  # as many rows as partitions
    return sorted(found)


def read_stream(path: str) -> pa.Table:
    """A whole IPC stream file, on the driver."""
    with _open(path) as source:
        return ipc.open_stream(source).read_all()
