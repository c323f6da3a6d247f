"""A push source: producers deliver segments of records to an inbox, a stream takes each of them once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of records in a file of a segment.
FILE_BYTES = 32 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Inbox:
    """A folder that producers write to and a stream empties.

    A segment is a number of files of records and a manifest that names them.
    The manifest comes last and by a rename, so a segment is there as a whole or
    not at all; its number is its place in the order of delivery.  One producer
    at a time delivers to an inbox.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.files, self.root = _opened(folder)
        self.files.create_dir(f"{self.root}/manifests", recursive=True)
        self.files.create_dir(f"{self.root}/records", recursive=True)

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are there, rising."""
        names = (f.base_name for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/manifests")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    @property
    def delivered(self) -> int:
        """Segments delivered so far, those already taken included."""
        numbers = self.numbers()
        return numbers[-1] + 1 if numbers else 0

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def seal(self, names: list[str]) -> int:
        """Deliver files that have been written to ``records`` as the next segment; gives its number."""
        number = self.delivered
        draft = f"{self.root}/manifests/{uuid.uuid4().hex}.draft"
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(sorted(names)).encode())
        self.files.move(draft, self._manifest(number))
        return number

    def names(self, number: int) -> list[str]:
        with self.files.open_input_stream(self._manifest(number)) as found:
            return json.loads(found.read())

    def discard(self, below: int) -> None:
        """Forget segments below ``below``; the newest manifest stays, as it carries the count."""
        numbers = self.numbers()
        for number in numbers:
            if number >= below:
                break
            for name in self.names(number):
                path = f"{self.root}/records/{name}"
                if self.files.get_file_info(path).type != fs.FileType.NotFound:
                    self.files.delete_file(path)
            if number != numbers[-1]:
                self.files.delete_file(self._manifest(number))

    def write(self, batches: Iterable[pa.RecordBatch]) -> Iterator[str]:
        """Write batches as files of records that no segment names yet; gives their names."""
        name, writer, size = "", None, 0
        for batch in batches:
            if writer is None:
                name = f"{uuid.uuid4().hex}.arrow"
                sink = self.files.open_output_stream(f"{self.root}/records/{name}")
                writer = pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
            size += batch.nbytes
            if size >= FILE_BYTES:
                writer.close()
                sink.close()
                yield name
                writer, size = None, 0
        if writer is not None:
            writer.close()
            sink.close()
            yield name

    def read(self, name: str) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_stream(f"{self.root}/records/{name}") as source, pa.ipc.open_stream(source) as batches:
            yield from batches


def deliver(df: DataFrame, folder: str) -> int:
    """Push a frame as one segment: its tasks write the files, the manifest names those of the tasks that counted.

    The driver sees one name for each file.  Files of attempts that failed are named by no manifest.
    """
    Inbox(folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in Inbox(folder).write(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return Inbox(folder).seal([r.name for r in df.mapInArrow(write, "name string").collect()])


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class InboxReader(DataSourceStreamReader):
    """An offset is a number of segments and stands in the query's log alone; the reader itself remembers nothing.

    So a query that starts again reads a batch that was cut short from the
    segments of its logged offsets, and goes on behind them.  Segments are
    deleted when the engine reports their batch done, not before.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.start = int(options.get("from", 0))
        self.keep = options.get("keep", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"segment": self.start}

    def latestOffset(self) -> dict:
        return {"segment": max(self.start, Inbox(self.folder).delivered)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        inbox = Inbox(self.folder)
        return [_File(name) for number in range(start["segment"], end["segment"]) for name in inbox.names(number)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in Inbox(self.folder).read(partition.name):
            yield batch.select(self.columns)

    def commit(self, end: dict) -> None:
        if not self.keep:
            Inbox(self.folder).discard(end["segment"])


class InboxSource(DataSource):
    """Stream source ``inbox``; options: path; schema; from, the first segment; keep=true to delete nothing."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> InboxReader:
        return InboxReader(self.options, schema.fieldNames())


def inbox_stream(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """Stream of the records that are delivered to ``folder``."""
    spark.dataSource.register(InboxSource)
    return spark.readStream.format("inbox").options(path=folder, schema=schema, **options).load()
