"""Change records as a streaming source: several readers, each with its own position in its log.

A log is a folder of segments, ``<reader>/<first>-<last>.parquet`` with the records of those indexes (column idx), or a
folder of that name with several files; names of partition columns (``mdt=<reader>/span=<first>-<last>``) may be in
front. A segment doesn't change once it is there. The position is one index for each reader. A batch goes from one position to another and is planned into ranges of at most
``range`` indexes. The plan lists the log once and gives each range the segments that it touches; a task reads these, and
of them the rows in it, and lists nothing. A task costs a start of Python, so with the option ``tasks`` a batch of more
ranges than that is dealt into as many tasks, each with its ranges one after another. ``commit`` notes the position in ``acknowledged``, from which a stream without
a checkpoint goes on.

    register(spark)
    spark.readStream.format("change_records").option("path", ...).option("schema", "idx long, ...").load()
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "change_records"
_SEGMENT = re.compile(r"(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?(\d+)-(\d+)(?:/[^/_.][^/]*)?\.parquet$")


@dataclass
class IndexRange(InputPartition):
    """Records of one reader with first <= idx <= last, and the paths of the segments that may hold them."""

    reader: str
    first: int
    last: int
    paths: tuple[str, ...] = ()


@dataclass
class Share(InputPartition):
    """The ranges that one task reads, one after another."""

    ranges: tuple[IndexRange, ...]


def touched(segments: list[tuple[int, int, str]], ranges: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    """For each of the ranges, which are in order and apart, the paths of the segments that it touches, in order."""
    firsts, lasts = [a for a, _ in ranges], [b for _, b in ranges]
    out: list[list[str]] = [[] for _ in ranges]
    for first, last, path in segments:
        for k in range(bisect_left(lasts, first), bisect_right(firsts, last)):
            out[k].append(path)
    return [tuple(own) for own in out]


class _Log:
    def __init__(self, path: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def segments(self) -> dict[str, list[tuple[int, int, str]]]:
        """(first, last, path) of each reader's segments, in order."""
        out: dict[str, list[tuple[int, int, str]]] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            m = _SEGMENT.search(info.path)
            if m and info.is_file:
                out.setdefault(m[1], []).append((int(m[2]), int(m[3]), info.path))
        return {reader: sorted(own) for reader, own in out.items()}


class ChangeRecordReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def _log(self) -> _Log:
        return _Log(self.options["path"])

    def initialOffset(self) -> dict:
        if not self.options.get("acknowledged"):
            return {}
        log = _Log(self.options["acknowledged"])
        if log.store.get_file_info(log.root).type == fs.FileType.NotFound:
            return {}
        with log.store.open_input_stream(log.root) as f:
            return json.loads(f.read().decode())

    def latestOffset(self) -> dict:
        return {reader: own[-1][1] for reader, own in sorted(self._log().segments().items())}

    def partitions(self, start: dict, end: dict) -> list[IndexRange] | list[Share]:
        size, out, segments = int(self.options.get("range", "100000")), [], self._log().segments()
        for reader, last in end.items():
            first = start.get(reader, -1) + 1
            known = segments.get(reader, [])
            first = max(first, known[0][0]) if known else first  # a log may begin after its cleared part
            ranges = [(at, min(at + size - 1, last)) for at in range(first, last + 1, size)]
            out += [IndexRange(reader, a, b, paths) for (a, b), paths in zip(ranges, touched(known, ranges), strict=True)]
        tasks = int(self.options.get("tasks", "0"))
        if not tasks or len(out) <= tasks:
            return out
        cuts = [i * len(out) // tasks for i in range(tasks + 1)]
        return [Share(tuple(out[a:b])) for a, b in pairwise(cuts)]

    def read(self, partition: IndexRange | Share) -> Iterator[pa.RecordBatch]:
        for own in partition.ranges if isinstance(partition, Share) else (partition,):
            yield from self._rows(own)

    def _rows(self, partition: IndexRange) -> Iterator[pa.RecordBatch]:
        log = self._log()
        for path in partition.paths:
            with log.store.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches():
                    table = pa.Table.from_batches([batch])
                    table = table.filter(pc.and_(pc.greater_equal(table["idx"], partition.first), pc.less_equal(table["idx"], partition.last)))
                    if "mdt" in self.schema.names and "mdt" not in table.column_names:
                        table = table.append_column("mdt", pa.array([partition.reader] * table.num_rows, pa.string()))
                    yield from table.select(self.schema.names).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        if self.options.get("acknowledged"):
            log = _Log(self.options["acknowledged"])
            with log.store.open_output_stream(log.root) as f:
                f.write(json.dumps(end).encode())


class ChangeRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> ChangeRecordReader:
        return ChangeRecordReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeRecordSource)
