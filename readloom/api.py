"""Reads of an archive as Python records, and folds over them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sources import archive


class Record(NamedTuple):
    """A read; streams that are not chosen are empty."""

    name: str
    sequence: str
    quality: str


def _rows(reads: DataFrame) -> DataFrame:
    have = set(reads.columns)
    return reads.selectExpr("read_id", *[f"coalesce({c}, '') AS {c}" if c in have else f"'' AS {c}" for c in ("name", "seq", "qual")])


class RecordReader:
    """The records of an archive in their order, pulled one by one. Partitions
    come to the driver one at a time, the next while one is read; an error is
    raised where the records end. May be closed early or used in ``with``."""

    def __init__(self, spark: SparkSession, path: str, streams=None, groups: list[int] | None = None):
        rows = _rows(archive.read_archive(spark, path, streams, groups))
        self._rows = rows.orderBy("read_id").toLocalIterator(prefetchPartitions=True)
        self.read = 0

    def __iter__(self) -> RecordReader:
        return self

    def __next__(self) -> Record:
        if self._rows is None:
            raise StopIteration
        row = next(self._rows)
        self.read += 1
        return Record(row.name, row.seq, row.qual)

    def close(self) -> None:
        self._rows = None

    def __enter__(self) -> RecordReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def each_record(spark: SparkSession, path: str, visit: Callable[[Record], None], streams=None) -> int:
    """Gives every record to visit, in order, on the driver; how many there were."""
    with RecordReader(spark, path, streams) as reader:
        for record in reader:
            visit(record)
        return reader.read


def for_each(reads: DataFrame, visit: Callable[[int, Record], None]) -> None:
    """Gives every record to visit where it lies, in no order."""

    def run(rows) -> None:
        for r in rows:
            visit(r.read_id, Record(r.name, r.seq, r.qual))

    _rows(reads).foreachPartition(run)


def fold(reads: DataFrame, init: Callable[[], Any], visit: Callable[[Any, int, Record], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """merge of the states that visit makes of the records of each partition,
    beginning with init(). Records are visited once, in no order, and partitions
    are merged in any, so that the result must not depend on either. States are
    merged by groups on the executors before the driver sees them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = init(), False
        for batch in batches:
            seen |= batch.num_rows > 0
            for i, name, seq, qual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = visit(state, i, Record(name, seq, qual))
        if seen:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]}, pa.schema([("state", pa.binary())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for one in batch.column(0).to_pylist():
                state = pickle.loads(one) if state is None else merge(state, pickle.loads(one))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]}, pa.schema([("state", pa.binary())]))

    states = _rows(reads).mapInArrow(part, "state binary").repartition(16).mapInArrow(join, "state binary")
    out = init()
    for row in states.collect():  # 16 at most
        out = merge(out, pickle.loads(row.state))
    return out


def _column(spark: SparkSession, path: str, stream: str, groups: list[int] | None) -> list[str]:
    return [r[1] for r in archive.read_archive(spark, path, stream, groups).orderBy("read_id").collect()]


def read_names(spark: SparkSession, path: str, groups: list[int] | None = None) -> list[str]:
    """The names of an archive, or of some of its row groups, on the driver."""
    return _column(spark, path, "names", groups)


def read_sequences(spark: SparkSession, path: str, groups: list[int] | None = None) -> list[str]:
    return _column(spark, path, "sequence", groups)


def read_qualities(spark: SparkSession, path: str, groups: list[int] | None = None) -> list[str]:
    return _column(spark, path, "quality", groups)


def read_block(spark: SparkSession, path: str, group: int) -> list[Record]:
    """The records of one row group, on the driver."""
    rows = _rows(archive.read_archive(spark, path, groups=[group])).orderBy("read_id").collect()
    return [Record(r.name, r.seq, r.qual) for r in rows]


def count_reads(spark: SparkSession, path: str) -> int:
    """From the footers alone."""
    return archive.info(spark, path).first().reads
