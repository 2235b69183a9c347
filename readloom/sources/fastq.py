"""FASTQ as a Spark data source. Plain files are split by byte ranges and BGZF
files by their blocks; other gzip files are a partition each. A record belongs
to the range it begins in; in a BGZF file one that begins where a range of
blocks does belongs to the range before."""

from __future__ import annotations

import gzip
import io
import zlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import written

SCHEMA = "file string, split int, nth long, name string, seq string, qual string"
_ROWS = 8192
#: Splits whose places are looked up by broadcast; more are joined.
SPLITS = 1_000_000


_SCHEMA = pa.schema([("file", pa.string()), ("split", pa.int32()), ("nth", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


class FastqError(ValueError):
    """A record that is cut off or wrongly formed."""


class Range(InputPartition):
    def __init__(self, path: str, split: int, start: int, end: int, kind: str):
        self.path, self.split, self.start, self.end, self.kind = path, split, start, end, kind


def sniff(head: bytes) -> str:
    """plain, gzip or bgzf, by the first 18 bytes."""
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "bgzf" if _block_size(head) else "gzip"


def _block_size(head: bytes) -> int:
    """Bytes of the BGZF block that begins with head, 0 if none does."""
    if len(head) < 18 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:14] != b"BC":
        return 0
    return int.from_bytes(head[16:18], "little") + 1


def first_block(stream, start: int, size: int) -> int:
    """The place of the first BGZF block that begins at start or later: its
    header is followed by another one or by the end of the file."""
    stream.seek(start)
    window = stream.read(1 << 17)  # a block has at most 64 KiB
    at = window.find(b"\x1f\x8b\x08")
    while at >= 0:
        n = _block_size(window[at : at + 18])
        if n and (start + at + n == size or _block_size(window[at + n : at + n + 18])):
            return start + at
        at = window.find(b"\x1f\x8b\x08", at + 1)
    return size


class Blocks(io.RawIOBase):
    """The text of the BGZF blocks from one on; ``limit`` is the length of the
    text of those that begin before ``end``, known once they have been read."""

    def __init__(self, stream, first: int, end: int):
        self.stream, self.first, self.end = stream, first, end
        self.limit: int | None = None
        self._restart()

    def _restart(self) -> None:
        self.at, self.place, self.held = self.first, 0, b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = 0) -> int:
        offset += self.place if whence == 1 else 0
        if offset < self.place:
            self._restart()
        while self.place < offset and self._fill():
            step = min(len(self.held), offset - self.place)
            self.held, self.place = self.held[step:], self.place + step
        return self.place

    def _fill(self) -> bool:
        while not self.held:
            if self.at >= self.end and self.limit is None:
                self.limit = self.place
            self.stream.seek(self.at)
            head = self.stream.read(18)
            if not head:
                if self.limit is None:
                    self.limit = self.place
                return False
            size = _block_size(head)
            block = head + self.stream.read(size - 18) if size else b""
            if not size or len(block) < size:
                raise FastqError("a BGZF block is damaged or cut off")
            inflater = zlib.decompressobj(31)
            self.held = inflater.decompress(block) + inflater.flush()
            self.at += size
        return True

    def readinto(self, buffer) -> int:
        if not self._fill():
            return 0
        part = self.held[: len(buffer)]
        buffer[: len(part)] = part
        self.held, self.place = self.held[len(part) :], self.place + len(part)
        return len(part)


def _line(raw: bytes) -> bytes:
    raw = raw[:-1] if raw.endswith(b"\n") else raw
    return raw[:-1] if raw.endswith(b"\r") else raw


def _seek_record(stream, start: int) -> int:
    """The place of the first record that begins at start or later: its first
    line begins with @, its third with +, its second and fourth are as long."""
    if not start:
        return 0
    stream.seek(start - 1)
    stream.readline()
    window: list[tuple[int, bytes]] = []
    while True:
        while len(window) < 4:
            at, raw = stream.tell(), stream.readline()
            if not raw:
                return at
            window.append((at, _line(raw)))
        (at, a), (_, b), (_, c), (_, d) = window
        if a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d):
            return at
        window.pop(0)


def records(stream, start: int = 0, end=lambda: None):
    """(name, seq, qual) as bytes of the records that begin in the range. end
    is a function, as it may become known while the stream is read."""
    at = _seek_record(stream, start)
    if start:
        stream.seek(at)
    while (stop := end()) is None or at < stop:
        lines = [stream.readline() for _ in range(4)]
        if not lines[0]:
            return
        at += sum(map(len, lines))
        name, seq, plus, qual = map(_line, lines)
        if name[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
            raise FastqError(f"malformed or truncated record {name[:60]!r}")
        yield name[1:], seq, qual


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, counts: bool = False):
        self.path, self.split_bytes, self.counts = path, split_bytes, counts

    def partitions(self):
        store, at = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
        hidden = lambda f: any(p[:1] in "._" for p in f.path.removeprefix(at).strip("/").split("/") if p)
        files = sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f)), key=lambda f: f.path)

        def kind_of(f) -> str:
            with store.open_input_stream(f.path, compression=None) as s:
                return sniff(s.read(18))

        # what fits in one split is looked at by the task that reads it
        large = [f for f in files if f.size > self.split_bytes]
        with ThreadPoolExecutor(16) as pool:
            kinds = dict(zip((f.path for f in large), pool.map(kind_of, large), strict=True))
        out = []
        for f in files:
            kind = kinds.get(f.path, "")
            cuts = [0] if kind in ("", "gzip") else range(0, f.size, self.split_bytes)
            parts = [Range(f.path, k, a, f.size if kind in ("", "gzip") else min(f.size, a + self.split_bytes), kind) for k, a in enumerate(cuts)]
            out += parts if len(parts) > 1 or not self.counts else []
        return out or [Range("", 0, 0, 0, "none")]

    def _open(self, part: Range):
        """(stream, start, end) for records."""
        store, _ = pafs.FileSystem.from_uri(self.path)
        raw = store.open_input_file(part.path)
        if not part.kind:
            part.kind = sniff(raw.read(18))
            raw.seek(0)
        if part.kind == "gzip":
            return gzip.open(raw), 0, lambda: None
        if part.kind == "plain":
            return io.BufferedReader(raw, 1 << 20), part.start, lambda: part.end
        first = first_block(raw, part.start, raw.size()) if part.start else 0
        blocks = Blocks(raw, first, part.end)
        if first >= part.end:  # no block begins in the range
            return io.BytesIO(), 0, lambda: 0
        return io.BufferedReader(blocks, 1 << 16), min(part.start, 1), lambda: None if blocks.limit is None else blocks.limit + 1

    def read(self, part: Range):
        if part.kind == "none":
            return
        stream, start, end = self._open(part)
        rows, nth = [], 0
        if self.counts:
            with stream:
                n = sum(1 for _ in records(stream, start, end))
            yield pa.RecordBatch.from_pydict({"file": [part.path], "split": pa.array([part.split], pa.int32()), "nth": [n], "name": [None], "seq": [None], "qual": [None]}, _SCHEMA)
            return
        with stream:
            for name, seq, qual in records(stream, start, end):
                rows.append((name.decode("latin-1"), seq.decode("latin-1"), qual.decode("latin-1")))
                if len(rows) == _ROWS:
                    yield self._batch(part, nth, rows)
                    nth, rows = nth + len(rows), []
        if rows:
            yield self._batch(part, nth, rows)

    @staticmethod
    def _batch(part: Range, nth: int, rows: list) -> pa.RecordBatch:
        n = len(rows)
        cols = [pa.array([part.path] * n), pa.array([part.split] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64()), *[pa.array(c) for c in zip(*rows, strict=True)]]
        return pa.RecordBatch.from_arrays(cols, names=["file", "split", "nth", "name", "seq", "qual"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return FastqReader(options["path"], int(options.get("splitbytes", 64 << 20)), options.get("counts") == "True")


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(file, read_id, name, seq, qual) of a file or folder, given as a URI.
    read_id is a record's place in its file, found from the records of the
    splits before; it does not depend on how the file is split. Files of one
    split are read once; of others the records of each split are counted first."""
    spark.dataSource.register(FastqSource)
    load = lambda counts: spark.read.format("fastq").option("splitBytes", split_bytes).option("counts", str(counts)).load(path)
    sizes = load(True).select("file", "split", F.col("nth").alias("n"))  # a row per split of a file that has several
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(sizes.select("file", "split", F.coalesce(before, F.lit(0)).alias("base")))
    base = F.coalesce("base", F.lit(0))
    rows = load(False)
    joined = rows.join(F.broadcast(bases) if bases.count() <= SPLITS else bases, ["file", "split"], "left")
    return joined.select("file", (base + F.col("nth")).alias("read_id"), "name", "seq", "qual")


def fastq_text(reads: DataFrame) -> DataFrame:
    """A column ``value`` with the four lines of each read, for ``write.text``."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))
