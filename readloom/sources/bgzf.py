"""FASTQ text as BGZF: gzip in blocks of at most 64 KiB, so that readers can
split it. A task writes one file under a name of its own attempt; files of
attempts that did not end well are removed when all are done."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .archive import ArchiveError, _hadoop, _lines

#: Text of a block; compressed it stays below 64 KiB whatever it is.
BLOCK = 65_280
#: The empty block that ends a file, a fixed value of the format.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(text: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    if len(body) > 65_536 - 26:
        squeeze = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = squeeze.compress(text) + squeeze.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def write_bgzf(reads: DataFrame, path: str, fasta: bool = False, overwrite: bool = False) -> int:
    """Writes files part-00000-*.gz of reads in the order of read_id, and returns
    how many. path is a URI or a path that all executors know."""
    spark, uri = reads.sparkSession, path if "://" in path else "file://" + path
    store, target = _hadoop(spark, uri)
    if store.exists(target):
        if not overwrite:
            raise ArchiveError(f"{path} already exists")
        store.delete(target, True)
    ending = "fasta.gz" if fasta else "fastq.gz"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        name, held, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{ending}", bytearray(), None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += text.encode("latin-1") + b"\n"
                while len(held) >= BLOCK:
                    out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(block(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if held or out:
            out = out or files.open_output_stream(f"{base}/{name}", compression=None)
            out.write((block(bytes(held)) if held else b"") + END)
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = reads.repartitionByRange("read_id").sortWithinPartitions("read_id").select(_lines(fasta))
    kept = {r["name"] for r in rows.mapInArrow(run, "name string").collect()}  # a row per file
    if store.exists(target):
        for status in store.listStatus(target):
            if status.getPath().getName() not in kept:
                store.delete(status.getPath(), False)
    return len(kept)
