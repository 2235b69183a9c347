"""An archive read over a store, without Spark: only footers and the chunks of
the columns and row groups that are asked for are fetched."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.json as pj
import pyarrow.parquet as pq
from pyarrow import fs as pafs

from .api import Record
from .sources.archive import _COLUMN, STREAMS, VERSION, ArchiveError, streams_of


class Counted(io.RawIOBase):
    """A file of a store that counts the bytes it fetches."""

    def __init__(self, file: pa.NativeFile, tally: list[int]):
        self.file, self.tally = file, tally

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(None if n is None or n < 0 else n)
        self.tally[0] += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def readall(self) -> bytes:
        return self.read()


class RemoteArchive:
    """``RemoteArchive.open(uri)``; bytes_fetched grows with what is read."""

    def __init__(self, uri: str, store: pafs.FileSystem, base: str):
        self.uri, self._store, self._tally = uri, store, [0]
        listed = store.get_file_info(pafs.FileSelector(f"{base}/reads"))
        parts = [f for f in listed if f.path.endswith(".parquet")]
        self.size = sum(f.size for f in parts)
        files = [self._file(f.path) for f in parts]
        # the file a row group is in, and its number there, in the order of reads
        groups = [(f.metadata.row_group(k).column(0).statistics.min, f, k) for f in files for k in range(f.num_row_groups)]
        self._groups = [(f, k) for _, f, k in sorted(groups, key=lambda g: g[0])]

    @classmethod
    def open(cls, uri: str) -> RemoteArchive:
        try:
            store, base = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
            told = [f for f in store.get_file_info(pafs.FileSelector(f"{base}/manifest")) if f.path.endswith(".json")]
        except (OSError, pa.ArrowInvalid) as e:
            raise ArchiveError(f"{uri}: {e}") from e
        if not told:
            raise ArchiveError(f"{uri} has no manifest")
        with store.open_input_stream(told[0].path) as stream:
            version = pj.read_json(stream).to_pylist()[0].get("version")
        if version != VERSION:
            raise ArchiveError(f"{uri} is of version {version}")
        return cls(uri, store, base)

    def _file(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(pa.PythonFile(Counted(self._store.open_input_file(path), self._tally), mode="r"), pre_buffer=False)

    @property
    def bytes_fetched(self) -> int:
        return self._tally[0]

    @property
    def row_groups(self) -> int:
        return len(self._groups)

    def __len__(self) -> int:
        return sum(f.metadata.row_group(k).num_rows for f, k in self._groups)

    def _column(self, stream: str, groups: Iterable[int] | None) -> list[str]:
        chosen = self._groups if groups is None else [self._groups[g] for g in groups]
        return [v for f, k in chosen for v in f.read_row_group(k, columns=[_COLUMN[stream]]).column(0).to_pylist()]

    def names(self, groups: Iterable[int] | None = None) -> list[str]:
        return self._column("names", groups)

    def sequences(self, groups: Iterable[int] | None = None) -> list[str]:
        return self._column("sequence", groups)

    def qualities(self, groups: Iterable[int] | None = None) -> list[str]:
        return self._column("quality", groups)

    def records(self, streams=None, groups: Iterable[int] | None = None) -> Iterator[Record]:
        """Records in order, a row group fetched at a time; streams that are not
        chosen are empty."""
        chosen = streams_of(streams)
        for f, k in self._groups if groups is None else [self._groups[g] for g in groups]:
            n = f.metadata.row_group(k).num_rows
            held = f.read_row_group(k, columns=[_COLUMN[s] for s in chosen]) if chosen else None
            part = {s: held.column(_COLUMN[s]).to_pylist() if s in chosen else [""] * n for s in STREAMS}
            yield from map(Record, *(part[s] for s in STREAMS))


def stream(uri: str, streams=None) -> Iterator[Record]:
    """The records of an archive, forward."""
    return RemoteArchive.open(uri).records(streams)


def download(uri: str, target: str, fasta: bool = False) -> int:
    """Writes an archive's reads as FASTQ or FASTA text to a local file, and
    returns how many. The file comes to its name when it is whole."""
    aside, n = f"{target}.{uuid.uuid4().hex}.tmp", 0
    try:
        with open(aside, "w", encoding="latin-1") as out:
            for r in stream(uri, ("names", "sequence") if fasta else None):
                out.write(f">{r.name}\n{r.sequence}\n" if fasta else f"@{r.name}\n{r.sequence}\n+\n{r.quality}\n")
                n += 1
        os.replace(aside, target)
    finally:
        if os.path.exists(aside):
            os.remove(aside)
    return n
