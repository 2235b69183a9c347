import os
import random

import pytest

from readloom import remote
from readloom.api import Record
from readloom.sources import archive

ROWS = [(i, f"read {i}", "".join(random.Random(i).choices("ACGT", k=200)), "".join(random.Random(-i).choices("#5:FI", k=200))) for i in range(3000)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("remote") / "a")
    frame = spark.createDataFrame(ROWS, "read_id long, name string, seq string, qual string")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    archive.write_archive(frame, path, group_reads=1000)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return path


def test_only_what_is_asked_for_is_fetched(path):
    whole = remote.RemoteArchive.open(f"file://{path}")
    assert list(whole.records()) == [Record(*r[1:]) for r in ROWS] and len(whole) == 3000
    some = remote.RemoteArchive.open(path)
    opened = some.bytes_fetched
    assert some.sequences() == [r[2] for r in ROWS]
    assert opened < 0.2 * whole.bytes_fetched and some.bytes_fetched < 0.6 * whole.bytes_fetched <= 1.2 * whole.size
    few = remote.RemoteArchive.open(path)
    assert few.names([0]) == [r[1] for r in ROWS[: len(few.names([0]))]] and few.bytes_fetched < some.bytes_fetched
    assert few.qualities() == [r[3] for r in ROWS] and few.row_groups >= 1
    assert {(r.name, r.quality) for r in few.records("seq", [0])} == {("", "")} and sum(1 for _ in few.records(())) == 3000


def test_forward_and_download(path, tmp_path):
    assert next(remote.stream(path, "names")) == Record("read 0", "", "")
    assert remote.download(path, str(tmp_path / "r.fastq")) == 3000
    assert (tmp_path / "r.fastq").read_text() == "".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in ROWS)
    assert remote.download(path, str(tmp_path / "r.fa"), fasta=True) == 3000
    for bad in (str(tmp_path / "nothing"), "file:///nowhere/at/all"):
        with pytest.raises(archive.ArchiveError):
            remote.RemoteArchive.open(bad)
        with pytest.raises(archive.ArchiveError):
            remote.download(bad, str(tmp_path / "x"))
    assert sorted(os.listdir(tmp_path)) == ["r.fa", "r.fastq"]
