import gzip
import io
import random
import zlib

import pytest

from readloom.sources import fastq


def lines(n):
    return [(f"r{i} x\t{i}", "ACGTN"[i % 5] * (i % 40), "@+I!#"[i % 5] * (i % 40)) for i in range(n)]


def text(rows, end="\n"):
    return "".join(f"@{a}{end}{b}{end}+{end}{c}{end}" for a, b, c in rows).encode()


def test_any_split_gives_every_record_once():
    rows = lines(120)
    data = text(rows)
    want = [tuple(x.encode() for x in r) for r in rows]
    for size in (7, 50, 333, 10_000):
        got = [r for a in range(0, len(data), size) for r in fastq.records(io.BytesIO(data), a, lambda a=a: min(len(data), a + size))]
        assert got == want
    assert list(fastq.records(io.BytesIO(text(rows, "\r\n")))) == want


def test_malformed_records_are_refused():
    for bad in (b"@a\nAC\n+\nI\n", b"@a\nAC\n-\nII\n", b"@a\nAC\n+", b"a\nAC\n+\nII\n"):
        with pytest.raises(fastq.FastqError):
            list(fastq.records(io.BytesIO(bad)))


def test_source(spark, tmp_path):
    rows = lines(300)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_bytes(text(rows))
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(text(rows[:50])) + gzip.compress(text(rows[50:90])))
    got = fastq.read_fastq(spark, f"file://{tmp_path}/in", 1000).collect()
    for end, n in (("a.fastq", 300), ("b.fastq.gz", 90)):
        part = sorted((r.read_id, r.name, r.seq, r.qual) for r in got if r.file.endswith(end))
        assert part == [(i, *rows[i]) for i in range(n)]


def bgzf(data, sizes):
    """data as BGZF blocks of the sizes in turn, with the empty one at the end."""
    out, at, i = [], 0, 0
    while True:
        part = data[at : at + sizes[i % len(sizes)]]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")
        out.append(head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
        if not part:
            return b"".join(out)
        at, i = at + len(part), i + 1


def test_bgzf_blocks_are_split_and_lose_nothing(spark, tmp_path):
    rows = lines(500)
    data = text(rows)
    ends = [len(text(rows[:n])) for n in (100, 101, 300)]  # blocks that end with a record
    sizes = [ends[0], ends[1] - ends[0], ends[2] - ends[1], 333, 7, 1000, 64]
    packed = bgzf(data, sizes)
    assert gzip.decompress(packed) == data and fastq.sniff(packed[:18]) == "bgzf" and fastq.sniff(gzip.compress(b"x")) == "gzip" and fastq.sniff(b"@r") == "plain"
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(packed)
    for split in (random.Random(1).randrange(100, 400), 2000, 1 << 20):
        reader = fastq.FastqReader(f"file://{path}", split)
        got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b.column(c).to_pylist() for c in ("name", "seq", "qual")))]
        assert got == rows
    frame = fastq.read_fastq(spark, f"file://{path}", 1500)
    assert sorted((r.read_id, r.name) for r in frame.collect()) == [(i, r[0]) for i, r in enumerate(rows)]
    path.write_bytes(packed[:-40])
    with pytest.raises(fastq.FastqError):
        list(list(reader.read(p)) for p in reader.partitions())
