import gzip
import json
import os

import pyarrow.parquet as pq
import pytest

from readloom import api
from readloom.functions.reads import content_stats
from readloom.sources import archive, bgzf, fastq, sam
from readloom.streaming.stats import running_stats, stream_reads

SCHEMA = "read_id long, name string, seq string, qual string"
ROWS = [(i, f"r{i // 2} x", "ACGTN"[i % 5] * (i % 31), "I#!+@"[i % 5] * (i % 31)) for i in range(400)]


@pytest.fixture
def reads(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_round_trip_projection_and_digests(spark, reads, tmp_path):
    path = str(tmp_path / "a")
    archive.write_archive(reads, path, group_reads=100)
    assert rows(archive.read_archive(spark, path)) == ROWS
    assert rows(archive.read_archive(spark, path, ("sequence",))) == [(i, s) for i, _, s, _ in ROWS]
    assert rows(archive.read_archive(spark, path, ("names",), [1])) == [(i, n) for i, n, _, _ in ROWS[100:200]]
    assert archive.read_archive(spark, path, (), []).count() == 0
    groups = archive.index(spark, path).collect()
    assert sum(r.reads for r in groups) == 400 and all(r.last_read - r.first_read + 1 == r.reads and r.names_bytes > 0 for r in groups)
    assert {g for r in groups for g in range(r.first_group, r.last_group + 1)} == set(range(4))
    assert all(r.ok for r in archive.verify(spark, path, quick=True).collect()) and archive.verify_roundtrip(spark, path, reads)
    assert not archive.verify_roundtrip(spark, path, reads.where("read_id > 0"))
    assert archive.info(spark, path).first().reads == 400
    assert all(r.ok for r in archive.verify(spark, path).collect())
    plan = archive.read_archive(spark, path, ("sequence",), [1])._jdf.queryExecution().executedPlan().toString()
    assert "qual:string" not in plan and "PushedFilters: [IsNotNull(row_group), EqualTo(row_group,1)]" in plan
    with pytest.raises(archive.ArchiveError):
        archive.read_archive(spark, path, ("bases",))
    with pytest.raises(archive.ArchiveError, match="already exists"):
        archive.write_archive(reads, path)
    archive.write_archive(reads.where("read_id < 9"), path, binning="bin2", overwrite=True)
    assert archive.info(spark, path).first().reads == 9 and archive.verify_roundtrip(spark, path, reads.where("read_id < 9"))
    with pytest.raises(Exception, match="unlike"):
        archive.write_archive(reads.selectExpr("IF(read_id = 7, raise_error('unlike'), read_id) AS read_id", "name", "seq", "qual"), str(tmp_path / "b"))
    assert os.listdir(tmp_path) == ["a"]  # what failed leaves nothing


def test_damage_shows_and_the_rest_is_recovered(spark, reads, tmp_path):
    path = str(tmp_path / "a")
    archive.write_archive(reads, path)
    spark.createDataFrame([(*ROWS[7][:2], "T", "I")], SCHEMA).selectExpr("read_id", "0L row_group", "name", "seq", "qual").write.mode("append").parquet(f"{path}/reads")
    assert not any(r.ok for r in archive.verify(spark, path).collect()) and not all(r.ok for r in archive.verify(spark, path, quick=True).collect())


def test_row_groups_that_are_damaged_are_told_and_passed_over(spark, tmp_path):
    path, rows = str(tmp_path / "a"), [(i, f"read number {i}", f"{i:0200d}".translate(str.maketrans("0123456789", "ACGTACGTAC")), "I" * 200) for i in range(6000)]
    archive.write_archive(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert archive.recovery_report(spark, path) == {"reads": 6000, "recovered": 6000, "lost": 0, "skipped_groups": 0}
    table = spark.read.parquet(f"{path}/reads").orderBy("read_id").toArrow()
    for f in os.listdir(f"{path}/reads"):
        if f.endswith(".parquet") or f.endswith(".crc"):
            os.remove(f"{path}/reads/{f}")
    pq.write_table(table.slice(0, 5000), f"{path}/reads/part-0.parquet", row_group_size=1000, compression="zstd")
    pq.write_table(table.slice(5000), f"{path}/reads/part-1.parquet", compression="zstd")
    place = pq.ParquetFile(f"{path}/reads/part-0.parquet").metadata.row_group(2).column(2)
    with open(f"{path}/reads/part-0.parquet", "r+b") as f:
        f.seek(place.dictionary_page_offset or place.data_page_offset)
        f.write(b"\xff" * 40)
    assert archive.recovery_report(spark, path) == {"reads": 6000, "recovered": 5000, "lost": 1000, "skipped_groups": 1}
    assert {r.read_id for r in archive.recover(spark, path).collect()} == set(range(6000)) - set(range(2000, 3000))
    with open(f"{path}/reads/part-1.parquet", "r+b") as f:
        f.seek(-30, 2)
        f.truncate()
    told = archive.recovery_report(spark, path)
    assert (told["recovered"], told["lost"], told["skipped_groups"]) == (4000, 2000, 2)
    assert sum(r.error is not None for r in archive.verify_report(spark, path).collect()) == 2


def test_names_of_streams_labels_and_files():
    assert archive.streams_of(None) == archive.STREAMS and archive.streams_of("seq") == ("sequence",) and archive.streams_of([]) == ()
    assert archive.streams_of(["qual", "names", "quality"]) == ("names", "quality")
    for bad in ("s", ["names", 3], ["reads"]):
        with pytest.raises(archive.ArchiveError):
            archive.streams_of(bad)
    assert archive.member_labels(["R1", "I1"], 2) == ["R1", "I1"]
    assert archive.member_labels(["R1"], 2) == archive.member_labels(["", "a"], 2) == archive.member_labels(["x" * 16, "a"], 2) == archive.member_labels(["a", "a"], 2) == archive.member_labels(None, 1) == []
    names = {"a/x_R1.fastq.gz": "R1", "SRR1_2.fq": "2", "x_i2.fastq": "i2", "sample.fastq": None, "x_lane.fq.gz": None, "x_R.fastq": None, "_1.fastq": "1", "x_RR1.fastq": None}
    assert {n: archive.slot_label(n) for n in names} == names
    assert archive.split_name("p", 2) == "p_R2.fastq" and archive.split_name("p", 2, "auto", "I1", True) == "p_I1.fastq.gz"
    assert archive.split_name("p", 2, "num", "I1") == "p_2.fastq" and archive.split_name("p", 2, "R", "I1") == "p_R2.fastq"


@pytest.mark.parametrize(
    "names, size",
    [
        (["s0", "s0", "s1", "s1"] * 4, 2), (["a", "a", "a", "b", "b", "b", "c"], 1), ([f"s{i // 3}" for i in range(18)], 3), ([f"s{i // 4}/{i % 4 + 1}" for i in range(40)], 4),
        ([f"s{i // 2}/1" for i in range(20)], 1), ([f"s{i // 2} {i % 2 + 1}:N:0:A" for i in range(20)], 2), (["x"] * 16, 1), (["x"] * 3, 3), ([f"s{i}" for i in range(20)], 1), ([], 1), (["one"], 1),
    ],
)
def test_group_size_by_names(spark, names, size):
    if names[:4] == ["s0", "s0", "s1", "s1"]:
        names = [f"s{i // 2}" for i in range(16)]
    frame = spark.createDataFrame([(i, n, "A", "I") for i, n in enumerate(names)], SCHEMA)
    assert archive.group_size_of(frame) == size


def test_bgzf_is_split_by_blocks_and_read_by_gzip(spark, reads, tmp_path):
    big = reads.selectExpr("read_id", "name", "repeat(seq, 40) AS seq", "repeat(qual, 40) AS qual")
    n = bgzf.write_bgzf(big, str(tmp_path / "z"))
    files = sorted(os.listdir(tmp_path / "z"))
    assert len(files) == n and all(f.endswith(".fastq.gz") for f in files)
    text = b"".join(gzip.decompress((tmp_path / "z" / f).read_bytes()) for f in files)
    assert text == "".join(f"@{r.name}\n{r.seq}\n+\n{r.qual}\n" for r in big.orderBy("read_id").collect()).encode()
    got = fastq.read_fastq(spark, f"file://{tmp_path}/z", 1 << 14).collect()
    assert sorted((r.name, r.seq, r.qual) for r in got) == sorted((r.name, r.seq, r.qual) for r in big.collect())
    assert len({(r.file, r.read_id) for r in got}) == 400
    assert gzip.decompress(bgzf.block(os.urandom(bgzf.BLOCK)) + bgzf.END) and len(bgzf.block(os.urandom(bgzf.BLOCK))) <= 1 << 16
    with pytest.raises(archive.ArchiveError):
        bgzf.write_bgzf(reads, str(tmp_path / "z"))


def test_alignment_text(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t0\tchr\t5\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:0\tRG:Z:x\nr2\t256\t*\tzero\t0\t*\t*\t0\t0\tA\tI\n\nshort\t4\n")
    got = {r.qname: r for r in sam.read_sam(spark, f"{tmp_path}/a.sam").collect()}
    assert set(got) == {"r1", "r2", "short"} and got["r1"].tags == ["NM:i:0", "RG:Z:x"] and (got["r1"].pos, got["r2"].pos) == (5, None)
    assert got["short"].seq is None and got["short"].flag == 4 and got["r2"].tags == []
    assert {r.qname for r in sam.primary(sam.read_sam(spark, f"{tmp_path}/a.sam")).collect()} == {"r1", "short"}


def test_records_and_folds(spark, reads, tmp_path):
    path, seen = str(tmp_path / "a"), []
    archive.write_archive(reads, path, group_reads=100)
    assert api.each_record(spark, path, seen.append) == 400 and seen == [api.Record(*r[1:]) for r in ROWS]
    with api.RecordReader(spark, path, "seq", [1]) as reader:
        first = next(reader)
    assert first == api.Record("", ROWS[100][2], "") and next(reader, None) is None
    assert api.read_names(spark, path, [0]) == [r[1] for r in ROWS[:100]] and api.read_qualities(spark, path) == [r[3] for r in ROWS]
    assert api.read_sequences(spark, path, []) == [] and api.count_reads(spark, path) == 400
    assert api.read_block(spark, path, 2) == [api.Record(*r[1:]) for r in ROWS[200:300]]
    longest = lambda a, b: max(a, b, key=lambda x: (len(x[1]), -x[0]))
    got = api.fold(reads, lambda: (-1, ""), lambda s, i, r: longest(s, (i, r.sequence)), longest)
    assert got == max(((i, s) for i, _, s, _ in ROWS), key=lambda x: (len(x[1]), -x[0]))
    assert api.fold(reads.limit(0), lambda: 5, lambda s, i, r: s + 1, lambda a, b: a + b) == 5
    assert api.fold(reads.select("read_id", "seq"), list, lambda s, i, r: [*s, r.name], lambda a, b: a + b) == [""] * 400


def test_text_files_split_and_lockstep(spark, reads, tmp_path):
    archive.write_fastq(reads, str(tmp_path / "q"))
    text = b"".join((tmp_path / "q" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "q")) if f.startswith("part"))
    assert text == "".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in ROWS).encode()
    archive.write_split(reads, str(tmp_path / "s"), 2, gzip=True)
    parts = [fastq.read_fastq(spark, f"file://{tmp_path}/s/member={m}").drop("file") for m in (0, 1)]
    names = lambda f: sorted(r.seq for r in f.collect())
    assert [names(p) for p in parts] == [sorted(r[2] for r in ROWS[m::2]) for m in (0, 1)]
    halves = [spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(ROWS[m::2])], SCHEMA) for m in (0, 1)]
    assert rows(archive.interleave(*halves)) == ROWS
    with pytest.raises(Exception, match="unequal"):
        archive.interleave(halves[0], halves[1].where("read_id > 0")).collect()
    with pytest.raises(Exception, match="multiple of 3"):
        archive.members(reads, 3).collect()


def test_running_statistics_equal_those_of_a_batch(spark, reads, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in range(3):
        reads.where(f"read_id % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
        running_stats(stream_reads(spark, source, 1), out, mark).awaitTermination(120)
        spark.catalog.refreshByPath(out)
        assert spark.read.parquet(out).first().reads == sum(i % 3 <= part for i in range(400))
    assert spark.read.parquet(out).first() == content_stats(reads).first()


def test_command_line(spark, reads, tmp_path, capsys):
    from readloom.__main__ import main

    halves = []
    for m in (0, 1):
        text = "".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in ROWS[m::2])
        (tmp_path / f"{m}.fastq").write_text(text)
        halves.append(f"file://{tmp_path}/{m}.fastq")
    a = f"{tmp_path}/a"
    assert main(["compress", *halves, "-o", a], spark) == 0 and rows(archive.read_archive(spark, a)) == ROWS
    assert main(["info", a], spark) == 0 and "reads\t400" in capsys.readouterr().out
    assert main(["info", a, "--content", "--json"], spark) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["mean_len"] > 0
    assert main(["verify", a], spark) == 0 and "FAILED" not in capsys.readouterr().out
    assert main(["verify", a, "--quick", "--json"], spark) == 0
    os.makedirs(tmp_path / "both")
    for m in (0, 1):
        os.rename(tmp_path / f"{m}.fastq", tmp_path / "both" / f"x_{m + 1}.fastq")
    b = f"{tmp_path}/b"
    assert main(["compress", f"file://{tmp_path}/both", "-o", b], spark) == 0
    assert rows(archive.read_archive(spark, b)) == [(i, *r[1:]) for i, r in enumerate(ROWS[0::2] + ROWS[1::2])]
    assert main(["decompress", a, "-o", f"{tmp_path}/fa", "--fasta"], spark) == 0
    text = "".join((tmp_path / "fa" / f).read_text() for f in sorted(os.listdir(tmp_path / "fa")) if f.startswith("part"))
    assert text == "".join(f">{n}\n{s}\n" for _, n, s, _ in ROWS)
