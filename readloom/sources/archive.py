"""An archive of reads: Parquet files in the order of the reads, which gives
column projection, row-group pruning and an index from the footers; a manifest
of digests makes it verifiable. It is written aside and renamed when whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import bin_quality

STREAMS = ("names", "sequence", "quality")
_COLUMN = {"names": "name", "sequence": "seq", "quality": "qual"}
_ALIASES = {"name": "names", "seq": "sequence", "qual": "quality"}
#: Reads in a row group by default, and characters of a label.
GROUP_READS, LABEL_CHARS = 1_048_576, 15
#: Version of the layout, and what an archive may ask of its reader.
VERSION, FEATURES = 1, frozenset({"binned"})
SCHEMA = "read_id long, row_group long, name string, seq string, qual string"


class ArchiveError(ValueError):
    """An archive that is damaged or does not hold what its manifest says."""


def streams_of(streams: str | Iterable[str] | None) -> tuple[str, ...]:
    """The streams meant: all for None, one for a name, the union for several
    names, none for no name; ``name``, ``seq`` and ``qual`` are names too."""
    if streams is None:
        return STREAMS
    wanted = [streams] if isinstance(streams, str) else list(streams)
    found = {_ALIASES.get(s, s) for s in wanted}
    if not all(isinstance(s, str) for s in wanted) or found - set(STREAMS):
        raise ArchiveError(f"no such streams: {sorted(map(str, found - set(STREAMS)))}; there are {STREAMS}")
    return tuple(s for s in STREAMS if s in found)


def member_labels(labels: Iterable[str] | None, group_size: int) -> list[str]:
    """Labels of the members of a spot, or none if they are not one for each, of
    1 to 15 characters and all different: they name, and are never a reason to fail."""
    found = list(labels or [])
    whole = len(found) == max(group_size, 1) and len(set(found)) == len(found)
    return found if whole and all(0 < len(x) <= LABEL_CHARS for x in found) else []


def slot_label(file_name: str) -> str | None:
    """The slot of a FASTQ file by its name, ``R1`` of ``x_R1.fastq.gz``."""
    stem = file_name.rsplit("/", 1)[-1]
    for end in (".fastq.gz", ".fq.gz", ".fastq", ".fq"):
        if stem.endswith(end):
            stem = stem[: -len(end)]
            break
    head, _, label = stem.rpartition("_")
    digits = label.lstrip("RIri") if label[:1] in "RIri" else label
    known = bool(_) and 0 < len(label) <= LABEL_CHARS and digits.isascii() and digits.isdigit() and len(label) - len(digits) <= 1
    return label if known else None


def split_name(prefix: str, member: int, style: str = "auto", label: str | None = None, gzip: bool = False) -> str:
    """The file of a member, counted from 1: ``auto`` takes the label that is
    kept and else ``R1``, ``R`` and ``num`` count."""
    if style not in ("auto", "R", "num"):
        raise ValueError(f"no such style: {style}")
    own = str(member) if style == "num" else label if style == "auto" and label else f"R{member}"
    return f"{prefix}_{own}.fastq{'.gz' if gzip else ''}"


def _digest(column: Column) -> Column:
    """A sum of hashes, equal for equal multisets however they are split."""
    return F.coalesce(F.sum(F.xxhash64(column).cast("decimal(38,0)")), F.lit(0)).cast("string")


def digests(reads: DataFrame) -> DataFrame:
    """One row: reads, and the multiset digests of records and of each stream,
    each bound to the read's number so that a changed order shows."""
    streams = [_digest(F.struct("read_id", _COLUMN[s])).alias(s) for s in STREAMS]
    return reads.agg(F.count("*").alias("reads"), _digest(F.struct("name", "seq", "qual")).alias("records"), *streams)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_archive(reads: DataFrame, path: str, group_reads: int = GROUP_READS, binning: str | None = None, overwrite: bool = False, group_size: int = 1, labels: Iterable[str] | None = None) -> None:
    """Writes reads (read_id, name, seq, qual) range-partitioned by read_id, so
    that footers' bounds prune; qualities pass through a binning table first.
    Refuses a folder that exists unless overwrite is set. Reads and manifest
    are written beside it and come to its name together, by one rename."""
    spark, aside = reads.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    store, target = _hadoop(spark, path)
    if store.exists(target) and not overwrite:
        raise ArchiveError(f"{path} already exists")
    if binning:
        reads = reads.withColumn("qual", bin_quality(F.col("qual"), binning))
    rows = reads.select("read_id", (F.col("read_id") / group_reads).cast("long").alias("row_group"), "name", "seq", "qual")
    try:
        rows.repartitionByRange("read_id").sortWithinPartitions("read_id").write.option("compression", "zstd").parquet(f"{aside}/reads")
        told = {"binning": F.lit(binning or "none"), "version": F.lit(VERSION), "features": F.array(*([F.lit("binned")] if binning else [])).cast("array<string>")}
        told |= {"group_size": F.lit(group_size), "labels": F.array(*map(F.lit, member_labels(labels, group_size))).cast("array<string>")}
        digests(spark.read.schema(SCHEMA).parquet(f"{aside}/reads")).withColumns(told).coalesce(1).write.json(f"{aside}/manifest")
        if store.exists(target):
            store.delete(target, True)
        if not store.rename(_hadoop(spark, aside)[1], target):
            raise ArchiveError(f"{aside} could not be renamed to {path}")
    finally:
        store.delete(_hadoop(spark, aside)[1], True)


def manifest(spark: SparkSession, path: str) -> dict:
    """What the archive says of itself. Refuses one of another version, or that
    asks for what this reader does not know."""
    kinds = "reads long, records string, names string, sequence string, quality string, binning string, version int, features array<string>, group_size int, labels array<string>"
    found = spark.read.schema(kinds).json(f"{path}/manifest").first()
    if found is None or found.version is None:
        raise ArchiveError(f"{path} has no manifest")
    if found.version != VERSION or set(found.features or []) - FEATURES:
        raise ArchiveError(f"{path} is of version {found.version} with {sorted(found.features or [])}")
    return found.asDict()


def read_archive(spark: SparkSession, path: str, streams: str | Iterable[str] | None = None, groups: list[int] | None = None) -> DataFrame:
    """(read_id and the chosen streams); other columns and, with groups, other
    row groups are not read."""
    chosen = streams_of(streams)
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/reads")
    if groups is not None:
        rows = rows.where(F.col("row_group").isin(*groups)) if groups else rows.limit(0)
    return rows.select("read_id", *[_COLUMN[s] for s in chosen])


def _over_files(spark: SparkSession, path: str, of, schema: str, fields: pa.Schema) -> DataFrame:
    """Rows that ``of`` gives of each Parquet file of the archive, a file a task."""
    files = spark.read.schema(SCHEMA).parquet(f"{path}/reads").inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = list(of(name))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, min(len(files), 10_000)), "file").mapInArrow(run, schema)


def _open(name: str) -> pq.ParquetFile:
    store, at = pafs.FileSystem.from_uri(name)
    return pq.ParquetFile(store.open_input_file(at))


_INDEX = pa.schema([("file", pa.string()), ("nth", pa.int32()), *[(n, pa.int64()) for n in ("reads", "first_read", "last_read", "first_group", "last_group", "names_bytes", "seq_bytes", "qual_bytes")]])


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group of the files, from their footers alone: file,
    nth, reads, the first and last read and logical group, and the bytes that
    each stream takes in it. No data page is read."""

    def groups(name: str) -> Iterator[dict]:
        meta = _open(name).metadata
        place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for k in range(meta.num_row_groups):
            g = meta.row_group(k)
            bounds = lambda c: (lambda s: (s.min, s.max) if s and s.has_min_max else (None, None))(g.column(place[c]).statistics)
            size = lambda c: g.column(place[c]).total_compressed_size
            (r0, r1), (g0, g1) = bounds("read_id"), bounds("row_group")
            yield {"file": name, "nth": k, "reads": g.num_rows, "first_read": r0, "last_read": r1, "first_group": g0, "last_group": g1, "names_bytes": size("name"), "seq_bytes": size("seq"), "qual_bytes": size("qual")}

    kinds = "file string, nth int, " + ", ".join(f"{f.name} bigint" for f in _INDEX if f.name not in ("file", "nth"))
    return _over_files(spark, path, groups, kinds, _INDEX)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row of what manifest and footers tell: reads, row groups, bytes of
    each stream. No data page is read."""
    told = manifest(spark, path)
    sums = index(spark, path).agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.count("*").alias("row_groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("names_bytes", "seq_bytes", "qual_bytes")])
    return sums.withColumns({"binning": F.lit(told["binning"]), "group_size": F.lit(told["group_size"]), "labels": F.lit(",".join(told["labels"] or []))})


def verify(spark: SparkSession, path: str, quick: bool = False) -> DataFrame:
    """A row per check: its name and whether the archive passes. quick: only the
    number of reads and their coming one after another, from the footers."""
    want = manifest(spark, path)
    if quick:
        groups = [r for r in index(spark, path).orderBy("first_read").select("reads", "first_read", "last_read").collect() if r.reads]
        follow = all(r.last_read - r.first_read + 1 == r.reads for r in groups) and all(a.last_read + 1 == b.first_read for a, b in zip(groups, groups[1:], strict=False))
        checks = [("reads", sum(r.reads for r in groups) == want["reads"]), ("order", follow)]
    else:
        got = digests(spark.read.schema(SCHEMA).parquet(f"{path}/reads")).first()
        checks = [(n, str(want[n]) == str(got[n])) for n in ("reads", "records", *STREAMS)]
    return spark.createDataFrame(checks, "check string, ok boolean")


def verify_roundtrip(spark: SparkSession, path: str, reads: DataFrame) -> bool:
    """Whether the archive holds just these reads, under their numbers; those
    of an archive with a binning table are binned first."""
    binning = manifest(spark, path)["binning"]
    if binning != "none":
        reads = reads.withColumn("qual", bin_quality(F.col("qual"), binning))
    return digests(reads).first() == digests(spark.read.schema(SCHEMA).parquet(f"{path}/reads")).first()


def verify_report(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: file, row groups and reads that can be read, row groups
    that can't, and why the first can't."""
    fields = pa.schema([("file", pa.string()), ("good_groups", pa.int32()), ("bad_groups", pa.int32()), ("reads", pa.int64()), ("error", pa.string())])

    def check(name: str) -> Iterator[dict]:
        out = {"file": name, "good_groups": 0, "bad_groups": 0, "reads": 0, "error": None}
        try:
            found = _open(name)
            for k in range(found.num_row_groups):
                try:
                    out["reads"] += found.read_row_group(k).num_rows
                    out["good_groups"] += 1
                except (OSError, pa.ArrowException) as e:
                    out["bad_groups"] += 1
                    out["error"] = out["error"] or str(e)[:200]
        except (OSError, pa.ArrowException) as e:
            out["error"], out["bad_groups"] = str(e)[:200], 1
        yield out

    return _over_files(spark, path, check, "file string, good_groups int, bad_groups int, reads bigint, error string", fields)


def recover(spark: SparkSession, path: str) -> DataFrame:
    """The reads of all row groups that can still be read; damaged row groups,
    and files whose footer is damaged, are passed over."""
    fields = pa.schema([("read_id", pa.int64()), ("row_group", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
    files = spark.read.schema(SCHEMA).parquet(f"{path}/reads").inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    found = _open(name)
                except (OSError, pa.ArrowException):
                    continue
                for k in range(found.num_row_groups):
                    try:
                        rows = found.read_row_group(k, columns=fields.names).cast(fields)
                    except (OSError, pa.ArrowException):
                        continue
                    yield from rows.to_batches(8192)

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, min(len(files), 10_000)), "file").mapInArrow(run, SCHEMA)


def recovery_report(spark: SparkSession, path: str) -> dict[str, int]:
    """Reads that the manifest tells of, that can still be read, and that are lost,
    and the row groups that are passed over."""
    want, got = manifest(spark, path)["reads"], verify_report(spark, path).agg(F.coalesce(F.sum("reads"), F.lit(0)), F.coalesce(F.sum("bad_groups"), F.lit(0))).first()
    return {"reads": want, "recovered": got[0], "lost": want - got[0], "skipped_groups": got[1]}


def members(reads: DataFrame, group_size: int) -> DataFrame:
    """Interleaved reads with spot_id and member. Raises in the job if the last
    spot is not whole."""
    total = reads.agg(F.count("*").alias("_n"))
    whole = F.when(F.col("_n") % group_size == 0, F.col("read_id")).otherwise(F.raise_error(F.lit(f"reads are not a multiple of {group_size}")).cast("long"))
    return reads.crossJoin(F.broadcast(total)).withColumn("read_id", whole).drop("_n").withColumn("spot_id", (F.col("read_id") / group_size).cast("long")).withColumn("member", (F.col("read_id") % group_size).cast("int"))


def interleave(*files: DataFrame) -> DataFrame:
    """Reads of several files in lockstep as one: read i of file m becomes read
    i * n + m. A file that is shorter than another raises in the job."""
    n, out = len(files), None
    counts = [f.agg(F.count("*").alias(f"_c{m}")) for m, f in enumerate(files)]
    sizes = counts[0]
    for c in counts[1:]:
        sizes = sizes.crossJoin(c)  # one row each
    same = F.lit(True)
    for m in range(1, n):
        same = same & (F.col("_c0") == F.col(f"_c{m}"))
    for m, f in enumerate(files):
        part = f.select((F.col("read_id") * n + m).alias("read_id"), "name", "seq", "qual")
        out = part if out is None else out.unionByName(part)
    checked = F.when(same, F.col("read_id")).otherwise(F.raise_error(F.lit("files hold unequal numbers of reads")).cast("long"))
    return out.crossJoin(F.broadcast(sizes)).select(checked.alias("read_id"), "name", "seq", "qual")


def group_size_of(reads: DataFrame) -> int:
    """How many reads a spot has, told by the names of the leading 16: runs of
    one spot's names, of which the last counts only if no read comes behind. All
    are as long, 2 to 4, and their marks differ or are missing; otherwise 1."""
    some = sorted((r.read_id, r.name) for r in reads.where("read_id < 17").select("read_id", "name").collect())
    runs: list[list[tuple[str, str]]] = []
    for _, name in some[:16]:
        first, _, rest = (name or "").replace("\t", " ").partition(" ")
        base, mark = (first[:-2], first[-1]) if first[-2:-1] == "/" and first[-1:] in "1234" else (first, rest[0] if rest[1:2] == ":" and rest[:1] in "1234" and rest[:1] else "")
        if runs and runs[-1][-1][0] == base:
            runs[-1].append((base, mark))
        else:
            runs.append([(base, mark)])
    if len(some) >= 16:
        runs = runs[:-1]
    sizes = {len(r) for r in runs}
    marks = [[m for _, m in r if m] for r in runs]
    distinct = all(not m or len(set(m)) == len(r) for m, r in zip(marks, runs, strict=True))
    return sizes.pop() if len(sizes) == 1 and distinct and next(iter(sizes)) in (2, 3, 4) else 1


def auto_layout(reads: DataFrame) -> DataFrame:
    """reads with the group size that their names tell, spot_id and member."""
    return members(reads, n := group_size_of(reads)).withColumn("group_size", F.lit(n))


def _lines(fasta: bool) -> Column:
    lines = [F.concat(F.lit(">"), "name"), "seq"] if fasta else [F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual"]
    return F.concat_ws("\n", *lines).alias("value")


def write_fastq(reads: DataFrame, path: str, fasta: bool = False, gzip: bool = False, overwrite: bool = False) -> None:
    """FASTQ or FASTA text files in the order of read_id."""
    rows = reads.repartitionByRange("read_id").sortWithinPartitions("read_id").select(_lines(fasta))
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip" if gzip else "none").text(path)


def write_split(reads: DataFrame, path: str, group_size: int, gzip: bool = False, overwrite: bool = False) -> None:
    """A folder ``member=m`` of FASTQ text for each member of the spots."""
    rows = members(reads, group_size).repartitionByRange("member", "read_id").sortWithinPartitions("member", "read_id")
    rows.select("member", _lines(False)).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("member").option("compression", "gzip" if gzip else "none").text(path)
