"""Queries over the driver's tables whose operators are no SQL, with SQL where
their result can be told by other means."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions.hashes import crc32c_of, xxh3_of
from ..operators import assembly, codecs
from ..operators.align import aligned, wavefront_aligned
from ..operators.contigs import folded, op_statistics
from ..operators.groups import cut_groups
from ..operators.overlap import overlaps
from ..operators.sketch import seeds
from ..sources import archive, bgzf
from ..sources.fastq import read_fastq
from ..sources.sam import primary, read_sam
from ..sources.scratch import shared_folder, written
from ..sources.synthetic import synthetic_reads
from ..streaming.stats import running_stats
from .forms import cluster_plan, spread
from .views import VIEWS, to_duckdb, to_spark


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(to_spark(sql, sf_dir))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT read_id, name, seq, qual FROM reads")


def _uri(spark: SparkSession) -> str:
    folder = shared_folder(spark)
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """An archive of the reads, in row groups of 128."""
    path = _uri(spark)
    archive.write_archive(_reads(spark, sf_dir), path, group_reads=128, group_size=2, labels=["R1", "R2"])
    return path


# sources and sinks


def s01_fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads written as FASTQ text, and read again by splits of 64 KiB."""
    path = _uri(spark)
    archive.write_fastq(_reads(spark, sf_dir), path)
    return read_fastq(spark, path, 1 << 16).select("name", "seq", "qual")


def s23_bgzf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads written as BGZF, and read again by blocks."""
    path = _uri(spark)
    bgzf.write_bgzf(_reads(spark, sf_dir), path)
    return read_fastq(spark, path, 1 << 15).select("name", "seq", "qual")


def s05_interleaved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second mates as two tables, in lockstep again."""
    mate = lambda m: _reads(spark, sf_dir).where(f"read_id % 2 = {m}").selectExpr("read_id DIV 2 AS read_id", "name", "seq", "qual")
    return archive.interleave(mate(0), mate(1))


def s12_footer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.index(spark, _archive(spark, sf_dir))
    return rows.agg(F.sum("reads").alias("reads"), F.min("first_read").alias("first_read"), F.max("last_read").alias("last_read"), F.max("last_group").alias("last_group"))


def s16_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.info(spark, _archive(spark, sf_dir)).select("reads", "binning", "group_size", "labels")


def s20_split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads written to a folder a member, and what the folders hold."""
    path = _uri(spark)
    archive.write_split(_reads(spark, sf_dir), path, 2)
    rows = read_fastq(spark, path)
    member = F.regexp_extract("file", "member=([0-9]+)", 1).cast("bigint")
    return rows.groupBy(member.alias("member")).agg(F.count("*").alias("reads"), F.sum(F.length("name") + F.length("seq") + F.length("qual") + 6).alias("out_bytes"))


def s22_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_archive(spark, _archive(spark, sf_dir))


def s25_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _archive(spark, sf_dir)
    told = archive.recovery_report(spark, path)
    rows = archive.recover(spark, path).agg(F.count("*").alias("recovered"))
    return rows.select("recovered", F.lit(told["lost"]).alias("lost"), F.lit(told["skipped_groups"]).alias("skipped"))


def s26_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _archive(spark, sf_dir)
    checks = archive.verify(spark, path).unionByName(archive.verify(spark, path, quick=True).withColumn("check", F.concat(F.lit("quick "), "check")))
    whole = archive.verify_roundtrip(spark, path, _reads(spark, sf_dir))
    return checks.unionByName(spark.createDataFrame([("roundtrip", whole)], "check string, ok boolean"))


def s27_synthetic_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many reads as there are suppliers."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return synthetic_reads(spark, n, "novaseq", 100_000).selectExpr("read_id", "length(seq) AS bases", "length(seq) = length(qual) AS whole", "seq RLIKE '^[ACGT]*$' AS plain")


def s28_sam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads written as alignment text, a header before, and scanned."""
    path = _uri(spark)
    line = "concat_ws(chr(9), split(name, ' ')[0], CAST(read_id % 16 * 128 AS STRING), '*', '0', '0', '*', '*', '0', '0', seq, replace(qual, chr(9), ' '), concat('RD:i:', read_id))"
    _reads(spark, sf_dir).selectExpr(f"{line} AS value").write.text(f"{path}/a.sam")
    spark.createDataFrame([("@HD\tVN:1.6",), ("@CO\tnothing",)], "value string").coalesce(1).write.text(f"{path}/head.sam")
    rows = primary(read_sam(spark, f"{path}/*.sam"))
    return rows.selectExpr("CAST(substr(tags[0], 6) AS BIGINT) AS read_id", "qname", "flag", "seq")


def s29_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))
    return reads.select(F.to_json(F.struct("reads", "bases")).alias("line"))


def p24_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader says to the reads' archive under other manifests."""
    path, out = _archive(spark, sf_dir), []
    told = spark.read.json(f"{path}/manifest")
    changes = {"as it is": told, "version": told.withColumn("version", F.lit(99)), "feature": told.withColumn("features", F.array(F.lit("unheard of")))}
    for name, frame in changes.items():
        other = _uri(spark)
        frame.coalesce(1).write.json(f"{other}/manifest")
        try:
            archive.manifest(spark, other)
            out.append((name, True))
        except archive.ArchiveError:
            out.append((name, False))
    return spark.createDataFrame(out, "manifest string, taken boolean")


# folds and records


def a13_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, bases and the largest number, by a fold of records."""
    found = api.fold(_reads(spark, sf_dir), lambda: (0, 0, -1), lambda s, i, r: (s[0] + 1, s[1] + len(r.sequence), max(s[2], i)), lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])))
    return spark.createDataFrame([found], "reads long, bases long, last long")


def s10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an archive pulled one by one, sequences only."""
    with api.RecordReader(spark, _archive(spark, sf_dir), "seq") as reader:
        bases = sum(len(r.sequence) + len(r.name) for r in reader)
        return spark.createDataFrame([(reader.read, bases)], "reads long, bases long")


# codecs


def _coded(spark: SparkSession, sf_dir: str, codec: str, column: str) -> DataFrame:
    """A row group's strings, one after another, under a codec."""
    rows = _reads(spark, sf_dir).groupBy(F.expr("read_id DIV 100").alias("group_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read_id", column))), lambda r: r[column]), "").alias("text"))
    return codecs.coded(rows, codec, "group_id", "text")


def c04_lzma_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "lzma", "seq").select("group_id", "raw_bytes", "restored")


def c08_rans_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _coded(spark, sf_dir, "rans0", "qual").withColumn("lanes", F.lit(0)).unionByName(_coded(spark, sf_dir, "rans1", "qual").withColumn("lanes", F.lit(1)))
    return both.select("group_id", F.col("lanes").alias("order"), "raw_bytes", "restored", (F.octet_length("coded") < F.col("raw_bytes")).alias("smaller"))


def c02_order_k_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases behind the six before, and behind thirteen by hashed slots."""
    both = _coded(spark, sf_dir, "order-6", "seq").withColumn("k", F.lit(6)).unionByName(_coded(spark, sf_dir, "hashed", "seq").withColumn("k", F.lit(13)))
    return both.select("group_id", "k", "raw_bytes", "restored")


def c05_quality_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of a row group behind those before, by position and beside the bases."""
    rows = _reads(spark, sf_dir).groupBy(F.expr("read_id DIV 100").alias("group_id")).agg(F.sort_array(F.collect_list(F.struct("read_id", "seq", "qual"))).alias("r"))
    return codecs.coded_qualities(rows.select("group_id", F.col("r.seq").alias("seqs"), F.col("r.qual").alias("quals")), "group_id")


def c09_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities, a read at a time, under models that grow as they are coded."""
    return codecs.coded(spread(spark, sf_dir, "reads", "read_id, qual"), "adaptive", "read_id", "qual").select("read_id", "raw_bytes", "restored")


def c12_reference_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as edits of a shared table of contigs, and what they come to again."""
    contigs = _contigs(spark, sf_dir)
    rows = written(spread(spark, sf_dir, "reads_overlap", "read_id AS id, seq"))
    return assembly.restored(assembly.referenced(rows, contigs), contigs).select(F.col("id").alias("read_id"), "seq")


def c17_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in cluster order with their orientation, and in file order again."""
    return assembly.unclustered(assembly.clustered(cluster_plan(spark, sf_dir)))


def c13_packed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "pack", "seq").select("group_id", "raw_bytes", F.octet_length("coded").cast("long").alias("packed_bytes"), "restored")


def c16_codec_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reads(spark, sf_dir).groupBy(F.expr("read_id DIV 100").alias("group_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read_id", "seq"))), lambda r: r["seq"]), "").alias("text"))
    return codecs.contest(rows, "group_id", "text")


# contigs


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT id, seq FROM contigs")


def j08_contig_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.successors(_contigs(spark, sf_dir))


def g05_merged_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = _contigs(spark, sf_dir)
    return assembly.merged(contigs, assembly.successors(contigs))


def j11_placed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.placed(spread(spark, sf_dir, "reads_overlap", "read_id AS id, seq"), _contigs(spark, sf_dir))


def a30_indel_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of which every third has a base too many, against contigs."""
    reads = _sql(spark, sf_dir, "SELECT id, CASE WHEN id % 3 = 0 THEN concat(substr(seq, 1, 40), 'ACGTT', substr(seq, 41, 100)) ELSE seq END AS seq FROM contigs")
    return assembly.indel_probe(reads.withColumn("id", F.col("id") + 1_000_000_000), _contigs(spark, sf_dir))


def j09_best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = _contigs(spark, sf_dir).withColumnRenamed("id", "read_id")
    return assembly.best_reference(written(spread(spark, sf_dir, "reads_overlap")), references)


def _laid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reads = _contigs(spark, sf_dir).withColumnRenamed("id", "read_id")
    return reads, assembly.layout(reads, overlaps(reads), min_score=40)


def g03_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir)[1]


def j12_interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, laid = _laid(spark, sf_dir)
    return assembly.tilings(laid, reads.select(F.col("read_id").alias("read"), F.length("seq").alias("len")), 30)


def g04_consensi(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, laid = _laid(spark, sf_dir)
    return assembly.consensi(laid, reads, 30)


def j14_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _contigs(spark, sf_dir).withColumnRenamed("id", "read_id")
    return assembly.tiles(overlaps(reads), reads)


def f23_wavefront(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against what they are without three bases before and with three behind."""
    pairs = _sql(spark, sf_dir, "SELECT read_id, concat(substr(seq, 4, 97), 'ACG') AS ref, seq AS read FROM reads_overlap")
    return wavefront_aligned(pairs).select("read_id", "edits", "restored")


def a15_xxh3_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _sql(spark, sf_dir, "SELECT read_id, name, seq, qual FROM reads")
    return reads.select("read_id", *[xxh3_of(F.col(c)).alias(c) for c in ("name", "seq", "qual")])


def a16_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _sql(spark, sf_dir, "SELECT read_id, name, seq, qual FROM reads")
    return reads.select("read_id", crc32c_of(F.concat_ws("\n", "name", "seq", "qual")).alias("crc32c"))


def w04_cut_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most 6,400 bases over pairs, five files."""
    reads = _sql(spark, sf_dir, "SELECT CAST(read_id % 5 AS STRING) AS file, read_id @DIV 5 AS read_id, seq FROM reads")
    return cut_groups(reads, 1000, 6400, 2).groupBy("file", "row_group").agg(F.count("*").alias("reads"))


def w06_exact_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(_sql(spark, sf_dir, "SELECT read_id, seq FROM reads"), "hifi")


def w07_exact_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(_sql(spark, sf_dir, "SELECT read_id, seq FROM reads"), "ont")


def g02_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spread(spark, sf_dir, "reads_overlap"))


def f22_edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the table; the band takes in all of a read."""
    pairs = _sql(spark, sf_dir, "SELECT a.read_id, a.seq AS ref, b.seq AS read FROM reads_overlap a JOIN (SELECT read_id - 1 AS p, seq FROM reads_overlap) b ON a.read_id = b.p")
    return aligned(pairs.repartition("read_id"), 100).select("read_id", "edits", "restored")


def c10_contig_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(cluster_plan(spark, sf_dir)).select("read_id", "op", "contig", "start", "mismatches", "novel")


def a29_operation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_statistics(folded(cluster_plan(spark, sf_dir)))


def t03_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, read until none is left."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    view, folder = f"events_{uuid.uuid4().hex}", shared_folder(spark)
    events.createOrReplaceTempView(view)
    reads = spark.sql(VIEWS["reads"].replace("FROM events", f"FROM {view}"))
    running_stats(reads, f"{folder}/out", f"{folder}/mark").awaitTermination()
    spark.catalog.dropTempView(view)
    return spark.read.parquet(f"{folder}/out").select("reads", "bases", "min_len", "max_len", "a", "c", "g", "t", "n", "other", F.round("gc", 9).alias("gc"), F.round("mean_quality", 9).alias("mean_quality"))


QUERIES = [
    s01_fastq_scan, s23_bgzf_scan, s05_interleaved_files, s10_records, s12_footer_index, s16_metadata, s20_split_sink, s22_archive_scan, s25_recovered, s26_verified, s27_synthetic_reads, s28_sam_scan, s29_report_json, p24_refusals,
    a13_fold, a15_xxh3_digests, a16_crc32c, w04_cut_groups, w06_exact_minimizers, w07_exact_syncmers, g02_overlaps, f22_edit_scripts, f23_wavefront, c02_order_k_sequence, c04_lzma_sequence, c05_quality_codecs, c08_rans_quality, c09_adaptive_quality, c12_reference_coded, c17_clustered_layout, c10_contig_operations, c13_packed_sequence,
    c16_codec_contest, a29_operation_statistics, j08_contig_successors, g05_merged_contigs, j09_best_reference, j11_placed_reads, a30_indel_probe, g03_layout, j12_interval_cover, g04_consensi, j14_tiles, t03_running_stats,
]

_N = "sum(length(seq) - length(replace(seq, '{0}', '')))".format
_Q = "(SELECT ascii(substr(qual, i, 1)) - 33 AS q FROM (SELECT qual, @EX(length(qual))@ AS i FROM reads))"
#: DuckDB SQL of splitmix64 and of a k-mer's number, by unsigned arithmetic in 128 bits.
_WRAP = "CAST(({}) % 18446744073709551616 AS UBIGINT)".format
_TIMES = lambda z, m: _WRAP(f"CAST({z} AS UHUGEINT) * {m}")
_FOLD = "xor({0}, {0} >> {1})".format
_HASHED = lambda source, out: f"SELECT * EXCLUDE (z0, z1, z2), {_FOLD('z2', 31)} AS {out} FROM (SELECT *, {_TIMES(_FOLD('z1', 27), 0x94D049BB133111EB)} AS z2 FROM (SELECT *, {_TIMES(_FOLD('z0', 30), 0xBF58476D1CE4E5B9)} AS z1 FROM (SELECT *, {_WRAP(f'CAST(v AS UHUGEINT) + {0x9E3779B97F4A7C15}')} AS z0 FROM ({source}))))"
_NUMBER = lambda column, k: f"CAST(list_sum(list_transform(range(1, {k + 1}), lambda i: (strpos('ACGT', substr({column}, i, 1)) - 1) * CAST(pow(4, {k} - i) AS BIGINT))) AS UBIGINT)"
_STRANDS = lambda k: f"SELECT read_id, length, pos, least(f, r) AS v, f <= r AS forward FROM (SELECT read_id, length, pos, {_NUMBER('kmer', k)} AS f, {_NUMBER(_RC('kmer'), k)} AS r FROM (SELECT read_id, length(seq) AS length, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM reads WHERE length(seq) >= {k})) WHERE NOT regexp_matches(kmer, '[^ACGT]'))"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))".format
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE CAST({0} AS HUGEINT) END AS BIGINT)".format
_MINIMIZERS = f"""SELECT read_id, {_SIGNED('h')} AS hash, CAST(pos AS BIGINT) AS pos, forward, length FROM (
  SELECT b.read_id, b.h, b.at AS pos, s.forward, s.length, lag(b.h) OVER (PARTITION BY b.read_id ORDER BY b.i) AS last FROM (
    SELECT read_id, i, CAST(m // 1048576 AS UBIGINT) AS h, 1048575 - CAST(m % 1048576 AS BIGINT) AS at FROM (
      SELECT read_id, pos AS i, min(CAST(h AS UHUGEINT) * 1048576 + CAST(1048575 - pos AS UHUGEINT)) OVER (PARTITION BY read_id, run ORDER BY pos RANGE BETWEEN 18 PRECEDING AND CURRENT ROW) AS m
      FROM (SELECT *, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM ({_HASHED(_STRANDS(19), 'h')}))) WHERE i >= 18) b
  JOIN ({_STRANDS(19)}) s ON s.read_id = b.read_id AND s.pos = b.at) WHERE last IS NULL OR last <> h"""
_SYNCMERS = f"""SELECT k.read_id, {_SIGNED('k.h')} AS hash, CAST(k.pos AS BIGINT) AS pos, k.forward, k.length FROM ({_HASHED(_STRANDS(15), 'h')}) k JOIN (
  SELECT read_id, pos, small, min(small) OVER w AS least, last_value(small) OVER w AS final FROM ({_HASHED(_STRANDS(5), 'small')}) WINDOW w AS (PARTITION BY read_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING)) s
  ON s.read_id = k.read_id AND s.pos = k.pos WHERE small = least OR final = least"""
_LAST = "(SELECT max(read_id) FROM reads)"
_CK = "(SELECT id, i - 1 AS pos, substr(seq, i, 15) AS f FROM (SELECT id, seq, @EX(length(seq) - 14)@ AS i FROM {}) AS ck)".format
_HEADS = f"(SELECT * FROM (SELECT id, pos, f, row_number() OVER (PARTITION BY f ORDER BY id, pos) AS n FROM {_CK('contigs')} AS c0 WHERE pos + 15 <= 64) WHERE n <= 16)"
_GROUPED = "(SELECT read_id // 100 AS group_id, sum(length({0})) AS raw, sum(length({0}) - length(replace({0}, 'N', ''))) AS odd FROM reads GROUP BY read_id // 100)".format
ORACLES = {
    "s01_fastq_scan": "SELECT name, seq, qual FROM reads",
    "s23_bgzf_scan": "SELECT name, seq, qual FROM reads",
    "s05_interleaved_files": "SELECT read_id, name, seq, qual FROM reads",
    "s22_archive_scan": "SELECT read_id, name, seq, qual FROM reads",
    "s10_records": "SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads",
    "a13_fold": "SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, max(read_id) AS last FROM reads",
    "s12_footer_index": "SELECT count(*) AS reads, min(read_id) AS first_read, max(read_id) AS last_read, max(read_id // 128) AS last_group FROM reads",
    "s16_metadata": "SELECT count(*) AS reads, 'none' AS binning, 2 AS group_size, 'R1,R2' AS labels FROM reads",
    "s20_split_sink": "SELECT read_id % 2 AS member, count(*) AS reads, CAST(sum(length(name) + length(seq) + length(qual) + 6) AS BIGINT) AS out_bytes FROM reads GROUP BY read_id % 2",
    "s25_recovered": "SELECT count(*) AS recovered, 0 AS lost, 0 AS skipped FROM reads",
    "s26_verified": "SELECT unnest(['reads', 'records', 'names', 'sequence', 'quality', 'quick reads', 'quick order', 'roundtrip']) AS \"check\", TRUE AS ok",
    "s27_synthetic_reads": "SELECT unnest(range(n)) AS read_id, 150 AS bases, TRUE AS whole, TRUE AS plain FROM (SELECT count(*) AS n FROM supplier)",
    "s28_sam_scan": "SELECT read_id, split_part(name, ' ', 1) AS qname, read_id % 16 * 128 AS flag, seq FROM reads WHERE (read_id % 16 * 128) & 2304 = 0",
    "s29_report_json": "SELECT concat('{\"reads\":', count(*), ',\"bases\":', sum(length(seq)), '}') AS line FROM reads",
    "p24_refusals": "SELECT unnest(['as it is', 'version', 'feature']) AS manifest, unnest([TRUE, FALSE, FALSE]) AS taken",
    "w06_exact_minimizers": _MINIMIZERS,
    "w07_exact_syncmers": _SYNCMERS,
    "c04_lzma_sequence": f"SELECT group_id, CAST(raw AS BIGINT) AS raw_bytes, TRUE AS restored FROM {_GROUPED('seq')}",
    "c02_order_k_sequence": f"SELECT group_id, k, CAST(raw AS BIGINT) AS raw_bytes, TRUE AS restored FROM {_GROUPED('seq')}, (VALUES (6), (13)) AS t(k)",
    "c05_quality_codecs": f"SELECT group_id, beside, CAST(raw AS BIGINT) AS raw_bytes, TRUE AS restored FROM {_GROUPED('qual')}, (VALUES (TRUE), (FALSE)) AS t(beside)",
    "c09_adaptive_quality": "SELECT read_id, length(qual) AS raw_bytes, TRUE AS restored FROM reads",
    "c12_reference_coded": "SELECT read_id, seq FROM reads_overlap",
    "c17_clustered_layout": "SELECT read_id, seq FROM reads_overlap",
    "c08_rans_quality": f"SELECT group_id, o AS \"order\", CAST(raw AS BIGINT) AS raw_bytes, TRUE AS restored, TRUE AS smaller FROM {_GROUPED('qual')}, (VALUES (0), (1)) AS t(o)",
    "c13_packed_sequence": f"SELECT group_id, CAST(raw AS BIGINT) AS raw_bytes, CAST(16 + 9 * odd + ceil(raw / 4.0) AS BIGINT) AS packed_bytes, TRUE AS restored FROM {_GROUPED('seq')}",
    "f23_wavefront": "SELECT read_id, CAST(levenshtein(concat(substr(seq, 4, 97), 'ACG'), seq) AS BIGINT) AS edits, TRUE AS restored FROM reads_overlap",
    "j08_contig_successors": f"""SELECT a, b, shift, overlap, mism FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, mism, b, shift) AS rn FROM (
      SELECT a, b, shift, overlap, CAST(hamming(substr(sa, CAST(shift + 1 AS BIGINT), overlap), substr(sb, 1, overlap)) AS BIGINT) AS mism FROM (
        SELECT p.a, p.b, p.shift, length(x.seq) - p.shift AS overlap, x.seq AS sa, y.seq AS sb FROM (SELECT DISTINCT t.id AS a, h.id AS b, t.pos - h.pos AS shift FROM {_CK('contigs')} AS t JOIN {_HEADS} AS h ON t.f = h.f AND t.id <> h.id AND t.pos > h.pos) p
        JOIN contigs x ON x.id = p.a JOIN contigs y ON y.id = p.b) WHERE overlap >= 24 AND overlap <= length(sb)) WHERE mism <= overlap // 8) WHERE rn = 1""",
    "j11_placed_reads": f"""SELECT "read", contig, off, overlap, mism FROM (SELECT *, row_number() OVER (PARTITION BY "read" ORDER BY mism, contig DESC, off) AS rn FROM (
      SELECT "read", contig, off, overlap, len, CAST(hamming(substr(rs, 1, overlap), substr(cs, CAST(off + 1 AS BIGINT), overlap)) AS BIGINT) AS mism FROM (
        SELECT p.r AS "read", p.c AS contig, p.off, least(length(y.seq) - p.off, length(x.seq)) AS overlap, length(x.seq) AS len, x.seq AS rs, y.seq AS cs FROM (
          SELECT DISTINCT o.id AS r, t.id AS c, t.pos - o.pos AS off FROM {_CK("(SELECT read_id AS id, seq FROM reads_overlap)")} AS o JOIN {_CK('contigs')} AS t ON o.f = t.f AND t.pos >= o.pos WHERE o.pos % 15 = 0) p
        JOIN reads_overlap x ON x.read_id = p.r JOIN contigs y ON y.id = p.c)) WHERE overlap >= least(16, len) AND mism <= overlap // 4 AND len - overlap + 2 * mism < len) WHERE rn = 1""",
    "f22_edit_scripts": "SELECT a.read_id, CAST(levenshtein(a.seq, b.seq) AS BIGINT) AS edits, TRUE AS restored FROM reads_overlap a JOIN (SELECT read_id - 1 AS p, seq FROM reads_overlap) b ON a.read_id = b.p",
    "t03_running_stats": f"SELECT reads, bases, lo AS min_len, hi AS max_len, a, c, g, t, n, bases - a - c - g - t - n AS other, round((g + c) * 1.0 / (a + c + g + t), 9) AS gc, round((SELECT avg(q) FROM {_Q}), 9) AS mean_quality FROM (SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(min(length(seq)) AS INT) AS lo, CAST(max(length(seq)) AS INT) AS hi, "
    + ", ".join(f"CAST({_N(b)} AS BIGINT) AS {b.lower()}" for b in "ACGTN")
    + " FROM reads)",
    "w04_cut_groups": "SELECT file, row_group, CAST(count(*) AS BIGINT) AS reads FROM (SELECT CAST(read_id % 5 AS STRING) AS file, (read_id // 5) // 100 AS row_group FROM reads) GROUP BY file, row_group",
}


def oracles() -> dict[str, str]:
    return {name: to_duckdb(sql) for name, sql in ORACLES.items()}
