"""``python -m readloom compress|decompress|info|verify``: archives of reads
from the command line. Paths are URIs or paths that Spark understands."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.reads import content_stats
from .operators.ordering import numbered
from .plans.views import BINS
from .sources import archive
from .sources.fastq import read_fastq


def _one(reads: DataFrame) -> DataFrame:
    """Reads of several files under numbers that go on from file to file."""
    return numbered(reads, "file", "read_id", name="n").select((F.col("n") - 1).alias("read_id"), "name", "seq", "qual")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("readloom")
    commands = parser.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("compress", help="FASTQ files of one run, in lockstep if several, to an archive")
    pack.add_argument("inputs", nargs="+")
    pack.add_argument("-o", "--output", required=True)
    pack.add_argument("--quality-bin", choices=sorted(BINS))
    pack.add_argument("-f", "--force", action="store_true")
    unpack = commands.add_parser("decompress", help="an archive to FASTQ or FASTA text")
    unpack.add_argument("input")
    unpack.add_argument("-o", "--output", required=True)
    unpack.add_argument("--fasta", action="store_true")
    unpack.add_argument("--gzip", action="store_true")
    unpack.add_argument("--split", type=int, metavar="N", help="a folder for each member of spots of N reads")
    unpack.add_argument("-f", "--force", action="store_true")
    for name, text in (("info", "what manifest and footers tell"), ("verify", "digests against the manifest")):
        command = commands.add_parser(name, help=text)
        command.add_argument("input")
        command.add_argument("--json", action="store_true")
        if name == "info":
            command.add_argument("--content", action="store_true", help="statistics of all reads as well")
        else:
            command.add_argument("--quick", action="store_true", help="numbers of reads only, from the footers")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    if args.command == "compress":
        files = [_one(read_fastq(spark, p)) for p in args.inputs]
        if len(files) == 1:
            reads, size = files[0], archive.group_size_of(files[0])
        else:
            reads, size = archive.interleave(*files), len(files)
        labels = [archive.slot_label(p) for p in args.inputs]
        archive.write_archive(reads, args.output, binning=args.quality_bin, overwrite=args.force, group_size=size, labels=labels if all(labels) else None)
    elif args.command == "decompress":
        reads = archive.read_archive(spark, args.input, ("names", "sequence") if args.fasta else archive.STREAMS)
        if args.split:
            archive.write_split(reads, args.output, args.split, args.gzip, args.force)
        else:
            archive.write_fastq(reads, args.output, args.fasta, args.gzip, args.force)
    elif args.command == "info":
        told = archive.info(spark, args.input).first().asDict()
        if args.content:
            told |= content_stats(archive.read_archive(spark, args.input)).drop("reads", "qual_hist").first().asDict()
        print(json.dumps(told) if args.json else "\n".join(f"{k}\t{v}" for k, v in told.items()))
    else:
        checks = archive.verify(spark, args.input, args.quick).collect()
        print(json.dumps({c["check"]: c.ok for c in checks}) if args.json else "\n".join(f"{c['check']}\t{'ok' if c.ok else 'FAILED'}" for c in checks))
        return 0 if all(c.ok for c in checks) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
