"""Row groups: files are cut where a limit of reads or of bases is met."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def cut_groups(reads: DataFrame, max_reads: int, max_bases: int, group_size: int = 1) -> DataFrame:
    """(file, read_id, row_group). A group ends with the spot in which it
    reaches max_reads (rounded down to whole spots) or max_bases. As each cut
    depends on the one before, a file is folded in one task; only numbers and
    lengths are shuffled, and a task holds two counters."""
    most = max(max_reads // group_size, 1) * group_size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, group, n, bases = object(), 0, 0, 0
        for frame in frames:
            out = []
            for f, size in zip(frame["file"], frame["size"], strict=True):
                if f != file:
                    file, group, n, bases = f, 0, 0, 0
                elif n % group_size == 0 and (n >= most or bases >= max_bases):
                    group, n, bases = group + 1, 0, 0
                n, bases = n + 1, bases + int(size)
                out.append(group)
            yield pd.DataFrame({"file": frame["file"], "read_id": frame["read_id"], "row_group": out})

    sizes = reads.selectExpr("file", "read_id", "coalesce(length(seq), 0) AS size")
    return sizes.repartition("file").sortWithinPartitions("file", "read_id").mapInPandas(run, "file string, read_id long, row_group long")
