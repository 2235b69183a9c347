"""Reads drawn from an invented genome; every read depends on the seed and its
number alone, so any partitioning gives the same reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Platform: read length, share of substituted bases, qualities drawn from.
PLATFORMS = {"novaseq": (150, 0.001, (2, 12, 23, 37)), "hiseq": (100, 0.002, tuple(range(2, 41))), "ont": (5000, 0.05, tuple(range(1, 41))), "hifi": (12000, 0.001, tuple(range(20, 94)))}


def _name(platform: str, i: int) -> str:
    if platform == "ont":
        h = f"{i:032x}"
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]} runid=0 read={i} ch={i % 512}"
    return f"m64001/{i}/ccs" if platform == "hifi" else f"SIM:1:FC:1:{1101 + i % 78}:{i % 32749}:{i} 1:N:0:ACGT"


def synthetic_reads(spark: SparkSession, n: int, platform: str = "novaseq", genome: int = 1 << 20, seed: int = 42) -> DataFrame:
    """n reads (read_id, name, seq, qual) of a platform. Places in the genome
    are made by a hash of their number, so no genome is sent to the tasks."""
    from ..functions.hashes import hash64

    length, errors, quals = PLATFORMS[platform]
    length = min(length, genome)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases, marks = np.frombuffer(b"ACGT", np.uint8), np.array([q + 33 for q in quals], np.uint8)
        for frame in frames:
            for at in range(0, len(frame), 256):  # bounds a batch of long reads
                rows = []
                for i in frame["id"].tolist()[at : at + 256]:
                    rng = np.random.default_rng([seed, i])
                    start = int(rng.integers(genome - length + 1))
                    code = (hash64(np.arange(start, start + length, dtype=np.uint64) + np.uint64(seed << 32)) & np.uint64(3)).astype(np.uint8)
                    wrong = rng.random(length) < errors
                    code[wrong] = (code[wrong] + rng.integers(1, 4, int(wrong.sum()))) % 4
                    if rng.integers(2):
                        code = 3 - code[::-1]
                    rows.append((i, _name(platform, i), bases[code].tobytes().decode(), marks[rng.integers(len(marks), size=length)].tobytes().decode()))
                yield pd.DataFrame(rows, columns=["read_id", "name", "seq", "qual"])

    return spark.range(n).mapInPandas(run, "read_id long, name string, seq string, qual string")
