"""bigWig files as rows (chrom, start, end, value).

The driver reads the chromosome tree and the index, a few bytes for each block of
some hundred values; executors read and unpack the blocks. The file must lie where
executors can open it too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Magic numbers of the file, its chromosome tree and its index.
FILE, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
SCHEMA = "chrom string, start long, end long, value double"


def _chromosomes(f, at: int, order: str) -> dict[int, tuple[str, int]]:
    f.seek(at)
    magic, _, key, _, _, _ = struct.unpack(order + "IIIIQQ", f.read(32))
    if magic != TREE:
        raise ValueError("no chromosome tree")
    out: dict[int, tuple[str, int]] = {}
    todo = [at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, count = struct.unpack(order + "BBH", f.read(4))
        for _ in range(count):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack(order + "II", f.read(8))
                out[number] = (name, size)
            else:
                todo.append(struct.unpack(order + "Q", f.read(8))[0])
    return out


def _blocks(f, at: int, order: str) -> Iterator[tuple[int, int]]:
    f.seek(at)
    if struct.unpack(order + "I", f.read(4))[0] != INDEX:
        raise ValueError("no index")
    todo = [at + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, count = struct.unpack(order + "BBH", f.read(4))
        size = 32 if leaf else 24
        data = f.read(size * count)
        for i in range(count):
            if leaf:
                yield struct.unpack_from(order + "QQ", data, i * size + 16)
            else:
                todo.append(struct.unpack_from(order + "Q", data, i * size + 16)[0])


def head(path: str) -> tuple[str, int, dict[int, tuple[str, int]], list[tuple[int, int]]]:
    """Byte order, size of the unpacking buffer (0: blocks are not packed), chromosomes by number, and the place and size of all blocks."""
    with open(path, "rb") as f:
        data = f.read(64)
        order = "<" if struct.unpack("<I", data[:4])[0] == FILE else ">"
        if struct.unpack(order + "I", data[:4])[0] != FILE:
            raise ValueError(f"{path} is no bigWig file")
        tree, _, index = struct.unpack_from(order + "QQQ", data, 8)
        packed = struct.unpack_from(order + "I", data, 52)[0]
        return order, packed, _chromosomes(f, tree, order), sorted(_blocks(f, index, order))


def values(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome number, starts, ends and values of an unpacked block."""
    number, start, _, step, span, kind, _, count = struct.unpack_from(order + "IIIIIBBH", data, 0)
    body = np.frombuffer(data, dtype=np.dtype("u4").newbyteorder(order), offset=24)
    real = body.view(np.dtype("f4").newbyteorder(order))
    if kind == 1:
        starts, ends, v = body[0 : 3 * count : 3], body[1 : 3 * count : 3], real[2 : 3 * count : 3]
    elif kind == 2:
        starts, v = body[0 : 2 * count : 2], real[1 : 2 * count : 2]
        ends = starts + span
    else:
        starts, v = start + step * np.arange(count), real[:count]
        ends = starts + span
    return number, starts.astype(np.int64), ends.astype(np.int64), v.astype(np.float64)


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """All values of the file; a block is read by the executor that needs it."""
    order, packed, chromosomes, blocks = head(path)
    names = {k: name for k, (name, _) in chromosomes.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as f:
            for batch in batches:
                for at, size in zip(batch["at"], batch["size"], strict=True):
                    f.seek(at)
                    data = f.read(size)
                    number, starts, ends, v = values(zlib.decompress(data) if packed else data, order)
                    yield pd.DataFrame({"chrom": names[number], "start": starts, "end": ends, "value": v})

    told = spark.createDataFrame(blocks, "at long, size long") if blocks else spark.createDataFrame([], "at long, size long")
    return told.repartition(max(1, min(len(blocks) // 64, 10_000) + 1)).mapInPandas(run, SCHEMA)
