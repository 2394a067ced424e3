"""One of each group of overlapping calls, chosen in a fixed order.

Calls that cannot overlap are parted first: by runs of anchors or of regions, found
by a sweep. Only a run goes to a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators import intervals


def _meets(boxes: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Whether box i shares a position in every dimension (pairs of columns) with the others."""
    out = np.ones(len(others), dtype=bool)
    for d in range(0, boxes.shape[1], 2):
        out &= (boxes[i, d] <= boxes[others, d + 1]) & (boxes[others, d] <= boxes[i, d + 1])
    return out


def strongest(boxes: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the best of each group. In order, an unclaimed box takes all later ones that meet a box of its group; the
    best of each group stays, and then every box that meets none that stays."""
    claimed, kept = np.zeros(len(boxes), bool), []
    for i in range(len(boxes)):
        if claimed[i]:
            continue
        reached = np.zeros(len(boxes), bool)
        group = [i]
        # later boxes join in order, each seen once: it must meet a member found before it
        hit = _meets(boxes, i, np.arange(len(boxes)))
        for j in range(i + 1, len(boxes)):
            if hit[j] and not reached[j]:
                reached[j] = claimed[j] = True
                group.append(j)
                hit = hit | _meets(boxes, j, np.arange(len(boxes)))
        kept.append(max(group, key=lambda g: (score[g], -group.index(g))))
    return _uncovered(boxes, kept)


def shortest(boxes: np.ndarray) -> np.ndarray:
    """Places of the boxes that claim others, in order, and then of those that meet none that stays."""
    claimed, kept = np.zeros(len(boxes), bool), []
    for i in range(len(boxes)):
        if not claimed[i]:
            kept.append(i)
            later = np.arange(i + 1, len(boxes))
            claimed[later[_meets(boxes, i, later)]] = True
    return _uncovered(boxes, kept)


def _uncovered(boxes: np.ndarray, kept: list[int]) -> np.ndarray:
    kept = list(dict.fromkeys(kept))
    for i in range(len(boxes)):
        if not _meets(boxes, i, np.array(kept, dtype=int)).any():
            kept.append(i)
    return np.array(kept, dtype=int)


def _per_run(calls: DataFrame, start: str, end: str, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """``of`` on the calls of each run of [start, end]."""
    runs = intervals.stitch(calls.select("chrom", F.col(start).alias("start"), F.col(end).alias("end")), 0)
    # names of our own, as calls may have a start and an end too
    at = calls.select("chrom", F.col(start).alias("pos"), F.struct(*calls.columns).alias("call"))
    told = intervals.hits(at, "pos", runs.select("chrom", "start", "end")).select("call.*", F.col("start").alias("_run"))
    # named columns decide the schema, in the order of ``calls``
    return told.groupBy("chrom", "_run").applyInPandas(lambda d: of(d.drop(columns="_run")), schema or calls.schema)


def best_loops(loops: DataFrame, score: str = "es", rounds: int = 2) -> DataFrame:
    """Loops (chrom, start_a, end_a, start_b, end_b, ...) of which no group overlaps: the best score of each; ``rounds`` times over."""
    def of(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["start_a", "start_b", "end_a", "end_b"], kind="stable").reset_index(drop=True)
        for _ in range(rounds):
            d = d.iloc[strongest(d[["start_a", "end_a", "start_b", "end_b"]].to_numpy(), d[score].to_numpy(float))].reset_index(drop=True)
        return d

    return _per_run(loops, "start_a", "end_a", of)


def shortest_peaks(peaks: DataFrame) -> DataFrame:
    """Peaks (chrom, start, end, length, ...) none of which overlaps a shorter one that stays."""
    def of(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["length", "start", "end"], kind="stable").reset_index(drop=True)
        return d.iloc[shortest(d[["start", "end"]].to_numpy())]

    return _per_run(peaks, "start", "end", of)


def merged_domains(domains: DataFrame, share: float = 0.9) -> DataFrame:
    """Domains (chrom, start, end, ss, rank, ...) of several settings, in order of rank and start: one that shares more than
    ``share`` of the longer length with an earlier one takes its place if its score is higher, and goes otherwise."""
    def of(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["rank", "start", "end"], kind="stable").reset_index(drop=True)
        start, end, ss = (d[c].to_numpy(float) for c in ("start", "end", "ss"))
        kept: list[int] = []
        for _, places in d.groupby("rank", sort=True).groups.items():
            if not kept:  # the domains of the first setting all stay
                kept = list(places)
                continue
            for i in places:
                k = np.array(kept)
                long = np.maximum(end[i] - start[i], end[k] - start[k])
                same = (start[k] <= end[i]) & (start[i] <= end[k]) & ((np.minimum(end[i], end[k]) - np.maximum(start[i], start[k])) / np.maximum(long, 1) > share)
                if not same.any():
                    kept.append(i)
                elif ss[i] > ss[kept[int(same.argmax())]]:
                    kept[int(same.argmax())] = i
        return d.iloc[kept]

    return _per_run(domains, "start", "end", of)


def united_loops(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Both sets of loops: one of ``a`` and the first of ``b`` that it overlaps become their common box, and that one of ``b`` is used up.

    Gives loop_id, chrom and the box; ids tell the samples.
    """
    columns = ["loop_id", "chrom", "start_a", "end_a", "start_b", "end_b"]
    rows = None
    for of, frame in enumerate((a, b)):
        one = frame.select(F.col("loop_id").cast("string").alias("loop_id"), *columns[1:], F.lit(of).alias("of"))
        rows = one if rows is None else rows.unionByName(one)

    def unite(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["of", "start_a", "start_b", "end_a", "end_b", "loop_id"], kind="stable").reset_index(drop=True)
        boxes = d[columns[2:]].to_numpy()
        mine, free = d.index[d["of"] == 0], list(d.index[d["of"] == 1])
        out = []
        for i in mine:
            hit = np.flatnonzero(_meets(boxes, i, np.array(free, dtype=int)))
            if len(hit):
                j = free.pop(int(hit[0]))
                low, high = np.minimum(boxes[i], boxes[j]), np.maximum(boxes[i], boxes[j])
                out.append((f"{d.loop_id[i]}|{name_a}|{d.loop_id[j]}|{name_b}", d.chrom[i], low[0], high[1], low[2], high[3]))
            else:
                out.append((f"{d.loop_id[i]}|{name_a}", d.chrom[i], *boxes[i]))
        out += [(f"{d.loop_id[j]}|{name_b}", d.chrom[j], *boxes[j]) for j in free]
        return pd.DataFrame(out, columns=columns)

    return _per_run(rows, "start_a", "end_a", unite, "loop_id string, chrom string, start_a long, end_a long, start_b long, end_b long")
