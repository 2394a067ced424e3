"""Exact deduplication by a content sort.

Texts count as equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. Among equal texts the row with the most code
points in its original text stays; ties go to the smallest id, null ids last.

How it runs, all in the JVM:

1. One narrow pass counts rows per 64-bit hash of the normalised text, combined
   before the shuffle. Hashes with more than ``rows / (4 * partitions)`` rows, and
   more than ``FEW`` (which any task can hold), are *hot*; there are at most
   ``4 * partitions`` of them by construction, which is the proven bound under
   which that list is broadcast.
2. Cold rows are range-partitioned by sampled splitters over (leading
   characters, hash), sorted externally by the whole normalised text, and
   neighbours are compared in full by the window operator.
3. Hot groups never meet in one task: every task sorts and combines its own
   copies by full text first, so that each task ships one row for each group.

Defined results: a null text counts as empty (all empty texts are one group);
a null id is allowed and sorts last; among fully repeated rows exactly one is
kept; an empty table gives an empty result; columns other than the two named
are carried or ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.session import partitions, prepare

#: The white space that does not count.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Characters of the normalised text that lead the range key: splitters are sampled keys and come to the driver, so whole texts cannot be.
LEAD = 64
#: Rows of a group that are sorted in one task, whatever the size of the table.
FEW = 1_000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _hot(docs: DataFrame, text: str, width: int, few: int) -> DataFrame:
    """Hashes of the groups that are too large for one task: at most 4 * width rows."""
    # one read of the texts: only groups above ``few`` can be hot, and the counts are 16 bytes a group
    counts = docs.select(F.xxhash64(normalised(F.col(text))).alias("h")).groupBy("h").count().checkpoint()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.where(F.col("count") > max(few, total // (4 * width))).select("h")


def _packed(docs: DataFrame, id: str, text: str, carry: Column) -> DataFrame:
    """id, n (code points), row (what is carried) and h, under names of our own."""
    return docs.select(
        F.col(id).alias("id"),
        F.col(text).alias("text"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        F.xxhash64(normalised(F.col(text))).alias("h"),
        carry.alias("row"),
    )


def _sorted(cold: DataFrame, width: int):
    """Cold rows in content order, with the window that compares neighbours in full."""
    ranged = cold.withColumn("lead", F.substring(normalised(F.col("text")), 1, LEAD)).repartitionByRange(width, "lead", "h")
    ranged = ranged.withColumn("norm", normalised(F.col("text")))
    group = Window.partitionBy("lead", "h", "norm")
    return ranged, group, group.orderBy(F.desc("n"), F.asc_nulls_last("id"))


def _best() -> Column:
    """Smallest for the row that stays."""
    return F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    width = partitions(prepare(docs.sparkSession))
    hot = F.broadcast(_hot(docs, text, width, few))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = _packed(docs, id, text, whole)
    ranged, _, order = _sorted(packed.join(hot, "h", "left_anti"), width)
    cold = ranged.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
    large = (
        packed.join(hot, "h", "left_semi")
        .groupBy("h", normalised(F.col("text")).alias("norm"))
        .agg(F.min_by("row", _best()).alias("row"))
        .select("row.*")
    )
    return cold.unionByName(large)


def duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars."""
    width = partitions(prepare(docs.sparkSession))
    hot = F.broadcast(_hot(docs, text, width, few))
    packed = _packed(docs, id, text, F.lit(None))
    ranged, group, order = _sorted(packed.join(hot, "h", "left_anti"), width)
    cold = ranged.select(
        "id",
        F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
        "n",
    )
    # The hot rows are written once, narrow, so that both uses see the same place numbers.
    rows = (
        packed.join(hot, "h", "left_semi")
        .withColumn("norm", normalised(F.col("text")))
        .select("id", "n", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("place"))
        .checkpoint()
    )
    best = rows.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "place")).alias("best"),
    )
    large = rows.join(F.broadcast(best), "sha").select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n",
    )
    return cold.unionByName(large).withColumnsRenamed({"id": id, "n": "n_chars"})
