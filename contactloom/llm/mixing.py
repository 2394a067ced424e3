"""Mixing sources to target weights.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Sources in code-point order (null last)
weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of all sizes. A source is never
repeated more than twice: a share above twice its size stops there, and what is
over is shared again by weight among the rest until no share is above.

A source's repetition rate is target / size. Each document is emitted
floor(rate) times, plus once more if the hash of its id, read as a number in
[0, 1), is below the fraction. Hashes make reruns agree and need no shuffle.

Everything is DataFrame operations. Sums per source are combined before the
shuffle, so a source with a third of all rows costs one row per task. Ranks are
found by a range sort of the (small) source table and per-partition offsets,
never by one task that sees every source.

Defined results: null or empty text has size 0 and takes 0 words; a null source
is a source of its own, last in order; a null id draws by its text;
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactloom.session import partitions, prepare

#: Weights in turn, the share of all sizes, and the repetition limit.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Up to this many sources the rate table is broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000


def size_in_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def fraction(id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id, or from the text where that is null: the first 32 bits of an MD5."""
    digits = F.substring(F.md5(F.coalesce(id.cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit(""))))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in code-point order, null last."""
    width = partitions(sources.sparkSession)
    placed = (
        sources.repartitionByRange(width, F.asc_nulls_last("source"))
        .sortWithinPartitions(F.asc_nulls_last("source"))
        .withColumn("mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    part, row = F.shiftright("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count()  # at most one row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(before), "part")
        .select("source", "source_size", (F.col("before") + row).alias("rank"))
    )


def _level(sources: DataFrame, share: float) -> tuple[float, int]:
    """The level at which min(limit, level * weight) sums to the budget, and the number of sources.

    Each round caps the sources that are above and shares the rest again; a round
    returns one row of sums, whatever the number of sources.
    """
    level = 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        left, weight, total, n = sources.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)),
            F.sum("source_size"),
            F.count(F.lit(1)),
        ).first()
        if not n or not weight:
            return level, n or 0
        new = (share * total - left) / weight
        if new <= level:
            return level, n
        level = new


def rates(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> tuple[DataFrame, int]:
    """source, source_size, target and rate for each source, and the number of sources."""
    prepare(docs.sparkSession)
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size_in_words(F.col(text))).alias("source_size"))
    turn = F.lit([float(x) for x in weights])
    sources = (
        _ranked(sums)
        .withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * float(limit))
        .checkpoint()
    )
    level, n = _level(sources, share)
    target = F.least("cap", F.lit(level) * F.col("weight"))
    out = sources.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), n


def plan(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", carry: Column | None = None, **how) -> DataFrame:
    """One row for each document: id, size, source_size, target, copies (and ``row``, if carried)."""
    table, n = rates(docs, source, text, **how)
    table = table.withColumnRenamed("source", "of")
    rows = docs.select(
        F.col(id).alias("id"),
        F.col(source).alias("from"),
        size_in_words(F.col(text)).alias("size"),
        fraction(F.col(id), F.col(text)).alias("draw"),
        *([carry.alias("row")] if carry is not None else []),
    )
    joined = rows.join(F.broadcast(table) if n <= BROADCAST_SOURCES else table, F.col("from").eqNullSafe(F.col("of")))
    extra = (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).drop("from", "of", "rate", "draw")


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixture: every document as many times as the plan takes it, with all columns of ``docs``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    planned = plan(docs, id, source, text, carry=whole, **how).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
