"""Similarity join on word n-grams: MinHash banding, then full verification.

1. Every text becomes the set of hashes of its n-grams of words (a text with
   fewer than n words is one n-gram). Texts with equal sets form one class, so
   that copies are never paired with each other; a class keeps its smallest id.
2. Class representatives get a MinHash signature, cut into bands. Band and row
   counts are the cheapest that find a pair at the threshold with the target
   recall. Rows meet on the band hash, and each points to the smallest id of its
   bucket: as many edges as rows, never the pairs of a bucket. The connected
   components of these edges are the clusters; any pair that shares a bucket is
   in one cluster.
3. A cluster is cut into blocks of bounded rows and n-grams, within levels of set
   size: sizes of a similar pair are in one level or in neighbouring ones. Every
   two blocks that can hold similar texts meet in one task, which compares full
   n-gram sets, made again from the texts. N-grams that occur in the same texts
   of the task count as one column with a weight, and the sizes of all
   intersections are one matrix product. A task returns, for each text with a
   link, the number of its links and the smallest text it reaches within the
   task, or the links themselves for ``pairs``.

Links are between classes; ``n_links`` counts the classes that a document's class
is linked to. ``group_id`` is the smallest id of the connected component of
links. Components merge edges before they follow them, so that a hub of many
near copies is neither joined edge by edge nor sent to one task, and classes and
buckets with many rows are joined by broadcast.

What grows faster than the corpus: every two distinct texts of a cluster in equal
or neighbouring levels of size are compared (one entry of a matrix product), as the
number of links of each text is asked for, and a text of a cluster of many blocks
is sent to each task of its block. A cluster of near copies that grows with the
corpus costs the square of its size in CPU. A loose cluster, chained by texts that
are somewhat alike, is compared in full as well. Blocks bound the memory of a
task, and tasks are independent.

Defined results: words are ``[^\\W_]+`` in lower case; a null text counts as
empty, and a text without words has the empty set: such texts are one class
without links. Null ids get null ids, classes and groups and no links. An empty
table gives an empty result. Repeated rows appear each, and ``keep_one`` keeps or
drops them together. Rows that share an id but not their n-grams are different
documents: each has the links of its own text, and one going does not take the
other along; ids in the result do not tell them apart.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.network import components, spread_join
from contactloom.session import prepare

#: Words in an n-gram, similarity of a link, recall of a pair exactly at it.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Places of texts in tasks that may be broadcast (some 60 bytes each); more of them are shuffled.
BROADCAST_PLACES = 500_000
#: Texts and n-grams of a block; a task holds two blocks.
BLOCK_ROWS, BLOCK_GRAMS = 1024, 2_000_000
#: Columns of one step of the matrix product.
COLUMNS = 4096
_words = re.compile(r"[^\W_]+").findall


def banding(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): of the ten-row-at-most choices that reach the recall within 256 hashes, the most selective."""
    best = (1, 1)
    for rows in range(1, 11):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= 256 and bands <= 40:
            best = (bands, rows)
    return best


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams."""
    words = _words((text or "").lower())
    if not words:
        return np.empty(0, dtype=np.int64)
    codes: dict[str, int] = {}
    for word in words:
        if word not in codes:
            data = word.encode("utf-8", "surrogatepass")
            codes[word] = zlib.crc32(data) << 32 | zlib.crc32(data[::-1], 0x9E3779B9)
    h = _mix(np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words)))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, len(words) if len(words) < n else n, dtype=np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out.view(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the signature."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    g = grams.view(np.uint64)
    for i in range(0, len(g), 1024):  # blocks bound the memory of very long texts
        low = np.minimum(low, _mix(g[None, i : i + 1024] ^ seeds[:, None]).min(axis=1))
    out = np.zeros(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _signed(docs: DataFrame, id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, th (a hash of the text), node, key (a digest of the n-gram set), size and band hashes of every row: the sets are not shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            flat = [band_hashes(g, bands, rows) if len(g) else g for g in sets]
            ends = np.cumsum([0] + [len(f) for f in flat]).astype(np.int32)
            hashes = pa.array(np.concatenate([*flat, np.empty(0, dtype=np.int64)]))
            keys = [_digest(g) for g in sets]
            nodes = [None if i is None else _node(i, k) for i, k in zip(batch.column(0).to_pylist(), keys, strict=True)]
            arrays = [
                batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(keys, pa.binary()),
                pa.array([len(g) for g in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), hashes),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "node", "key", "n", "bands"])

    return _narrow(docs, id, text).mapInArrow(run, "id long, th long, node binary, key binary, n int, bands array<bigint>")


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _node(id: int, key: bytes) -> bytes:
    """Id and digest as bytes that sort by id: rows that share an id but not their n-grams are told apart."""
    return (id + (1 << 63)).to_bytes(8, "big") + key


def _id_of(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (number - F.expr("9223372036854775808BD")).cast("long")


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """Node, n-gram set and places of the rows whose id and set are those of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            right = [i for i, (g, of) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if _digest(g) == of[8:]]
            sets = [sets[i] for i in right]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = pa.array(np.concatenate([*sets, np.empty(0, dtype=np.int64)]))
            rest = batch.take(pa.array(right, pa.int32()))
            arrays = [rest.column("node"), pa.ListArray.from_arrays(pa.array(ends), flat), rest.column("places")]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "grams", "places"])

    return rows.mapInArrow(run, f"node binary, grams array<bigint>, places array<{PLACE}>")


PLACE = "struct<la:int,ia:int,lb:int,ib:int,side:int,cluster:binary>"
TASK = ["cluster", "la", "ia", "lb", "ib"]


def _clusters(classes: DataFrame) -> DataFrame:
    """Node and cluster of the representatives that share a bucket with another.

    A bucket's rows all point to its smallest node. Common buckets are joined by
    broadcast, so that none of them fills a task.
    """
    banded = classes.where("n > 0").select("node", F.explode("bands").alias("h"))
    lows = banded.groupBy("h").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").checkpoint()
    total = lows.agg(F.sum("c")).first()[0] or 0
    stars = spread_join(banded, lows, "h", total).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(stars).withColumnRenamed("component", "cluster")


def _places(clusters: DataFrame, classes: DataFrame, similarity: float, block_rows: int, block_grams: int) -> DataFrame:
    """Node and the tasks of every clustered representative.

    A cluster that fits one block has one task. Otherwise blocks are numbered
    within a level; block i of level la meets block j of level lb for lb = la,
    i <= j, and for lb = la + 1. ``side`` is 0 where a block meets itself, else
    1 or 2.
    """
    width = math.log(1 / similarity) * (1 + 1e-9)
    rows = clusters.join(classes.select("node", "class_id", "n"), "node")
    rows = rows.withColumn("l", F.floor(F.log("n") / width).cast("int")).checkpoint()
    levels = rows.groupBy("cluster", "l").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    levels = levels.withColumn("m", F.ceil(F.greatest(F.col("c") / block_rows, F.col("s") / block_grams)).cast("int"))
    large = levels.groupBy("cluster").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("l", "m"))).alias("blocks"))
    large = large.where((F.col("c") > block_rows) | (F.col("s") > block_grams)).select("cluster", "blocks", "c")
    rows = spread_join(rows, large, "cluster", rows.count(), how="left").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("l")]).cast("int"))

    def meets(level: Column, place: Callable[[Column], Column]) -> Column:
        count = F.coalesce(F.try_element_at("blocks", level), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), place)).otherwise(F.array().cast(f"array<{PLACE}>"))

    def place(la: Column, ia: Column, lb: Column, ib: Column, side: Column) -> Column:
        named = zip(("la", "ia", "lb", "ib", "side"), (la, ia, lb, ib, side), strict=True)
        return F.struct(*[c.cast("int").alias(k) for k, c in named], F.col("cluster")).cast(PLACE)

    zero, l, i = F.lit(0), F.col("l"), F.col("i")
    own = meets(l, lambda j: place(l, F.least(i, j), l, F.greatest(i, j), F.when(i == j, 0).when(i < j, 1).otherwise(2)))
    above = meets(l + 1, lambda j: place(l, i, l + 1, j, F.lit(1)))
    below = meets(l - 1, lambda j: place(l - 1, j, l, i, F.lit(2)))
    alone = F.array(place(zero, zero, zero, zero, zero))
    return rows.select(F.col("class_id").alias("id"), "node", F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(own, above, below)).alias("places"))


def shared_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate([*sets, np.empty(0, dtype=np.int64)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.r_[starts, len(flat)])
    starts, counts = starts[counts > 1], counts[counts > 1]
    if not len(starts):
        return out
    # n-grams of the same texts have the same sum of codes: one column with their number as weight
    total = np.r_[np.uint64(0), np.cumsum(_mix(owner.astype(np.uint64) + np.uint64(1)))]
    _, first, weight = np.unique(total[starts + counts] - total[starts], return_index=True, return_counts=True)
    for at in range(0, len(first), COLUMNS):
        some = first[at : at + COLUMNS]
        lens = counts[some]
        column = np.repeat(np.arange(len(some)), lens)
        places = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts[some], lens)
        x = np.zeros((len(sets), len(some)))
        x[owner[places], column] = 1
        out += (x[left] * weight[at : at + COLUMNS]) @ x[right].T
    return out


def _linked(similarity: float, pairs: bool) -> Callable[[pa.Table], pa.Table]:
    """Compares the blocks of one task: its links (pairs), or for each node with a link their number and the smallest node in reach."""

    def run(task: pa.Table) -> pa.Table:
        # repeated rows of a node carry the same set
        first: dict[bytes, int] = {}
        for i, node in enumerate(task.column("node").to_pylist()):
            first.setdefault(node, i)
        nodes = sorted(first)
        task = task.take(pa.array([first[k] for k in nodes], pa.int64()))
        side, grams = task.column("side").to_numpy(), task.column("grams").combine_chunks()
        ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        shared, sizes = shared_grams(sets, left, right), np.diff(ends).astype(np.float64)
        score = np.zeros((len(nodes), len(nodes)))
        score[np.ix_(left, right)] = shared / (sizes[left][:, None] + sizes[right][None, :] - shared)
        score = np.maximum(score, score.T)
        np.fill_diagonal(score, 0)
        hit = score >= similarity
        if pairs:
            a, b = np.nonzero(np.triu(hit))
            return pa.table([pa.array([nodes[i] for i in x], pa.binary()) for x in (a, b)] + [pa.array(score[a, b])], names=["a", "b", "jaccard"])
        low = np.arange(len(nodes))
        while True:
            near = np.minimum(low, np.where(hit, low[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
            near = near[near]
            if (near == low).all():
                break
            low = near
        some = np.flatnonzero(hit.any(axis=1))
        names = [pa.array([nodes[i] for i in x], pa.binary()) for x in (some, low[some])]
        return pa.table([names[0], pa.array(hit[some].sum(axis=1).astype(np.int64)), names[1]], names=["node", "n_links", "low"])

    return run


def _join(docs: DataFrame, id: str, text: str, pairs: bool, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL,
          block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, found): every row with its key, the classes of equal n-gram sets, and what the tasks find."""
    prepare(docs.sparkSession)
    rows = _signed(docs, id, text, n, *banding(similarity, recall)).checkpoint()
    # only the smallest node of a class carries its bands on; map-side combined
    classes = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("node").alias("node"), F.min_by(F.struct("id", "n", "bands"), "node").alias("s"), F.count(F.lit(1)).alias("c"))
    classes = classes.select("key", "node", F.col("s.id").alias("class_id"), "s.n", "s.bands", "c").checkpoint()
    places = _places(_clusters(classes), classes, similarity, block_rows, block_grams).checkpoint()
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    texts = _narrow(docs, id, text).drop("th").join(F.broadcast(places) if few else places, "id")
    sets = _sets(texts, n).select("node", "grams", F.explode("places").alias("p")).select("node", "grams", "p.*")
    schema = "a binary, b binary, jaccard double" if pairs else "node binary, n_links long, low binary"
    return rows, classes, sets.groupBy(*TASK).applyInArrow(_linked(similarity, pairs), schema)


def pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """a, b and jaccard of the linked classes, named by their smallest ids, a <= b (equal only where two texts share an id)."""
    found = _join(docs, id, text, True, **options)[2]
    return found.select(_id_of(F.col("a")).alias("a"), _id_of(F.col("b")).alias("b"), "jaccard")


def _grouped(docs: DataFrame, id: str, text: str, **options: float) -> DataFrame:
    """id, th, node, n, class_id, group (the smallest node of its component, null without links) and n_links of every row."""
    rows, classes, found = _join(docs, id, text, False, **options)
    found = found.checkpoint()
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "group")
    linked = counts.join(groups, "node")
    about = classes.select("key", "node", "class_id", "c").join(linked, "node", "left").select("key", F.col("node").alias("class"), "class_id", "group", "n_links", "c")
    return spread_join(rows.drop("bands"), about, "key", rows.count(), how="left")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """One row for each row: id, class_id, group_id and n_links (the classes that its class is linked to)."""
    named = F.col("id").isNotNull()
    group = F.coalesce(_id_of(F.col("group")), F.col("class_id"))
    return _grouped(docs, id, text, **options).select(
        F.col("id").alias(id), F.when(named, F.col("class_id")).alias("class_id"), F.when(named, group).alias("group_id"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The documents with the smallest id of their group; rows with a null id, and texts without words, all stay."""
    kept = F.coalesce("group", "class")
    gone = _grouped(docs, id, text, **options).where((F.col("n") > 0) & (F.col("node") != kept)).select("id", "th").distinct()
    names = [k + "_" * max(map(len, docs.columns)) for k in ("id", "th")]
    here = (F.col(f"`{id}`").cast("long") == F.col(names[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names[1]))
    return docs.join(gone.toDF(*names), here, "left_anti")
