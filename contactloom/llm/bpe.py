"""Byte-level BPE by the ranks of a public vocabulary file.

A text is cut by the vocabulary's pattern; every match is encoded separately.
A match that is itself a token is that token. Else its bytes are merged: a
segment tree over byte positions stores, for each live pair, its rank and place,
so that its root is the leftmost pair of least rank; each merge updates three
leaves (the pair, its left neighbour, the absorbed one) in logarithmic time. A
match of n bytes costs O(n log n), however long it is. Short matches that are not
yet known are merged together, one tree per row of an array, in numpy.

The ranks are one file of fixed size; the driver reads it from the path given and
broadcasts its bytes. Texts stream through Arrow batches, a row in, a row out.

Defined results: a null text counts as empty, with no tokens and no bytes;
special tokens are ordinary text; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Matches that the cache holds, the bytes up to which a match is short, and the
#: characters of text that are cut at a time.
CACHED, SHORT, CHUNK = 300_000, 64, 1_000_000
#: Stands for no pair.
FAR = 1 << 40


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token -> rank from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class RankTree:
    """Minimum segment tree over the starts of live pairs: the root is the leftmost least rank."""

    def __init__(self, ranks: Sequence[int | None]):
        self.width = 1
        while self.width < len(ranks):
            self.width *= 2
        self.far = 1 << 62
        # rank and place in one integer: its order is by rank, then from the left
        leaves = [self.far if r is None else r * self.width + i for i, r in enumerate(ranks)]
        self.tree = [self.far] * self.width + leaves + [self.far] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def set(self, place: int, rank: int | None) -> None:
        tree, i = self.tree, place + self.width
        tree[i] = self.far if rank is None else rank * self.width + place
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def least(self) -> int | None:
        """The place of the leftmost pair of least rank."""
        root = self.tree[1]
        return None if root == self.far else root % self.width


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The tokens of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the token that starts here; also the next live start
    before = list(range(-1, n - 1))
    tree = RankTree([get(piece[i : i + 2]) for i in range(n - 1)])
    while (at := tree.least()) is not None:
        gone = end[at]
        end[at] = after = end[gone]
        if gone < n - 1:
            tree.set(gone, None)
        if after < n:
            before[after] = at
            tree.set(at, get(piece[at : end[after]]))
        else:
            tree.set(at, None)
        left = before[at]
        if left >= 0:
            tree.set(left, get(piece[left:after]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return tuple(out)


class Pairs:
    """The ranks of all pairs of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.span = max(ranks.values(), default=-1) + 1
        found = [
            (a * self.span + b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        found.append((self.span * self.span, 0))  # above any key, so that a search ends inside
        keys = np.array(found, dtype=np.int64)
        keys = keys[np.argsort(keys[:, 0], kind="stable")]
        self.keys, self.ranks = keys[:, 0].copy(), keys[:, 1].copy()
        self.bytes = np.array([ranks.get(bytes([i]), 0) for i in range(256)], dtype=np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, FAR for those that are no token."""
        key = a * self.span + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], FAR)


def merge_rows(pieces: list[bytes], pairs: Pairs, width: int) -> list[tuple[int, ...]]:
    """The tokens of matches of 2 to ``width`` bytes: row r of every array is match r."""
    rows = len(pieces)
    size = np.array([len(p) for p in pieces])
    token = pairs.bytes[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)]
    token = np.pad(token, ((0, 0), (0, 1)))
    after = np.tile(np.arange(1, width + 2), (rows, 1))
    before = np.tile(np.arange(-1, width), (rows, 1))
    place = np.arange(width)
    ranks = pairs.of(token[:, :-1], token[:, 1:])
    leaves = np.where((place < size[:, None] - 1) & (ranks < FAR), ranks * width + place, FAR)
    levels = [leaves]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    live = np.arange(rows)
    while True:
        root = levels[-1][live, 0]
        live = live[root < FAR]
        if not len(live):
            break
        rank, at = np.divmod(root[root < FAR], width)
        gone = after[live, at]
        end = after[live, gone]
        after[live, at] = end
        token[live, at] = rank
        before[live, end] = at
        left = before[live, at]
        new = np.where(end < size[live], pairs.of(rank, token[live, end]), FAR)
        old = np.where(left >= 0, pairs.of(token[live, left], rank), FAR)
        left = np.maximum(left, 0)
        # the first place may have no left neighbour: then it is set twice, to the same value
        old = np.where(before[live, at] >= 0, old, new)
        row = np.concatenate([live, live, live])
        leaf = np.concatenate([gone, at, left])
        value = np.concatenate([np.full(len(live), FAR), new, old])
        levels[0][row, leaf] = np.where(value < FAR, value * width + leaf, FAR)
        for down, up in zip(levels, levels[1:]):
            leaf = leaf >> 1
            up[row, leaf] = np.minimum(down[row, 2 * leaf], down[row, 2 * leaf + 1])
    # walk the live starts of all rows together
    out: list[list[int]] = [[] for _ in range(rows)]
    live, at = np.arange(rows), np.zeros(rows, dtype=np.int64)
    while len(live):
        for r, t in zip(live.tolist(), token[live, at].tolist()):
            out[r].append(t)
        at = after[live, at]
        on = at < size[live]
        live, at = live[on], at[on]
    return list(map(tuple, out))


class Codec(dict):
    """Encodes and decodes; as a dict it holds the tokens of matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.cut = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * self.pairs.span
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]

    def learn(self, matches: Iterable[str]) -> None:
        """Holds the tokens of these matches."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            piece = match.encode()
            rank = self.ranks.get(piece)
            if rank is not None:
                self[match] = (rank,)
            elif len(piece) > SHORT:
                self[match] = merge(piece, self.ranks)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append((match, piece))
        for width, held in by_width.items():
            for i in range(0, len(held), 4096):
                part = held[i : i + 4096]
                self.update(zip([m for m, _ in part], merge_rows([p for _, p in part], self.pairs, width)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self.cut(text))
            chars += len(text)
            if chars >= CHUNK:
                yield from self._known(held)
                held, chars = [], 0
        yield from self._known(held)

    def _known(self, held: list[list[str]]) -> Iterator[list[int]]:
        if len(self) >= CACHED:
            self.clear()
        self.learn(set().union(*held).difference(self))
        get = self.__getitem__
        for matches in held:
            yield list(chain.from_iterable(map(get, matches)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def written(self, ids: Iterable[int]) -> bytes:
        """The ids as decimals, joined by one blank."""
        return " ".join(map(self.names.__getitem__, ids)).encode()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and Python process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def _mapped(docs: DataFrame, path: str, pattern: str, value: Column, carry: tuple[str, ...], fields: list, of) -> DataFrame:
    """of(codec, values) gives the values of ``fields`` for each row in turn."""
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*[F.col(c) for c in carry], value.alias("__value"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, coder = to_arrow_schema(schema), codec(held.value, pattern)
        for batch in batches:
            k = batch.num_columns - 1
            made = list(of(coder, (x.as_py() for x in batch.column(k))))
            new = [pa.array([m[i] for m in made], out.field(k + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new], names=out.names)

    return rows.mapInArrow(run, schema)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``ids`` (array of int)."""
    return _mapped(docs, path, pattern, _text(text), carry, [("ids", T.ArrayType(T.IntegerType()))], lambda c, xs: ((ids,) for ids in c.encode_all(xs)))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``decoded`` (binary); null ids count as none."""
    value = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return _mapped(tokens, path, pattern, value, carry, [("decoded", T.BinaryType())], lambda c, xs: ((c.decode(x),) for x in xs))


def _digest(c: Codec, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
    for ids in c.encode_all(texts):
        yield len(ids), hashlib.sha256(c.written(ids)).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes, decodes the ids, and keeps n_tokens, ids_sha256 and decoded_sha256."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, path, pattern, _text(text), carry, fields, _digest)
