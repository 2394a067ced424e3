"""Progressive JPEG: lossless payload storage, and a decoder to RGB tensors.

Decoding accumulates the scans (spectral selection and successive approximation)
into integer coefficient arrays, dequantises, inverse-transforms all blocks at
once in numpy, upsamples chroma to full resolution and gives an (h, w, 3) tensor.

Storing puts one payload byte into each coefficient of a YCbCr image with chroma
of half width and height: 64 bytes a block, in zigzag order, first the blocks of
Y, then of Cb and Cr, with unit quantisation, so that the coefficients read back
are the payload, bit for bit. Each component has five scans: DC without its last
bit, two bands of AC without their last bits, and two refinements. AC values are
offset by 256, which makes all of them nine bits wide: their scans are regular
and are packed and unpacked as arrays. As in any file, pixels are cut to 0..255;
the payload is read from the coefficients, which are not.

Read are grey and YCbCr files, 8 bits a sample, Huffman-coded, with scans of one
or of several components, restart markers and quantisation tables of 8 or 16
bits. Not read: baseline, lossless and arithmetic-coded files, 12 bits, RGB and
CMYK files of four components; they raise ``ValueError``. Chroma is upsampled by
repetition, without smoothing.

A row in, a row out; nothing is shuffled, one image at a time is decoded, and
tensors leave Python in batches of bounded size.

Defined results: a null text counts as empty; the empty payload is one block of
zeros; a damaged file raises ``ValueError``; repeated rows are stored each.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload bytes in a block, what AC values are offset by.
BLOCK, OFFSET = 64, 256
#: Blocks in a unit of 16 x 16 pixels (4 of luma, 1 of each chroma), units in a row of the image, rows that a file can have.
UNIT, ROW, TALL = 6, 512, 4095
#: What the comment of a stored file begins with; bytes of tensors after which a batch is given out.
STORED, BATCH_BYTES = b"payload", 1 << 24


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: diagonals, alternating in direction."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
#: A marker that ends a scan; restart markers, which do not.
MARKER = re.compile(rb"\xff(?![\x00\xd0-\xd7])").search
SPLIT = re.compile(rb"\xff+[\xd0-\xd7]").split
COSINES = np.array([[np.sqrt((2 if u else 1) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Table:
    """A Huffman table: the canonical code of each symbol."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.codes: dict[tuple[int, int], int] = {}
        code, left = 0, iter(symbols)
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[length, code] = next(left)
                code += 1
            code *= 2
        self.of = {s: key for key, s in self.codes.items()}

    def segment(self, kind: int) -> bytes:
        return bytes([kind, *self.counts, *self.symbols])

    def alone(self) -> int | None:
        """The only symbol, where there is one, and its code is one bit."""
        return self.symbols[0] if len(self.symbols) == 1 and self.counts[0] == 1 else None


def flat(symbols: list[int], length: int) -> Table:
    """All codes of one length."""
    return Table([len(symbols) if i == length else 0 for i in range(1, 17)], symbols)


DC, RUNS = flat(list(range(12)), 4), flat([r << 4 for r in range(15)], 4)
WIDE = flat([8], 1)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each value as ``width`` bits, highest first."""
    return ((values[..., None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def _packed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled with ones, a zero after each 255."""
    fill = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(fill, dtype=np.uint8)]))
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(component: int, first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low])) + _packed(bits)


def _scans(components: list[np.ndarray]) -> list[bytes]:
    """The five scans of each component's blocks: DC in 0..1023, AC in 256..511."""
    blocks, parts, start = np.concatenate(components), [], 0
    half = blocks[:, 0] >> 1
    diff = np.diff(half, prepend=0)
    for component in components:
        parts.append(slice(start, start + len(component)))
        diff[start] = half[start]
        start += len(component)
    size = np.where(diff, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(int) + 1, 0)
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    # the code of a category is the category; both together are 4 + size bits
    word = _bits((size << size) | value, 16)
    used = np.arange(16) >= 12 - size[:, None]
    # halves of AC values are eight bits wide
    coded = np.zeros((len(blocks), BLOCK - 1, 9), dtype=np.uint8)
    coded[:, :, 1:] = np.unpackbits((blocks[:, 1:] >> 1).astype(np.uint8).ravel()).reshape(-1, BLOCK - 1, 8)
    low = (blocks & 1).astype(np.uint8)
    refined = []
    for part in parts:
        words = []
        for at in range(part.start, part.stop, 0x7FFF):
            run = low[at : min(at + 0x7FFF, part.stop), 1:]
            size_of_run = len(run).bit_length() - 1
            words += [_bits(np.array(size_of_run), 4), _bits(np.array(len(run)), 16)[16 - size_of_run :], run.ravel()]
        refined.append(np.concatenate(words))
    of = list(enumerate(parts, 1))
    return [
        _segment(0xC4, DC.segment(0) + WIDE.segment(0x10)),
        *(_scan(c, 0, 0, 0, 1, word[part][used[part]]) for c, part in of),
        *(_scan(c, 1, 5, 0, 1, coded[part, :5].ravel()) for c, part in of),
        *(_scan(c, 6, 63, 0, 1, coded[part, 5:].ravel()) for c, part in of),
        *(_scan(c, 0, 0, 1, 0, low[part, 0]) for c, part in of),
        _segment(0xC4, RUNS.segment(0x10)),
        *(_scan(c, 1, 63, 1, 0, bits) for c, bits in enumerate(refined, 1)),
    ]


def write(width: int, height: int, components: list[tuple[int, int, np.ndarray]], quant: np.ndarray, comment: bytes = b"") -> bytes:
    """A progressive file from (h sampling, v sampling, blocks in zigzag order) for each component."""
    frame = struct.pack(">BHHB", 8, height, width, len(components))
    frame += b"".join(bytes([i, h << 4 | v, 0]) for i, (h, v, _) in enumerate(components, 1))
    head = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, bytes([0, *quant.tolist()])), _segment(0xC2, frame)]
    return b"".join([*head, *_scans([blocks for _, _, blocks in components]), b"\xff\xd9"])


class _Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table


class Image:
    """A decoded file: coefficients of each component, comment, size."""

    def __init__(self, data: bytes):
        self.comment, self.parts, self.quant = b"", {}, {}
        self.tables: dict[int, Table] = {}
        self.restart = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            if data[at + 1] == 0xFF:  # fill
                at += 1
                continue
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    size = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], dtype=">u2" if body[0] >> 4 else np.uint8).astype(np.int64)
                    body = body[1 + size :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    self.tables[body[0]] = Table(counts, list(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == 0xDA:
                end = found.start() if (found := MARKER(data, at)) else len(data)
                parts = SPLIT(data[at:end]) if self.restart else [data[at:end]]
                self._read(body, [np.unpackbits(np.frombuffer(p.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)) for p in parts])
                at = end
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only progressive files with Huffman codes")

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3) or not self.height or not self.width:
            raise ValueError("only grey or YCbCr files of 8 bits and known size")
        for i in range(n):
            key, hv, table = body[6 + 3 * i : 9 + 3 * i]
            self.parts[key] = _Component(hv >> 4, hv & 15, table)
        self.hmax, self.vmax = max(p.h for p in self.parts.values()), max(p.v for p in self.parts.values())
        for p in self.parts.values():
            p.wide = -(-self.width * p.h // (8 * self.hmax))
            p.high = -(-self.height * p.v // (8 * self.vmax))
            p.coefficients = np.zeros((p.wide * p.high, 64), dtype=np.int32)

    def _read(self, body: bytes, parts: list[np.ndarray]) -> None:
        """A scan; ``parts`` holds the bits between restarts."""
        n = body[0]
        picked = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n > 1:
            if first or last:
                raise ValueError("a scan of several components holds DC only")
            self._interleaved(picked, parts, high, low)
            return
        part, tables = picked[0]
        dc, ac = self.tables.get(tables >> 4), self.tables.get(0x10 | tables & 15)
        step = self.restart or len(part.coefficients)
        if len(parts) != -(-len(part.coefficients) // step):
            raise ValueError("restarts are missing")
        for k, bits in enumerate(parts):
            _blocks(part.coefficients[k * step : (k + 1) * step], bits, dc, ac, first, last, high, low)

    def _interleaved(self, picked: list[tuple[_Component, int]], parts: list[np.ndarray], high: int, low: int) -> None:
        """DC of several components: units of h x v blocks of each, also beyond the edges."""
        wide, tall = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        step = self.restart or wide * tall
        if len(parts) != -(-wide * tall // step):
            raise ValueError("restarts are missing")
        grids = [np.zeros((tall * p.v, wide * p.h), dtype=np.int64) for p, _ in picked]
        for k, bits in enumerate(parts):
            read, before = _Reader(bits), [0] * len(picked)
            for unit in range(k * step, min((k + 1) * step, wide * tall)):
                row, column = divmod(unit, wide)
                for i, (p, tables) in enumerate(picked):
                    for y in range(row * p.v, (row + 1) * p.v):
                        for x in range(column * p.h, (column + 1) * p.h):
                            if high:
                                grids[i][y, x] = read.take(1)
                            else:
                                before[i] += read.signed(read.symbol(self.tables[tables >> 4]))
                                grids[i][y, x] = before[i]
        for (p, _), grid in zip(picked, grids, strict=True):
            p.coefficients[:, 0] |= (grid[: p.high, : p.wide].ravel() << low).astype(np.int32)

    def pixels(self) -> np.ndarray:
        """The full-resolution RGB tensor."""
        planes, start = [], 0
        values = np.concatenate([p.coefficients * self.quant[p.table] for p in self.parts.values()])
        blocks = np.zeros(values.shape)
        blocks[:, ZIGZAG] = values
        blocks = COSINES.T @ blocks.reshape(-1, 8, 8) @ COSINES
        for p in self.parts.values():
            block = blocks[start : start + len(p.coefficients)]
            start += len(block)
            plane = block.reshape(p.high, p.wide, 8, 8).swapaxes(1, 2).reshape(8 * p.high, 8 * p.wide) + 128
            if (p.v, p.h) != (self.vmax, self.hmax):
                plane = plane[np.arange(self.height) * p.v // self.vmax][:, np.arange(self.width) * p.h // self.hmax]
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            rgb = planes * 3
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            # fixed values: the colour transform of the file format
            rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        return np.clip(np.rint(np.stack(rgb, axis=-1)), 0, 255).astype(np.uint8)


class _Reader:
    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | int(b)
        self.at += n
        return out

    def symbol(self, table: Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("a code that the table lacks")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _blocks(c: np.ndarray, bits: np.ndarray, dc: Table | None, ac: Table | None, first: int, last: int, high: int, low: int) -> None:
    """The blocks ``c`` of one component between two restarts."""
    if first == 0:
        if high:
            c[:, 0] |= bits[: len(c)].astype(np.int32) << low
        else:
            c[:, 0] = np.cumsum(_dc(bits, dc, len(c))) << low
    elif high:
        _refine(bits, ac, c, first, last, 1 << low)
    elif (only := ac.alone()) is not None and 0 < only < 16:
        n = last - first + 1
        words = bits[: len(c) * n * (only + 1)].reshape(len(c), n, only + 1)
        if words[:, :, 0].any():
            raise ValueError("a code that the table lacks")
        if only == 8:
            value = np.packbits(words[:, :, 1:].ravel()).reshape(len(c), n).astype(np.int32)
        else:
            value = words[:, :, 1:].astype(np.int32) @ (1 << np.arange(only - 1, -1, -1, dtype=np.int32))
        value = np.where(value >> (only - 1), value, value - (1 << only) + 1)
        c[:, first : last + 1] = value << low
    else:
        _first(bits, ac, c, first, last, low)


def _dc(bits: np.ndarray, table: Table, n: int) -> np.ndarray:
    """The n differences."""
    read = _Reader(bits)
    return np.array([read.signed(read.symbol(table)) for _ in range(n)], dtype=np.int64)


def _first(bits: np.ndarray, table: Table, c: np.ndarray, first: int, last: int, low: int) -> None:
    read, run = _Reader(bits), 0
    for block in c:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = read.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = read.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + read.take(zeros)
                break


def _refine(bits: np.ndarray, table: Table, c: np.ndarray, first: int, last: int, one: int) -> None:
    """Correction bits of known coefficients; new ones of size one between them."""
    read = _Reader(bits[:0])
    read.bits = bits  # sliced, not listed: most bits are taken in bulk

    def correct(rows: np.ndarray) -> None:
        known = rows != 0
        more = bits[read.at : read.at + int(known.sum())].astype(np.int32)
        read.at += len(more)
        rows[known] += np.where(rows[known] > 0, one, -one) * more

    i = 0
    while i < len(c):
        k = first
        while k <= last:
            symbol = read.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + read.take(zeros)
                if k > first:
                    correct(c[i, k : last + 1])
                correct(c[i + (k > first) : i + run, first : last + 1])
                i += run - 1
                break
            new = (one if read.take(1) else -one) if size else 0
            while k <= last:
                if c[i, k]:
                    if read.take(1):
                        c[i, k] += one if c[i, k] > 0 else -one
                elif zeros:
                    zeros -= 1
                else:
                    c[i, k] = new
                    k += 1
                    break
                k += 1
        i += 1


def store(data: bytes) -> bytes:
    """A progressive file that holds ``data``, filled up with zeros to a positive multiple of 64."""
    payload = np.frombuffer(data.ljust(max(BLOCK, len(data) + -len(data) % BLOCK), b"\0"), dtype=np.uint8)
    blocks = payload.reshape(-1, BLOCK).astype(np.int64)
    units = -(-len(blocks) // UNIT)
    high = min(-(-units // ROW), TALL)
    wide = -(-units // high)
    units = wide * high
    all_blocks = np.zeros((UNIT * units, BLOCK), dtype=np.int64)
    all_blocks[: len(blocks)] = blocks
    all_blocks[:, 1:] += OFFSET
    luma, blue, red = np.split(all_blocks, [4 * units, 5 * units])
    return write(16 * wide, 16 * high, [(2, 2, luma), (1, 1, blue), (1, 1, red)], np.ones(64, dtype=np.uint8), STORED + struct.pack(">QQ", len(data), len(payload)))


def restore(image: Image) -> tuple[int, bytes]:
    """(length without fill, payload) of a stored file."""
    n, size = struct.unpack(">QQ", image.comment.removeprefix(STORED))
    blocks = np.concatenate([p.coefficients for p in image.parts.values()])[: size // BLOCK]
    blocks[:, 1:] -= OFFSET
    if blocks.min() < 0 or blocks.max() > 255:
        raise ValueError("coefficients that no payload gives")
    return n, blocks.astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, and counts of the values of red, green and blue in eight ranges each."""
    counts = [np.bincount(rgb[:, :, k].ravel() >> 5, minlength=8).tolist() for k in range(3)]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + "/".join(".".join(map(str, c)) for c in counts)


def media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with each whole text as a stored file."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([store((t or "").encode()) for t in texts], dtype=object)

    return docs.withColumn(out, of(F.col(text)))


def _opened(data: bytes) -> dict:
    image = Image(data)
    rgb = image.pixels()
    n, payload = restore(image) if image.comment.startswith(STORED) else (None, None)
    return {"width": rgb.shape[1], "height": rgb.shape[0], "data": rgb.tobytes(), "feature": feature(rgb), "n_bytes": n, "payload": payload}


def tensors(files: DataFrame, media: str = "media", out: str = "rgb") -> DataFrame:
    """``files`` with width, height, full-resolution RGB bytes (row by row) and feature of each file; null for null.

    Files that ``store`` made also give their payload, and its length without fill.
    """
    at, kept = files.columns.index(media), [i for i, c in enumerate(files.columns) if c != out]
    made = T.StructType.fromDDL("width int, height int, data binary, feature string, n_bytes long, payload binary")
    schema = T.StructType([*(files.schema.fields[i] for i in kept), T.StructField(out, made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows, size = [], 0
            for end, data in enumerate(batch.column(at), 1):
                row = _opened(data.as_py()) if data.is_valid else None
                rows.append(row)
                size += len(row["data"]) if row else 0
                if size >= BATCH_BYTES or end == batch.num_rows:
                    part = batch.slice(end - len(rows), len(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(rows, arrow.field(len(kept)).type)], names=arrow.names)
                    rows, size = [], 0

    return files.mapInArrow(run, schema)


def digests(files: DataFrame, id: str = "doc_id", media: str = "media") -> DataFrame:
    """Of each stored file: the digests of the payload read back, and size, feature and digest of its full-resolution RGB tensor."""
    made = tensors(files.select(F.col(id).alias("id"), F.col(media).alias("media")))
    payload, size = F.col("rgb.payload"), lambda c: F.octet_length(c).cast("long")
    return made.select(
        F.col("id").alias(id), "rgb.n_bytes", size(payload).alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "rgb.feature", "rgb.width", "rgb.height", F.sha2("rgb.data", 256).alias("rgb_sha256"),
    )
