"""Colour files of another encoder, against its own decoder; restarts; 16-bit tables."""

import hashlib
import struct
import zlib

import numpy as np

from contactloom.llm import media


def _java_file(spark, rgb):
    """(progressive file, its pixels) by the JVM's ImageIO: 4:2:0, DC of all components in one scan."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    high, wide, _ = rgb.shape
    flat = [int(r) << 16 | int(g) << 8 | int(b) for r, g, b in rgb.reshape(-1, 3)]
    image = jvm.java.awt.image.BufferedImage(wide, high, 1)
    for i, x in enumerate(flat):
        image.setRGB(i % wide, i // wide, x)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    options.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), options)
    stream.close()
    data = bytes(out.toByteArray())
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    back = np.array([read.getRGB(i % wide, i // wide) & 0xFFFFFF for i in range(len(flat))])
    return data, np.stack([back >> 16, back >> 8 & 255, back & 255], axis=-1).reshape(rgb.shape)


def test_colour_file_against_another_decoder(spark):
    for high, wide in ((37, 45), (16, 17)):
        y, x = np.mgrid[:high, :wide]
        rgb = np.stack([60 + 3 * x, 200 - 4 * y, 90 + 2 * x + y], axis=-1).clip(0, 255)
        rgb[::5, ::3] //= 2
        data, want = _java_file(spark, rgb)
        image = media.Image(data)
        got = image.pixels().astype(int)
        assert (image.hmax, image.vmax) == (2, 2) and got.shape == want.shape
        grey = np.array([0.299, 0.587, 0.114])
        # luma is equal but for rounding; chroma differs as the other decoder smooths it
        assert np.abs(got @ grey - want @ grey).max() < 2.5 and np.abs(got - want).mean() < 4
        row = media.tensors(spark.createDataFrame([(bytearray(data),)], "media binary")).first().rgb
        assert (row.height, row.width) == (high, wide) and bytes(row.data) == image.pixels().tobytes()


def test_restarts_and_wide_tables():
    r = np.random.default_rng(2)
    # 20 x 20 pixels: 2 x 2 units of 2 x 2 blocks of luma, of which 3 x 3 are inside
    luma, chroma = r.integers(-200, 200, (4, 4)), r.integers(-200, 200, (2, 2, 2))

    def code(value):
        size = int(abs(value)).bit_length()
        return [size >> k & 1 for k in (3, 2, 1, 0)] + [(value if value > 0 else value + (1 << size) - 1) >> k & 1 for k in range(size - 1, -1, -1)]

    for every in (1, 3):
        parts, before, bits = [], [0, 0, 0], []
        for unit in range(4):
            if unit and unit % every == 0:
                parts.append(media._packed(np.array(bits, dtype=np.uint8)))
                before, bits = [0, 0, 0], []
            row, column = divmod(unit, 2)
            values = [(0, int(luma[2 * row + i, 2 * column + k])) for i in (0, 1) for k in (0, 1)]
            for part, value in values + [(1, int(chroma[0, row, column])), (2, int(chroma[1, row, column]))]:
                bits += code(value - before[part])
                before[part] = value
        parts.append(media._packed(np.array(bits, dtype=np.uint8)))
        body = b"".join(p + (bytes([0xFF, 0xD0 + i]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
        frame = struct.pack(">BHHB", 8, 20, 20, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        data = b"".join([b"\xff\xd8", media._segment(0xDB, bytes([0x10]) + struct.pack(">64H", *[300] * 64)), media._segment(0xC2, frame),
                         media._segment(0xDD, struct.pack(">H", every)), media._segment(0xC4, media.DC.segment(0)),
                         media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), body, b"\xff\xd9"])
        image = media.Image(data)
        assert (image.parts[1].coefficients[:, 0].reshape(3, 3) == luma[:3, :3]).all() and (image.quant[0] == 300).all()
        assert all((image.parts[2 + k].coefficients[:, 0].reshape(2, 2) == chroma[k]).all() for k in (0, 1))


def _plain_pixels(image):
    """Pixels of a 4:2:0 file by the definition: each block alone, a chroma value for each 2 x 2 pixels."""
    planes = []
    for part in image.parts.values():
        plane = np.zeros((8 * part.high, 8 * part.wide))
        for b, block in enumerate(part.coefficients):
            table = np.zeros((8, 8))
            for k, place in enumerate(media.ZIGZAG):
                table[divmod(int(place), 8)] = block[k] * image.quant[part.table][k]
            y, x = 8 * (b // part.wide), 8 * (b % part.wide)
            for i in range(8):
                for j in range(8):
                    waves = np.outer(np.cos((2 * i + 1) * np.arange(8) * np.pi / 16), np.cos((2 * j + 1) * np.arange(8) * np.pi / 16))
                    waves[0] /= np.sqrt(2)
                    waves[:, 0] /= np.sqrt(2)
                    plane[y + i, x + j] = (waves * table).sum() / 4 + 128
        planes.append(plane)
    out = np.zeros((image.height, image.width, 3))
    for i in range(image.height):
        for j in range(image.width):
            luma, blue, red = planes[0][i, j], planes[1][i // 2, j // 2] - 128, planes[2][i // 2, j // 2] - 128
            out[i, j] = luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue
    return np.clip(out, 0, 255)


def test_stored_texts_are_colour_with_chroma_upsampled(spark):
    texts = [None, "", "a" * 64, "é and ü " * 90, "".join(map(chr, range(128))) * 7]
    files = media.media(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    read = {r.doc_id: r for r in media.tensors(files).collect()}
    digests = {r.doc_id: r for r in media.digests(files).collect()}
    assert len(read) == len(digests) == len(texts) and read[0].rgb == read[1].rgb
    for i, text in enumerate(texts):
        image = media.Image(bytes(read[i].media))
        assert [(p.h, p.v) for p in image.parts.values()] == [(2, 2), (1, 1), (1, 1)]
        data, row = (text or "").encode(), read[i].rgb
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert bytes(row.payload) == payload and row.n_bytes == len(data)
        rgb = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, 3)
        assert np.abs(rgb - _plain_pixels(image)).max() < 0.501 and (rgb[:, :, 0] != rgb[:, :, 1]).any()
        got = digests[i]
        assert (got.payload_sha256, got.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got.rgb_sha256, got.feature, got.width, got.height) == (hashlib.sha256(bytes(row.data)).hexdigest(), row.feature, row.width, row.height)
    # another decoder takes the stored file as colour, too
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(read[3].media)))
    assert (image.getWidth(), image.getHeight(), image.getRaster().getNumBands()) == (read[3].rgb.width, read[3].rgb.height, 3)


def test_tensors_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 1)
    texts = spark.range(7).selectExpr("id", "CASE id WHEN 2 THEN NULL ELSE repeat('x', int(id) * 500) END AS text", "id AS rgb").coalesce(1)
    files = media.media(texts).selectExpr("id", "text", "rgb", "IF(id = 5, NULL, media) AS media")
    got = media.tensors(files).orderBy("id").collect()
    assert got.pop(5).rgb is None
    assert [r.id for r in got] == [0, 1, 2, 3, 4, 6] and got[0].asDict().keys() == {"id", "text", "media", "rgb"}
    assert all(bytes(r.rgb.payload)[: r.rgb.n_bytes] == (r.text or "").encode() for r in got)
