"""Progressive images: a plain decoder bit by bit, the platform's own decoder, and the registered query."""

import hashlib
import zlib

import numpy as np
import pytest

from strideloom.llm import progressive_jpeg as jpeg


class Bits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{x:08b}" for x in data.replace(b"\xff\x00", b"\xff")), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2) if n else 0

    def symbol(self, table):
        code, first, i = 0, 0, 0
        for n in table.counts:
            code, first = code * 2 + self.take(1), first * 2
            if code - first < n:
                return table.symbols[i + code - first]
            i, first = i + n, first + n
        raise AssertionError("no such code")

    def value(self, size):
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def plain_coefficients(p):
    """Scan by scan and block by block, as the format tells it."""
    coefs = np.zeros((sum(x.size for x in p.shape.grids()), 64), int)
    for parts, first, last, high, low, dc, ac, every, data in p.scans:
        units = jpeg.interleaved(p.shape)[0] if len(parts) > 1 else jpeg.alone(p.shape, parts[0])[:, None]
        of = jpeg.interleaved(p.shape)[1] if len(parts) > 1 else [parts[0]]
        pieces, cut = [], 0
        for i in range(len(data) - 1):
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                assert data[i + 1] == 0xD0 + len(pieces) % 8
                pieces.append(data[cut:i])
                cut = i + 2
        pieces.append(data[cut:])
        for n, piece in enumerate(pieces):
            bits, before, skip = Bits(piece), [0, 0, 0], 0
            for unit in units[n * every : (n + 1) * every] if every else units:
                for block, c in zip(unit, of):
                    x = coefs[block]
                    if first == 0:
                        if high:
                            x[0] |= bits.take(1) << low
                        else:
                            before[c] += bits.value(bits.symbol(dc[parts.index(c)]))
                            x[0] = before[c] << low
                        continue
                    k = first
                    while k <= last and not skip:
                        run, size = divmod(bits.symbol(ac[0]), 16)
                        if size == 0 and run < 15:
                            skip = (1 << run) + bits.take(run)
                            break
                        if not high:
                            k += run
                            if size:
                                x[k] = bits.value(size) * (1 << low)
                            k += 1
                            continue
                        new = (1 if bits.take(1) else -1) << low if size else 0
                        while k <= last:
                            if x[k]:
                                if bits.take(1):
                                    x[k] += np.sign(x[k]) * (1 << low)
                            elif run == 0:
                                x[k] = new
                                k += 1
                                break
                            else:
                                run -= 1
                            k += 1
                    if skip:
                        for k in range(k, last + 1) if high else ():
                            if x[k] and bits.take(1):
                                x[k] += np.sign(x[k]) * (1 << low)
                        skip -= 1
            assert skip == 0 and bits.at <= len(bits.bits) < bits.at + 8
    return coefs


def payloads():
    rng = np.random.default_rng(3)
    text = ("A quick brown fox, an élan, 漢字.\n" * 400).encode()
    sparse = (rng.integers(0, 256, 64 * 40) * (rng.random(64 * 40) < 0.05)).astype(np.uint8).tobytes()
    small = rng.integers(-2, 3, 64 * 30).astype(np.int8).tobytes()
    return [bytes(64), b"a" * 64, text[: 64 * 33], text[: 64 * 97], rng.integers(0, 256, 64 * 50, dtype=np.uint8).tobytes(), sparse, small, bytes([0x80]) * 64 * 7]


def test_round_trip_and_a_plain_decoder():
    want = payloads()
    media = jpeg.encoded(want)
    assert media == [jpeg.encoded([p])[0] for p in want]
    images = [jpeg.parsed(m) for m in media]
    coefs, base = jpeg.coefficients(images)
    for p, image, x, y in zip(want, images, base, base[1:]):
        assert image.length == len(p)
        assert coefs[x:y][jpeg.interleaved(image.shape)[0].ravel()].astype(np.int8).tobytes()[: len(p)] == p
        assert (plain_coefficients(image) == coefs[x:y]).all()


def test_scans_without_restarts_runs_of_blocks_and_one_component():
    """A file of another build: no restart markers, an end-of-block run, sizes that are no multiple of a block, a single component."""
    g = jpeg.Geometry(21, 37, ((1, 1),))
    code, length = jpeg.b.codes(jpeg.HIGH)
    blocks = jpeg.alone(g, 0)
    assert len(blocks) == 15
    tokens = [(int(code[0x06]) << 6 | 40, int(length[0x06]) + 6), (int(code[0x30]) << 3 | 6, int(length[0x30]) + 3)]  # one value, then 8 + 6 blocks and this one's rest
    bits = "".join(f"{v:0{n}b}" for v, n in tokens)
    tail = "".join(f"{int(code[0]):0{int(length[0])}b}" for _ in range(1))
    bits += tail
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = jpeg.segment(0xDB, bytes([0] + [1] * 64)) + jpeg.segment(0xC2, bytes([8, 0, 21, 0, 37, 1, 7, 0x11, 0])) + jpeg._tables()
    image = jpeg.parsed(b"\xff\xd8" + head + jpeg.segment(0xDA, bytes([1, 7, 0x01, 1, 63, 0])) + raw + b"\xff\xd9")
    coefs, _ = jpeg.coefficients([image])
    assert coefs[0, 1] == 40 and np.count_nonzero(coefs) == 1
    assert jpeg.pixels(image, coefs).shape == (21, 37, 3)


def test_errors():
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8" + jpeg.segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.parsed(bad)


def test_the_platforms_decoder(spark):
    """The JVM's image reader takes the files as progressive JPEG and sees the same luma."""
    jvm = spark.sparkContext._jvm
    for p in payloads()[:5]:
        media = jpeg.encoded([p])[0]
        image = jpeg.parsed(media)
        coefs, _ = jpeg.coefficients([image])
        reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
        reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(media)))
        raster = reader.readRaster(0, None)
        h, w = image.shape.height, image.shape.width
        assert (raster.getHeight(), raster.getWidth(), raster.getNumBands()) == (h, w, 3)
        luma = np.array(list(raster.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, w * h)))).reshape(h, w)
        grid = image.shape.grids()[0]
        own = jpeg.samples(coefs[grid.ravel()], image.scales[0]).reshape(*grid.shape, 8, 8).transpose(0, 2, 1, 3).reshape(h, w)
        assert np.abs(luma - own).max() <= 1


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in jpeg.op13_progressive_jpeg(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for d, raw in docs.items():
        p, r = jpeg.padded(raw), got[d]
        media = jpeg.encoded([p])[0]
        image = jpeg.parsed(media)
        rgb = jpeg.pixels(image, jpeg.coefficients([image])[0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), jpeg.feature(rgb))
    assert len({r.feature for r in got.values()}) > 0.5 * len({x for x in docs.values()})


def test_awkward_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, columns of clashing names, no rows."""
    monkeypatch.setattr(jpeg, "CHUNK", 3000)
    texts = [None, "", "x", "x", "é" * 1000, "long " * 60_000, "\0" * 64, "y" * 64]
    kind = "text string, media string, payload long, height string, id long"
    df = spark.createDataFrame([(t, "m", 1, "h", i) for i, t in enumerate(texts)], kind)
    got = {r.id: r for r in jpeg.with_pixels(jpeg.with_media(df, "text")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert bytes(r.payload) == jpeg.padded((t or "").encode()) and len(r.rgb) == 3 * r.height * r.width
    assert got[0].media == got[1].media and got[2].media == got[3].media and got[2].feature == got[3].feature
    assert got[1].feature == "16x16 128000 128000 128000 0000000000000000"
    assert jpeg.with_pixels(jpeg.with_media(df.limit(0), "text")).collect() == []
    nulls = spark.createDataFrame([(None,)], "media binary")
    assert jpeg.with_pixels(nulls).first().payload is None
