"""Payloads as progressive JPEG images: bytes are the quantised coefficients, 64 to a block, so that they come back exactly."""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideloom.llm import jpeg_bits as b
from strideloom.llm.common import table

#: Bytes of payload, or of media, that are worked on at once; a longer one is alone.
CHUNK = 1 << 20
#: Sampling factors of our images: luma in full, both chromas halved. An MCU is 16 pixels square: four blocks of luma and one of each chroma.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Huffman tables: DC; first passes over the low and the high band; refinements.
DC, LOW, HIGH, REFINE = b.huffman(b.dc_weights()), b.huffman(b.first_weights(6)), b.huffman(b.first_weights(7)), b.huffman(b.refining_weights())
#: Scans as (components, first and last coefficient, successive approximation from and to, AC table, MCUs or blocks between restart markers).
SCANS = [((0, 1, 2), 0, 0, 0, 1, 0, 16), *(((c,), 1, 5, 0, 1, 0, 8) for c in range(3)), *(((c,), 6, 63, 0, 0, 1, 1) for c in range(3)),
         ((0, 1, 2), 0, 0, 1, 0, 0, 16), *(((c,), 1, 5, 1, 0, 2, 8) for c in range(3))]
NOTE = b"payload "
#: A marker within a file that is neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass(frozen=True)
class Geometry:
    """Where blocks lie: components one after the other, each in rows of its grid padded to whole MCUs."""

    height: int
    width: int
    sampling: tuple[tuple[int, int], ...]

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)

    @property
    def mcus(self) -> tuple[int, int]:
        """Rows and columns."""
        h, v = self.most
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def grids(self) -> list[np.ndarray]:
        """Block numbers of each component, by row and column."""
        (rows, cols), out, at = self.mcus, [], 0
        for h, v in self.sampling:
            out.append(np.arange(at, at + rows * v * cols * h).reshape(rows * v, cols * h))
            at += rows * v * cols * h
        return out


@lru_cache(512)
def interleaved(g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order of MCUs (MCUs by blocks of one), and the component of each block of an MCU."""
    (rows, cols), parts = g.mcus, []
    for grid, (h, v) in zip(g.grids(), g.sampling):
        parts.append(grid.reshape(rows, v, cols, h).transpose(0, 2, 1, 3).reshape(rows * cols, v * h))
    return np.concatenate(parts, 1), np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])


@lru_cache(512)
def alone(g: Geometry, c: int) -> np.ndarray:
    """Blocks of component c in a scan of its own, which leaves out those beyond the image."""
    (h, v), (hm, vm) = g.sampling[c], g.most
    rows, cols = (-(-(-(-n * f // m)) // 8) for n, f, m in ((g.height, v, vm), (g.width, h, hm)))
    return g.grids()[c][:rows, :cols].ravel()


def geometry_of(blocks: int) -> Geometry:
    """The image for so many blocks: MCUs in a square, or nearly."""
    mcus = -(-blocks // 6)
    cols = int(np.ceil(np.sqrt(mcus)))
    return Geometry(16 * -(-mcus // cols), 16 * cols, SAMPLING)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    one = lambda kind, t: bytes([kind, *t.counts, *t.symbols])
    return segment(0xC4, one(0x00, DC) + one(0x10, LOW) + one(0x11, HIGH) + one(0x12, REFINE))


def _dc_tokens(v: np.ndarray, parts: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DC differences, MCU by MCU; v is (MCUs, blocks of one), ``fresh`` the MCUs before which predictions restart."""
    d = np.empty_like(v)
    for c in range(parts.max() + 1):
        own = v[:, parts == c]
        before = np.concatenate([[0], own.ravel()[:-1]]).reshape(own.shape)
        before[fresh, 0] = 0
        d[:, parts == c] = own - before
    size = b.bit_length(np.abs(d)).ravel()
    code, length = b.codes(DC)
    return code[size] << size.astype(np.uint64) | b.signed_bits(d.ravel(), size), length[size] + size


def _first_tokens(v: np.ndarray, huffman: b.Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, codes and lengths of a first pass over v (blocks, coefficients of the band)."""
    code, length = b.codes(huffman)
    row, col = np.nonzero(v)
    value = v[row, col].astype(np.int64)
    head = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    run = col - np.where(head, 0, np.concatenate([[0], col[:-1] + 1])[: len(row)])
    size = b.bit_length(np.abs(value))
    symbol = (run & 15) << 4 | size
    ends = v[:, -1] == 0
    long = run >> 4
    per = np.bincount(row, 1 + long, len(v)).astype(np.int64)
    place = np.cumsum(1 + long) - 1 + (np.cumsum(ends) - ends)[row]
    total = int(per.sum() + ends.sum())
    block = np.repeat(np.arange(len(v)), per + ends)
    out, bits = np.full(total, code[b.ZRL]), np.full(total, length[b.ZRL])
    out[place], bits[place] = code[symbol] << size.astype(np.uint64) | b.signed_bits(value, size), length[symbol] + size
    closing = np.cumsum(per + ends)[ends] - 1
    out[closing], bits[closing] = code[b.EOB], length[b.EOB]
    return block, out, bits


def _refining_tokens(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a refinement to bit ``low`` of a band of 16 coefficients at most."""
    code, length = b.codes(REFINE)
    size = np.abs(v.astype(np.int64)) >> low
    wide = v.shape[1]
    new, old = size == 1, size > 1
    # each coefficient that was known goes behind the symbol of the next new one, or behind the end of block
    group = np.where(new, np.arange(wide), wide)
    group = np.minimum.accumulate(group[:, ::-1], 1)[:, ::-1]
    zeros = np.cumsum(size == 0, 1)
    row, col = np.nonzero(new)
    head = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    passed = zeros[row, col]
    run = passed - np.where(head, 0, np.concatenate([[0], passed[:-1]])[: len(row)])
    symbol = run << 4 | 1
    orow, ocol = np.nonzero(old)
    erow = np.flatnonzero(~new[:, -1])
    span = wide + 1
    keys = np.concatenate([(row * span + col) * (span + 1), (orow * span + group[orow, ocol]) * (span + 1) + 1 + ocol, (erow * span + wide) * (span + 1)])
    out = np.concatenate([code[symbol] << np.uint64(1) | (v[row, col] > 0).astype(np.uint64), (size[orow, ocol] & 1).astype(np.uint64), np.full(len(erow), code[b.EOB])])
    bits = np.concatenate([length[symbol] + 1, np.ones(len(orow), np.int64), np.full(len(erow), length[b.EOB])])
    order = np.argsort(keys, kind="stable")
    return (keys // (span * (span + 1)))[order], out[order], bits[order]


def encoded(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as a progressive JPEG file."""
    shapes = [geometry_of(len(p) // 64) for p in payloads]
    orders = [interleaved(g)[0] for g in shapes]
    base = np.cumsum([0] + [o.size for o in orders])
    coefs = np.zeros((base[-1], 64), np.int16)
    for p, o, at in zip(payloads, orders, base):
        coefs[at + o.ravel()[: len(p) // 64]] = np.frombuffer(p, np.int8).reshape(-1, 64)
    files = []
    for p, g in zip(payloads, shapes):
        frame = struct.pack(">BHHB", 8, g.height, g.width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
        files.append([b"\xff\xd8", segment(0xDB, bytes([0] + [1] * 64)), segment(0xFE, NOTE + str(len(p)).encode()), segment(0xC2, frame), _tables()])
    for parts, first, last, high, low, tree, every in SCANS:
        units = orders if len(parts) > 1 else [alone(g, parts[0])[:, None] for g in shapes]
        counts = np.array([len(u) for u in units])
        rows = np.concatenate([u + at for u, at in zip(units, base)])
        number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        intervals = -(-counts // every)
        interval = number // every + np.repeat(np.cumsum(intervals) - intervals, counts)
        marks = np.arange(intervals.sum()) - np.repeat(np.cumsum(intervals) - intervals, intervals)
        marks[np.cumsum(intervals) - 1] = -1
        if first == 0:
            v = coefs[rows, 0].astype(np.int64) >> low
            own = np.repeat(interval, rows.shape[1])
            if high:
                code, size = (v & 1).ravel().astype(np.uint64), np.ones(v.size, np.int64)
            else:
                code, size = _dc_tokens(v, interleaved(shapes[0])[1], np.flatnonzero(number % every == 0))
        else:
            v = coefs[rows[:, 0], first : last + 1]
            if high:
                block, code, size = _refining_tokens(v, low)
            else:
                block, code, size = _first_tokens(np.sign(v) * (np.abs(v) >> low), (LOW, HIGH)[tree])
            own = interval[block]
        raw, ends = b.packed(own, code, size, marks)
        stop = ends[np.cumsum(intervals) - 1]
        head = segment(0xDD, struct.pack(">H", every)) + segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, tree)), first, last, high << 4 | low]))
        for f, x, y in zip(files, np.concatenate([[0], stop[:-1]]), stop):
            f += [head, raw[x:y].tobytes()]
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


@dataclass
class Parsed:
    """A file's frame and scans: (components, first, last, high, low, DC and AC tables by component, restart interval, data)."""

    shape: Geometry | None = None
    quants: list[int] = field(default_factory=list)
    scales: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    length: int | None = None


def parsed(media: bytes) -> Parsed:
    """Markers of a progressive file of one or three components with samples of 8 bits; others are an error."""
    out, ids, dc, ac, every, at = Parsed(), [], {}, {}, 0, 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        hit = MARKER.search(media, at)
        if not hit or media[hit.start() + 1] == 0xD9:
            break
        kind, at = media[hit.start() + 1], hit.end()
        size = struct.unpack_from(">H", media, at)[0]
        body, at = media[at + 2 : at + size], at + size
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out.scales[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide > 1 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = b.Huffman(tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xFE and body.startswith(NOTE):
            out.length = int(body[len(NOTE) :])
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(n)]
            out.shape = Geometry(height, width, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)))
            out.quants = [body[8 + 3 * i] for i in range(n)]
            if n not in (1, 3):
                raise ValueError(f"{n} components")
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError(f"not a progressive frame: {kind:#x}")
        elif kind == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            n = body[0]
            parts = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            picks = [body[2 + 2 * i] for i in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = MARKER.search(media, at)
            data = media[at : end.start() if end else len(media)]
            at = end.start() if end else len(media)
            out.scans.append((parts, first, last, bits >> 4, bits & 15, tuple(dc.get(p >> 4) for p in picks), tuple(ac.get(p & 15) for p in picks), every, data))
    if out.shape is None:
        raise ValueError("no frame")
    return out


def _rounds(scans: list[tuple]) -> list[list[tuple]]:
    """Scans that may be read at the same time: the same band and bits of different components, one after the other."""
    out: list[list[tuple]] = []
    for s in scans:
        if out and out[-1][0][1:5] == s[1:5] and not {c for x in out[-1] for c in x[0]} & set(s[0]):
            out[-1].append(s)
        else:
            out.append([s])
    return out


def coefficients(images: list[Parsed]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks, 64 in zigzag order) of all images, and where each one's begin.

    Images of the same course of bands and bits are read side by side: round by round each restart interval of each scan adds its
    coefficients, or a further bit of them, to the arrays.
    """
    base = np.cumsum([0] + [sum(x.size for x in p.shape.grids()) for p in images])
    coefs = np.zeros((base[-1], 64), np.int16)
    alike = defaultdict(list)
    for i, p in enumerate(images):
        rounds = _rounds(p.scans)
        alike[tuple(r[0][1:5] for r in rounds)].append((i, rounds))
    for course, members in alike.items():
        for k, (first, last, high, low) in enumerate(course):
            books: dict[b.Huffman, int] = {}
            pick = lambda t: books.setdefault(t, len(books)) if t else 0
            rows, parts, trees, starts, ends, data, at = [], [], [], [], [], [], 0
            for i, rounds in members:
                for comps, *_, dc, ac, every, raw in rounds[k]:
                    g = images[i].shape
                    if len(comps) > 1:
                        order, part = interleaved(g)
                        if len(comps) < len(g.sampling):
                            own = np.isin(part, comps)
                            order, part = order[:, own], part[own]
                    else:
                        order, part = alone(g, comps[0])[:, None], np.array(comps)
                    n, wide = order.shape
                    cuts = np.arange(at, at + order.size, (every or n) * wide)
                    starts.append(cuts)
                    ends.append(np.minimum(cuts + (every or n) * wide, at + order.size))
                    rows.append(order.ravel() + base[i])
                    if first == 0 and not high:
                        parts.append(np.broadcast_to(part, order.shape).ravel())
                        trees.append(np.broadcast_to([pick(dc[comps.index(c)]) for c in part], order.shape).ravel())
                    else:
                        trees.append(np.full(len(cuts), pick(ac[0])))
                    data.append(raw)
                    at += n * wide
            lanes = b.Lanes(data)
            rows, trees, start, end = (np.concatenate(x) for x in (rows, trees, starts, ends))
            if len(lanes.bit) != len(start):
                raise ValueError("restart markers do not fit the frame")
            book = np.concatenate([b.lookup(t) for t in books] or [np.zeros(1 << 16, np.uint16)])
            if first == 0 and high:
                b.refine_dc(lanes, rows, start, end, low, coefs)
            elif first == 0:
                b.decode_dc(lanes, trees, book, rows, start, end, np.concatenate(parts), low, coefs)
            else:
                (b.refine_ac if high else b.decode_ac)(lanes, trees, book, rows, start, end, (first, last), low, coefs)
    return coefs, base


def zigzag() -> np.ndarray:
    """Place in a block, by rows, of each coefficient: diagonals in turn, every other one upwards."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = zigzag()
#: The cosine transform in fixed point: sums of products of whole numbers under 2^53 are exact in any order, so equal images have equal pixels.
POINT = 12
_u = np.arange(8)
BASIS = np.rint(np.where(_u == 0, np.sqrt(1 / 8), 1 / 2)[:, None] * np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16) * 2**POINT)
# The format's colour conversion, by Cr and Cb.
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 1.402, 0.344136, 0.714136, 1.772


def samples(coefs: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Blocks of 8 by 8 samples of coefficients in zigzag order and their quantiser."""
    x = np.empty((len(coefs), 64))
    x[:, ZIGZAG] = coefs * scale
    x = BASIS.T @ x.reshape(-1, 8, 8) @ BASIS
    return np.clip(np.floor((x + 2 ** (2 * POINT - 1)) / 2 ** (2 * POINT)) + 128, 0, 255).astype(np.uint8)


def pixels(p: Parsed, coefs: np.ndarray) -> np.ndarray:
    """The RGB tensor (height, width, 3) of an image: samples, chroma repeated to full resolution, colours."""
    g, planes = p.shape, []
    for grid, (h, v), q in zip(g.grids(), g.sampling, p.quants):
        s = samples(coefs[grid.ravel()], p.scales[q]).reshape(*grid.shape, 8, 8).transpose(0, 2, 1, 3).reshape(8 * grid.shape[0], 8 * grid.shape[1])
        planes.append(s.repeat(g.most[1] // v, 0).repeat(g.most[0] // h, 1)[: g.height, : g.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = (x.astype(np.int32) for x in planes)
    cb, cr, fixed = cb - 128, cr - 128, lambda f: round(f * 65536)
    half = 1 << 15
    rgb = np.stack([y + (fixed(RED_CR) * cr + half >> 16), y - (fixed(GREEN_CB) * cb + fixed(GREEN_CR) * cr + half >> 16), y + (fixed(BLUE_CB) * cb + half >> 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and whether each cell of an 8 by 8 grid is brighter than the whole, in hexadecimal."""
    h, w, _ = rgb.shape
    total = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    light = rgb.sum(2, dtype=np.int64)
    ys, xs = (np.arange(8) * n // 8 for n in (h, w))
    cells = np.add.reduceat(np.add.reduceat(light, ys, 0), xs, 1)
    area = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None, :]
    bright = cells * (h * w) > light.sum() * area
    return f"{h}x{w} {' '.join(str(int(t) * 1000 // (h * w)) for t in total)} {np.packbits(bright).tobytes().hex()}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def chunked(batch: pa.RecordBatch, column: str):
    """Slices of about CHUNK bytes of the column, one row at least."""
    sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()])
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHUNK:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if batch.num_rows > at:
        yield batch.slice(at)


def with_media(df: DataFrame, column: str) -> DataFrame:
    """df with ``media`` in place of ``column`` (string or binary): its bytes, zeros up to a positive multiple of 64, as a progressive JPEG file.

    Null counts as empty; equal values have equal files; a column media is replaced; repeated rows stay; no rows give no rows.
    """
    rest = [f for f in df.drop("media").schema.fields if f.name != column]
    body = F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("_body")
    names = [f.name for f in rest]

    def run(batches):
        for whole in batches:
            for x in chunked(whole, "_body"):
                media = encoded([padded(r) for r in x.column("_body").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), pa.array(media, pa.binary())], names=[*names, "media"])

    return df.select(*names, body).mapInArrow(run, T.StructType([*rest, T.StructField("media", T.BinaryType())]))


DECODED = ("payload", "height", "width", "rgb", "feature")


def with_pixels(df: DataFrame) -> DataFrame:
    """df with what its progressive JPEG files ``media`` hold: payload (binary), height, width, rgb (binary: rows of pixels of three bytes) and feature.

    A file of another origin has all its blocks as payload. Null media give nulls. Columns of these names are replaced; a file that is no
    progressive JPEG is an error.
    """
    rest = df.drop(*DECODED).schema.fields
    names = [f.name for f in rest]
    kinds = [T.BinaryType(), T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType()]

    def read(media: list[bytes | None]) -> list[tuple]:
        at = [i for i, m in enumerate(media) if m is not None]
        out: list[tuple] = [(None,) * len(DECODED)] * len(media)
        images = [parsed(media[i]) for i in at]
        if images:
            coefs, base = coefficients(images)
            for i, p, x, y in zip(at, images, base, base[1:]):
                own = coefs[x:y]
                raw = own[interleaved(p.shape)[0].ravel()].astype(np.int8).tobytes()
                rgb = pixels(p, own)
                out[i] = (raw if p.length is None else raw[: p.length], *rgb.shape[:2], rgb.tobytes(), feature(rgb))
        return out

    def run(batches):
        for whole in batches:
            for x in chunked(whole, "media"):
                found = [pa.array(c, k) for c, k in zip(zip(*read(x.column("media").to_pylist())), (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), *found], names=[*names, *DECODED])

    return df.drop(*DECODED).mapInArrow(run, T.StructType([*rest, *(T.StructField(c, k) for c, k in zip(DECODED, kinds))]))


def op13_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as images, and what is read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    t = with_pixels(with_media(docs, "text"))
    return t.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
