"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import lookup_join, shuffle_partitions, stage, table
from strideloom.llm.hashing import MIX, mixed
from strideloom.llm.repeat_anchors import BEFORE, GRAM, LENGTH, anchors
from strideloom.llm.suffix_runs import Run, front_coded, merge

#: Suffixes in a sorted run and, on average, in a part of the order; sampled suffixes that part it.
RUN, PART, SAMPLE = 20_000, 50_000, 20_000
#: Suffixes of one gram that one task may hold (about half a GB at a time, with their contexts); those of a more frequent gram go by their strings.
GRAM_MOST = 1_000_000
#: Stands for a null doc_id: after all others.
NO_ID = 2**63 - 1
#: Low bits of ``at``: the position in the text; above it 31 bits of the text's hash, which tell apart rows of one doc_id.
POS = (1 << 32) - 1
BATCH_BYTES = 8 << 20
#: Over the number of strings of one anchor.
MORE = 128


def _tag(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), _tag(text).alias("tag"), text.cast("binary").alias("bytes"))


def _slices(sizes: np.ndarray, most: int):
    start = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def later(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an earlier (doc, at) has the same keys; the same place met twice is not earlier than itself."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), bool)
    out[order] = (doc[order] != doc[first]) | (at[order] != at[first])
    return out


def found_anchors(texts: DataFrame) -> DataFrame:
    """texts(doc, tag, bytes) to (h, doc, at, sure), an anchor's gram hash and its place.

    Of a batch's anchors alike in gram and whole context, by hash, all but the earliest surely repeat: they are marked and get a hash of
    their own, so that no gram brings more than one row from a batch to its task for each context.
    """

    def run(batches):
        for batch in batches:
            col = batch.column("bytes")
            sizes = np.array([len(x.as_buffer()) for x in col], np.int64)
            docs, tags = (batch.column(c).to_numpy() for c in ("doc", "tag"))
            for i, j in _slices(sizes, BATCH_BYTES):
                offsets = np.concatenate([[0], np.cumsum(sizes[i:j])])
                data = np.frombuffer(b"".join(x.as_buffer() for x in col.slice(i, j - i)), np.uint8)
                got = list(anchors(data, offsets))
                if not got:
                    continue
                d, p, h, c = map(np.concatenate, zip(*got))
                doc, at = docs[i:j][d], (tags[i:j][d] << 32) | p
                sure = later((h, c), doc, at)
                h = np.where(sure, mixed(doc.view(np.uint64) ^ mixed(at.view(np.uint64))), h)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), doc, at, sure)], names=["h", "doc", "at", "sure"])

    return texts.mapInArrow(run, "h long, doc long, at long, sure boolean")


def hits(found: DataFrame, partitions: int) -> DataFrame:
    """By text (doc, tag): ``old``, anchors that repeat one of their own batch, and ``open``, those of grams that occur again.

    All open anchors go to the sorted runs. Before, a batch's anchors alike in their whole context are one: the map side of
    the exchange, so that no group of copies brings more than a row a batch to its gram. Only short rows meet here by gram, and they spill.
    """
    t = found.repartition(partitions, "h").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("n > 1 or sure")
    t = t.withColumn("kind", F.when(F.col("sure"), 0).when(F.col("n") > GRAM_MOST, 2).otherwise(1))
    t = t.select("doc", F.shiftright("at", 32).alias("tag"), "kind", F.col("at").bitwiseAND(F.lit(POS)).cast("int").alias("pos"))
    pick = lambda k, name: F.collect_list(F.when(F.col("kind") == k, F.col("pos"))).alias(name)
    return stage(t.groupBy("doc", "tag").agg(pick(0, "old"), pick(1, "open"), pick(2, "frequent")), "hits")


def contexts(texts: DataFrame, hit: DataFrame, kind: str) -> DataFrame:
    """The open anchors' (doc, at, left, right): up to BEFORE bytes before each, and up to LENGTH bytes from it on."""

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                b = batch.slice(one, 1)
                data = _unpacked(b.column("packed")[0].as_py())
                tag, doc = b.column("tag")[0].as_py(), b.column("doc")[0].as_py()
                places = b.column(kind)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(places), pa.int64()), pa.array([tag << 32 | p for p in places], pa.int64()),
                     pa.array([data[max(0, p - BEFORE) : p] for p in places], pa.binary()), pa.array([data[p : p + LENGTH] for p in places], pa.binary())],
                    names=["doc", "at", "left", "right"])

    wanted = hit.filter(F.size(kind) > 0).select("doc", "tag", kind)
    return texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", kind).mapInArrow(run, "doc long, at long, left binary, right binary")


def packed(texts: DataFrame) -> DataFrame:
    """texts with their bytes compressed, in half the space that a shuffle's own codec takes."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = pa.array([z.compress(x.as_buffer()) for x in batch.column("bytes")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), small], names=["doc", "tag", "packed"])

    return texts.mapInArrow(run, "doc long, tag long, packed binary")


def _unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _matrix(parts: list[bytes], width: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as zero-padded rows, at the left, or at the right if ``end``, and their lengths."""
    pad = (lambda x: x.rjust(width, b"\0")) if end else (lambda x: x.ljust(width, b"\0"))
    rows = np.frombuffer(b"".join(map(pad, parts)), np.uint8).reshape(len(parts), width)
    return rows, np.array([len(x) for x in parts], np.int64)


def sorted_runs(found: DataFrame, cuts: list[bytes]) -> DataFrame:
    """contexts to front-coded runs, one row for each run and part of the order that it reaches into."""

    def run(batches):
        edges = np.array(cuts, f"S{GRAM}") if cuts else np.zeros(0, f"S{GRAM}")
        for whole in batches:
            for i in range(0, whole.num_rows, RUN):
                b = whole.slice(i, RUN)
                rows, lengths = _matrix(b.column("right").to_pylist(), LENGTH, False)
                left, left_len = _matrix(b.column("left").to_pylist(), BEFORE, True)
                order = np.argsort(rows.view(f"S{LENGTH}").ravel(), kind="stable")
                rows, lengths, left, left_len = (x[order] for x in (rows, lengths, left, left_len))
                doc, at = (b.column(c).to_numpy()[order] for c in ("doc", "at"))
                part = np.searchsorted(edges, np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel(), side="right")
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                for lo, hi in zip(bounds, bounds[1:]):
                    s = slice(lo, hi)
                    cols = [*front_coded(rows[s], lengths[s]), left[s].tobytes(), left_len[s].astype(np.uint8).tobytes(), doc[s].tobytes(), at[s].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["part", "shared", "lengths", "rest", "lefts", "left_lens", "docs", "ats"])

    return found.mapInArrow(run, "part int, shared binary, lengths binary, rest binary, lefts binary, left_lens binary, docs binary, ats binary")


def repeats(shared: np.ndarray, lengths: np.ndarray, left: np.ndarray, left_len: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes that start earlier as well, from suffixes in order: document, start of the first and number of the others of each unbroken row of starts.

    A string that starts ``o`` bytes before an anchor is its last o bytes of left context and the first LENGTH - o
    of its suffix. Suffixes that share so many stand together, between shared prefixes that are shorter.
    """
    n = len(shared)
    tail = np.full(n, MIX[1])  # hash of the last o bytes of left context
    again = np.zeros((n, BEFORE + 1), bool)
    for o in range(BEFORE + 1):
        if o:
            tail = mixed(tail ^ left[:, BEFORE - o].astype(np.uint64))
        here = np.flatnonzero((left_len >= o) & (lengths >= LENGTH - o))
        if len(here) < 2:
            continue
        group = np.cumsum(shared < LENGTH - o)[here]
        key = mixed(mixed(group.astype(np.uint64)) + tail[here])
        again[here, o] = later((key,), doc[here], at[here])
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, nearest = np.nonzero(edge == 1)
    farthest = np.nonzero(edge == -1)[1] - 1
    return doc[row], at[row] - farthest, farthest - nearest


def merged(runs: DataFrame) -> DataFrame:
    """Runs to the places (doc, at) where a repeated string starts, and so do ``more`` right after it: each part's runs meet in one loser tree."""

    def combine(key, t):
        cols = {c: t.column(c).to_pylist() for c in t.column_names if c != "part"}
        order = list(merge([Run(*x) for x in zip(cols["shared"], cols["lengths"], cols["rest"])]))
        first = np.concatenate([[0], np.cumsum([len(x) for x in cols["shared"]])])
        run, place, shared = (np.array(x, np.int64) for x in zip(*order))
        at = first[run] + place
        flat = lambda c, kind: np.frombuffer(b"".join(cols[c]), kind)[at]
        left = np.frombuffer(b"".join(cols["lefts"]), np.uint8).reshape(-1, BEFORE)[at]
        doc, start, more = repeats(shared, flat("lengths", np.uint8).astype(np.int64), left, flat("left_lens", np.uint8).astype(np.int64), flat("docs", np.int64), flat("ats", np.int64))
        return pa.table({"doc": pa.array(doc, pa.int64()), "at": pa.array(start, pa.int64()), "more": pa.array(more, pa.int64())})

    return runs.groupBy("part").applyInArrow(combine, "doc long, at long, more long")


def by_strings(found: DataFrame) -> DataFrame:
    """The same places for contexts of grams too frequent for a task: each string by its 128-bit digest, in partial aggregates."""
    o = F.explode(F.sequence(F.lit(0), F.octet_length("left")))
    t = found.select("doc", "at", "left", "right", o.alias("o")).filter(F.octet_length("right") >= LENGTH - F.col("o"))
    string = F.concat(F.expr("substring(left, octet_length(left) - o + 1, o)"), F.expr(f"substring(right, 1, {LENGTH} - o)"))
    t = stage(t.select("doc", (F.col("at") - F.col("o")).alias("at"), F.md5(string).alias("key")), "strings")
    first = t.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lookup_join(t, first, ["key"], "n", t.count()).filter(F.col("first") != F.struct("doc", "at")).select("doc", "at", F.lit(0).cast("long").alias("more"))


def repeated_starts(texts: DataFrame, hit: DataFrame) -> DataFrame:
    """(doc, tag, starts): where the strings start that repeat, of those an open anchor's context holds: a position times MORE and the number of starts right after it."""
    places = None
    found = stage(contexts(texts, hit, "open"), "contexts")
    n = found.count()
    if n:
        parts = -(-n // PART)
        sample = found.sample(min(1.0, SAMPLE / n), seed=1).select(F.substring("right", 1, GRAM).alias("g")).orderBy("g").limit(4 * SAMPLE).collect()
        grams = [bytes(r["g"]) for r in sample]
        cuts = sorted({grams[len(grams) * k // parts] for k in range(1, parts)}) if grams else []
        places = merged(sorted_runs(found, cuts))
    if hit.agg(F.max(F.size("frequent"))).first()[0]:
        more = by_strings(contexts(texts, hit, "frequent"))
        places = more if places is None else places.unionByName(more)
    if places is None:
        return None
    at = F.col("at").bitwiseAND(F.lit(POS)) * MORE + F.col("more")
    return places.groupBy("doc", F.shiftright("at", 32).alias("tag")).agg(F.collect_list(at).alias("starts"))


def _spans(size: int, old: list[int], starts: list[int]) -> np.ndarray:
    """Maximal covered runs, rows of start and end."""
    o, s = np.array(old or [], np.int64), np.array(starts or [], np.int64)
    lo, hi = np.maximum(o - BEFORE, 0), np.minimum(o + LENGTH, size)
    whole = hi - lo >= LENGTH
    lo, hi = np.concatenate([lo[whole], s // MORE]), np.concatenate([hi[whole], s // MORE + s % MORE + LENGTH])
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.stack([lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])]], 1)


def dedup_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (start, end of each removed run of bytes), n_removed, and ``kept``, the remaining bytes.

    Removes each byte of a text that a string of LENGTH bytes covers which also starts earlier: in a
    smaller doc_id, or before in the same text. Strings are judged on the input and do not cross
    documents. Null text counts as empty. A null doc_id comes after all others. Rows of one doc_id are one
    document if their texts are equal, else ordered by hash of text. An empty table gives no rows.

    1. Of each such string the 32-byte gram of least hash is an anchor, so equal strings have equal anchors
       in the same place. Of a batch's anchors with equal contexts one is left. Anchors meet by gram hash.
    2. The suffixes at all anchors of repeated grams are sorted in runs, front-coded, exchanged by
       range of gram, and merged by loser trees. Shared prefixes and left contexts give the repeats.
    3. Each text's runs are cut out.
    Hashes are of 64 bits within groups of equal 64-bit gram hashes.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    texts = _texts(docs)
    hit = hits(found_anchors(texts), partitions)
    starts = repeated_starts(packed(texts), hit)
    cut = hit.select("doc", "tag", "old")
    if starts is None:
        cut = cut.withColumn("starts", F.lit(None).cast("array<long>"))
    else:
        cut = cut.join(stage(starts, "starts"), ["doc", "tag"], "left")

    def run(batches):
        for batch in batches:
            for i, j in _slices(np.array([len(x.as_buffer()) * 3 for x in batch.column("packed")], np.int64), BATCH_BYTES):
                b = batch.slice(i, j - i)
                kept, spans, sizes, removed = [], [], [], []
                for text, old, start in zip(b.column("packed"), b.column("old").to_pylist(), b.column("starts").to_pylist()):
                    data = _unpacked(text.as_buffer())
                    cuts = _spans(len(data), old, start).tolist()
                    ends = [0, *(x for c in cuts for x in c), len(data)]
                    kept.append(b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2])))
                    spans.append([{"start": x, "end": y} for x, y in cuts])
                    sizes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    t = packed(texts).join(cut, ["doc", "tag"], "left").select("doc", "packed", "old", "starts")
    out = t.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less their repeated strings of 100 bytes."""
    t = dedup_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
