"""JSON documents of any length, read by many tasks: each takes a range of bytes.

Where a range begins, nothing tells whether that is within a string or how deep. So one pass counts quotes and brackets of each range, brackets
for both cases; a window over the ranges of a file, one row each, settles which case holds and the depth there; then each task reads the entries that begin
in its range, and on beyond it to the end of the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of what a task looks at in one go.
RANGE, PIECE = 32 << 20, 1 << 20
_COMMA, _QUOTE, _BACKSLASH = b',"\\'
#: By byte: 1 and -1 for brackets that open and close, 2 for a comma, else 0.
_KIND = np.zeros(256, np.int8)
_KIND[list(b"{[")], _KIND[list(b"}]")], _KIND[_COMMA] = 1, -1, 2
#: The string an entry begins with, and what follows it; or the first character of another value.
_HEAD = re.compile(rb'\s*(?:("(?:[^"\\]|\\.)*")\s*(\S)|[^"\s])', re.DOTALL)


def _open(path: str):
    """The file at a path or URI, for reads at any place."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _slashes_before(f, at: int) -> int:
    """Backslashes directly before a place."""
    n = 0
    while n < at:
        data = f.read_at(min(256, at - n), max(0, at - n - 256))
        n += len(data) - len(data.rstrip(b"\\"))
        if not data.endswith(b"\\" * len(data)):
            break
    return n


def _marks(f, lo: int, hi: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of lo to hi: offset, bytes, places of brackets and commas, their kinds, and quotes from lo up to each; then quotes of the piece are in."""
    quotes, slashes = 0, _slashes_before(f, lo)
    while lo < hi:
        data = f.read_at(min(PIECE, hi - lo), lo)
        a = np.frombuffer(data, np.uint8)
        q = np.flatnonzero(a == _QUOTE)
        back = np.flatnonzero(a == _BACKSLASH)
        if len(back) or slashes:
            # the run of backslashes that ends before each quote, if any, begins at its first
            first = back[np.r_[True, np.diff(back) > 1]] if len(back) else back
            run = np.searchsorted(first, q, "left") - 1
            after = (q > 0) & (a[q - 1] == _BACKSLASH)
            start = np.where(after, first[np.maximum(run, 0)] if len(first) else 0, q)
            length = q - start + np.where(start == 0, slashes, 0)
            q = q[length % 2 == 0]
        at = np.flatnonzero(_KIND[a])
        yield lo, data, at, _KIND[a[at]], quotes + np.searchsorted(q, at)
        quotes += len(q)
        own = len(data) - len(data.rstrip(b"\\"))
        slashes = own + slashes if own == len(data) else own
        lo += len(data)
    yield lo, b"", np.zeros(0, np.int64), np.zeros(0, np.int8), np.array([quotes])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quotes of each range, and what its brackets add to the depth if it begins outside and inside a string."""
    for ranges in batches:
        out = []
        for r in ranges.itertuples():
            with _open(r.path) as f:
                outside = inside = quotes = 0
                for _, _, at, kind, before in _marks(f, r.lo, r.hi):
                    if not len(at):
                        quotes = int(before[0]) if len(before) else quotes
                        continue
                    odd, step = before % 2 == 1, np.where(kind == 2, 0, kind)
                    inside += int(step[odd].sum())
                    outside += int(step[~odd].sum())
            out.append((r.path, r.lo, r.hi, quotes, outside, inside))
        yield pd.DataFrame(out, columns=["path", "lo", "hi", "quotes", "outside", "inside"])


def _walk(f, lo: int, hi: int, odd: int, depth: int, level: int) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """Pieces from lo: offset, bytes, and (place, kind, depth after) of all that bounds entries at depths 1 to ``level``."""
    for at, data, place, kind, before in _marks(f, lo, hi):
        if len(place):
            real = (before + odd) % 2 == 0
            place, kind = place[real], kind[real]
            step = np.where(kind == 2, 0, kind)
            after = depth + np.cumsum(step)
            depth = int(after[-1]) if len(after) else depth
            # a bracket that closes belongs to the depth it leaves
            owner = after - np.minimum(step, 0)
            bounds = (owner >= 1) & (owner <= level)
            yield at, data, list(zip(place[bounds].tolist(), kind[bounds].tolist(), owner[bounds].tolist()))
        else:
            yield at, data, []


def _key_and_value(text: bytes) -> tuple[str | None, bytes]:
    import json

    m = _HEAD.match(text)
    if m and m[2] == b":":
        return json.loads(m[1]), text[m.end():]
    return None, text


def _key_at(f, at: int, size: int) -> str | None:
    """The key of the entry that begins there, null in an array."""
    n = 1024
    while True:
        text = f.read_at(min(n, size - at), at)
        m = _HEAD.match(text)
        if m or at + n >= size:
            return _key_and_value(text)[0]
        n *= 4


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges with ``head``: where the last entry at depth 1 that begins in them does."""
    for ranges in batches:
        out = []
        for r in ranges.itertuples():
            head = None
            with _open(r.path) as f:
                for at, _, bounds in _walk(f, r.lo, r.hi, r.odd, r.depth, 1):
                    starts = [p for p, kind, _ in bounds if kind > 0]
                    head = at + starts[-1] + 1 if starts else head
            out.append((r.path, r.lo, r.hi, r.odd, r.depth, head))
        yield pd.DataFrame(out, columns=["path", "lo", "hi", "odd", "depth", "head"]).astype({"head": "Int64"})


def _entries(f, lo: int, hi: int, odd: int, depth: int, head: int | None, level: int) -> Iterator[tuple[list[str | None], str]]:
    """Keys and text of each entry whose first bound, a bracket or comma, lies in lo to hi."""
    size = f.size()
    begin, held, outer = None, [], None
    if level == 2 and depth >= 1 and head is not None:
        outer = _key_at(f, head, size)
    for at, data, bounds in _walk(f, lo, size, odd, depth, level):
        if at >= hi and begin is None:
            return
        for place, kind, owner in bounds:
            here = at + place
            if owner < level:
                if kind > 0 and here < hi:
                    outer = _key_at(f, here + 1, size)
                continue
            if begin is not None and kind != 1:
                text = b"".join(held) + data[max(begin - at, 0):place]
                held.clear()
                begin = None
                key, value = _key_and_value(text)
                if value.strip():
                    yield ([outer, key] if level == 2 else [key]), value.decode()
            if here >= hi:
                return
            if kind > 0:
                begin = here + 1
        if begin is not None:
            held.append(data[max(begin - at, 0):])


def json_entries(spark: SparkSession, path: str, level: int = 1, range_bytes: int = RANGE) -> DataFrame:
    """(path, keys, value) of each entry at depth ``level``, 1 or 2, of the JSON documents in the files at ``path``, value as JSON text.

    ``keys`` are those on the way to the entry, null for an element of an array. Documents may follow each other in a file. Files are not compressed. An entry is in
    one task and row, what holds it need not be. Empty files and empty objects have no entries; a file whose brackets or quotes are not closed is an error.
    """
    if level not in (1, 2):
        raise ValueError("entries are at depth 1 or 2")
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0]
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", lo.alias("lo")).select("path", "lo", F.least(F.col("lo") + range_bytes, "length").alias("hi"))
    # one row a range, in as many tasks: a given number is not coalesced
    spread = lambda t: t.repartition(int(n or 1))
    t = spread(ranges).mapInPandas(_scan, "path string, lo long, hi long, quotes long, outside long, inside long")
    file = Window.partitionBy("path")
    upto = file.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("odd", F.coalesce(F.sum("quotes").over(upto), F.lit(0)) % 2)
    t = t.withColumn("step", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    closed = (F.sum("step").over(file) == 0) & (F.sum("quotes").over(file) % 2 == 0)
    fault = F.raise_error(F.concat(F.lit("JSON that is not closed in "), "path")).cast("long")
    t = t.withColumn("depth", F.when(closed, F.coalesce(F.sum("step").over(upto), F.lit(0))).otherwise(fault)).select("path", "lo", "hi", "odd", "depth")
    if level == 2:
        t = spread(t).mapInPandas(_heads, "path string, lo long, hi long, odd long, depth long, head long").withColumn("head", F.last("head", True).over(upto))
    else:
        t = t.withColumn("head", F.lit(None).cast("long"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ranges in batches:
            for r in ranges.itertuples():
                rows, held = [], 0
                with _open(r.path) as f:
                    for keys, value in _entries(f, r.lo, r.hi, r.odd, r.depth, None if pd.isna(r.head) else int(r.head), level):
                        rows.append((r.path, keys, value))
                        held += len(value)
                        if held > PIECE:
                            yield pd.DataFrame(rows, columns=["path", "keys", "value"])
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "keys", "value"])

    return spread(t).mapInPandas(read, "path string, keys array<string>, value string")
