"""JSON read by ranges of bytes, against json.loads of the whole."""

import json
import random

import pytest

from strideloom.schemas import FRAME_METRICS
from strideloom.sources import stores
from strideloom.sources.split_json import json_entries


def _entries(doc, level):
    pairs = lambda x: list(x.items()) if isinstance(x, dict) else [(None, v) for v in x] if isinstance(x, list) else []
    for k, v in pairs(doc):
        if level == 1:
            yield (k,), v
        else:
            yield from (((k, i), w) for i, w in pairs(v))


def _sorted(rows):
    return sorted(((list(k), v) for k, v in rows), key=lambda x: json.dumps(x, sort_keys=True))


def _awkward(rng, depth=0):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "]", ",", ":", "a", "é", "\n", "\\\"", "𝄞", " "]) for _ in range(rng.randrange(9)))
    kind = rng.randrange(6) if depth else rng.randrange(2)
    if kind == 0 and depth < 4:
        return {text() + str(i): _awkward(rng, depth + 1) for i in range(rng.randrange(5))}
    if kind == 1 and depth < 4:
        return [_awkward(rng, depth + 1) for _ in range(rng.randrange(5))]
    return rng.choice([None, True, rng.randrange(99), -1.5e-7, text(), text()])


@pytest.mark.parametrize("level", [1, 2])
def test_awkward_documents_by_short_ranges(spark, tmp_path, level):
    """Quotes, backslashes and brackets in strings, ranges that begin anywhere, several documents in a file, empty ones."""
    rng, want = random.Random(level), []
    for i in range(3):
        docs = [_awkward(rng) for _ in range(25)]
        want += [e for doc in docs for e in _entries(doc, level)]
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(doc, ensure_ascii=i == 0, indent=i or None) for doc in docs))
    (tmp_path / "none.json").write_text("")
    for size in (23, 400, 1 << 20):
        got = json_entries(spark, str(tmp_path), level, size).collect()
        assert _sorted((r["keys"], json.loads(r.value)) for r in got) == _sorted(want)
    assert len(want) > 50


def test_every_start_and_small_pieces(tmp_path, monkeypatch):
    """Each place of a document as the border of two ranges, and pieces of a few bytes."""
    import pandas as pd

    from strideloom.sources import split_json as s

    monkeypatch.setattr(s, "PIECE", 5)
    doc = {'a"\\': {"b\\\\": ["x,\\", {"c": "}"}], "": "\\\\\""}, "d": [1, "[\\\"", {}], "e": {}, "f": []}
    path, text = tmp_path / "d.json", json.dumps(doc)
    path.write_text(text)
    for cut in range(1, len(text)):
        ranges = pd.DataFrame([(str(path), 0, cut), (str(path), cut, len(text))], columns=["path", "lo", "hi"])
        a, b = next(s._scan(iter([ranges]))).itertuples()
        odd, depth = a.quotes % 2, a.outside
        assert depth + (b.inside if odd else b.outside) == 0 and (a.quotes + b.quotes) % 2 == 0
        for level in (1, 2):
            t = pd.DataFrame([(str(path), 0, cut, 0, 0), (str(path), cut, len(text), odd, depth)], columns=["path", "lo", "hi", "odd", "depth"])
            head = next(s._heads(iter([t]))).iloc[0]["head"]
            with s._open(str(path)) as f:
                got = [*s._entries(f, 0, cut, 0, 0, None, level), *s._entries(f, cut, len(text), odd, depth, int(head), level)]
            assert [(tuple(k), json.loads(v)) for k, v in got] == list(_entries(doc, level)), (cut, level)


def test_a_file_that_is_not_closed(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"a": [1, 2], "b": {"c": 1}')
    with pytest.raises(Exception, match="not closed"):
        json_entries(spark, str(tmp_path), 1, 7).collect()


def test_one_object_is_read_by_several_tasks(spark, tmp_path):
    row = {"video": "a", "side": "right"} | {m: 1.0 for m in FRAME_METRICS}
    doc = {v: [row | {"video": v, "frame": i} for i in range(n)] for v, n in (("a", 3000), ("b", 2), ("c", 0))}
    doc["b"][1]["ankle_y_vel"] = None
    (tmp_path / "f.json").write_text(json.dumps(doc))
    plain, split = stores.frame_tables(spark, str(tmp_path)), stores.frame_tables(spark, str(tmp_path), range_bytes=1 << 16)
    assert split.schema == plain.schema and sorted(split.collect()) == sorted(plain.collect()) and plain.count() == 3001
    tasks = {i for i, r in enumerate(split.rdd.glom().map(len).collect()) if r}
    assert len(tasks) >= 5


def test_legacy_frames_by_ranges(spark, tmp_path):
    rows = [('q"v', i, "L", n, None if i % 3 else i / 7) for i in range(200) for n in ("m", 'n"\\')] + [("w", 1, "R", "m", 1.0), ("w", 1, "L", "m", 3.0)]
    stores.write_legacy(spark.createDataFrame(rows, "video string, frame int, side string, name string, value double"), str(tmp_path / "l"))
    key = lambda r: (r.video, r.frame)
    plain, split = (sorted(stores.legacy_frames(spark, str(tmp_path / "l"), True, n).collect(), key=key) for n in (None, 999))
    assert plain == split and len(plain) == 201
