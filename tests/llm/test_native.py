"""Sharding, mixing, line dedup, licence scans and fingerprints on small and awkward tables."""

import hashlib
import random
import re
import textwrap
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from strideloom.llm import hilbert_shards, license_scan, line_dedup, mixing, registry, winnowing
from strideloom.llm import common
from strideloom.llm.common import lookup_join, with_rank
from strideloom.llm.license_texts import LICENSES

FULL = Path(license_scan.__file__).parent / "licenses"

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string, size string, rank int"
BLANK = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    """rows of (doc_id, text, source); with more columns, of names that operators use too."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "s", 1) for i, t, s in rows], DOC)


AWKWARD = [
    (1, "a b c d e f g h\nsame line of text\n x ", "s1"), (2, "same line of text\nSAME line of text \nother", "s1"), (2, "same line of text\nSAME line of text \nother", "s1"),
    (3, None, None), (4, "", "s2"), (None, "same line of text\nnull id", "s2"), (5, "same line of text", "ü"), (6, " \n\n ", "s1"), (7, "w " * 3000 + "end", "s1"),
    (2, "another text of the same id\nsame line of text", "s3")]


# ranks and lookups

def test_rank_is_gapless(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    t, n = with_rank(df, [F.col("k").desc(), F.col("id")], "t")
    got = [(r.k, r.id) for r in t.orderBy("_rank").collect()]
    assert n == 1000 and got == sorted(((i % 3, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r._rank for r in t.collect()) == list(range(1000))


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(3000).withColumn("k", F.when(F.col("id") < 1000, -1).otherwise(F.col("id")))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = lookup_join(left, right, ["k"], "n", 3000)
    assert got.count() == 3000 and got.filter("k = -1 and first <> 0").count() == 0


# sharding

@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(spark, n, bits):
    """The index is a bijection, and successive cells differ by one in one coordinate."""
    side = 1 << bits
    cells = spark.range(side**n).select(*(F.expr(f"cast(id div {side**j} % {side} as int) as c{j}") for j in range(n)))
    rows = cells.withColumn("h", hilbert_shards.hilbert_index(hilbert_shards.digits([f"c{j}" for j in range(n)], bits), n)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**n))
    assert all(sum(abs(a[j] - b[j]) for j in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark):
    got = hilbert_shards.document_shards(docs(spark, AWKWARD * 5), 16).collect()
    assert len(got) == 50
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in AWKWARD * 5)
    assert sorted((r["size"], r.text_crc32) for r in got) == want


def test_strings_are_told_apart_beyond_their_start(spark):
    rows = [(i, "x", f"https://example.org/{i % 4}") for i in range(64)]
    q = hilbert_shards.quantised(docs(spark, rows), {"source": F.col("source"), "doc_id": F.col("doc_id")}, 2)
    assert {(r.source[-1], r._c0) for r in q.collect()} == {("0", 0), ("1", 1), ("2", 2), ("3", 3)}


def test_shards_like_a_plain_sort(spark):
    """Cells, curve, ties and cuts together."""
    rows = [(i, "t" * (i * 7 % 90), f"source {i % 3}") for i in range(150)] + [(3, "tie", "source 1")] * 2
    t = docs(spark, rows)
    got = {(r.doc_id, r["size"], r.shard, r.slot) for r in hilbert_shards.document_shards(t, 7).collect()}
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.octet_length("text") + 1, "doc_id": F.col("doc_id")}
    cells = hilbert_shards.quantised(t, dims, hilbert_shards.BITS).withColumn("h", hilbert_shards.hilbert_index(hilbert_shards.digits([f"_c{i}" for i in range(4)], hilbert_shards.BITS), 4))
    flat = sorted((r.h, zlib.crc32(r.text.encode()), r.doc_id, len(r.text) + 1) for r in cells.collect())
    want, n = set(), len(flat)
    for rank, (_, _, i, size) in enumerate(flat):
        shard = rank * 7 // n
        want.add((i, size, shard, rank - next(x for x in range(n) if x * 7 // n == shard)))
    assert got == want


def test_shards_of_few_rows_and_none(spark):
    assert sorted((r.shard, r.slot) for r in hilbert_shards.document_shards(docs(spark, AWKWARD[:3])).collect()) == [(0, 0), (5, 0), (10, 0)]
    assert hilbert_shards.document_shards(docs(spark, [])).count() == 0


def test_written_shards_prune(spark, tmp_path):
    t = hilbert_shards.document_shards(docs(spark, [(i, "x" * (i % 50), f"s{i % 4}") for i in range(400)]), 8)
    hilbert_shards.write_shards(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    z = hilbert_shards.zones(t, ["doc_id", "size"]).collect()
    assert sum(r.rows for r in z) == 400 and max(r.max_doc_id - r.min_doc_id for r in z) < 250
    sources = t.groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert sum(r.n for r in sources) <= 20


# mixing

def brute_targets(sizes, share=1.5, epochs=2):
    """sizes: {source: size}; water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        target = {s: epochs * sizes[s] if s in full else rest * w[s] / open_w for s in order}
        over = {s for s in order if s not in full and target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(0, 40)), rng.choice(["a", "a", "a", "b", "c", "é", None, "d"])) for i in range(200)] + AWKWARD
    got = mixing.mix(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: int(want[s] + 1e-9) for s in sizes}
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_mixed_documents_repeat(spark):
    t = docs(spark, [(i, "w " * 10, "a" if i % 2 else "b") for i in range(20)])
    got = mixing.mixed_documents(t)
    assert got.columns == t.columns
    m = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix(t).collect()}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {i: n for i, n in m.items() if n}


def test_mixed_documents_of_rows_alike_but_for_a_column(spark):
    """Which of them comes once more does not hang on how the rows are dealt."""
    rows = [(1, "a b c", "en", "s", 5, f"p{i}", "z", i) for i in range(7)] + [(2, "d " * 40, "en", "t", 5, "q", "z", 1)]
    runs = {tuple(sorted((r.doc_id, r.extra) for r in mixing.mixed_documents(spark.createDataFrame(some, DOC).repartition(n)).collect())) for n, some in ((1, rows), (3, rows[::-1]), (7, rows))}
    assert len(runs) == 1


def test_op3_query_like_its_definition(spark):
    """The registered query: sizes, checksums and slots; shards of nearly equal numbers that are runs of one curve."""
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.QUERIES["op3_hilbert_shards"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {r.doc_id for r in t}
    for r in t:
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    shards = {}
    for r in got.values():
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert {r.law for r in got.values()} == {"rows"} and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_mixed_documents_one_by_one(spark):
    """Repeated rows, null ids, columns of clashing names: copies are those of each row."""
    rows = [(None, "w " * 10, "a")] * 3 + [(7, "w " * 10, "a")] * 4 + [(8, None, "a"), (8, "", None)] + [(i, "w " * 30, "b") for i in range(20, 30)]
    t = docs(spark, rows).withColumn("row", F.lit("r")).withColumn("size", F.lit("s"))
    got = mixing.mixed_documents(t)
    assert got.columns == t.columns and {(r.row, r["size"]) for r in got.collect()} == {("r", "s")}
    copies = lambda r: -(-r.taken // r["size"]) if r["size"] else 1
    want = sum(copies(r) for r in mixing.mix(t).collect())
    assert got.count() == want
    assert got.filter("source = 'a' and text <> ''").count() <= 2 * 7


# line dedup

def brute_lines(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANK).translate(upper)
    order = lambda i: (i is None, i or 0)
    owners = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)], key=order) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    pool = ["a repeated line no %d" % i for i in range(25)] + ["short", "", "  A Repeated Line No 3\t", "É accented upper case"]
    rows = [(rng.randrange(60), "\n".join(rng.choices(pool, k=rng.randrange(6)) + [f"unique {i} line of text"]), "s") for i in range(60)] + AWKWARD
    got = line_dedup.dedup_lines(docs(spark, rows), batches)
    assert got.columns == [*docs(spark, []).columns, "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    t = docs(spark, [(1, "one repeated line\nown", "s"), (2, "one repeated line", None)])
    names = ["drop", "_l", "row", "lines", "th", "owner", "batch"]
    t = t.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names}).withColumns({"n_lines": F.lit("old"), "n_dropped": F.lit("old")})
    got = line_dedup.dedup_lines(t)
    assert sorted(got.columns) == sorted(t.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].n_lines, rows[1].n_dropped, rows[2].n_dropped, rows[2].text) == (2, 0, 1, "")
    assert all(rows[i][c] == f"{c}{i}" for i in rows for c in names)


def test_line_dedup_of_more_documents_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BATCH_DOCS", 5)
    rows = [(i, f"a common line {i % 7}\nnumber {i} alone", "s") for i in range(40)]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)


def test_runs_level_up(spark):
    """Lookups join runs as they lie: no shuffle of a run, and no sort."""
    kind = "h1 long, h2 long, least long"
    index = line_dedup.LineRuns(spark, fanout=2)
    spark.conf.set(line_dedup.ORDERED_SCAN, "true")
    for i in range(5):
        looked = index.looked_up(spark.createDataFrame([(i, i, i), (0, 0, i)], kind).dropDuplicates(["h1", "h2"]))
        index.add(looked.filter("not known").select("h1", "h2", F.col("least").alias("owner")))
    runs = [r for level in index.levels for r in level]
    assert [len(x) for x in index.levels] == [1, 0, 1] and sorted(r.owner for run in runs for r in run.collect()) == list(range(5))
    looked = index.looked_up(spark.createDataFrame([(3, 3, 8), (9, 9, 9)], kind).groupBy("h1", "h2").agg(F.min("least").alias("least")))
    assert {(r.h1, r.owner, r.known) for r in looked.collect()} == {(3, 3, True), (9, None, False)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = looked.join(runs[0].hint("merge"), ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset(line_dedup.ORDERED_SCAN)
    index.forget()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


# licences

def test_license_scan(spark):
    mit = LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit, None), (2, mit.upper().replace(",", " ;"), None), (3, mit + " and more", None), (4, None, None), (5, "", None),
        (6, mit.replace("sublicense", "sub-licence"), None), (6, mit, None), (7, "  © 2001 X\nAll rights reserved.\n" + LICENSES["BSD-3-Clause"].replace("holder", "owner"), None)]
    got = license_scan.scan(docs(spark, rows), license_scan.known_licenses(spark))
    assert sorted((r.doc_id, r.license_id) for r in got.collect() if r.license_id) == [(1, "MIT"), (2, "MIT"), (6, "MIT"), (6, "MIT"), (7, "BSD-3-Clause")]
    assert got.count() == len(rows)
    assert license_scan.scan(docs(spark, []), license_scan.known_licenses(spark)).count() == 0


def test_license_registry_in_any_form(spark):
    """Texts differ from each other after normalisation, so a digest has one name."""
    known = license_scan.known_licenses(spark).collect()
    assert len({r.digest for r in known}) == len(LICENSES)


def test_full_and_titled_licenses(spark):
    """Whole texts of common licences, as other packages and Debian carry them, and usual titles."""
    texts = {"Apache-2.0": 200, "GPL-2.0": 330, "GPL-3.0": 670, "LGPL-2.1": 490, "LGPL-3.0": 160, "MPL-2.0": 370, "CC0-1.0": 120, "CC-BY-SA-4.0": 420, "Unlicense": 24}
    rows = []
    for i, (name, lines) in enumerate(texts.items()):
        text = (FULL / f"{name}.txt").read_text(encoding="utf-8")
        assert len(text.splitlines()) >= lines, name
        rows.append((i, text, name))
    rows += [(100, "BSD 3-Clause License\n\nCopyright (c) 2020, X\n\n" + LICENSES["BSD-3-Clause"], "BSD-3-Clause"), (101, "ISC License\n\nCopyright (c) 2020 X\n\n" + LICENSES["ISC"], "ISC")]
    rows += [(102, "Licensed under CC BY-NC 4.0.", None), (103, (FULL / "GPL-3.0.txt").read_text() + " and more", None)]
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs(spark, [(i, t, None) for i, t, _ in rows]), license_scan.known_licenses(spark)).collect()}
    assert {i: g and g.split(" (")[0] for i, g in got.items()} == {i: name for i, _, name in rows}


def license_ids(spark, texts):
    got = license_scan.scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), license_scan.known_licenses(spark)).collect()
    return [(g := r.license_id) and g.split(" (")[0] for r in sorted(got, key=lambda r: r.doc_id)]


def test_license_notices(spark):
    mit, bsd = LICENSES["MIT"], LICENSES["BSD-3-Clause"]
    one = " ".join(mit.split())
    notices = ["Copyright Google LLC", "Copyright The Foo Authors 2020", "Portions Copyright (c) 2019 X, Inc.", "Copyright (c) 2020 X, Inc. and Y. All rights reserved.", "(c) 2020 X", "# Copyright: X"]
    assert license_ids(spark, [f"{n}\n\n{t}" for n in notices for t in (mit, bsd)]) == ["MIT", "BSD-3-Clause"] * len(notices)
    assert license_ids(spark, ["Copyright (c) 2020 X. " + one, "MIT License Copyright (c) 2020 X " + one, "Copyright Google LLC. All rights reserved. " + one]) == ["MIT"] * 3
    more = ["Это другой текст", "其他条款适用", "Copyright (c) 2020 X. You may not use this at all.", "Copyright (c) 2020 X.\n" + "Other terms. " * 30, "copyright notice to come"]
    assert license_ids(spark, [f"{mit}\n\n{m}" for m in more]) == [None] * len(more)
    known = license_scan.known_licenses(spark).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert not any(r.digest == empty for r in known)
    forms = [r.w for r in spark.createDataFrame([("Это текст",), ("其他条款",)], "t string").select(license_scan.canonical(F.col("t")).alias("w")).collect()]
    assert forms == ["это текст", "其他条款"]


def test_long_notices(spark):
    """A notice may be as long as its line, and many may stand on one."""
    mit = LICENSES["MIT"]
    one = " ".join(mit.split())
    holders = "Copyright (c) 2020 " + ", ".join(f"Holder {i} of Some Works" for i in range(20_000))
    assert license_ids(spark, [f"{holders}\n\n{mit}", f"{holders} {one}", "Copyright (c) 2020 X " * 20_000 + one, "MIT License " + "Copyright (c) 2020 X, " * 5000 + one, one + " Copyright (c) 2020 X " * 5000]) == ["MIT"] * 4 + [None]


def test_license_sql_knows_the_same_texts(spark, tmp_path):
    """The query and its SQL on a table with planted whole licences, long notices, other scripts and nulls."""
    texts = [*LICENSES.values(), *(f"Copyright (c) 2001-2020 {'Some Holder, ' * 40}\n\n{t}".replace("a copy", "A-COPY") for t in LICENSES.values())]
    texts += [None, "", " \t\n", "Это текст © 2020", "MIT License Copyright (c) 2020 X " + " ".join(LICENSES["MIT"].split()), "some parts of this work are copyright 2020 X\nand more", "the copyright holder is", "copyright holders are", "A line\r\n(c) 2020 Y\r\nB"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.canonical_sha256, r.license_id) for r in registry.QUERIES["op8_license_digests"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {d: (x, i) for d, x, i in c.sql(f"select doc_id, canonical_sha256, license_id from ({registry.SQL['op8_license_digests']})").fetchall()} == got
    n = len(LICENSES)
    assert all(got[i][1] and got[i] == got[n + i] for i in range(n))


def test_license_of_rewrapped_text(spark):
    """A text's lines may break anywhere, and be one."""
    names = [n for n in LICENSES if "\n" in LICENSES[n] and not re.search(r"copyright[ \t]*(\(c\)|©|\[)", LICENSES[n], re.I)]
    assert len(names) > 30
    for width in (37, 61, 80, 10**6):
        wrapped = ["\n".join(textwrap.wrap(LICENSES[n], width, break_long_words=False, break_on_hyphens=False)) for n in names]
        assert license_ids(spark, wrapped) == [n.split(" (")[0] for n in names], width


# fingerprints

def brute_fingerprint(spark, texts, k=winnowing.K, window=winnowing.WINDOW):
    """Rolling hashes by their recurrence, windows one by one; the chosen grams' hashes from the engine."""
    prime, base = winnowing.PRIME, winnowing.BASE
    out = []
    for t in texts:
        words = re.split(r"[\x20\x09-\x0D]+", (t or "").strip(BLANK).lower())
        words = words if words != [""] else []
        if not words:
            out.append([])
            continue
        hs = [r.h for r in spark.createDataFrame(list(enumerate(words)), "i long, w string").orderBy("i").select(F.xxhash64("w").alias("h")).collect()]
        grams = [hs[i : i + k] for i in range(max(1, len(hs) - k + 1))]
        df = spark.createDataFrame([(i, *(g + [None] * (k - len(g)))) for i, g in enumerate(grams)], "i long, " + ", ".join(f"h{j} long" for j in range(k)))
        g = [r.g for r in df.orderBy("i").select(F.xxhash64(*(f"h{j}" for j in range(k))).alias("g")).collect()]
        v = [h % prime for h in hs] + [0] * k
        rank = [sum(v[j] * base ** (k - 1 - j) for j in range(k)) % prime]
        for i in range(len(g) - 1):
            rank.append(((rank[i] - v[i] * base ** (k - 1)) * base + v[i + k]) % prime)
        chosen = set()
        for a in range(max(1, len(g) - window + 1)):
            w = range(a, min(len(g), a + window))
            least = min(rank[i] for i in w)
            chosen.add(max(i for i in w if rank[i] == least))
        out.append([(g[i], i) for i in sorted(chosen)])
    return out


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefg", k=n)) for n in (0, 1, 4, 5, 6, 11, 12, 13, 60)] + [None, "x " * 40, " A b\tC d E "]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [[(x.hash, x.pos) for x in r.fp] for r in winnowing.with_fingerprint(df, "text", "fp").orderBy("i").collect()]
    assert got == brute_fingerprint(spark, texts)
    got = [[(x.hash, x.pos) for x in r.fp] for r in winnowing.with_fingerprint(df.filter("i > 6"), "text", "fp", 7, 4).orderBy("i").collect()]
    assert got == brute_fingerprint(spark, texts[7:], 7, 4)


def test_shared_run_of_words_is_found(spark):
    rng = random.Random(4)
    run = " ".join(f"r{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    rows = [(i, " ".join([*(f"u{rng.random()}" for _ in range(rng.randrange(30))), run, *(f"v{rng.random()}" for _ in range(rng.randrange(30)))])) for i in range(20)]
    fps = [{x.hash for x in r.fp} for r in winnowing.with_fingerprint(spark.createDataFrame(rows, "i long, text string"), "text", "fp").collect()]
    assert all(a & b for a in fps for b in fps)


def test_text_without_blanks(spark):
    """Half of a text is found again, and a short shared run, in scripts without blanks, base64 and minified code."""
    rng = random.Random(6)
    kinds = {"han": [chr(c) for c in range(0x4E00, 0x8E00)], "kana": [chr(c) for c in range(0x3041, 0x3090)], "thai": [chr(c) for c in range(0x0E01, 0x0E2F)], "base64": list("abcdefghijklmnopqrstuvwxyz0123456789+/"), "code": list("abcdefxyz01(){};=+.,[]")}
    run = winnowing.K + winnowing.WINDOW - 1
    for kind, letters in kinds.items():
        a, b = ("".join(rng.choices(letters, k=4000)) for _ in range(2))
        got = {r.doc_id: r for r in winnowing.edited_fingerprints(docs(spark, [(2, a, None), (1, b, None)])).collect()}
        assert got[2].near_edited > 0.25 and got[1].near_edited > 0.25, kind
        part = "".join(rng.choices(letters, k=run))
        rows = [(i, "".join(rng.choices(letters, k=40)) + part + "".join(rng.choices(letters, k=40))) for i in range(5)]
        fps = [{x.hash for x in r.fp} for r in winnowing.with_fingerprint(spark.createDataFrame(rows, "i long, text string"), "text", "fp").collect()]
        assert all(x & y for x in fps for y in fps), kind
    cut = [r.w for r in spark.createDataFrame([("ab 中文x " + "y" * 33 + " " + "z" * 32 + " end",)], "t string").select(F.split(winnowing.spaced(F.col("t")), winnowing.SPLIT).alias("w")).collect()]
    assert cut == [["ab", "中", "文", "x", *["y"] * 33, "z" * 32, "end"]]


def test_edited(spark):
    rows = [(9, "nine über words of text here now", None), (5, "five", None), (5, "five", None), (2, None, None), (None, "null id's text", None)]
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(docs(spark, rows)).collect()}
    ring = [(9, rows[0][1]), (5, "five"), (2, ""), (None, "null id's text")]
    for (i, t), (_, nxt) in zip(ring, ring[1:] + ring[:1]):
        half = len(t) // 2
        assert got[i].edited == t[: len(t) - half] + nxt[:half], i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert winnowing.edited_fingerprints(docs(spark, rows)).count() == 5
    one = winnowing.edited_fingerprints(docs(spark, [(1, "only one", None)])).first()
    assert one.edited == "onlyonly" and one.near_next == 1
    assert winnowing.edited_fingerprints(docs(spark, [])).count() == 0


def brute_likeness(a, b):
    a, b = ({x.split("@")[0] for x in f.split()} for f in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ids", [[9, 4, 4, 1], [], [7]])
def test_edits_of_many_rows_without_an_id(spark, ids):
    """Each has the edit by the highest id's text, and the lowest id has that by the text of least hash among them."""
    rows = [(i, f"text {n} of {i} " + "w " * n, None) for n, i in enumerate(ids)] + [(None, f"nameless {n % 7} " + "v " * (n % 7), None) for n in range(40)] + [(None, None, None)]
    t = docs(spark, rows)
    hashes = {r.text: r.h for r in t.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    least = lambda i: min((x or "" for j, x, _ in rows if j == i), key=hashes.get)
    ring = [*sorted(set(ids), reverse=True), None]
    want = []
    for i, x, _ in rows:
        x, after = x or "", least(ring[(ring.index(i) + 1) % len(ring)])
        want.append((str(i), x, x[:len(x) - len(x) // 2] + after[:len(x) // 2]))
    got = winnowing.edited_fingerprints(t).select("doc_id", "text", "edited", "near_next").collect()
    assert sorted((str(r.doc_id), r.text, r.edited) for r in got) == sorted(want)
    assert all(0 <= r.near_next <= 1 for r in got)


def test_op2_likeness(spark):
    """near_edited and near_next, from fingerprints of the same texts each worked out alone."""
    got = {r.doc_id: r for r in registry.QUERIES["op2_winnowing"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        r = got[i]
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, got[j].fingerprint))
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(order, order[1:] + order[:1])}
    alone = winnowing.with_fingerprint(spark.createDataFrame(list(edited.items()), "doc_id long, text string"), "text", "fp")
    assert {r.doc_id: r.f for r in alone.select("doc_id", winnowing.shown(F.col("fp")).alias("f")).collect()} == {i: r.edited_fingerprint for i, r in got.items()}


def test_op2_digests(spark):
    t = {r.doc_id: r for r in registry.QUERIES["op2_winnowing"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        assert t[i].edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - half] + texts[j][:half]).encode()).hexdigest()
    assert len({texts[i] for i in texts}) == len({r.fingerprint for r in t.values()})


def test_staged_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    t = common.stage(spark.range(5))
    assert t.count() == 5 and list((tmp_path / "strideloom").iterdir())
    common.clear(spark)
    assert not list((tmp_path / "strideloom").iterdir())
    common.clear(spark)
