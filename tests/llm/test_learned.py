"""Search, encoding, language ID, repeated strings and near duplicates against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideloom.llm import bag_minhash, components, language_crf, permutation_index, piece_codec, suffix_dedup
from strideloom.llm.suffix_runs import Run, front_coded, merge

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, ids string, score string, kept string"


def docs(spark, rows):
    """rows of (doc_id, text); with more columns, of names that operators use too."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], DOC)


# nearest neighbours

def nearest(vectors, q, k):
    found = sorted((-float(np.dot(np.array(v, float), np.array(vectors[q], float))), i) for i, v in vectors.items() if i != q)
    return [(i, -s) for s, i in found[:k]]


def test_search_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    good = {i: [float(x) for x in np.float32(rng.normal(size=8))] for i in range(40)}
    good |= {i: good[3] for i in range(100, 140)}  # many copies of one
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0]), (None, good[1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*good.items(), *bad]], "id long, v array<float>, n int")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.filter("id % 20 = 0 or id is null or id > 199"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = nearest(good, q, 20)
        assert [s for _, s in found] == pytest.approx([s for _, s in want])
        assert [i for i, _ in found] == [i for i, _ in want]


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in permutation_index.search(df, df.filter("id = 0"), 20).collect()] == [(0, 1, 1)]
    assert permutation_index.search(df.limit(0), df.limit(0), 20).count() == 0


def test_search_repeated_rows_and_other_lengths(spark):
    """A repeated row of a query or a candidate counts once; vectors of another length have an index of their own."""
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(0, [1.0, 1.0])] * 2 + [(5, [6.0, 1.0])] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.filter("id in (0, 100)"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert got == {0: [(n + 1, 29 - n) for n in range(20)], 100: [(n + 1, 101 + n) for n in range(4)]}


def test_search_recall(spark):
    """At the smallest scale the block's least number of candidates is half of all vectors."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    df = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = defaultdict(set)
    for r in permutation_index.search(df, df.filter("id % 20 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    vectors = {r.id: r.v for r in df.collect()}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    hits = []
    for q in got:
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -np.inf
        hits.append(len(got[q] & set(ids[np.argsort(-s, kind="stable")[:20]])) / 20)
    assert np.mean(hits) >= 0.9


def test_footrule_order_like_its_definition():
    rng = np.random.default_rng(1)
    near = permutation_index.nearest_pivots(rng.normal(size=(50, 5)), rng.normal(size=(20, 5)), 6)
    files = permutation_index.post(near, 20)
    rank = np.full((50, 20), 6)
    np.put_along_axis(rank, near, np.arange(6)[None, :], 1)
    for q in range(5):
        distance = np.abs(rank - rank[q]).sum(1)
        assert list(permutation_index.footrule_order(near[q], files)) == list(np.argsort(distance, kind="stable"))


def test_search_broadcasts_no_queries(spark, monkeypatch):
    """Queries are copied for each group of blocks, so a side that looks small to Spark may be far larger than its limit for broadcasts."""
    plans = []

    def planned(df, name="t", then=permutation_index.stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return then(df, name)

    monkeypatch.setattr(permutation_index, "stage", planned)
    monkeypatch.setattr(permutation_index, "BLOCK", 64)
    monkeypatch.setattr(permutation_index, "QUERIES", 4)
    monkeypatch.setattr(permutation_index, "HELD", 2, raising=False)
    monkeypatch.setattr(permutation_index, "ASKED", 2, raising=False)
    rng = np.random.default_rng(4)
    good = {i: [float(y) for y in x] for i, x in enumerate(rng.normal(size=(400, 8)))}
    df = spark.createDataFrame(list(good.items()), "id long, v array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.filter("id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i, _ in nearest(good, q, 20)] for q in good if q % 20 == 0}
    assert plans and not [p for p in plans if "BroadcastExchange" in p]


def test_rank_products_like_their_definition():
    rng = np.random.default_rng(1)
    near = permutation_index.nearest_pivots(rng.normal(size=(50, 5)), rng.normal(size=(20, 5)), 6)
    weight = np.zeros((50, 20))
    np.put_along_axis(weight, near, 6.0 - np.arange(6)[None, :], 1)
    assert (permutation_index.rank_products(near[:7], permutation_index.post(near, 20).astype(np.float32)) == weight[:7] @ weight.T).all()


# SentencePiece

TEXTS = ["", None, " ", "  a  b ", "word", "naïve façade\n\ttab", "▁ marks ▁▁ here▁", "日本語 текст 🙂 \x00 nul", "x" * 500 + " y", "a b " * 2000, "trailing  ", "\n"]


def test_codec_like_the_library(spark):
    import sentencepiece

    model = piece_codec.default_model()
    assert piece_codec.parts_at_marks(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    got = piece_codec.coded(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r.text or "")
        assert list(r.ids) == ids and r.decoded == (sp.decode(ids) if ids else ""), r.text
    assert piece_codec.coded(docs(spark, []), model).count() == 0


def test_codec_table_is_bounded(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(piece_codec, "TABLE_CHUNKS", 5)
    model = piece_codec.default_model()
    codec, sp = piece_codec.Codec(model, True), sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(20):
        texts = [f"word{i} and word{i + j}" for j in range(3)]
        assert codec.encode(texts) == sp.encode(texts)
        assert len(codec.table) <= 9


# language ID

def test_forward_backward_like_a_loop():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 40, 16, 17, 100, 3])
    scores, moves = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3))
    got, at = language_crf.posteriors(scores, lengths, moves), 0
    for n in lengths:
        e, a = np.exp(scores[at : at + n]), np.exp(moves)
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        x = np.full(3, 1 / 3)
        for t in range(n):
            x = (x @ a) * e[t]
            x = f[t] = x / x.sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (b[t + 1] * e[t + 1])
            b[t] /= b[t].sum()
        p = f * b
        assert got[at : at + n] == pytest.approx(p / p.sum(1, keepdims=True))
        at += n


def test_forward_backward_with_many_languages(monkeypatch):
    """Longer blocks give the same; a group of 100 languages takes no more than it should."""
    import tracemalloc

    rng = np.random.default_rng(2)
    lengths = np.array([700, 1, 40, 3])
    scores, moves = rng.normal(size=(lengths.sum(), 5)), rng.normal(size=(5, 5))
    want = language_crf.posteriors(scores, lengths, moves)
    monkeypatch.setattr(language_crf, "PAIRS", 400)
    assert np.allclose(language_crf.posteriors(scores, lengths, moves), want)
    monkeypatch.undo()
    k = 100
    n = language_crf.PAIRS // (k * k) * language_crf.BLOCK
    scores, moves = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    tracemalloc.start()
    language_crf.posteriors(scores, np.array([n]), moves)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_op6_query(spark):
    """The registered query: which documents are held out, what has no letter, and that most held-out labels are found."""
    t = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in language_crf.op6_language_crf(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(t)
    right = []
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t[i].text or "")))
        if r.held_out and t[i].lang is not None and r.lang_pred != "und":
            right.append(r.lang_pred == t[i].lang)
    assert len(right) > 100 and sum(right) > 0.9 * len(right)


def test_gradient_like_differences():
    rng = np.random.default_rng(4)
    flat, owner = rng.integers(0, 12, 30), np.sort(rng.integers(0, 9, 30))
    weights, moves = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    words, labels = rng.integers(0, 9, (5, 6)), rng.integers(0, 3, (5, 6))
    loss = lambda: language_crf.loss_and_gradient(weights, moves, words, labels, flat, owner, 9)
    _, gw, gm = loss()
    for x, g in ((weights, gw), (moves, gm)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = loss()[0]
            x[at] -= 2e-5
            assert (up - loss()[0]) / 2e-5 == pytest.approx(g[at], abs=1e-7)
            x[at] += 1e-5


def test_training_in_chunks(monkeypatch):
    texts, langs = ["the cat sat on the mat " * 5, "le chat est sur le tapis " * 5], ["en", "fr"]
    one = language_crf.fit(texts, langs)
    monkeypatch.setattr(language_crf, "CHUNK", 4000)
    two = language_crf.fit(texts, langs)
    assert np.allclose(one.weights, two.weights, atol=1e-4) and np.allclose(one.moves, two.moves, atol=1e-4)


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language_crf.fitted(d)
    got = language_crf.label(d.filter(language_crf.held_out()), crf).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) & 3) == 2 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    rows = [(1, None), (2, ""), (3, "123 — !! ²"), (4, "the and of the tion"), (4, "the and of the tion"), (None, "Le la pour eauenaux"), (5, "a" * 100_000)]
    out = {r.doc_id: r for r in language_crf.label(docs(spark, rows), crf).collect()}
    assert len(out) == 6 and [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0
    assert (out[4].lang_pred, out[None].lang_pred) == ("en", "fr") and all(0 <= r.score <= 1 for r in out.values())
    assert language_crf.label(docs(spark, []), crf).count() == 0
    # code-switched text
    by = {r.lang: r.text for r in d.filter("n_chars between 1000 and 3000").collect()}
    mixed = " ".join(by["en"].split()[:30] + by["de"].split()[:30])
    one = language_crf.label(docs(spark, [(1, mixed)]), crf, spans=True).first()
    spans = one.spans
    assert one.score < 0.75 and one.certainty > 0.9
    assert [s.lang for s in spans if s.words > 5] == ["en", "de"]


def test_nothing_to_learn_from(spark):
    empty = language_crf.fitted(docs(spark, []))
    assert language_crf.label(docs(spark, [(1, "text")]), empty).first().lang_pred == "und"


# repeated strings

def test_merge_like_sorting():
    rng = random.Random(1)
    lists = [sorted(bytes(rng.choices(b"ab\0", k=rng.randrange(12))) for _ in range(n)) for n in (30, 1, 17, 0, 8)]
    lists = [x for x in lists if x]
    runs = []
    for x in lists:
        x.sort(key=lambda s: s.ljust(12, b"\0"))
        rows = np.frombuffer(b"".join(s.ljust(12, b"\0") for s in x), np.uint8).reshape(len(x), 12)
        runs.append(Run(*front_coded(rows, np.array([len(s) for s in x]))))
    got = [(lists[r][i], shared) for r, i, shared in merge(runs)]
    assert sorted(s for s, _ in got) == sorted(s for x in lists for s in x)
    padded = [s.ljust(12, b"\0") for s, _ in got]
    assert padded == sorted(padded)
    for (a, _), (b, shared) in zip(got, got[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared == same


def brute_strings(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
        out[i] = (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover) if not c))
    return out


def strings(spark, rows):
    got = suffix_dedup.dedup_strings(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got}


def awkward_strings(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passages = [word(n) for n in (100, 101, 99, 150, 400, 60)]
    rows = [(i, "".join(rng.choice([word(rng.randrange(150)), rng.choice(passages)]) for _ in range(rng.randrange(6)))) for i in range(50)]
    rows += [(100, "z" * 700), (101, "z" * 350 + word(50)), (102, None), (103, ""), (104, rows[7][1]), (None, passages[4] + "!"), (105, "q" * 99), (106, "q" * 99), (107, "ab" * 200)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_strings(spark, seed):
    rows = awkward_strings(seed)
    assert strings(spark, rows) == brute_strings(rows)


def test_strings_with_small_parts_and_frequent_grams(spark, monkeypatch):
    rows = awkward_strings(5)
    want = brute_strings(rows)
    monkeypatch.setattr(suffix_dedup, "PART", 40)
    monkeypatch.setattr(suffix_dedup, "RUN", 16)
    assert strings(spark, rows) == want
    monkeypatch.setattr(suffix_dedup, "GRAM_MOST", 3)
    assert strings(spark, rows) == want


def test_strings_in_segments(spark, monkeypatch):
    """Texts longer than a segment of hashed bytes."""
    from strideloom.llm import repeat_anchors

    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghij", k=5000))
    rows = [(1, long), (2, long[1200:2900] + "x" * 300 + long[:800])]
    monkeypatch.setattr(repeat_anchors, "SEGMENT", 700)
    assert strings(spark, rows) == brute_strings(rows)


def test_strings_of_repeated_rows_and_none(spark):
    t = "".join(random.Random(9).choices("abcdef", k=300))
    got = suffix_dedup.dedup_strings(docs(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 300)]
    assert suffix_dedup.dedup_strings(docs(spark, [])).count() == 0


# near duplicates

def bag(text):
    w = re.split(r"[\x20\x09-\x0D]+", (text or "").strip(BLANK))
    return Counter() if w == [""] else Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_classes(rows):
    rows = [r for r in rows if r[0] is not None]
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if rows[i][0] == rows[j][0] and rows[i][1] == rows[j][1] or (either and both / either >= 0.8) or (rows[i][1] or "") == (rows[j][1] or ""):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def edits(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.random()}"
    return " ".join(out)


def near_rows():
    rng = random.Random(8)
    base, other = [f"w{rng.randrange(300)}" for _ in range(150)], [f"v{rng.randrange(300)}" for _ in range(150)]
    rows = [(i, edits(rng, base, rng.randrange(9))) for i in range(0, 120, 2)] + [(i, edits(rng, other, rng.randrange(6))) for i in range(1, 60, 2)]
    rows += [(200 + i, " ".join(base[: 60 + i]) + " " + " ".join(f"u{rng.random()}" for _ in range(30))) for i in range(20)]
    rows += [(300, ""), (301, None), (302, " \n"), (303, "one two"), (304, "one  two"), (305, "a " * 200), (306, "a " * 170), (307, "a " * 100), (308, "one two three")]
    return rows


def test_near_classes(spark):
    rows = near_rows()
    got = bag_minhash.near_classes(docs(spark, rows + [(None, "no id"), rows[0]])).collect()
    assert [(r.rep, r.class_id) for r in got if r.doc_id is None] == [(None, None)]
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == brute_classes(rows + [rows[0]])
    kept = bag_minhash.near_deduped(docs(spark, rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_classes(rows)})
    assert bag_minhash.near_classes(docs(spark, [])).count() == 0


def test_each_way_alone_finds_all_pairs(spark, monkeypatch):
    """Without rounds of centres the comparison within buckets, and the exact search by rare shingles, find the same classes."""
    monkeypatch.setattr(bag_minhash, "STARS", 1)
    rows = near_rows()
    for few in (0, 10**9):
        monkeypatch.setattr(bag_minhash, "FEW", few)
        got = bag_minhash.near_classes(docs(spark, rows)).collect()
        assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_parities_refuse_no_similar_pair(spark):
    """Of all pairs none that is similar enough is refused, repeated words and long texts included; most others are."""
    rng = random.Random(15)
    long = [f"l{rng.randrange(10**5)}" for _ in range(6000)]
    rows = near_rows() + [(400, " ".join(long)), (401, edits(rng, long, 90)), (402, edits(rng, long, 500))]
    words = docs(spark, rows).filter("doc_id not in (300, 301, 302)").select(F.col("doc_id").alias("id"), bag_minhash.word_hashes(F.col("text")).alias("words"))
    sets = bag_minhash.bag_sets(words).withColumn("size", F.size("bag"))
    other = sets.select(*(F.col(c).alias(f"x_{c}") for c in sets.columns))
    both = F.size(F.array_intersect("bag", "x_bag"))
    pairs = other.join(sets, F.col("x_id") < F.col("id"))
    pairs = pairs.select((both / (F.col("size") + F.col("x_size") - both)).alias("s"), bag_minhash.can_meet("", "x_", 0.8).alias("may")).collect()
    assert all(p.may for p in pairs if p.s >= 0.8) and sum(p.s >= 0.8 for p in pairs) > 100
    assert sum(p.may for p in pairs if p.s < 0.7) < 0.02 * len(pairs)


def test_near_classes_of_awkward_rows(spark):
    """A doc_id with different texts has the class of one of them, in any order of rows; very long texts and other columns do no harm."""
    rng = random.Random(12)
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(30_000))
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, b), (2, a), (3, a), (4, b), (5, long), (6, long + " end"), (5, long)]
    seen = set()
    for order in (rows, rows[::-1]):
        df = docs(spark, order).withColumn("class_id", F.lit("x")).withColumn("bands", F.lit("y"))
        got = sorted((r.doc_id, r.class_id) for r in bag_minhash.near_classes(df).collect())
        seen.add(tuple(got))
        assert dict(got)[3] == 1 and dict(got)[6] == 5 and len(got) == len(rows)
        kept = bag_minhash.near_deduped(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got}
    assert len(seen) == 1


def test_signatures_of_parts_of_a_weight():
    """Weights that end amid an interval: the slots of the lesser weight are those of the greater whose points lie below it."""
    s, size = np.full(2, 77, np.uint64), 3000
    for a, b in ((3, 4), (5, 7), (1, 6), (100, 130)):
        sig = bag_minhash.signatures(s, np.array([0, 1]), np.array([a, b]), 2, size)
        assert (sig[0] == sig[1]).mean() == pytest.approx(a / b, abs=0.03)
        assert (sig[0] >= sig[1]).all()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    size = 4000
    ka, kb = a > 0, b > 0
    sig = bag_minhash.signatures(
        np.concatenate([s[ka], s[kb]]), np.concatenate([np.zeros(ka.sum(), int), np.ones(kb.sum(), int)]), np.concatenate([a[ka], b[kb]]), 2, size)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_components_like_a_loop(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# the pipeline

def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = d.columns, {}
    for name, f in corpus_pipeline.STAGES:
        d = f(spark, d, SF)
        d = spark.createDataFrame(d.collect(), d.schema)
        rows[name] = d.collect()
        if name != "piece_codec":
            assert d.columns == columns
    assert 190 <= len(rows["language_id"]) == len(rows["line_dedup"])
    kept = [(r.doc_id, r.text) for r in rows["line_dedup"]]
    assert sorted(r.doc_id for r in rows["near_dedup"]) == sorted({c for _, c in brute_classes(kept)})
    copies = Counter(r.doc_id for r in rows["source_mix"])
    assert set(copies) <= {r.doc_id for r in rows["near_dedup"]} and max(copies.values()) == 2
    texts = {r.doc_id: r.text for r in rows["near_dedup"]}
    assert Counter(r.doc_id for r in rows["piece_codec"]) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows["piece_codec"])
