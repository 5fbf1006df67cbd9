"""The filter audit against plain loops over rows and orders."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strideloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, first string"
LABELS = "doc_id long, quality int, toxic int, good int"


def failures(docs):
    """Letters that each row fails."""
    out = []
    for d, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {k for k, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                                  ("D", re.search("[#$%&*|]", text)), ("E", d is not None and any(x[0] is not None and x[0] < d and (x[1] or "") == text for x in docs))) if bad}
        out.append(fails)
    return out


def brute(docs, labels):
    fails, out, shapley = failures(docs), {}, Counter()
    good, toxic = ({d for d, q, t, *_ in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = [r[3] or "" for r in docs]
    for part in set(parts):
        rows = [(d, f) for (d, *_), p, f in zip(docs, parts, fails) if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(letter in f for _, f in rows) - len(gone), sum(f == {letter} for _, f in rows),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    t = filter_audit.audited_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    got = filter_audit.audit(t, {k: F.col(k) for k in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def document(i, text, source="a"):
    return (i, text, "en", source, 0, "x", "y", "z")


def test_awkward_rows(spark):
    """Null ids, texts and sources, repeated rows, copies before and after, white space of other kinds, a very long text."""
    varied = " ".join(f"w{i}" for i in range(250))
    docs = [
        document(1, None), document(2, ""), document(None, ""), document(None, None, None), document(3, varied), document(3, varied), document(4, varied, None),
        document(5, "SHOUT " * 300, "b"), document(6, "a|b " * 199, "b"), document(7, "one two three " * 200, ""), document(8, "\t\n\x0b\x0c\r ", ""),
        document(9, " ".join(f"word{i % 5000}" for i in range(100_000)), "b"), document(0, varied, "c"), document(10, "É" * 50 + "AB", "c")]
    labels = [(1, 1, 0, 5), (1, 0, 1, 5), (3, 1, 1, None), (4, None, 1, 1), (None, 1, 1, 1), (77, 1, 1, 1), (0, 1, None, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_many_copies_and_no_rows(spark):
    docs = [document(i, "same", "hot" if i % 3 else None) for i in range(300)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], [(1, 1, 1, 1)]) == {}


def test_any_filters(spark):
    """Two filters of the caller's own, one of them null for a row; parts beyond what a task holds."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2 == 0).alias("even"))
    got = filter_audit.audit(df, {"x": F.col("even"), "y": F.col("id") < 10}, (F.col("id") % 1500).cast("string"), {}).collect()
    assert len(got) == 1500 * 2 * 2
    want = Counter()
    for i in range(3000):
        fails = "".join(k for k, bad in (("x", i % 5 > 0 and i % 2 == 0), ("y", i < 10)) if bad)
        for order in ("xy", "yx"):
            want[str(i % 1500), order, next((s for s, k in enumerate(order, 1) if k in fails), 3)] += 1
    assert all(r.removed == want[r.part, r.filter_order, r.step] for r in got)
    with pytest.raises(ValueError):
        filter_audit.audit(df, {}, F.lit("a"), {})
