"""What each of several filters removes, in every order in which they could run."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import BLANKS, stage, table

#: Rows that are looked up at once, and parts whose sums a task holds before it hands them on.
ROWS, PARTS = 4096, 512
#: Filters of an audit: their orders are 720 at most.
MOST_FILTERS = 6


def first_failures(n: int) -> np.ndarray:
    """(2^n, n!): the step at which a row that fails the filters of a set of bits is removed in each order, or n."""
    orders = np.array(list(permutations(range(n))))
    fails = (np.arange(2**n)[:, None, None] >> orders) & 1 > 0
    return np.where(fails.any(2), fails.argmax(2), n)


def audit(df: DataFrame, failures: dict[str, Column], part: Column, marks: dict[str, Column]) -> DataFrame:
    """For each part, order of the filters and step: what is kept and removed.

    ``failures`` has a name of one letter and a condition for each filter (null: passes), ``marks`` a condition for each group of
    rows whose losses are counted. Returns part, filter_order, step (from 1), kept, removed, redundant (failing this filter,
    removed earlier), unique_fails (failing no other), shapley (removed by this filter over all orders) and a column for each mark.
    Rows count one by one; a null part is the empty string; no rows give no rows.

    Each task looks its rows up in a table of sets by orders and counts them by part, order, step and mark; the counts, so many for
    each part, are then summed, so a part of any size is no more than its counts to the task that sums them.
    """
    letters = "".join(failures)
    n, orders = len(letters), ["".join(x) for x in permutations(letters)]
    if not 0 < n <= MOST_FILTERS or len(set(letters)) < n or any(len(x) > 1 for x in failures):
        raise ValueError(f"give 1 to {MOST_FILTERS} filters, each of its own letter")
    slots, counts, tags = len(orders) * (n + 1), ["removed", *marks], len(marks)
    bits = [F.coalesce(c, F.lit(False)).cast("int") * 2**i for i, c in enumerate(failures.values())]
    rows = df.select(F.coalesce(part, F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("set"),
                     *(F.coalesce(c, F.lit(False)).alias(f"mark{i}") for i, c in enumerate(marks.values())))

    def run(batches):
        steps = first_failures(n) + np.arange(len(orders)) * (n + 1)
        held: dict[str, np.ndarray] = {}

        def summed():
            for name, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * slots), pa.array(np.arange(slots, dtype=np.int32)), *map(pa.array, x)], ["part", "slot", *counts])
            held.clear()

        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                parts = b.column("part").dictionary_encode()
                names, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
                cells = at[:, None].astype(np.int64) * slots + steps[b.column("set").to_numpy()]
                kept = [np.ones(len(at), bool), *(b.column(f"mark{k}").to_numpy(zero_copy_only=False) for k in range(tags))]
                found = [np.bincount(cells[k].ravel(), minlength=len(names) * slots).reshape(len(names), slots) for k in kept]
                for k, name in enumerate(names):
                    x = np.stack([f[k] for f in found])
                    held[name] = held[name] + x if name in held else x
                if len(held) > PARTS:
                    yield from summed()
        yield from summed()

    partial = rows.mapInArrow(run, "part string, slot int, " + ", ".join(f"`{c}` long" for c in counts))
    total = partial.groupBy("part", "slot").agg(*(F.sum(c).alias(c) for c in counts))
    t = total.withColumns({"order": F.floor(F.col("slot") / (n + 1)), "step": (F.col("slot") % (n + 1) + 1).cast("int")})
    t = t.withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), F.col("order").cast("int")))
    later = Window.partitionBy("part", "filter_order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("kept", F.sum("removed").over(later)).filter(F.col("step") <= n)
    t = t.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    same = Window.partitionBy("part", "letter")
    at_step = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(same)
    return t.select("part", "filter_order", "step", "kept", "removed", (at_step(1) - F.col("removed")).alias("redundant"), at_step(n).alias("unique_fails"),
                    *marks, F.sum("removed").over(same).alias("shapley"))


def conditions(text: Column) -> dict[str, Column]:
    """Failures of a text by itself: A, under 200 words; B, under half of them distinct; C, over 2 % capitals; D, any of #$%&*|. Null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part (source, null: empty), failures A to E and labels ``good`` and ``toxic``, a row for each of docs.

    E: the text is that of a row of smaller doc_id. A null doc_id is neither smaller nor larger than any, so it neither fails E nor
    makes another fail, and has no labels. A document labelled more than once is good or toxic if a row of it says so. Other columns do not matter.

    A row is the first of its text if it carries the least doc_id of the text's digest. That join is by digest and doc_id together, which is
    nearly unique, so copies do not meet; the least is a partial aggregate.
    """
    found = conditions(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"),
                       *(c.alias(k) for k, c in found.items()))
    rows = stage(rows, "filters")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    t = rows.join(least, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    return t.join(said, "doc_id", "left").select("doc_id", "part", *found, "E", "good", "toxic")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders."""
    t = audited_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(t, {k: F.col(k) for k in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


OP11_SQL = r"""with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
worded as (select *, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from texts),
failing as (
  select doc_id, part, concat(
    case when len(words) < 200 then 'A' else '' end, case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end,
    case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) then 'C' else '' end,
    case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end, case when doc_id > least then 'E' else '' end) as fails
  from worded),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
sets as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from failing left join said using (doc_id) group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places as (
  select *, coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, substring(filter_order, i, 1)))), 6) as at from sets, orders),
grid as (select part, filter_order, unnest(range(1, 6))::int as step from (select distinct part from sets), orders),
counted as (
  select g.part, g.filter_order, g.step, substring(g.filter_order, g.step, 1) as letter,
         sum(case when p.at > g.step then n else 0 end)::bigint as kept, sum(case when p.at = g.step then n else 0 end)::bigint as removed,
         sum(case when p.at < g.step and contains(p.fails, substring(g.filter_order, g.step, 1)) then n else 0 end)::bigint as redundant,
         sum(case when p.fails = substring(g.filter_order, g.step, 1) then n else 0 end)::bigint as unique_fails,
         sum(case when p.at = g.step then good else 0 end)::bigint as good_lost, sum(case when p.at = g.step then toxic else 0 end)::bigint as toxic_lost
  from grid g join places p on p.part = g.part and p.filter_order = g.filter_order group by 1, 2, 3)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from counted"""
