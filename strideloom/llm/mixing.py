"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import table, with_range_parts

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, weight, source_size) with ``target``: words to take from each source.

    The sources share ``share`` times all words by weight; a target stops at ``epochs`` times its
    source's size and the excess goes to the others by weight. In order of size over weight the full
    sources come first, so one running sum finds the level at which no further source is full. One row
    for each source: sources are labels, few beside the documents.
    """
    every, cap = Window.partitionBy(), F.col("source_size") * epochs
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = budget / F.sum("weight").over(rest)
    full = cap / F.col("weight") < level
    out = sizes.withColumn("_level", level).withColumn("_full", full)
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)  # that of the first that is not full
    part = F.least(cap.cast("double"), final * F.col("weight"))
    return out.withColumn("target", F.when(F.col("_full"), cap.cast("double")).otherwise(part)).drop("_level", "_full")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", hashed: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``: the words that the mix takes of each document; ``text_hash`` as well if ``hashed``.

    Sources sorted by code point, null last, take the weights in turn. Each source's documents stand in
    the order of a random key, the digest of seed and doc_id. Whole epochs are taken first; the rest of
    the budget, floor(target), is cut at its exact word by a prefix sum of sizes. Prefix sums are sums of
    ranges first, so one source may hold any share of the rows.

    Null text: size 0, nothing taken. Null source: a source of its own. Null doc_id: a key as any other.
    Repeated rows are separate documents. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("_key"), *([F.xxhash64("text").alias("text_hash")] if hashed else []))
    order = ["source", "_key", "doc_id", "size"]
    t = with_range_parts(rows, [F.col(c).asc_nulls_last() for c in order], "mix")

    parts = t.groupBy("source", "_pid").agg(F.sum("size").alias("_sum"))
    by_source = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "_pid", F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_ahead"), "_sum")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    sizes = parts.groupBy("source").agg(F.sum("_sum").alias("source_size")).withColumn("weight", weight)
    plan = parts.drop("_sum").join(targets(sizes, share, epochs).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    plan = plan.withColumnRenamed("source", "_s").withColumnRenamed("_pid", "_p")

    inside = Window.partitionBy("_pid", "source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    t = t.join(plan, (F.col("_pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("_ahead") - F.col("_in")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return t.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["text_hash"] if hashed else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, one copy for each epoch it takes of them.

    A document that the cut of its source's budget falls into is not split: it comes whole, so a source exceeds its target
    by less than one document. A document without words takes no part of any budget; it stays, once. Rows alike in doc_id, source and
    text share their copies evenly, those of least hash of all columns taking one more. Texts move once, by the hash of doc_id, source and text. Nulls
    as in ``mix``; columns of any name stay; an empty table gives no rows.
    """
    m = mix(docs, hashed=True)
    taken = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    alike = m.groupBy("doc_id", "source", "text_hash").agg(F.sum(taken).cast("int").alias("copies"), F.count(F.lit(1)).cast("int").alias("rows"))
    t = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64("text").alias("h"))
    on = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("h") == F.col("text_hash"))
    t = t.join(alike.filter("copies > 0").hint("merge"), on)
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "text_hash").orderBy(F.xxhash64("row")))
    t = t.withColumn("place", F.when(F.col("rows") > 1, place).otherwise(1))
    n = F.expr("copies div rows + if(place <= copies % rows, 1, 0)").cast("int")
    return t.select("row", n.alias("n")).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size,
             [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
      from d group by source),
l as (select *, 2 * source_size as cap, 2 * source_size / weight as ratio,
             (1.5::double * (sum(source_size) over ())::double
              - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
             / (sum(weight) over (order by 2 * source_size / weight, source nulls last rows between current row and unbounded following))::double as level
      from s),
f as (select *, ratio < level as is_full from l),
t as (select *, case when is_full then cap::double
                     else least(cap::double, (select max(level) from f where not is_full) * weight) end as target
      from f),
p as (select d.*, t.source_size, t.target,
             coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then floor(target)::bigint // source_size else 0 end * size
        + greatest(0, least(size, floor(target)::bigint
          - case when source_size > 0 then floor(target)::bigint // source_size else 0 end * source_size - ahead)))::bigint as taken
from p
"""
