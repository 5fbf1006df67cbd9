"""Approximate nearest neighbours by a permutation index with pivot inverted files."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import key128, lookup_join, shuffle_partitions, stage, table

#: Pivots, the vectors of least hash of id; ranks kept of each vector's nearest ones.
PIVOTS, PREFIX = 256, 128
#: Vectors of an index block, queries of a query block.
BLOCK, QUERIES = 4096, 1024
#: Index blocks and query blocks that meet in one group at most; queries whose files are summed at a time.
HELD, ASKED, SLAB = 16, 32, 256
#: Share of a block's vectors, those with the largest products of ranks, whose inner products are computed; and at least so many.
RERANK, LEAST = 0.15, 250


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with a component more that brings all to one norm, so that inner products with them order as distances do."""
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row its nearest pivots in order; equals by number."""
    return np.argsort(-(x @ pivots.T), 1, kind="stable")[:, :prefix]


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def post(near: np.ndarray, pivots: int) -> np.ndarray:
    """Inverted files: row p is the file of pivot p, with prefix - rank for each vector that has it among its nearest, else 0.

    The files are dense, as each vector is in half of them; one byte an entry.
    """
    n, prefix = near.shape
    files = np.zeros((pivots, n), np.uint8)
    files[near, np.arange(n)[:, None]] = prefix - np.arange(prefix)
    return files


def footrule_order(near: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Rows by footrule distance to a query with these nearest pivots, equals by number; the search takes ``rank_products``.

    With ranks beyond the prefix taken as ``prefix`` the distance is a constant less twice the sum of prefix - max(rank, rank') over
    the pivots that both have, so only the query's pivots' files are read.
    """
    prefix = len(near)
    both = np.minimum(files[near], (prefix - np.arange(prefix)).astype(np.uint8)[:, None])
    shared = both.sum(0, dtype=np.uint16)  # at most PREFIX^2, and 255^2 fits
    return np.argsort(np.uint16(65535) - shared, kind="stable")


def rank_products(near: np.ndarray, files: np.ndarray) -> np.ndarray:
    """For queries with these nearest pivots (rows) and all rows of the files, the sum of (prefix - rank) * (prefix - rank') over pivots.

    It orders as Spearman's rho does with ranks beyond the prefix taken as ``prefix``, and reads the queries' pivots' files as one matrix product.
    Sums are whole numbers under 2^24, so they are exact in float32 and in any order.
    """
    prefix = near.shape[1]
    asked = np.zeros((len(near), len(files)), np.float32)
    asked[np.arange(len(near))[:, None], near] = prefix - np.arange(prefix)
    return asked @ files


def distinct_vectors(vectors: DataFrame, copies: int) -> DataFrame:
    """vectors(id, v) to (k1, k2, v, ids): equal vectors once, with the least ``copies`` of their ids; no result needs more of them."""
    keyed = vectors.select("id", "v", *(k.alias(n) for k, n in zip(key128(F.col("v")), ("k1", "k2"))))
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    least = keyed.withColumn("_n", first).filter(F.col("_n") <= copies)
    return least.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def choose_pivots(unique: DataFrame, count: int) -> np.ndarray:
    """The PIVOTS vectors of least hash. A bound on the hash, which nearly always leaves enough, keeps the rows that reach the driver few."""
    least = F.xxhash64("k1", "k2")
    bound = F.lit(-(2**63) + (4 * PIVOTS * 2**64 - 1) // count) if count > 4 * PIVOTS else None
    for some in [unique.filter(least <= bound), unique] if bound is not None else [unique]:
        found = some.orderBy(least, "k1", "k2").limit(PIVOTS).select("v").collect()
        if len(found) == min(PIVOTS, count):
            break
    return np.array([r["v"] for r in found], np.float64)


def build_index(vectors: DataFrame, count: int, pivots: np.ndarray, norm: float) -> tuple[DataFrame, int]:
    """Blocks of distinct vectors (block, ids, vectors, near), staged, and their number. Every vector is in one.

    ``near`` has the numbers of each vector's nearest pivots in order, a byte each, from which ``post`` makes the block's inverted files.
    """
    blocks = max(1, -(-count // BLOCK))
    prefix = min(PREFIX, len(pivots))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("k1"), F.lit(blocks)).cast("int")).select("block", "v", "ids")

    def pack(t):
        order = np.argsort([x[0] for x in t.column("ids").to_pylist()], kind="stable")
        t = t.take(order)
        x = np.array(t.column("v").to_pylist(), np.float64)
        near = nearest_pivots(lifted(x, norm), pivots, prefix).astype(np.uint8)
        return pa.table({"block": t.column("block").slice(0, 1), "ids": pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         "vectors": pa.array([packed(x)], pa.binary()), "near": pa.array([packed(near)], pa.binary())})

    packed_blocks = dealt.groupBy("block").applyInArrow(pack, "block int, ids array<array<long>>, vectors binary, near binary")
    return stage(packed_blocks, "index"), blocks


def one_each(vectors: DataFrame) -> DataFrame:
    """One row (id, v) for each id, that of least hash; an id's repeated rows are the same vector in the ordinary case."""
    return vectors.groupBy("id").agg(F.min_by("v", F.struct(*key128(F.col("v")))).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int, rerank: float = RERANK) -> DataFrame:
    """vectors(id, v), queries(id, v) to (query_id, rank, vec_id, score): the k of largest inner product found for each query, its own id left out.

    Ties go to the smaller id; all vectors if there are fewer than k. Vectors null, zero, or with null or
    non-finite components take no part, nor do null ids. Queries meet vectors of their own length; there is an index for each length of a query, so
    lengths should be few. Rows of one id count once, the vector of least hash. Scores are inner products of the vectors in double precision.

    The index is fitted on PIVOTS vectors; all vectors are posted. A query is searched in every block and its finds are merged.
    Groups of up to ASKED query blocks meet groups of up to HELD index blocks in a cogroup: only finds leave it, and neither
    side can be broadcast, as a join's side might be that Spark takes for small before it is multiplied. Equal queries are searched once.
    """
    vectors, queries = (x.filter(usable(F.col("v")) & F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v")) for x in (vectors, queries))
    vectors, queries = stage(one_each(vectors), "all"), stage(one_each(queries), "asked")
    sizes = sorted(r["d"] for r in queries.select(F.size("v").alias("d")).distinct().collect())
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(*(x.filter(F.size("v") == d) for x in (vectors, queries)), k, rerank) for d in sizes]
    return reduce(DataFrame.unionByName, found)


def _search(vectors: DataFrame, queries: DataFrame, k: int, rerank: float) -> DataFrame:
    norm = float(vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0)
    unique = stage(distinct_vectors(vectors, k + 1), "vectors")
    count = unique.count()
    pivots = lifted(choose_pivots(unique, count), norm)
    index, blocks = build_index(unique, count, pivots, norm)
    prefix = min(PREFIX, len(pivots))

    asked = stage(queries.select("id", "v", *(h.alias(n) for h, n in zip(key128(F.col("v")), ("k1", "k2")))), "queries")
    once = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    query_blocks = max(1, -(-once.count() // QUERIES))
    # as many groups of index blocks as partitions, if there are so many blocks; a query is copied once for each
    wide, high = max(-(-blocks // HELD), min(blocks, shuffle_partitions(vectors.sparkSession))), -(-query_blocks // ASKED)
    dealt = once.withColumn("part", F.pmod(F.xxhash64("k1"), F.lit(query_blocks)).cast("int")).groupBy("part").agg(F.collect_list(F.struct("k1", "k2", "v")).alias("queries"))
    across = dealt.select((F.col("part") % high).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("column"), "queries")
    down = index.select(F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("row"), (F.col("block") % wide).alias("column"), "ids", "vectors", "near")

    def find(blocks, parts):
        keys, q, best = ([], []), [], []
        if blocks.num_rows and parts.num_rows:
            k1, k2, v = parts.column("queries").combine_chunks().flatten().flatten()
            keys, q = (k1, k2), v.flatten().to_numpy().reshape(len(k1), -1)
            near = nearest_pivots(np.column_stack([q, np.zeros(len(q))]), pivots, prefix)
            best = [[] for _ in q]  # of each query, (-score, id) in order, k + 1 at most
        for row in range(blocks.num_rows if len(q) else 0):
            one = {c: blocks.column(c)[row].as_py() for c in ("ids", "vectors", "near")}
            ids, n = one["ids"], len(one["ids"])
            x = np.frombuffer(one["vectors"], np.float64).reshape(n, -1)
            files = post(np.frombuffer(one["near"], np.uint8).reshape(n, -1), len(pivots)).astype(np.float32)
            most = min(n, max(LEAST, int(np.ceil(rerank * n))))
            for at in range(0, len(q), SLAB):
                shared = rank_products(near[at : at + SLAB], files)
                least = np.partition(shared, n - most, 1)[:, n - most]
                for i, (products, low) in enumerate(zip(shared, least), at):
                    rows = np.flatnonzero(products >= low)
                    score = x[rows] @ q[i]
                    score[np.isnan(score)] = -np.inf  # products of huge components
                    low = np.partition(score, -k - 1)[-k - 1] if len(score) > k else -np.inf
                    if len(best[i]) > k:
                        low = max(low, -best[i][-1][0])
                    found = np.flatnonzero(score >= low)
                    if len(found):
                        best[i] = sorted(best[i] + [(-s, y) for s, r in zip(score[found].tolist(), rows[found].tolist()) for y in ids[r]])[: k + 1]
        of = np.repeat(np.arange(len(best)), [len(b) for b in best]) if best else []
        k1, k2 = (pa.array(np.asarray(x)[of] if best else [], pa.int64()) for x in keys)
        return pa.table({"k1": k1, "k2": k2, "vec_id": pa.array([y for b in best for _, y in b], pa.int64()), "score": pa.array([-s for b in best for s, _ in b], pa.float64())})

    found = down.groupBy("row", "column").cogroup(across.groupBy("row", "column")).applyInArrow(find, "k1 long, k2 long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("_n", order).filter(F.col("_n") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best"))
    best = stage(best.join(once.select("k1", "k2", "n").hint("merge"), ["k1", "k2"]), "best")
    out = lookup_join(asked.select(F.col("id").alias("query_id"), "k1", "k2"), best, ["k1", "k2"], "n", asked.count())
    kept = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(kept).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(e, e.filter(F.col("id") % 20 == 0), 20)
