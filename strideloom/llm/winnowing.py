"""Document fingerprints by winnowing, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import BLANKS, shuffle_partitions, table, with_rank

K, WINDOW = 5, 8
SPLIT = r"[\x20\x09-\x0D]+"
#: Words of more characters, and letters of scripts written without blanks, are cut into single characters.
LONGEST = 32
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}])"
LONG = rf"[^\x20\x09-\x0D]{{{LONGEST + 1}}}"
#: Each character of a long word: its first one, and then those that follow a match.
OF_LONG = rf"(?:\G(?!^)|(?={LONG}))([^\x20\x09-\x0D])"
LOW = 0xFFFFFFFF
#: Modulus and base of the rolling hash of a gram: values of 31 bits, products within a long.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
#: Buckets of consecutive ids for each shuffle partition.
BUCKETS = 4
#: Stands for a null doc_id: after all others in descending order.
NO_ID = -(2**63)


def spaced(text: Column) -> Column:
    """text with blanks around each character of a run without white space."""
    cut = F.regexp_replace(F.regexp_replace(text, UNSPACED, " $1 "), OF_LONG, "$1 ")
    return F.when(text.rlike(f"{UNSPACED}|{LONG}"), F.btrim(cut, F.lit(BLANKS))).otherwise(text)


def rolled(k: int) -> list[tuple[str, str]]:
    """Steps (name, SQL) to ``_g<k>``, the rolling hash of the k words from each position on, of their hashes ``_g1``.

    The value is sum of w[i + j] BASE^(k - 1 - j) modulo PRIME, the one that the recurrence
    g[i + 1] = (g[i] - w[i] BASE^(k - 1)) BASE + w[i + k] rolls along. A column expression cannot carry a value from one
    element to the next without copying the array, so each gram's value is made of those of the two shorter runs it
    consists of, which its neighbours use too. Words past the end count as 0.
    """
    steps, made = [], {1}

    def make(n: int) -> None:
        if n in made:
            return
        head = 1 << (n.bit_length() - 1)
        head = head // 2 if head == n else head
        make(head)
        make(n - head)
        power = pow(BASE, n - head, PRIME)
        steps.append((f"_g{n}", f"transform(_g{head}, (v, i) -> (v * {power}L + coalesce(get(_g{n - head}, i + {head}), 0L)) % {PRIME}L)"))
        made.add(n)

    make(k)
    return steps


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with ``out``: array<struct<hash, pos>> of the text's winnowed k-grams, in order of position.

    A gram is k consecutive words (lower case, parted by white space; a character of a script without blanks or of a
    word of over LONGEST characters is a word), its position the number of its first word. Of each ``window`` consecutive grams the one with the least
    hash is kept, the rightmost of equals. So two texts that share k + window - 1 words in a row share a
    fingerprint, and its positions say where. A text of fewer than k words is one gram, one of fewer
    grams than the window one window; a null or blank text has no fingerprint.

    Grams compete by their rolling hash; the fingerprint has a 64-bit hash of each chosen one.

    The window is a power of 2, as minima over 1, 2, 4, ... grams come from each other. Each long holds the 31 bits of
    the rolling hash above the inverse of the position, so that ``least`` picks the rightmost of equals. Time and
    memory are in proportion to the text.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of 2")
    # get() takes an element in constant time and gives null past the end, which the hash skips; slice() would copy the array
    gram = lambda i: "xxhash64(" + ", ".join(f"get(_h, {i} + {j})" for j in range(k)) + ")"
    blank = F.btrim(F.col(text), F.lit(BLANKS))
    df = df.withColumn("_w", F.when(blank != "", F.split(spaced(F.lower(blank)), SPLIT, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_h", F.expr("transform(_w, x -> xxhash64(x))")).drop("_w")
    df = df.withColumn("_g1", F.expr(f"transform(_h, x -> pmod(x, {PRIME}L))"))
    steps = rolled(k)
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    df = df.withColumn("_m", F.expr(f"transform(slice(_g{k}, 1, greatest(size(_h) - {k} + 1, 1)), (v, i) -> shiftleft(v, 32) | ({LOW}L - i))"))
    df = df.drop("_g1", *(name for name, _ in steps))
    df = df.withColumn("_all", F.expr(f"if(size(_m) between 1 and {window - 1}, array_min(_m), null)"))
    step = 1
    while step < window:
        df = df.withColumn("_m", F.expr(f"zip_with(slice(_m, 1, greatest(size(_m) - {step}, 0)), slice(_m, {step + 1}, greatest(size(_m) - {step}, 0)), (a, b) -> least(a, b))"))
        step *= 2
    df = df.withColumn("_m", F.expr("if(_all is null, array_distinct(_m), array(_all))"))
    at = f"cast({LOW}L - (v & {LOW}L) as int)"
    chosen = f"transform(_m, v -> named_struct('hash', {gram(at)}, 'pos', {at}))"
    return df.withColumn(out, F.expr(chosen)).drop("_h", "_m", "_all")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints' hashes; 1 if both are empty."""
    a, b = a.getField("hash"), b.getField("hash")
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["pos"])), " ")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document with its next one's edit: doc_id, text, edited, fp, edited_fp, near_edited, near_next.

    The next document is that of the next lower doc_id; after the lowest comes the highest. A null doc_id
    counts as below all others; null text as empty. Repeated rows of a doc_id are one document to the one
    before it (the text of least hash), and each gives a row. A single document is its own next.

    Ids alone are range-sorted and cut into buckets of consecutive ids. A text moves once, to its bucket; the highest
    of a bucket moves to the bucket above as well, so that each document meets its next one where it is. Rows without an id, however many,
    do not move: one of them goes to the bucket of the lowest id, and the next document of all, that of the highest id, is a scalar to them.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), text.alias("text"))
    ring, n = with_rank(base.select("k").distinct(), [F.col("k")], "ring")
    rows = max(1, -(-n // (BUCKETS * shuffle_partitions(docs.sparkSession))))
    last = ring.filter((F.col("_rank") % rows == rows - 1) | (F.col("_rank") == n - 1)).orderBy("_rank")
    tops = [r["k"] for r in last.select("k").collect()]  # one for each bucket
    if not tops:
        tops = [0]
    least = lambda rows: rows.select(text.alias("text")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    nameless = docs.filter("doc_id is null")
    base = base.filter("doc_id is not null").unionByName(least(nameless).filter("text is not null").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(NO_ID).alias("k"), "text"))
    # two levels of about sqrt(buckets) ids each, so that a row looks at few of them
    width = max(1, math.isqrt(len(tops)))
    literal = lambda ids: "array(" + ", ".join(f"{i}L" if i != NO_ID else "(-9223372036854775807L - 1L)" for i in ids) + ")"
    groups = [tops[i : i + width] for i in range(0, len(tops), width)]
    base = base.withColumn("_g", F.expr(f"size(filter({literal([g[-1] for g in groups])}, c -> c < k))"))
    base = base.withColumn("_cuts", F.expr(f"get(array({', '.join(map(literal, groups))}), _g)")).withColumn("_in", F.expr("size(filter(_cuts, c -> c < k))"))
    own = F.expr(f"_g * {width} + _in")
    above = F.expr(f"if(get(_cuts, _in) = k, array((_g * {width} + _in + 1) % {len(tops)}), array())")
    places = F.concat(F.array(F.struct(own.cast("long").alias("bucket"), F.lit(1).alias("mine"))), F.transform(above, lambda b: F.struct(b.cast("long").alias("bucket"), F.lit(0).alias("mine"))))
    t = base.withColumn("_p", F.explode(places)).select("doc_id", "k", "text", "_p.bucket", "_p.mine")
    t = with_fingerprint(t.repartition(shuffle_partitions(docs.sparkSession), "bucket").withColumn("th", F.xxhash64("text")), "text", "fp")

    # ascending, so the next document is the row before; of a repeated doc_id all rows take what comes before the first
    order = ("bucket", "mine", "k")
    before = F.lag(F.struct("text", "fp")).over(Window.partitionBy("bucket").orderBy("mine", "k", F.desc("th")))
    t = t.withColumn("_before", before)
    t = t.withColumn("v", F.first("_before").over(Window.partitionBy(*order).orderBy(F.desc("th")))).filter("mine = 1 and doc_id is not null")
    highest = nameless if tops[-1] == NO_ID else docs.filter(F.col("doc_id") == tops[-1])
    after = with_fingerprint(least(highest), "text", "fp").select(F.struct("text", "fp").alias("v"))
    rest = with_fingerprint(nameless.select("doc_id", text.alias("text")), "text", "fp").withColumn("v", after.scalar())
    t = t.select("doc_id", "text", "fp", "v").unionByName(rest)
    t = t.withColumn("half", F.expr("cast(char_length(text) div 2 as int)"))
    t = t.withColumn("edited", F.expr("concat(substring(text, 1, char_length(text) - half), substring(v.text, 1, half))"))
    t = with_fingerprint(t, "edited", "edited_fp")
    near = (likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("v.fp")).alias("near_next"))
    return t.select("doc_id", "text", "edited", "fp", "edited_fp", *near)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits."""
    t = edited_fingerprints(table(spark, sf_dir, "documents"))
    return t.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
