"""MinHash near-dedup of multisets of word shingles by BagMinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideloom.llm.common import BLANKS, key128, stage, table
from strideloom.llm.components import components
from strideloom.llm.hashing import MIX, mixed, uniform

SHINGLE, SIMILAR = 5, 0.8
#: At a similarity of 0.8 a pair meets in one of the bands with probability 1 - (1 - 0.8^6)^24 = 0.9993.
BANDS, ROWS = 24, 6
SPLIT = r"[\x20\x09-\x0D]+"
#: Words worked on at once in a task.
GROUP_WORDS = 400_000
#: Rounds of comparison with centres; members outside a bucket's largest class that are compared with all of the bucket.
STARS, FEW = 2, 32
#: Ratio of neighbouring size classes, and hash classes in which shingles are counted to tell rare from common ones.
SIZE_STEP, CLASSES = 1.06, 1 << 18
#: Longs of a bag's parity bits.
MARKS = 32
#: Rows in which those counts come to the driver.
COUNT_ROWS = 64


def word_hashes(text: Column) -> Column:
    blank = F.btrim(text, F.lit(BLANKS))
    return F.transform(F.when(blank != "", F.split(blank, SPLIT, -1)).otherwise(F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of SHINGLE words, and each one's document; a shorter document is one shingle."""
    n, w = len(words), words.view(np.uint64)
    docs = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(n)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        moved = np.zeros(n, np.uint64)
        moved[: n - j] = w[j:]
        h = mixed(h ^ np.where(left > j, moved, np.uint64(0)))
    whole = left >= np.minimum(np.repeat(lengths, lengths), SHINGLE)
    return h[whole], docs[whole]


def bags(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted: hash, document, multiplicity."""
    s, d = shingles(words, lengths)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return s[at], d[at], np.diff(np.append(at, len(s)))


def signatures(s: np.ndarray, d: np.ndarray, w: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash: docs x size arrival times; two bags agree in a slot with the probability of their weighted Jaccard index.

    Weights are discretised at the whole numbers. Each element has a Poisson process for each of the weight intervals
    (0, 1], (1, 2], (2, 4], (4, 8], ... that its weight reaches, of a rate in proportion to the interval's width. A process
    is a tree: after its first point it is split at the middle weight into two of half the rate. The point goes to either
    half by chance; the other half draws its own first point from there on. Halves above the element's weight are
    not followed, and what reaches a single step of weight is a plain process whose points count. Draws depend on the element and
    the path alone, so bags share all points below the lesser weight. A slot keeps its first time.

    Points beyond the time at which all of a document's slots are likely full are never drawn: an element costs
    about one draw. A document with an empty slot is drawn again up to a later time.
    """
    out = np.full((docs, size), np.inf)
    weight = np.bincount(d, w, docs)
    todo = weight > 0
    horizon = np.full(docs, np.inf)
    horizon[todo] = size * (np.log(size) + 3) / weight[todo]

    def drawn(state: np.ndarray, time: np.ndarray, width: np.ndarray):
        """The next point of each process: state, time, slot."""
        state = mixed(state)
        time = time - np.log(uniform(state)) * size / width
        state = mixed(state)
        return state, time, (state % np.uint64(size)).astype(np.int64)

    while todo.any():
        mine = todo[d]
        roots, low, level = [], 0, 0
        s0, d0, w0 = s[mine], d[mine], w[mine]
        while len(s0):
            roots.append((mixed(s0 ^ np.uint64(level * int(MIX[1]) % 2**64)), d0, w0, np.full(len(s0), low), np.full(len(s0), max(low, 1))))
            low, level = (low * 2 or 1), level + 1
            more = w0 > low
            s0, d0, w0 = s0[more], d0[more], w0[more]
        state, doc, top, base, width = map(np.concatenate, zip(*roots))
        state, time, slot = drawn(state, np.zeros(len(doc)), width)
        while len(doc):
            live = time <= horizon[doc]
            state, doc, top, base, width, time, slot = (x[live] for x in (state, doc, top, base, width, time, slot))
            step = width == 1
            np.minimum.at(out.reshape(-1), doc[step] * size + slot[step], time[step])
            again = (*drawn(state[step], time[step], width[step]), doc[step], top[step], base[step], width[step])
            state, doc, top, base, half, time, slot = (x[~step] for x in (state, doc, top, base, width // 2, time, slot))
            if not len(doc):
                state, time, slot, doc, top, base, width = again
                continue
            upper = (state >> np.uint64(40)) & np.uint64(1)  # the half that has the point
            parts = [again]
            for side in (0, 1):
                seed = mixed(state ^ MIX[side + 1])
                new = drawn(seed, time, half)
                kept = upper == side
                both = np.where(kept, seed, new[0]), np.where(kept, time, new[1]), np.where(kept, slot, new[2])
                reached = base + side * half < top
                parts.append(tuple(x[reached] for x in (*both, doc, top, base + side * half, half)))
            state, time, slot, doc, top, base, width = map(np.concatenate, zip(*parts))
        open_slots = ~np.isfinite(out).all(1) & todo
        horizon[open_slots] *= 2
        todo = open_slots
    return out


def _groups(lengths: np.ndarray):
    """Slices of rows with about GROUP_WORDS words each."""
    start = words = 0
    for i, n in enumerate(lengths):
        words += n
        if words >= GROUP_WORDS:
            yield start, i + 1
            start, words = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _word_groups(batch: pa.RecordBatch):
    col = batch.column("words")
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for i, j in _groups(lengths):
        yield i, j, values[offsets[i] : offsets[j]], lengths[i:j]


def banded(texts: DataFrame) -> DataFrame:
    """texts(id, t1, t2, words) to (id, t1, t2, size, bands): number of shingles and BANDS hashes of ROWS slots each; none for a text without words."""

    def run(batches):
        for batch in batches:
            for i, j, words, lengths in _word_groups(batch):
                sig = signatures(*bags(words, lengths), j - i, BANDS * ROWS).view(np.uint64).reshape(j - i, BANDS, ROWS)
                h = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64)), (j - i, BANDS)).copy()
                for r in range(ROWS):
                    h = mixed(h ^ sig[:, :, r])
                ends = np.concatenate([[0], np.cumsum(np.where(lengths > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, h[lengths > 0].view(np.int64).ravel())
                sizes = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("id", "t1", "t2")), pa.array(sizes), lists], names=["id", "t1", "t2", "size", "bands"])

    return texts.mapInArrow(run, "id long, t1 long, t2 long, size int, bands array<long>")


def bag_sets(texts: DataFrame) -> DataFrame:
    """texts(id, words) to (id, bag, marks): each shingle's copies told apart by number, so that sets of them meet as the multisets do.

    ``marks`` are the parities of the numbers of elements in 64 * MARKS hash classes (see ``can_meet``). A bag has the upper 32 bits of its 64-bit hashes: two texts of 1,000 shingles have one alike by chance in 4,000 pairs,
    which moves their similarity by 0.0006.
    """

    def run(batches):
        for batch in batches:
            for i, j, words, lengths in _word_groups(batch):
                s, d, w = bags(words, lengths)
                each = np.repeat(np.arange(len(s)), w)
                copy = np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)
                key = np.where(copy == 0, s[each], mixed(s[each] ^ mixed(copy.astype(np.uint64))))
                ends = np.cumsum(np.bincount(d[each], minlength=j - i))
                short = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), short)
                bit = short.view(np.uint32).astype(np.int64) % (64 * MARKS)
                marks = np.zeros((j - i, MARKS), np.uint64)
                np.bitwise_xor.at(marks, (d[each], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
                marks = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * MARKS, marks.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), lists, marks], names=["id", "bag", "marks"])

    return texts.mapInArrow(run, "id long, bag array<int>, marks array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that share a band, with ``similarity``, the Jaccard index of their multisets, if it is ``similar`` or more.

    ``pairs`` and ``sets`` are staged, so both joins are plain shuffled ones whose skewed partitions Spark splits at run
    time: a bag that many pairs need is read by as many tasks.
    """
    bag = lambda x: sets.select(F.col("id").alias(x), F.col("bag").alias(f"bag_{x}"), F.col("bands").alias(f"bands_{x}"))
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    t = pairs.join(bag("b"), "b").join(bag("a"), "a").filter(F.arrays_overlap("bands_a", "bands_b"))
    t = t.select("a", "b", (both / (F.size("bag_a") + F.size("bag_b") - both)).alias("similarity"))
    return t.filter(F.col("similarity") >= similar)


def can_be(size: Column, other: Column, similar: float) -> Column:
    """Whether multisets of these sizes can be so similar."""
    return (size >= other * (similar - 1e-9)) & (other >= size * (similar - 1e-9))


def can_meet(x: str, y: str, similar: float) -> Column:
    """Whether multisets with the columns ``size`` and ``marks``, named with prefixes x and y, can be so similar.

    Two multisets of a and b elements are so similar if at most (a + b) (1 - similar) / (1 + similar) are in one alone. Each of
    those turns one parity, so at least as many are in one alone as parities differ: no pair that is similar enough is refused.
    """
    differ = F.zip_with(f"{x}marks", f"{y}marks", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda n, k: n + k)
    return apart <= (F.col(f"{x}size") + F.col(f"{y}size")) * ((1 - similar) / (1 + similar) + 1e-9)


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def live(members: DataFrame) -> DataFrame:
    """members(bucket, id, size, label) of the buckets that hold several labels, with the bucket's most frequent label ``most``, its members ``n`` and ``others`` of other labels."""
    each = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    spread = each.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("others"))
    return stage(members.join(stage(spread.filter("others > 0"), "live"), "bucket"), "members")


def to_centres(members: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of each bucket's centre and its other members of another label.

    The centre is the member whose buckets have most members: near a group's origin, since edits take a copy out of
    buckets. Members that share a label with others come last, so each round has a centre for those not yet joined.
    """
    of = members.groupBy("id", "label", "size").agg(F.sum("n").alias("score"))
    kin = members.groupBy("label", "id").agg(F.lit(1).alias("one")).groupBy("label").agg((F.count("one") == 1).alias("lone"))
    scored = stage(of.join(stage(kin, "kin"), "label"), "scored")
    rank = F.struct("lone", "score", "id")
    at = members.join(scored.select("id", "lone", "score"), "id")
    centres = stage(at.groupBy("bucket").agg(F.max_by(F.struct("id", "label", "size"), rank).alias("c")), "centres")
    met = members.join(centres, "bucket").filter("id <> c.id and label <> c.label").filter(can_be(F.col("size"), F.col("c.size"), similar))
    return met.select(*pair("id", "c.id")).distinct()


def across(members: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different labels in a bucket that can be of the wanted similarity, one at least not of the bucket's most frequent label.

    members(bucket, id, size, label, most, marks)
    """
    of_other = (F.col(c).alias(f"x_{c}") for c in ("label", "size", "marks"))
    other = members.filter("label <> most").select("bucket", F.col("id").alias("x"), *of_other)
    met = other.join(members, "bucket").filter("label <> x_label and (label = most or x < id)")
    met = met.filter(can_be(F.col("size"), F.col("x_size"), similar)).filter(can_meet("", "x_", similar))
    return met.select(*pair("x", "id")).distinct()


def prefixes(sets: DataFrame, counts: np.ndarray, similar: float) -> DataFrame:
    """sets(id, label, bag) to (key, id, label, side): two bags of the wanted similarity have a key in common, on opposite sides or both on side 2.

    Of two sets of a and b elements that share o = similar (a + b) / (1 + similar) or more, the rarest a - o + 1 of one and the
    rarest b - o + 1 of the other share one, in any common order of the elements. The order is by ``counts`` of hash
    classes, so common elements are seldom among them. Sizes fall into classes of SIZE_STEP; a set has a prefix for each
    class that its partners can be of, and keys are of an element and both classes; side 0 is the lesser class, 1 the
    greater, 2 either of two alike.
    """
    step = np.log(SIZE_STEP)

    def run(batches):
        for batch in batches:
            keys, sides, sizes = [], [], np.zeros(batch.num_rows, np.int64)
            for i, bag in enumerate(batch.column("bag")):
                bag = bag.values.to_numpy(zero_copy_only=False)
                a = len(bag)
                if not a:
                    continue
                bag = bag[np.lexsort((bag, counts[bag.astype(np.int64) % len(counts)]))].view(np.uint32).astype(np.uint64)
                own = int(np.floor(np.log(a) / step + 1e-9))
                for j in range(max(0, int(np.floor(np.log(max(1, similar * a)) / step - 1e-6))), int(np.floor(np.log(a / similar) / step + 1e-6)) + 1):
                    least = max(similar * a, SIZE_STEP**j * (1 - 1e-9))
                    overlap = int(np.ceil(similar * (a + least) / (1 + similar) - 1e-6))
                    keys.append(mixed(mixed(bag[: max(1, a - overlap + 1)]) ^ np.uint64(min(own, j) * 65536 + max(own, j))).view(np.int64))
                    sides.append(np.full(len(keys[-1]), 2 if own == j else int(own > j), np.int8))
                    sizes[i] += len(keys[-1])
            if keys:
                ids, labels = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("id", "label"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids), pa.array(labels), pa.array(np.concatenate(sides))], names=["key", "id", "label", "side"])

    return sets.mapInArrow(run, "key long, id long, label long, side byte")


def class_counts(bags: DataFrame) -> np.ndarray:
    """How many shingles of the bags fall into each of CLASSES hash classes; a few rows of bytes come to the driver, 1 MB in all."""

    def pack(key, t):
        part = np.zeros(CLASSES // COUNT_ROWS, np.uint32)
        part[t.column("c").to_numpy() % len(part)] = np.minimum(t.column("n").to_numpy(), 2**32 - 1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    each = bags.select(F.explode("bag").alias("s")).groupBy(F.pmod("s", F.lit(CLASSES)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy((F.col("c") / (CLASSES // COUNT_ROWS)).cast("int").alias("part")).applyInArrow(pack, "part int, counts binary")
    counts = np.zeros((COUNT_ROWS, CLASSES // COUNT_ROWS), np.uint32)
    for part, x in rows.collect():
        counts[part] = np.frombuffer(x, np.uint32)
    return counts.ravel()


def rare_pairs(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different labels among the members, all that can be of the wanted similarity: an exact search by rare shingles.

    A key's most frequent label is not paired with itself, so a key that a whole class has costs no more than its members
    for each outsider.
    """
    of = members.select("id", "label", "size").distinct()
    bags = stage(sets.select("id", "bag", "marks").join(of, "id"), "bags")
    posts = stage(prefixes(bags.select("id", "label", "bag"), class_counts(bags), similar), "posts")
    each = posts.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key")
    keys = each.agg(F.max_by("label", F.struct("k", "label")).alias("most"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    shared = posts.join(stage(keys.select("key", "most"), "keys"), "key")
    shared = stage(shared.join(bags.select("id", "size", "marks"), "id"), "shared")
    of_other = (F.col(c).alias(f"x_{c}") for c in ("label", "side", "size", "marks"))
    other = shared.filter("label <> most").select("key", F.col("id").alias("x"), *of_other)
    facing = (F.col("x_side") != F.col("side")) | (F.col("side") == 2)
    met = other.join(shared, "key").filter("label <> x_label and (label = most or x < id)").filter(facing)
    met = met.filter(can_meet("", "x_", similar))
    return met.select(*pair("x", "id")).distinct()


def hubs(links: DataFrame) -> DataFrame:
    """links(a, b) to (id, hub): of each node and its neighbours the one of most links. One hub means one class; the reverse need not hold."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("hub")).union(links.select("b", "a"))
    degree = stage(both.groupBy(F.col("id").alias("hub")).agg(F.count(F.lit(1)).alias("n")), "degree")
    every = both.join(degree, "hub").select("id", "hub", "n").unionByName(degree.select(F.col("hub").alias("id"), "hub", "n"))
    return stage(every.groupBy("id").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")), "hubs")


def linked(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame | None:
    """members(bucket, id, size) to (node, root) of the classes that verified links make; None if there is no link.

    A link joins two texts that share a bucket and whose similarity is ``similar`` or more. Members of a bucket are first
    compared with a centre, STARS times, which joins most of a group of copies at the cost of its size. In buckets
    that still hold several classes, members outside the largest are compared with all others if they are FEW at most, so
    that the cost is still in proportion to the bucket. Other buckets give up their members to an exact search by
    rare shingles, whose finds must share a bucket as well. Neither lists pairs whose parities show them too unlike. So every candidate pair is compared, or shown to be too
    unlike, or in one class already: no link between classes is lost, and no group's pairs are listed.
    """
    members, links, seen = members.withColumn("label", F.col("id")), None, None

    def compared(pairs: DataFrame) -> None:
        nonlocal links, seen
        pairs = stage(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        new = stage(verified(pairs, sets, similar).select("a", "b"), "links")
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = new if links is None else links.unionByName(new)

    for _ in range(STARS):
        members = live(members.select("bucket", "id", "size", "label"))
        compared(to_centres(members, similar))
        joined = members.select("bucket", "id", "size", F.col("label").alias("own")).join(hubs(links), "id", "left")
        members = joined.select("bucket", "id", "size", F.coalesce("hub", "own").alias("label"))
    members = live(members)
    few = members.filter(F.col("others") <= FEW).join(sets.select("id", "marks"), "id")
    pairs = across(few, similar)
    many = members.filter(F.col("others") > FEW)
    if not many.isEmpty():
        pairs = pairs.unionByName(rare_pairs(many, sets, similar)).distinct()
    compared(pairs)
    return None if links.isEmpty() else components(links)


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Each row's doc_id, ``rep`` (the first doc_id with the same text) and ``class_id`` (the least doc_id of its class).

    Classes are the components of links between texts that share a band and whose multisets of SHINGLE-word shingles have a
    Jaccard index of ``similar`` or more. Words are parted by white space; a text of fewer words is one shingle. Equal texts
    are one class; so are texts equal but for white space. Texts without words are linked to their equals only.
    Null text counts as empty. Null doc_ids take no part: class_id and rep are null. Repeated rows fare alike; the text of
    a doc_id whose rows have different ones is that of least hash. An empty table gives no rows; other columns are not read.

    Texts are reduced to one of each (by 128-bit hash) before any comparison.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = [k.alias(n) for k, n in zip(key128(text), ("t1", "t2"))]
    keyed = docs.select("doc_id", *hashed)
    own = stage(keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("t")).select("doc_id", "t.t1", "t.t2"), "own")
    first = stage(own.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep")), "texts")
    of_rep = first.select(F.col("rep").alias("id"), "t1", "t2")
    words = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), *hashed, word_hashes(text).alias("words"))
    bands = stage(banded(words).join(of_rep, ["id", "t1", "t2"], "left_semi").dropDuplicates(["id"]), "bands")
    every = bands.select("id", "size", F.explode("bands").alias("bucket"))
    shared = stage(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared")
    members = stage(every.join(shared, "bucket"), "buckets")
    wanted = of_rep.join(members.select("id").distinct(), "id", "left_semi")
    kept = docs.select(F.col("doc_id").alias("id"), *hashed, word_hashes(text).alias("words")).join(wanted, ["id", "t1", "t2"], "left_semi")
    sets = bag_sets(kept.select("id", "words")).dropDuplicates(["id"])
    sets = stage(sets.join(bands.select("id", "bands"), "id"), "sets")
    names = linked(members, sets, similar)
    if names is not None:
        first = first.join(names.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        first = first.withColumn("root", F.lit(None).cast("long"))
    first = stage(first.select("t1", "t2", "rep", F.coalesce("root", "rep").alias("class_id")), "classes")
    classed = stage(own.join(first, ["t1", "t2"]).select("doc_id", "rep", "class_id"), "classed")
    return docs.select("doc_id").join(classed, "doc_id", "left")


def near_deduped(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs of the least doc_id of each class; rows without a doc_id stay."""
    keep = stage(near_classes(docs.select("doc_id", "text"), similar).filter("doc_id = class_id").select("doc_id").distinct(), "kept")
    return docs.filter("doc_id is null").unionByName(docs.join(keep, "doc_id", "left_semi"))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
