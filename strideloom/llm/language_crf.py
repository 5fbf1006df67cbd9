"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideloom.llm.common import broadcast_small, stage, table
from strideloom.llm.hashing import mixed

#: Labelled documents of each language that the model is fitted on, those of least hash of doc_id.
SAMPLE_PER_LANG = 250
#: How many times the sample is sorted to find it.
SPARE = 8
#: Training sequences, words in each, and the longest span of one document in them.
SEQUENCES, STEPS, SPAN = 4000, 24, 16
SPACE = 1 << 17
#: n-grams of up to GRAM characters anywhere in a word with its ends marked, of up to AFFIX at either end.
GRAM, AFFIX = 3, 5
EPOCHS, RATE, DECAY = 60, 0.08, 1e-4
#: Entries of the arrays of pairs of labels in training.
CHUNK = 2_000_000
#: Words seen so often in the sample are in the lexicon.
LEXICON_MIN = 3
TABLE_WORDS, GROUP_WORDS, BLOCK = 200_000, 300_000, 16
#: Entries of the products of blocks that are held at once: 32 MB, and as much again while they are multiplied.
PAIRS = 1 << 22
WORD = re.compile(r"[^\W\d_]{1,32}")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; a run of over 32 is several words."""
    return WORD.findall(text.lower()) if text else []


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the word of each: n-grams of 1 to 3 with the ends marked, longer affixes, lexicon entries."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner, n = np.repeat(np.arange(len(words)), lengths), len(codes)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    at_start = left == lengths[owner]
    ids, owners, h = [], [], np.zeros(n, np.uint64)
    for size in range(1, AFFIX + 1):
        moved = np.zeros(n, np.uint64)
        moved[: max(0, n - size + 1)] = codes[size - 1 :]
        h = mixed(h ^ moved)
        ok = left >= size
        if size > GRAM:
            ok &= at_start | (left == size)
        ids.append((h[ok] >> np.uint64(32)).astype(np.int64) % SPACE)
        owners.append(owner[ok])
    entries = [(i, zlib.crc32(w.encode()) % SPACE) for i, w in enumerate(words) if w in lexicon]
    ids.append(np.array([x for _, x in entries], np.int64))
    owners.append(np.array([i for i, _ in entries], np.int64))
    return np.concatenate(ids), np.concatenate(owners)


def summed(weights: np.ndarray, ids: np.ndarray, owners: np.ndarray, words: int) -> np.ndarray:
    return np.stack([np.bincount(owners, weights[ids, i], words) for i in range(weights.shape[1])], 1)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # SPACE x langs
    moves: np.ndarray  # langs x langs, log
    lexicon: frozenset[str]

    def scores(self, words: list[str]) -> np.ndarray:
        return summed(self.weights, *features(words, self.lexicon), len(words))


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward: the probability of each label at each word of texts that lie one after another.

    Texts are cut into blocks. Products of a block's step matrices come first, for all blocks at once; then
    the messages into each block, from text start and text end, block after block; then the words within.
    So a text of n words takes n / BLOCK + 2 BLOCK vector steps instead of n. Blocks are longer where their products, of one entry for each
    pair of labels, would have over PAIRS entries.
    """
    n, k = scores.shape
    block = max(BLOCK, -(-n * k * k // PAIRS))
    per = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(per)])  # of each text's blocks
    nb = int(first[-1])
    text_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - text_at[owner]
    row, col = first[owner] + place // block, place % block
    emit = np.ones((nb, block, k))
    emit[row, col] = np.exp(scores - scores.max(1, keepdims=True))
    real = np.zeros((nb, block), bool)
    real[row, col] = True
    a = np.exp(moves)
    norm = lambda x, axes: x / x.sum(axes, keepdims=True)

    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        on = real[:, t]  # a block that has ended stays as it is
        product[on] = norm((product[on].reshape(-1, k) @ a).reshape(-1, k, k) * emit[on, t, None, :], (1, 2))

    # longest texts first, so that those still going are always the first few
    order = np.argsort(-per, kind="stable")
    base, count = first[:-1][order], per[order]
    into, back = np.empty((nb, k)), np.empty((nb, k))
    f, b = np.full((len(order), k), 1 / k), np.full((len(order), k), 1 / k)
    for i in range(int(count[0]) if len(count) else 0):
        m = int(np.searchsorted(-count, -i, side="left"))  # texts with more than i blocks
        at, end = base[:m] + i, base[:m] + count[:m] - 1 - i
        into[at], back[end] = f[:m], b[:m]
        f[:m] = norm(np.einsum("nk,nkj->nj", f[:m], product[at]), 1)
        b[:m] = norm(np.einsum("nkj,nj->nk", product[end], b[:m]), 1)

    forth = np.empty((nb, block, k))
    f = into
    for t in range(block):
        f = np.where(real[:, t, None], norm((f @ a) * emit[:, t], 1), f)
        forth[:, t] = f
    b = back
    for t in reversed(range(block)):
        forth[:, t] *= b
        b = np.where(real[:, t, None], norm((b * emit[:, t]) @ a.T, 1), b)
    return norm(forth[row, col], 1)


def loss_and_gradient(
    weights: np.ndarray, moves: np.ndarray, words: np.ndarray, labels: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int
) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood a word of labelled sequences (both sequences x steps), and its gradient in weights and moves.

    ``words`` are numbers below n; feature flat[i] is one of word owner[i]. Sequences are worked on in chunks, so that arrays of
    pairs of labels have at most CHUNK entries.
    """
    k, steps = len(moves), words.shape[1]
    scores = summed(weights, flat, owner, n)
    a, top = np.exp(moves - moves.max()), moves.max()
    loss, by_word, of_moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
    size = max(1, CHUNK // (k * k))
    for i in range(0, len(words), size):
        w, y = words[i : i + size], labels[i : i + size]
        rows = np.arange(len(w))[:, None]
        raw = scores[w]
        high = raw.max(2, keepdims=True)
        emit = np.exp(raw - high)
        f, b, scale = [], [np.ones((len(w), k))], []
        for t in range(steps):
            x = emit[:, 0] if t == 0 else (f[-1] @ a) * emit[:, t]
            scale.append(x.sum(1))
            f.append(x / scale[-1][:, None])
        for t in range(1, steps):
            x = (b[-1] * emit[:, steps - t]) @ a.T
            b.append(x / x.sum(1, keepdims=True))
        b.reverse()
        loss += np.log(scale).sum() + high.sum() + top * len(w) * (steps - 1)
        loss -= raw[rows, np.arange(steps), y].sum() + moves[y[:, :-1], y[:, 1:]].sum()
        p = np.stack(f, 1) * np.stack(b, 1)
        p /= p.sum(2, keepdims=True)
        for t in range(1, steps):
            x = f[t - 1][:, :, None] * a * (emit[:, t] * b[t])[:, None, :]
            of_moves += (x / x.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(of_moves, (y[:, :-1], y[:, 1:]), -1)
        p[rows, np.arange(steps), y] -= 1
        by_word += np.stack([np.bincount(w.ravel(), p[:, :, j].ravel(), n) for j in range(k)], 1)
    of_weights = np.stack([np.bincount(flat, by_word[owner, j], len(weights)) for j in range(k)], 1)
    return loss / words.size, of_weights / words.size, of_moves / words.size


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Crf:
    """Maximum likelihood on code-switched sequences: spans of sampled documents, joined at random, each word with its document's language."""
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    parted = [words_of(t) for t in texts]
    kept = [(w, names.index(g)) for w, g in zip(parted, langs) if w]
    if not kept:
        return Crf([], np.zeros((SPACE, 0), np.float32), np.zeros((0, 0)), frozenset())
    counts: dict[str, int] = {}
    for w, _ in kept:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    lexicon = frozenset(x for x, c in counts.items() if c >= LEXICON_MIN)
    by_lang = [[w for w, g in kept if g == i] for i in range(k)]
    known = [i for i in range(k) if by_lang[i]]

    index: dict[str, int] = {}
    words, labels = np.empty((SEQUENCES, STEPS), np.int64), np.empty((SEQUENCES, STEPS), np.int64)
    for s in range(SEQUENCES):
        line: list[tuple[str, int]] = []
        whole = s % 2 == 0  # every other sequence is of one language
        g = known[rng.integers(len(known))]
        while len(line) < STEPS:
            if not whole:
                g = known[rng.integers(len(known))]
            doc = by_lang[g][rng.integers(len(by_lang[g]))]
            size = STEPS if whole else int(rng.integers(3, SPAN + 1))
            start = int(rng.integers(max(1, len(doc) - size + 1)))
            line += [(w, g) for w in doc[start : start + size]]
        for t, (w, g) in enumerate(line[:STEPS]):
            words[s, t], labels[s, t] = index.setdefault(w, len(index)), g
    flat, owner = features(list(index), lexicon)
    seen, flat = np.unique(flat, return_inverse=True)  # the features that the sample has; all others keep weight 0

    weights, moves = np.zeros((len(seen), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for epoch in range(1, EPOCHS + 1):
        _, *grads = loss_and_gradient(weights, moves, words, labels, flat, owner, len(index))
        for x, g, m, v in ((weights, grads[0], *state[:2]), (moves, grads[1], *state[2:])):
            g += DECAY * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    whole = np.zeros((SPACE, k), np.float32)
    whole[seen] = weights
    return Crf(names, whole, moves, lexicon)


def held_out() -> Column:
    """crc32 of the doc_id's text mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Crf:
    """The model of the bounded sample: SAMPLE_PER_LANG labelled documents of each language, of those not held out.

    Of a language with many documents only those whose hash is below a threshold, about SPARE times the sample, are
    sorted, so that what one task reads does not grow with the table. The sample meets in one task, which fits the model; only the
    model (half a MB a language) comes to the driver.
    """
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = broadcast_small(stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")), "langs"))
    near = rows.join(sizes, "lang").filter(part * F.col("_size") <= SPARE * SAMPLE_PER_LANG)
    first = Window.partitionBy("lang").orderBy(part, "doc_id", F.xxhash64("text"))
    sample = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLE_PER_LANG).select("lang", "doc_id", "text")

    def run(batches):
        got = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "doc_id", "text"))))
        crf = fit([r[2] for r in got], [r[0] for r in got])
        yield pa.RecordBatch.from_arrays(
            [pa.array([crf.langs], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (crf.weights, crf.moves)), pa.array([sorted(crf.lexicon)], pa.list_(pa.string()))],
            names=["langs", "weights", "moves", "lexicon"])

    one = sample.repartition(1).mapInArrow(run, "langs array<string>, weights binary, moves binary, lexicon array<string>").toArrow()
    if not one.num_rows:
        return fit([], [])
    langs, lexicon = one.column("langs")[0].as_py(), one.column("lexicon")[0].as_py()
    k = len(langs)
    weights = np.frombuffer(one.column("weights")[0].as_buffer(), np.float32).reshape(SPACE, k)
    return Crf(langs, weights, np.frombuffer(one.column("moves")[0].as_buffer(), np.float64).reshape(k, k), frozenset(lexicon))


def label(docs: DataFrame, crf: Crf, spans: bool = False) -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``certainty``, and with ``spans`` their runs of words of one language.

    lang_pred is the language of greatest mean probability over the text's words, score that mean; ties go
    to the first name. certainty is the mean over the words of each one's greatest probability: high where several languages are
    mixed but each word's is plain. A null text or one without letters is ``und``, score and certainty 0, as are all texts when nothing was learned. spans
    is an array of (first word, number of words, lang). Columns of these names are replaced; repeated rows
    stay; an empty table gives no rows. Texts are scored whole, in groups of bounded size; memory grows as words by languages, for the longest text of a group alone.
    """
    docs = docs.drop("lang_pred", "score", "certainty", "spans")
    shipped = docs.sparkSession.sparkContext.broadcast((crf.langs, crf.weights, crf.moves, crf.lexicon))  # half a MB a language, and the lexicon of the bounded sample
    run_type = T.StructType().add("first", T.IntegerType()).add("words", T.IntegerType()).add("lang", T.StringType())
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType()), T.StructField("spans", T.ArrayType(run_type))]
    schema = T.StructType([*docs.schema.fields, *more[: 4 if spans else 3]])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = Crf(*shipped.value)
        k, index = len(model.langs), {}
        scores = np.zeros((0, k))

        def known(lines: list[list[str]]) -> None:
            nonlocal scores
            new = {w for line in lines for w in line}.difference(index)
            if len(index) + len(new) > TABLE_WORDS:
                index.clear()
                scores, new = np.zeros((0, k)), {w for line in lines for w in line}
            new = sorted(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            scores = np.concatenate([scores, model.scores(new)])

        def group(lines: list[list[str]]):
            known(lines)
            lengths = np.array([len(x) for x in lines])
            at = np.fromiter((index[w] for line in lines for w in line), np.int64, int(lengths.sum()))
            p = posteriors(scores[at], lengths, model.moves)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            mean = np.add.reduceat(p, starts) / lengths[:, None]
            best, top = mean.argmax(1), np.clip(mean.max(1), 0, 1)
            sure = np.clip(np.add.reduceat(p.max(1), starts) / lengths, 0, 1)
            runs = []
            for s, n in zip(starts, lengths) if spans else ():
                y = p[s : s + n].argmax(1)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1, [n]])
                runs.append([{"first": int(i), "words": int(j - i), "lang": model.langs[y[i]]} for i, j in zip(cut, cut[1:])])
            return best, top, sure, runs

        for batch in batches:
            n = batch.num_rows
            pred, score, certain, runs = [UNKNOWN] * n, np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            pending, lines, size = [], [], 0
            texts = batch.column("text")

            def close() -> None:
                nonlocal pending, lines, size
                best, top, sure, cut = group(lines)
                for j, g, s, c, r in zip(pending, best, top, sure, cut or [[]] * len(lines)):
                    pred[j], score[j], certain[j], runs[j] = model.langs[g], s, c, r
                pending, lines, size = [], [], 0

            for i in range(n + 1):
                line = words_of(texts[i].as_py()) if i < n and k else []
                if line and not all(map(str.isalpha, line)):
                    line = [w for w in line if any(map(str.isalpha, w))]
                room = PAIRS // max(1, k * k)  # blocks of a group of several texts
                if pending and line and (size + len(line)) // BLOCK + len(lines) >= room:
                    close()
                if line:
                    pending.append(i)
                    lines.append(line)
                    size += len(line)
                if pending and (size >= GROUP_WORDS or i == n):
                    close()
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(certain, pa.float64()), *([pa.array(runs, kind)] if spans else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "certainty", *(["spans"] if spans else [])])

    return docs.mapInArrow(run, schema)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    t = label(docs.select("doc_id", "text"), fitted(docs))
    return t.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
