"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideloom.llm.common import table

MARK = "▁"
#: Bounds of a task's chunk table: it is emptied when full, and longer chunks are segmented each time.
TABLE_CHUNKS, CHUNK_CHARS = 200_000, 64
#: Rows of an output batch: bounded memory on either side.
OUT_ROWS = 500
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parts_at_marks(model: bytes) -> bool:
    """Whether no piece crosses from a word into the next marker and the normaliser only marks spaces.

    Then merges never join two chunks (markers and the word after them), so chunks can be segmented alone.
    """
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    n, user_defined = m.normalizer_spec, 4
    return (
        n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        and not m.trainer_spec.treat_whitespace_as_suffix
        and not any(MARK in p.piece.lstrip(MARK) or p.type == user_defined for p in m.pieces))


class Codec:
    """Encodes texts by chunks; lives in one task."""

    def __init__(self, model: bytes, by_chunk: bool):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_chunk, self.table = by_chunk, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return self.sp.encode(texts, num_threads=1)
        parted = [self.chunks(t) for t in texts]
        new = {c for chunks in parted for c in chunks if c not in self.table}
        if len(self.table) + len(new) > TABLE_CHUNKS:
            self.table.clear()
            new = {c for chunks in parted for c in chunks}
        new = list(new)
        # the library puts one marker before any text, so the first marker of a chunk is left to it
        at = dict(zip(new, self.sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)))
        if MARK in at:  # nothing is left of a marker alone, and the library puts none before an empty text
            at[MARK] = self.sp.encode("x ")[len(self.sp.encode("x")) :]
        self.table |= at
        out = [list(chain.from_iterable(map(self.table.__getitem__, chunks))) for chunks in parted]
        for c in new:
            if len(c) > CHUNK_CHARS:
                del self.table[c]
        return out

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []


def coded(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with ``ids`` (array<int>) and ``decoded``, the library's decode(ids).

    Each task segments each distinct chunk (white-space markers and the word after them) once and joins
    the ids back by position, so nothing is shuffled; its table is bounded. A model whose pieces may
    cross markers gets its texts whole. Null text counts as empty: no ids, empty decoded text. Columns
    named ids or decoded are replaced; repeated rows stay; an empty table gives no rows.
    """
    docs = docs.drop("ids", "decoded")
    by_chunk = parts_at_marks(model)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB for 32,000 pieces
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec(shipped.value, by_chunk)
        for whole in batches:
            for i in range(0, whole.num_rows, OUT_ROWS):
                b = whole.slice(i, OUT_ROWS)
                ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
                decoded = [codec.sp.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def digests(t: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids"), ",")
    return t.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(coded(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model()))
