"""Token counts of whole texts, very long ones encoded in overlapping chunks that are spliced.

Texts of up to a chunk go to the library as they are. Longer ones are cut into chunks,
rows of their own dealt over all tasks, each with the beginning of the next (the overlap).
Within an overlap both chunks have token boundaries; one is proven stable where no entry
of the vocabulary lies across it in the text: merges then never cross it, so what stands on
either side is encoded alike in every chunk and in the whole text. Neighbours are spliced at
their first common stable boundary. Where an overlap has none, the document goes to the
next round with chunks and overlaps GROWTH times as long, at last in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, in_chunks, lean, text_key, texts_of

CHUNK, OVERLAP, GROWTH = 1 << 15, 1 << 9, 8
LIMIT = 4096
SPACE = "▁"  # how the vocabulary writes a space


class Pieces:
    """A sentencepiece model with what is needed to place its tokens in a text."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        bytes_ = {i: int(p[3:5], 16) for i, p in enumerate(entries) if self.model.is_byte(i)}
        #: Characters that a token ends; those of a character written in bytes count with its first.
        self.chars = np.array([not 128 <= bytes_[i] < 192 if i in bytes_ else len(p) for i, p in enumerate(entries)], np.int64)
        self.inner = np.array([128 <= bytes_.get(i, 0) < 192 for i in range(len(entries))])
        self.merged = {p for i, p in enumerate(entries) if len(p) > 1 and not (i in bytes_ or self.model.is_control(i) or self.model.is_unknown(i))}
        self.pairs = {p[k : k + 2] for p in self.merged for k in range(len(p) - 1)}
        self.longest = max(map(len, self.merged))

    def stable(self, text: str, at: int) -> bool:
        """No entry lies across ``at`` (0 < at < len) in the text, whose spaces are written as SPACE."""
        if text[at - 1 : at + 1] not in self.pairs:
            return True
        return not any(text[a:b] in self.merged for a in range(at - 1, max(-1, at - self.longest), -1) for b in range(at + 1, min(len(text), a + self.longest) + 1))

    def encoded(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; a megabyte of texts is encoded at once."""
        for _, some in in_chunks(texts):
            yield from self.model.encode(some, num_threads=1)

    def ends(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text's tokens, the end in characters and whether a character ends there."""
        for ids in self.encoded(texts):
            ids = np.array(ids, np.int64)
            ends = np.cumsum(self.chars[ids]) - 1  # the model writes a space before each text
            whole = np.append(~self.inner[ids[1:]], True) if len(ids) else np.zeros(0, bool)
            yield ends, whole

    def boundaries(self, text: str, ends: np.ndarray, whole: np.ndarray, begin: int, end: int) -> tuple[list[int], list[int]]:
        """Stable token boundaries between two places, from ``begin`` on, and the number of tokens before each.

        Places within an entry's length of the two are left out, so that the text around is known.
        """
        first, last = np.searchsorted(ends, [begin + self.longest, end - self.longest])
        marked = text[begin:end].replace(" ", SPACE)
        places = [int(k) for k in range(first, last) if whole[k] and self.stable(marked, int(ends[k]) - begin)]
        return [int(ends[k]) - begin for k in places], [k + 1 for k in places]


SEAMS = "array<int>"


def chunk_tokens(chunks: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Of each chunk: its tokens, and the stable boundaries in its first and last ``overlap`` characters."""
    kept = chunks.select("doc_id", "key", "copies", "nth", "n_bytes", "text")
    names = [*kept.columns[:5], "n", "head", "head_n", "tail", "tail_n"]
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes[:5]) + f", n long, head {SEAMS}, head_n {SEAMS}, tail {SEAMS}, tail_n {SEAMS}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch, texts in texts_of(batches):
            rows = []
            for text, nth, (ends, whole) in zip(texts, batch.column(3).to_pylist(), pieces.ends(texts)):
                head = pieces.boundaries(text, ends, whole, 0, overlap) if nth else ([], [])
                tail = pieces.boundaries(text, ends, whole, chunk, chunk + overlap) if len(text) == chunk + overlap else ([], [])
                rows.append((len(ends), *head, *tail))
            kinds = (pa.int64(), *[pa.list_(pa.int32())] * 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return kept.mapInArrow(lean(encode), schema)


def spliced(rows: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, key, copies, n_bytes, n_tokens) of long texts; null where two neighbours have no common stable boundary."""
    parts = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").alias("n_chars"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("parts"))
    joined = F.transform("parts", lambda p, i: F.concat(p, F.substring(F.coalesce(F.get("parts", i + 1), F.lit("")), 1, overlap)))
    # What no longer reaches beyond the chunk before it is no chunk.
    n_chunks = F.greatest(F.ceil((F.col("n_chars") - overlap) / chunk), F.lit(1)).cast("int")
    cut = parts.select("doc_id", "key", "n_bytes", F.posexplode(F.slice(joined, F.lit(1), n_chunks)).alias("nth", "text"))
    # Dealt out by chunk: neither a huge text nor one that stands in many rows stays in one task.
    chunks = cut.groupBy("doc_id", "key", "nth").agg(F.first("text").alias("text"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    order = Window.partitionBy("doc_id", "key").orderBy("nth")
    pairs = chunk_tokens(chunks, model, chunk, overlap).withColumns({"next": F.lead("head").over(order), "next_n": F.lead("head_n").over(order)})
    at = F.array_min(F.array_intersect("tail", "next"))
    before = F.element_at("tail_n", F.array_position("tail", at).cast("int"))
    after = F.element_at("next_n", F.array_position("next", at).cast("int"))
    # What the chunk has after the seam, and the next one before it, stands in the other one as well.
    surplus = F.when(F.col("next").isNull(), F.lit(0)).otherwise(F.col("n") - before + after)
    each = pairs.select("doc_id", "key", "copies", "n_bytes", "n", surplus.alias("surplus"))
    total = F.when(F.count("*") == F.count("surplus"), F.sum("n") - F.sum("surplus"))
    return each.groupBy("doc_id", "key").agg(F.first("copies").alias("copies"), F.first("n_bytes").alias("n_bytes"), total.alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no tokens. Very long texts are counted whole. Rows of one id and one
    text get the same result, each its own row; a null id is a document like others. An empty
    table gives an empty result. Further columns, whatever their names, aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap
    short = rows.where(~long)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch, texts in texts_of(batches, "text"):
            n = pa.array(list(map(len, pieces.encoded(texts))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    id_type = short.schema["doc_id"].dataType.simpleString()
    out = short.mapInArrow(lean(count), f"doc_id {id_type}, n_bytes long, n_tokens long")

    waiting = rows.where(long).withColumn("key", text_key("text"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    while True:
        counted = checkpoint(spliced(waiting, model, chunk, overlap))
        done, open_ = counted.where("n_tokens is not null"), counted.where("n_tokens is null").select("doc_id", "key")
        each = done.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        out = out.union(each.select("doc_id", "n_bytes", "n_tokens"))
        if open_.isEmpty():
            return out.withColumn("over_limit", F.col("n_tokens") > limit)
        waiting = waiting.join(open_, same(waiting, open_), "left_semi")
        chunk, overlap = GROWTH * chunk, GROWTH * overlap
