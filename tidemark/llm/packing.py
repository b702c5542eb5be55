"""Best-fit packing of tokenised documents into fixed-size sequences (minimum bin slack).

Pieces have at most ``capacity`` tokens, so a histogram of ``capacity`` counts
describes any corpus. The driver plans on that histogram alone: for each kind of
bin, a bitset subset-sum over the lengths still available finds the fullest
combination around the longest piece, which is taken as often as the counts
allow. A combination at least halves the count of one of its lengths, so there
are at most capacity * log2(rows) of them, of 45 different lengths at most: this
bounds the table that is sent to the tasks. Pieces get a rank within their
length from counts per partition, and the rank tells the bin and the place.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, in_chunks, lean, texts_of

CAPACITY = 1024
END_ID = 2
#: Entries after which a task's table of encoded words is set aside (some 60 MB, as much set aside).
CACHE_WORDS = 300_000
#: Characters of text whose words are looked up at once, each different one once.
STRETCH = 1 << 22
#: How the vocabulary writes a space, and words encoded as one text.
SPACE, TOGETHER = "Ġ", 500
#: A space before an empty word, or before one that begins with white space.
ODD_WORD = re.compile(r" (?:\s|\Z)")


class WordIds(dict):
    """Ids (as little-endian uint32 bytes) of what stands between two spaces.

    The vocabulary's pattern always begins a new piece before a space that a
    non-space follows, so texts can be encoded word by word. Texts with a word for
    which this doesn't hold (an empty one, or one that begins with white space) are
    encoded whole.

    A full table is set aside and a new one begun, into which a word that comes again
    is taken over: so frequent words are encoded once, and rare ones are forgotten.
    """

    def __init__(self, vocabulary: str):
        # Spark runs a task per core; threads of the tokenizer's own would only leave memory behind in each worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        self.aside: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Many words are encoded as one text: only a word's first id begins with a space."""
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self.encoded(["".join(f" {w}" for w in g) for g in groups])):
            starts = (4 * np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])).tolist()
            if len(starts) == len(group):
                self.update(zip(group, map(ids.__getitem__, map(slice, starts, [*starts[1:], len(ids)]))))
            else:
                self.update(zip(group, self.encoded([f" {w}" for w in group])))

    def known(self, words: list[str]) -> None:
        """See to it that each of the words, which are distinct, is in the table."""
        if len(self) > CACHE_WORDS:
            self.aside = dict(self)
            self.clear()
        new = set(filterfalse(self.__contains__, words))
        known = new & self.aside.keys()
        self.update(zip(known, map(self.aside.__getitem__, known)))
        self.learn(list(new - known))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words are encoded together."""
        plain = [ODD_WORD.search(t) is None for t in texts]
        words, place, begins = distinct_words(list(compress(texts, plain)))
        # A text's first word has no space before it: it isn't looked up, but encoded for that text.
        heads, inner = begins[:-1], np.ones(len(place), bool)
        inner[heads] = False
        used = np.zeros(len(words), bool)
        used[place[inner]] = True
        kept = list(compress(words, used))
        self.known(kept)
        first = self.encoded([words[k] for k in place[heads].tolist()])
        place = (np.cumsum(used) - 1)[place]
        place[heads] = len(kept) + np.arange(len(heads))
        looked_up = iter(gathered([*map(self.__getitem__, kept), *first], place, begins))
        odd = iter(self.encoded([t for t, ok in zip(texts, plain) if not ok]))
        return [next(looked_up if ok else odd) for ok in plain]


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words between spaces, which of them stands at each place, and each text's first place, with the number of all at the end."""
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
    return words, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64)


def gathered(cells: list[bytes], place: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Each text's ids, from those of its words: ``place`` and ``begins`` as ``distinct_words`` gives them."""
    ids, n = np.frombuffer(b"".join(cells), "<u4"), np.fromiter(map(len, cells), np.int64, len(cells)) // 4
    starts, n = (np.cumsum(n) - n)[place], n[place]
    ends = np.append(0, np.cumsum(n))
    at = np.repeat(starts - ends[:-1], n)
    at += np.arange(len(at))
    raw, cuts = ids[at].tobytes(), (4 * ends[begins]).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


PIECES = "doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document, with their number among the partition's of that length.

    Null text counts as empty: a piece with the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, part = WordIds(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)
        for batch, texts in texts_of(batches):
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for doc, b in zip(ids, (b for _, chunk in in_chunks(texts, STRETCH) for b in words.texts(chunk))):
                b += end
                n = len(b) // 4
                at, k = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if not k else capacity
                    out.append((doc, k, at, length, zlib.crc32(b[4 * at : 4 * (at + length)]), part, int(nth[length])))
                    nth[length] += 1
                    at, k = at + length, k + 1
            if out:
                kinds = (arrow_id, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(lean(cut), PIECES.format(id_type=id_type.simpleString()))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with repeats) whose sum is the largest that fits in ``room``.

    One bitset of reachable sums per step; longer lengths go first, so that a sum
    that can be had with few long pieces is, and short ones remain for later.
    """
    steps: list[tuple[int, int, int]] = []  # length, taken at once, sums reachable before
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach >> room:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces by length, number of such bins), using up the histogram."""
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        taken = fullest(rest, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in taken.items())
        plan.append((taken, times))
        for x, k in taken.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return plan


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset there.

    Rows of one id, null ids too, are packed each by itself. Null text counts as empty: a piece with the
    end id alone. Very long texts are cut into pieces, of which none is lost. Empty input gives no rows.
    Further columns, whatever their names, aren't looked at. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = checkpoint(pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = cut.join(by_part.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    histogram = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most

    used, entries, bins = dict.fromkeys(histogram, 0), [], 0
    for taken, times in plan_bins(histogram, capacity):
        offset = 0
        for length in sorted(taken, reverse=True):
            k = taken[length]
            entries.append(((length << 48) + used[length], k, bins, offset))
            used[length] += k * times
            offset += k * length
        bins += times
    table = np.array(sorted(entries) or [(0, 1, 0, 0)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = (length << 48) + rank
            key_at = np.searchsorted(table[:, 0], key, side="right") - 1
            start, k, first, offset = table[key_at].T
            nth = key - start
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + nth // k), pa.array(offset + nth % k * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return kept.mapInArrow(lean(place), ", ".join(f"{c} {t}" for c, t in kept.dtypes[:5]) + ", sequence_id long, offset long")
