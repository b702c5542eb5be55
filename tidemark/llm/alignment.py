"""Alignment of two tokenizers over whole texts by a sweep of the ends of their tokens.

Each text is split into words once and encoded by both tokenizers. The ends of the tokens,
in bytes, are the events: rows hold a run of them with its offset, of side A or B, and are
dealt out by document and sorted by offset within the task. A machine reads the rows in that order. An
offset at which both sides end a token closes a group; each different offset is one link,
since between two neighbouring ends lies exactly one token of either side. The machine
keeps only what the open group has and the document's sums.

How many documents hold a pair of linked ids is counted from each document's distinct
pairs, and joined back to them for the sums over its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS, distinct_rows, in_chunks, lean, texts_of, written
from tidemark.llm.packing import ODD_WORD, WordIds, distinct_words
from tidemark.llm.token_counts import SPACE, Pieces

#: Tokens in a row of events.
RUN = 4096
#: Tokens of short documents that are swept at once, and rows of events from which a document is swept by itself.
TOGETHER, LONG_RUNS = 150_000, 16
#: Characters of text that are encoded at once, and encoded words after which a task's table is set aside, so that its arrays and tables stay small.
STRETCH, KEPT_WORDS = 1 << 18, 50_000
#: Words that are encoded as one text.
JOINED = 500
#: Pairs of ids are sent to all tasks up to this many, and met by a shuffle beyond.
BROADCAST_PAIRS = 1_000_000
#: Sides: a document that has no tokens comes first.
VOID, A, B = 0, 1, 2


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What stands in ``flat`` from each start on, one run after another."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


class Table:
    """The bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.array(list(map(len, entries)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return runs(self.flat, self.starts[ids], self.lengths[ids])


class Side:
    """A tokenizer; of each id, ``opens`` tells whether its entry begins with a space."""

    opens: np.ndarray

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of a space and each text, as little-endian uint32 bytes."""
        raise NotImplementedError

    def cells(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has.

        Many words are encoded as one text: only a word's first id begins with a space.
        """
        raw, counts = [], [np.zeros(0, np.int64)]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self.ids(list(map(" ".join, groups)))):
            starts = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])
            if len(starts) == len(group):
                counts.append(np.diff(starts, append=len(ids) // 4))
            else:
                each = self.ids(group)
                ids = b"".join(each)
                counts.append(np.array(list(map(len, each))) // 4)
            raw.append(ids)
        return np.frombuffer(b"".join(raw), "<u4"), np.concatenate(counts)


class SideA(Side):
    """Ids by a byte-level vocabulary, special strings as plain text.

    Its pattern begins a new piece before a space that a non-space follows.
    """

    def __init__(self, vocabulary: str):
        words = WordIds(vocabulary)
        self.tokenizer, self.opens, self.encoded = words.tokenizer, words.opens, words.encoded
        self.tokenizer.encode_special_tokens = True

    @staticmethod
    def bytes_of(vocabulary: str) -> list[bytes]:
        from tokenizers import Tokenizer

        tokenizer, table = Tokenizer.from_file(vocabulary), byte_level()
        special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        ids = {i: t for t, i in tokenizer.get_vocab().items()}
        return [special[i].encode() if i in special else bytes(map(table.__getitem__, ids[i])) if i in ids else b"" for i in range(max(ids) + 1)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.encoded([f" {t}" for t in texts])


class SideB(Side):
    """Ids by a sentencepiece vocabulary, which adds the space.

    No entry has a space after another character, so merges never cross the beginning of a
    word with the space before it.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.opens = np.array([self.model.id_to_piece(i).startswith(SPACE) for i in range(self.model.get_piece_size())])

    @staticmethod
    def bytes_of(model: str) -> list[bytes]:
        pieces = Pieces(model)
        if any(SPACE in p.lstrip(SPACE) for p in pieces.merged):
            raise ValueError("an entry has a space after another character")
        m = pieces.model
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.get_piece_size())]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]


class Kept(dict):
    """A number for each word; ``held`` has each side's ids in the order of the numbers, and how many each word has."""

    def __init__(self, n_sides: int):
        self.held = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))] * n_sides

    def add(self, words: list[str], cells: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.held = [tuple(map(np.concatenate, zip(old, new))) for old, new in zip(self.held, cells)]

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def cells(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(runs(ids, (np.cumsum(n) - n)[numbers], n[numbers]), n[numbers]) for ids, n in self.held]


class Words:
    """Texts' ids on all sides; a word between spaces is looked up once a stretch for all of them.

    A full table of words is set aside and a new one begun, into which a word that comes
    again is taken over. Texts that have a space at an end, before white space or written
    as a sentencepiece vocabulary writes it are encoded whole.
    """

    def __init__(self, sides: list[Side]):
        self.sides, self.table, self.aside = sides, Kept(len(sides)), Kept(len(sides))

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side, the ids of all texts, one after another, and how many each text has."""
        plain = [ODD_WORD.search(f" {t}") is None and SPACE not in t for t in texts]
        words, place, begins = distinct_words(list(compress(texts, plain)))
        if len(self.table) > KEPT_WORDS:
            self.table, self.aside = Kept(len(self.sides)), self.table
        missing = list(filterfalse(self.table.__contains__, words))
        again, new = (list(keep(self.aside.__contains__, missing)) for keep in (filter, filterfalse))
        self.table.add(again, self.aside.cells(self.aside.numbers(again)))
        self.table.add(new, [side.cells(new) for side in self.sides])
        out = []
        for side, (ids, n) in zip(self.sides, self.table.cells(self.table.numbers(words)[place])):
            counts = np.diff(np.append(0, np.cumsum(n))[begins])
            if not all(plain):
                whole = iter(side.ids([t for t, ok in zip(texts, plain) if not ok]))
                split = iter(np.split(ids, np.cumsum(counts)[:-1]))
                each = [next(split) if ok else np.frombuffer(next(whole), "<u4") for ok in plain]
                ids, counts = np.concatenate(each), np.array(list(map(len, each)))
            out.append((ids, counts))
        return out


EVENTS = "doc_id {id_type}, key long, side int, offset long, ids binary, copies long"


def end_events(rows: DataFrame, vocabulary: str, model: str, tables: tuple[Table, Table]) -> DataFrame:
    """Runs of either side's token ends: the offset of the first token's end, and the ids, from which the other ends follow.

    A text that is empty, or whose tokens' bytes on a side aren't a space and the text, gives one row of side VOID.
    """
    kept = rows.select("doc_id", "key", "copies", "text")
    names = ["doc_id", "key", "side", "offset", "ids", "copies"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words([SideA(vocabulary), SideB(model)])
        for batch, texts in texts_of(batches):
            for at, some in in_chunks(texts, STRETCH):
                want = [b" " + t.encode() for t in some]
                begins, all_ = np.cumsum([0] + list(map(len, want))), np.frombuffer(b"".join(want), np.uint8)
                whole, sides = list(map(bool, some)), []
                for (ids, counts), table in zip(words.ids(some), tables):
                    tokens, ends = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(table.lengths[ids]))
                    got, cuts = table.bytes(ids), ends[tokens]
                    # Where every text begins at the same byte on both sides, one comparison tells all.
                    if not (np.array_equal(cuts, begins) and np.array_equal(got, all_)):
                        whole = [ok and got[a:b].tobytes() == w for ok, a, b, w in zip(whole, cuts, cuts[1:], want)]
                    sides.append((ids, tokens.tolist(), ends))
                which, kinds, offsets, out = [], [], [], []
                for k, ok in enumerate(whole):
                    if not ok:
                        which.append(at + k), kinds.append(VOID), offsets.append(-1), out.append(b"")
                        continue
                    for side, (ids, tokens, ends) in zip((A, B), sides):
                        a, b = tokens[k], tokens[k + 1]
                        for first in range(a, b, RUN):
                            which.append(at + k), kinds.append(side), offsets.append(int(ends[first + 1] - ends[a]))
                            out.append(packed(ids[first : min(first + RUN, b)]))
                few = batch.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(kinds, pa.int32()), pa.array(offsets, pa.int64()), pa.array(out, pa.binary()), few.column(2)], names)

    return kept.mapInArrow(lean(encode), EVENTS.format(id_type=kept.schema["doc_id"].dataType.simpleString()))


def packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they all fit; the number of bytes comes last."""
    small = not len(ids) or ids.max() < 1 << 16
    return ids.astype("<u2" if small else "<u4").tobytes() + (b"\x02" if small else b"\x04")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[-1] == 2 else "<u4", (len(raw) - 1) // raw[-1]).astype(np.int64)


class Sweep:
    """What a stretch of both sides' tokens has between two common ends, of one document or of many in a row.

    Ends are marked on the bytes of the stretch, so that all that follows is linear in its length.
    """

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        most = max(map(len, lengths))
        self.width = len(str(most)) + 1
        self.digits = np.array([str(i).ljust(self.width) for i in range(most)], f"S{self.width}").view(np.uint8).reshape(most, self.width)
        self.n_digits = np.array([len(str(i)) for i in range(most)])

    def ends(self, ids: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.cumsum(length[i]) for length, i in zip(self.lengths, ids))

    def marks(self, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, int(max(e[-1] for e in ends)) + 1), bool)
        for mark, e in zip(out, ends):
            mark[e] = True
        return out[0], out[1]

    def links(self, ids: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the A token, pair of ids) of each link, in order: between two neighbouring ends lies one token of either side."""
        at = np.flatnonzero(marks[0] | marks[1])
        a, b = (np.cumsum(m, dtype=np.int64)[at] - m[at] for m in marks)
        return a, ids[0][a] << 32 | ids[1][b]

    def text(self, ids: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Groups as text, A's ids before B's, each id with its mark, and where in it each A token's cell begins.

        ``common``: of each side's tokens, whether a group ends there.
        """
        last = [np.flatnonzero(c) + 1 for c in common]
        group = [np.cumsum(c) - c for c in common]
        n_a, n_b = map(len, ids)
        place = np.concatenate([np.arange(n_a) + np.append(0, last[1])[group[0]], np.arange(n_b) + last[0][group[1]]])
        order = np.empty(n_a + n_b, np.int64)
        order[place] = np.concatenate(ids)
        marks = np.empty(n_a + n_b, np.uint8)
        marks[place] = np.concatenate([np.where(common[0], ord("|"), ord(",")), np.where(common[1], ord(";"), ord(","))])
        cells, n = self.digits[order], self.n_digits[order]
        cells[np.arange(len(n)), n] = marks
        begins = np.cumsum(n + 1) - (n + 1)
        return cells[np.arange(self.width) <= n[:, None]].tobytes(), begins[place[:n_a]]


class Machine:
    """One long document's sweep, run by run; it keeps the open group, sums and the pairs so far."""

    def __init__(self, sweep: Sweep):
        self.sweep = sweep
        self.ids = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # of the open group
        self.counts, self.groups, self.links = [0, 0], 0, 0
        self.digest, self.pairs = hashlib.sha256(), {}

    def feed(self, side: int, ids: np.ndarray) -> None:
        self.ids = tuple(np.concatenate([x, ids]) if k == side else x for k, x in enumerate(self.ids))
        self.counts[side] += len(ids)
        if len(self.ids[0]) and len(self.ids[1]):
            self.close()

    def close(self) -> None:
        """Write the groups that end at or before the last common end, and keep the rest."""
        ends = self.sweep.ends(self.ids)
        marks = self.sweep.marks(ends)
        both = np.flatnonzero(marks[0] & marks[1])
        if not len(both):
            return
        n = [int(np.searchsorted(e, both[-1])) + 1 for e in ends]
        ids, ends = tuple(i[:k] for i, k in zip(self.ids, n)), tuple(e[:k] for e, k in zip(ends, n))
        marks = tuple(m[: both[-1] + 1] for m in marks)
        _, linked = self.sweep.links(ids, marks)
        pairs, times = np.unique(linked, return_counts=True)
        for pair, k in zip(pairs.tolist(), times.tolist()):
            self.pairs[pair] = self.pairs.get(pair, 0) + k
        text, _ = self.sweep.text(ids, (marks[1][ends[0]], marks[0][ends[1]]))
        self.digest.update((b";" if self.groups else b"") + text[:-1])
        self.groups += len(both)
        self.links += len(linked)
        self.ids = tuple(i[k:] for i, k in zip(self.ids, n))

    def row(self) -> tuple:
        pairs = np.array(sorted(self.pairs), np.int64)
        return (*self.counts, self.groups, self.links, self.digest.hexdigest(), pairs >> 32, pairs & 0xFFFFFFFF, [self.pairs[p] for p in pairs.tolist()])


def swept(sweep: Sweep, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """Many short documents at once, with what ``Machine.row`` gives of each.

    A document's tokens have the same bytes on both sides, so documents in a row keep in step.
    """
    ids = tuple(np.concatenate([d[side] for d in docs]) for side in (0, 1))
    ends = sweep.ends(ids)
    marks = sweep.marks(ends)
    common = marks[1][ends[0]], marks[0][ends[1]]
    first = [np.cumsum([0] + [len(d[side]) for d in docs]) for side in (0, 1)]
    groups = np.append(0, np.cumsum(common[0]))[first[0]]
    token, linked = sweep.links(ids, marks)
    begins = np.searchsorted(token, first[0])
    text, cells = sweep.text(ids, common)
    places = np.append(cells, len(text))[first[0]]
    out = []
    for k in range(len(docs)):
        pairs, times = np.unique(linked[begins[k] : begins[k + 1]], return_counts=True)
        digest = hashlib.sha256(text[places[k] : places[k + 1] - 1]).hexdigest()
        out.append((int(first[0][k + 1] - first[0][k]), int(first[1][k + 1] - first[1][k]), int(groups[k + 1] - groups[k]), int(begins[k + 1] - begins[k]), digest, pairs >> 32, pairs & 0xFFFFFFFF, times))
    return out


def aligned(events: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per distinct document: its sums, its distinct linked pairs of ids (a, b) and how often each is linked.

    ``events`` come sorted by document and offset within partitions.
    """
    id_type = events.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = (to_arrow_type(id_type), *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int32())] * 3)
    names = ["doc_id", "key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"]
    schema = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", groups_sha256 string, a array<int>, b array<int>, times array<int>"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, nothing = Sweep(lengths), (0, 0, 0, 0, "", [], [], [])
        waiting: list[tuple] = []  # whole short documents: (key, ids of either side)
        tokens, at, machine, void = 0, None, None, False
        held: tuple[list, list] = ([], [])

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        def ended() -> list[tuple]:
            """What the document that has ended gives at once; a short one waits for others."""
            if void:
                return [(*at, *nothing)]
            if machine:
                return [(*at, *machine.row())]
            waiting.append((at, tuple(map(np.concatenate, held))))
            return []

        def together() -> list[tuple]:
            return [(*key, *row) for (key, _), row in zip(waiting, swept(work, [ids for _, ids in waiting]))] if waiting else []

        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            rows = []
            for doc, key, side, _, raw, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, key, copies) != at:
                    if at is not None:
                        rows += ended()
                    at, machine, void, held = (doc, key, copies), None, False, ([], [])
                    if tokens >= TOGETHER:
                        rows += together()
                        waiting, tokens = [], 0
                void = void or side == VOID
                if void:
                    continue
                ids = unpacked(raw)
                tokens += len(ids)
                if machine:
                    machine.feed(side - A, ids)
                    continue
                held[side - A].append(ids)
                if sum(map(len, held)) > LONG_RUNS:
                    machine = Machine(work)
                    for k, runs in enumerate(held):
                        for run in runs:
                            machine.feed(k, run)
                    held = ([], [])
            if rows:
                yield done(rows)
        rows = (ended() if at is not None else []) + together()
        if rows:
            yield done(rows)

    return events.mapInArrow(lean(sweep), schema)


def align(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that either tokenizer doesn't give back whole, have no
    tokens: zeros and an empty digest. Very long texts are taken whole, in runs of events. Rows
    of one id and one text get the same result, each its own row and each counted as a document;
    a null id is a document like others. An empty table gives an empty result. Further
    columns, whatever their names, aren't looked at.
    """
    rows = distinct_rows(docs, id_col, text_col)
    tables = Table(SideA.bytes_of(vocabulary)), Table(SideB.bytes_of(model))
    events = end_events(rows, vocabulary, model, tables)
    sweeps = aligned(events.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "offset", "side"), (tables[0].lengths, tables[1].lengths))
    # Read twice: for the counts and for the sums.
    per_doc = written(sweeps, "alignment")
    linked = per_doc.select("doc_id", "key", "copies", F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select("doc_id", "key", "copies", "l.a", "l.b", "l.times")
    counts = written(linked.groupBy("a", "b").agg(F.sum("copies").alias("n")), "alignment-counts")
    best = counts.groupBy(F.col("a").alias("best_a")).agg(F.max("n").alias("most"))
    table = counts.join(best, F.col("a") == F.col("best_a")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    small = counts.count() <= BROADCAST_PAIRS
    times = F.col("times").cast("long")
    sums = linked.join(F.broadcast(table) if small else table, ["a", "b"]).groupBy("doc_id", "key").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    sums = sums.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_best", "count_sum")
    base = per_doc.select("doc_id", "key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = base.join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").na.fill(0, ["n_best", "count_sum"])
    each = both.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
