"""Resampling, token counts and alignment against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from tidemark.llm import alignment, resampling, token_counts

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(5)
PROSE = [" ".join(R.choice(["the", "Sea", "of", "tides", "naïve", "12", "marks"]) for _ in range(R.randint(15, 60))) for _ in range(25)]
ODD = [None, "", " ", "one", "two words", "a" * 3000, " " * 700, "é😀ß" * 200, "中文字符測試" * 150, "x▁y " * 90, "\x00 " * 90, "\r\n" * 300, " a", "a ", "a  b", "the end <|endoftext|> <s> <0x41>"]
ODD += ["".join(R.choice("ab c\n\t.é😀") for _ in range(2500)), "the" * 900 + " end", " ".join(R.choices(PROSE, k=40))]
ROWS = [(i, t, i, None) for i, t in enumerate([*PROSE, *ODD])] + [(None, PROSE[3], 1, 2), (3, PROSE[3], 1, 2), (3, PROSE[3], 1, 2), (4, "another text of the same id", 1, 2)]
#: Rows with further columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, key long, copies long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows):
    return sorted(map(str, rows))


def features(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]


def test_resampling(spark, docs, nothing):
    target = [(1, PROSE[1] + " new"), (1, PROSE[1] + " new"), (2, None), (None, "Sea of tides")]
    bench = spark.createDataFrame(target, "item_id long, text string")
    s, t = Counter(), Counter()
    for r in ROWS:
        s.update(features(r[1])[1])
    for r in target:
        t.update(features(r[1])[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    scored = []
    for i, text, *_ in ROWS:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fit) * 25 // 100
    got = resampling.resample(docs, bench).collect()
    assert by_text((r.doc_id, r.n_features, r.weight, r.score) for r in got) == by_text((r[0], *r[2:]) for r in scored)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in fit[:drawn]]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, drawn + 1)) and drawn > 3
    assert resampling.drawn(docs, bench).columns == docs.columns
    assert resampling.resample(nothing, bench).count() == 0
    assert {r.weight for r in resampling.resample(docs, nothing.withColumnRenamed("doc_id", "item_id")).collect()} != {0}


def test_resampling_of_three_words_and_ties(spark):
    rows = [(i, "one two three " * 10) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(table, table.withColumnRenamed("doc_id", "item_id"), orders=3, percent=50).collect()
    assert {r.n_features for r in got} == {30 + 29 + 28} and sum(r["rank"] is not None for r in got) == 4


@pytest.mark.parametrize(("chunk", "overlap"), [(400, 120), (300, 40), (1 << 15, 1 << 9)])
def test_token_counts(docs, nothing, chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), n, n > 100) for i, t, *_ in ROWS for n in [len(model.encode(t or ""))]]
    got = token_counts.count_tokens(docs, MODEL, 100, chunk, overlap)
    assert by_text(map(tuple, got.collect())) == by_text(want)
    assert token_counts.count_tokens(nothing, MODEL, 100, chunk, overlap).count() == 0


def test_chunks_are_spliced_where_they_can_be(spark):
    rows = spark.createDataFrame([(1, 0, " ".join(PROSE) * 3), (2, 0, "a" * 5000)], "doc_id long, key long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.spliced(rows, MODEL, 500, 100).collect()}
    assert got[1] == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(" ".join(PROSE) * 3))
    assert got[2] is None  # no boundary is proven stable there, so the next round widens


def test_alignment(docs, nothing, monkeypatch):
    a_side, b_side = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_side.encode_special_tokens = True
    tables = alignment.SideA.bytes_of(VOCABULARY), alignment.SideB.bytes_of(MODEL)
    held, df = [], Counter()
    for i, text, *_ in ROWS:
        sides = [a_side.encode(f" {text}", add_special_tokens=False).ids, b_side.encode(text)] if text else [[], []]
        if any(b"".join(table[x] for x in ids) != f" {text}".encode() for ids, table in zip(sides, tables)):
            sides = [[], []]
        spans = [[], []]
        for ids, table, out in zip(sides, tables, spans):
            for x in ids:
                begin = out[-1][1] if out else 0
                out.append((begin, begin + len(table[x]), x))
        links, k = [], 0
        for s, e, x in spans[0]:
            while k and spans[1][k][0] >= s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((x, spans[1][k][2]))
                k += 1
            k = max(0, k - 1)
        cuts, groups, before = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if before < e <= cut) for side in spans))
            before = cut
        df.update(set(links))
        held.append((i, *map(len, sides), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    want = [(i, a, b, g, len(links), sum(df[p] == best[p[0]] for p in links), sum(df[p] for p in links), digest) for i, a, b, g, links, digest in held]
    for run, pairs, together in ((4096, 1_000_000, 400_000), (50, 0, 100)):
        monkeypatch.setattr(alignment, "RUN", run)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
        assert by_text(map(tuple, alignment.align(docs, VOCABULARY, MODEL).collect())) == by_text(want)
    assert alignment.align(nothing, VOCABULARY, MODEL).count() == 0


def test_machine_takes_events_in_any_runs():
    tables = alignment.SideA.bytes_of(VOCABULARY), alignment.SideB.bytes_of(MODEL)
    lengths = tuple(alignment.np.array(list(map(len, t))) for t in tables)
    text = "One 日本 text, and tokens of it" * 3
    sides = [alignment.np.frombuffer(s(p).ids([text])[0], "<u4").astype(int) for s, p in ((alignment.SideA, VOCABULARY), (alignment.SideB, MODEL))]
    results = set()
    for run in (1, 2, 7, 1000):
        machine = alignment.Machine(alignment.Sweep(lengths))
        events = sorted((int(lengths[s][ids[: k + 1]].sum()), s, k) for s, ids in enumerate(sides) for k in range(0, len(ids), run))
        for _, s, k in events:
            machine.feed(s, sides[s][k : k + run])
        results.add((machine.digest.hexdigest(), machine.groups, machine.links, tuple(sorted(machine.pairs.items()))))
        assert not len(machine.ids[0]) and not len(machine.ids[1])
    assert len(results) == 1


def test_alignment_encodes_frequent_words_once(monkeypatch):
    """A word is encoded once for each side, though the table of words is set aside several times; odd texts are encoded whole."""
    monkeypatch.setattr(alignment, "KEPT_WORDS", 50)
    a_side, b_side = alignment.SideA(VOCABULARY), alignment.SideB(MODEL)
    learned = ([], [])
    for side, seen in zip((a_side, b_side), learned):
        monkeypatch.setattr(side, "cells", lambda new, cells=side.cells, seen=seen: seen.extend(new) or cells(new))
    words = alignment.Words([a_side, b_side])
    assert [counts.tolist() for _, counts in words.ids(["", " x"])] == [[len(ids) // 4 for ids in side.ids(["", " x"])] for side in (a_side, b_side)]
    for k in range(10):
        texts = ["so the herse, " + " ".join(f"x{k}y{i}" for i in range(40)) + " of the\n\nherse,", " odd", "", f"caf\u00e9 <|endoftext|> \u65e5\u672c\n the herse,", "two  spaces\t the", "a\u2581b", "of"]
        (a, n_a), (b, n_b) = words.ids(texts)
        assert a.tolist() == [x for t in texts for x in a_side.tokenizer.encode(f" {t}", add_special_tokens=False).ids]
        assert b.tolist() == [x for t in texts for x in b_side.model.encode(t)]
        assert n_b.tolist() == list(map(len, b_side.model.encode(texts))) and n_a.sum() == len(a)
    for seen in learned:
        assert len(seen) == len(set(seen)) > 400
