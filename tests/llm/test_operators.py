"""The corpus operators against brute force on small fixtures with nulls, repeats, ties and odd texts."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tidemark.llm import alignment, common, decontaminate, embeddings, langid, licences, minhash, packing, pii, quality, substrings, toxicity

RNG = np.random.default_rng(4)
VOCABULARY = ["ab", "cd", "efg", "hij", "klm", "nop", "qrs", "tuv", "wxy", "zeta", "eta", "theta"]
PROSE = [" ".join(RNG.choice(VOCABULARY, 60)) for _ in range(12)]
COPIES = [PROSE[0], PROSE[0] + " more", PROSE[1].replace("zeta", "ZETA"), PROSE[2][:200] + PROSE[3][:200]]
LONG = " ".join(RNG.choice(VOCABULARY, 30_000))
TEXTS = [*PROSE, *COPIES, None, "", " ", "one", "é😀 ß", "aaaa " * 300, LONG, "\x00 x\ty"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", i) for i, t in enumerate(TEXTS)]
    rows += [(None, PROSE[4], "en", 0), (3, TEXTS[3], "en", 1), (3, TEXTS[3], "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key long")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_packing(spark, docs, nothing):
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda text: plain.encode(text, add_special_tokens=False).ids
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bins = {}
    for r in out:
        ids = np.array([*encode(texts[r["doc_id"]] or ""), 2], "<u4")[r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bins_are_full_where_they_can_be():
    assert packing.fullest({5: 2, 3: 1, 7: 1}, 8) == {5: 1, 3: 1}
    plan = packing.plan_bins({600: 3, 424: 2, 400: 1, 24: 1}, 1024)
    assert sum(n for _, n in plan) == 3
    words = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", "a \n b", " lead", "trail ", "it's 12,5 €", "<|endoftext|>", " x \u3000y", "", "a b", "b a"]
    for t, ids in zip(texts, words.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_substrings(docs, nothing, monkeypatch):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    length = 60
    seen = {}
    for _, b in rows:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        want.append((str(i), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    for group, few in ((substrings.GROUP, 100_000), (3, 100_000), (1, 0)):
        monkeypatch.setattr(substrings, "GROUP", group)
        monkeypatch.setattr(substrings, "BROADCAST_GROUPS", few)
        got = [(str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeated(docs, length).collect()]
        assert sorted(got) == sorted(want)
    assert substrings.remove_repeated(nothing).count() == 0


def test_substring_segments_cover_every_string_once(monkeypatch):
    text = bytes(RNG.integers(97, 101, 40_000, np.uint8))
    monkeypatch.setattr(substrings, "SEGMENT", 4096)
    starts = [int(a) + k for _, _, _, _, start, n, place in substrings.runs_of([text], 60) for a, m, p in zip(start, n, place) if a <= p for k in range(int(m))]
    assert sorted(starts) == list(range(len(text) - 59))


def test_deep_shallow_sort():
    for _ in range(200):
        strings = [bytes(RNG.integers(97, 99, int(RNG.integers(0, 120)))) if RNG.random() < 0.5 else b"ab" * int(RNG.integers(0, 70)) for _ in range(9)]
        assert [strings[i] for i in substrings.deep_shallow(strings)] == sorted(strings)


def test_minhash(docs, nothing):
    sets = []
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets.append((r["doc_id"], {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}))
    head = {i: i for i, _ in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
            head[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted((str(i), len(s), str(find(i))) for i, s in sets)
    got = minhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_minhash_centre_that_is_not_the_head(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(9, " ".join(base))]
    for i in range(8):
        w = list(base)
        w[i * 50 : i * 50 + 45] = [f"x{i}_{k}" for k in range(45)]
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_decontamination(spark, docs, nothing):
    items = [(1, " ".join(PROSE[5].split()[10:40])), (2, "one"), (3, None), (None, "eta"), (4, PROSE[2][:100].upper()), (4, PROSE[2][:100]), (5, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {(str(i), tuple(w[k : k + 13])) for i, t in items if i is not None for w in [low(t)] for k in range(max(1, len(w) - 12)) if w}
    want = []
    for r in docs.collect():
        w, hit, ids = low(r["text"]), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
        want.append((str(r["doc_id"]), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(str(r[0]), *r[1:]) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_licences(spark, nothing):
    rows = [(1, "RELEASED under the MIT   licence"), (2, "Some prose.\nCopyright (c) 2020 A\nLicensed under CC BY-NC 4.0.\nmore"), (3, None), (3, ""), (2, "other"), (1, "RELEASED under the MIT   licence")]
    got = sorted((r["doc_id"], r["license_id"] or "", r["n_license_lines"], r["licenses"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 1, "MIT"), (1, "MIT", 1, "MIT"), (2, "", 0, ""), (2, "", 1, "CC-BY-NC-4.0"), (3, "", 0, ""), (3, "", 0, "")]
    assert licences.scan(nothing).count() == 0


def test_pii(spark, docs, nothing):
    field = pii.trained()
    text = "write to jan.p at example dot org or a.b@c.de, +32 475 12 34 56"
    base, every = pii.find(text, field)
    assert [s[0] for s in base] == ["email", "phone"] and set(base) < set(every)
    assert "@" not in pii.redacted(text, every)
    for _ in range(3000):
        t = "".join(RNG.choice(list("a1.@+- ()9é"), int(RNG.integers(1, 30))))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.digits_of(m[0])) <= 15]
        assert pii.base_spans(t) == want
    assert pii.find_personal(docs).count() == docs.count() and pii.find_personal(nothing).count() == 0
    assert sorted(str(r) for r in pii.redact(docs).collect()) == sorted(str(r) for r in docs.collect())
    made = np.random.default_rng(77)
    hit = total = wrong = 0
    for _ in range(300):
        t, true = pii.sentence(made)
        base, every = pii.find(t, field)
        true = {x for x in true if all(x[2] <= b[1] or b[2] <= x[1] for b in base)}
        hit, total, wrong = hit + len(true & set(every)), total + len(true), wrong + len(set(every) - set(base) - true)
    assert hit >= 0.95 * total and wrong <= 0.02 * total


def test_embeddings(spark):
    v = RNG.normal(size=(60, 16))
    v[10:20] = v[0] + RNG.normal(size=(10, 16)) * 0.04
    v[20] = 3 * v[1]
    rows = [(i, [float(x) for x in a], i % 2 if i >= 30 else 0) for i, a in enumerate(v)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None, 1.0], 0), (104, rows[0][1], None), (None, rows[0][1], 0), (105, rows[0][1], 0), (106, [1.0, 2.0], 0), (107, [], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(e) / np.linalg.norm(e), y) for i, e, y in rows if i is not None and y is not None and e and len(e) > 0 and None not in e and np.isfinite(e).all() and any(e)]
    links = {i: 0 for i in got}
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if x == y and len(a) == len(b) and a @ b >= 0.98:
            links[i] += 1
            links[j] += 1
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert got[105]["component_id"] == 0 and got[None]["component_id"] is None and got[None]["kept"]
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embedding_recall():
    u = RNG.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = RNG.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    pairs = 0.98 * u + np.sqrt(1 - 0.98**2) * w
    a, offset, dev = embeddings.directions(64)
    cell = lambda x: np.floor(x @ a / (embeddings.CELL * dev) + offset).reshape(len(x), embeddings.TABLES, embeddings.GROUP)
    met = (cell(u) == cell(pairs)).all(2).any(1)
    enough = (np.abs(u @ a - pairs @ a) <= embeddings.REACH * dev).sum(1) >= embeddings.least_count()
    assert (met & enough).mean() >= 0.99


def test_learned_scores(spark, docs, labels, nothing):
    for out in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score_quality(nothing, labels).count() == 0 and toxicity.score_toxicity(nothing, labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[12 + 4]["lang_pred"] == "und" and got[1]["lang_pred"] == "en"
    assert langid.identify(nothing).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.score_quality(d, y).join(y, "doc_id").where("held_out")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.9
    lang = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.97
    t = toxicity.score_toxicity(d, y).join(y, "doc_id").where("held_out")
    assert t.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] >= 0.85
    hit, said, true = t.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit >= 0.6 * true > 0 and hit >= 0.8 * said  # an answer of 0 for all has no hit


def test_deobfuscation(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.language_model(d)
    assert "idiot" in toxicity.readings("1d10t", model) and "loser" in toxicity.readings("looooser!!", model)
    assert "idiot" in toxicity.spaced("you i d i o t there", model) and "stupid" in toxicity.readings("s.t.u.p.i.d", model)
    assert toxicity.readings("the&&&", model) == ["the"] and toxicity.readings("***", model) == []


def test_deobfuscation_has_no_length_limit(spark):
    model = toxicity.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for gap in (" ", "  "):
        words = toxicity.spaced(gap.join("the" * 100 + "idiot"), model)
        assert "".join(words).endswith("idiot") and len("".join(words)) >= 300
    assert "loser" in toxicity.readings("l" + "o" * 60 + "ser", model)
    chained = "".join(toxicity.readings("s.t.u.p.i.d." * 8, model)[48:])
    assert chained == "stupid" * 8
    assert toxicity.readings("@55", model) == list(toxicity.decode("@55", model).split()) != []


def test_packing_encodes_as_the_vocabulary_with_its_defaults(spark):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|><|endoftext|> hi", "two  <|endoftext|>\n\n end", "<|endoftext", "é <|endoftext|>\t ß", ""]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert 50256 in want[0]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_minhash_repeated_rows_linked_by_another_than_the_head(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(9, " ".join(base))] * 4
    for i in range(8):
        w = list(base)
        w[i * 50 : i * 50 + 45] = [f"x{i}_{k}" for k in range(45)]
        rows += [(i, " ".join(w))] * 4
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 36 and {r["component_id"] for r in got} == {0}


def test_licences_whole_texts_and_paragraphs(spark):
    from tidemark.llm import licence_texts

    held = "Copyright (c) 2021 Some One\n\n"
    rows, want = [], {}
    for i, (licence, titles, text) in enumerate(licence_texts.WHOLE):
        rows.append((i, (titles[0] + "\n\n" if titles else "") + held + " ".join(text.split(" "))))
        want[i] = licence
    apache = next(t for i, _, t in licence_texts.WHOLE if i == "Apache-2.0")
    rows += [(100, apache.replace("\n", "\r\n")), (101, "Some prose.\n\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n\nmore")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["license_id"] for i in want} == want and set(want.values()) >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0"}
    assert got[100]["license_id"] == "Apache-2.0"
    assert (got[101]["license_id"], got[101]["n_license_lines"], got[101]["licenses"]) == (None, 0, "Apache-2.0")


def test_pii_long_disguised_addresses():
    field = pii.trained()
    for address in ("jan.peeters." * 4 + "jan.peeters1[at]example.org", "jan.p at a dot b dot c dot d dot e dot f dot org"):
        text = f"write to {address} today"
        _, every = pii.find(text, field)
        assert [text[a:b] for _, a, b in every] == [address]


def test_minhash_blocks_find_what_one_task_finds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    head = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and head[i] != head[j]:
            low, high = sorted((head[i], head[j]))
            head = {k: low if v == high else v for k, v in head.items()}
    assert 1 < len(set(head.values())) < 60
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket, shingles, pivots, few in ((2048, 1 << 20, 16, 100_000), (8, 1 << 20, 1, 0), (2048, 1200, 1, 100_000)):
        for name, value in (("BUCKET", bucket), ("BUCKET_SHINGLES", shingles), ("PIVOTS", pivots), ("BROADCAST_ROWS", few)):
            monkeypatch.setattr(minhash, name, value)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()} == head


def test_minhash_keeps_one_row_of_each_group(spark):
    a, z, q = (" ".join(f"{x}{i}" for i in range(30)) for x in "azq")
    d = spark.createDataFrame([(1, a, "en"), (3, a, "en"), (3, z, "en"), (5, q, "en"), (5, q, "fr"), (5, q, "en"), (None, q, "en"), (7, None, "en"), (8, "", "en")], "doc_id long, text string, lang string")
    got = sorted((str(r[0]), str(r[1])[:1]) for r in minhash.keep_one(d).collect())
    assert got == sorted([("1", "a"), ("3", "z"), ("5", "q"), ("None", "q"), ("7", "N"), ("8", "")])


def test_decontamination_without_broadcast_and_by_row(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(PROSE[5].split()[10:40])), (2, "one"), (4, PROSE[2][:100].upper())], "item_id long, text string")
    want = sorted(str(r) for r in decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(str(r) for r in decontaminate.contamination(docs, bench).collect()) == want
    d = spark.createDataFrame([(1, PROSE[5]), (1, PROSE[7]), (2, "one"), (None, PROSE[5])], "doc_id long, text string")
    assert sorted(str(r[1])[:9] for r in decontaminate.keep_clean(d, bench).collect()) == sorted([PROSE[7][:9], PROSE[5][:9]])


def test_labelled_sample_takes_one_row_of_an_id(spark, docs):
    from tidemark.llm.common import labelled_sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    twice = docs.union(docs.withColumn("text", F.lit("other words")))
    got = [r["id"] for r in labelled_sample(twice, labels, "quality", 5, 5, 0).collect()]
    assert len(got) == len(set(got)) == 5


def test_pii_secrets_cues_and_number_boundaries():
    field = pii.trained()
    for text, want in (
        ('le token = "11acdf0b9c2e4f6a8b7d1234567890abcdef1234" est', ("secret", "11acdf0b9c2e4f6a8b7d1234567890abcdef1234")),
        ("llame 1 (663) 555-6869 hoy", ("phone", "1 (663) 555-6869")),
        ("téléphone: 663-555-6869, merci", ("phone", "663-555-6869")),
    ):
        _, every = pii.find(text, field)
        assert [(k, text[a:b]) for k, a, b in every] == [want]
    assert pii.find("see words/of/a_path_12/to_files and some-long-hyphen-name-2019", field) == ([], [])
    text = "a@b.cd " * 3000 + "1 2 3 4 5 6 7 8 9 " * 3000
    assert len(pii.find(text, field)[0]) == 3000


def test_quality_features_by_plain_python():
    """Words in Python's own loops, each text by itself: neighbours in a batch make no difference."""
    vectors = RNG.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    texts = ["to be or", "or not to be", "be be be 12ab!?", "", "or", "or", "é ß 1", "a  b", " ".join(RNG.choice(VOCABULARY, 500))]

    def words(t):
        return re.findall(r"[A-Za-z\u0080-\uffff]+|[0-9]+|[^A-Za-z0-9\s\u0080-\uffff]+", t)

    def bucket(w):
        return next(ids[0] for _, ids, _ in quality.word_buckets([w]))

    want = []
    for t in texts:
        w = words(t)
        ids = [quality.AGAIN if i and w[i] == w[i - 1] else bucket(x) for i, x in enumerate(w)]
        v = vectors[ids].astype(np.float64) if ids else np.zeros((1, quality.DIMS))
        want.append(np.concatenate([v.mean(0), v.std(0), [np.log1p(len(ids))]]))
    assert np.allclose(quality.pooled(texts, vectors), np.array(want), atol=1e-3)


def test_decoding_by_trying_all_readings():
    model = np.log(RNG.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS)))
    for _ in range(150):
        token = "".join(RNG.choice(list("ab1l0o5s.é-"), int(RNG.integers(1, 7))))
        best = None
        for path in itertools.product(*toxicity.lattice(token)):
            codes = [z for _, c, _ in path for z in c]
            score = sum(cost for _, _, cost in path) + sum(model[x][y][z] for x, y, z in zip([0, 0, *codes], [0, *codes], codes))
            best = max(best or (-np.inf, ""), (score, "".join(t for t, _, _ in path)))
        assert toxicity.decode(token, model) == best[1].strip(), token


def test_language_scores_by_plain_python():
    langs, table = ["a", "b", "c"], RNG.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(langs, table, np.array([0.1, 0.0, -0.1]), 0.7)
    for text in ("Hello, World", "x", "é 1 ß!", "two  words", "a" * 500):
        kept = re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if m[1] is None else "\0", text.lower(), flags=re.S)
        padded = " " + re.sub("\0+", " ", kept).strip() + " "
        buckets, has_letter = langid.subwords(text)
        n = [len(padded) - 1, len(padded) - 2]
        if text[-1].isalpha():
            assert has_letter and len(buckets) == sum(n)
        z = (table[buckets].astype(np.float64).mean(0) + model.bias) / 0.7
        assert np.allclose(model.probabilities(model.average(buckets)), np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_licences_sql_knows_whole_texts_and_paragraphs(spark):
    import duckdb

    whole = {i: t for i, t in licences.known_texts() if len(t) > 900}
    rows = [(1, "Copyright (c) 2020 Jo\n\n" + whole["MIT"]), (2, "intro\n\n" + whole["MIT"].replace(" ", "  ") + "\n\nend"), (3, None), (4, "SPDX-License-Identifier: Apache-2.0\nx"), (5, whole[max(whole)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.sql(licences.oracle_sql()).df()
    got = licences.scan(docs).toPandas()
    clean = lambda df: sorted(map(str, df[["doc_id", "digest", "license_id", "n_license_lines", "licenses"]].astype(object).where(df.notna(), None).itertuples(index=False)))
    assert clean(got) == clean(want)
    assert set(want["license_id"].dropna()) >= {"MIT"} and "MIT" in want.set_index("doc_id")["licenses"][2]


def test_licences_read_and_even_out_a_text_once(spark, tmp_path):
    notice = "SPDX-License-Identifier: MIT"
    texts = [f"{notice}\r\n\r\n\x01{notice}", f"a\n---\n{notice}\n \t\r\n...\n(c) x 2020 y\n{notice}", f"x\x01y\n\x01\n{notice}\n\x01", "\n" * 50_000 + notice, "Licensed under CC BY-NC 4.0.\nv. 2\n\nReleased under\nthe MIT License.\n\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = licences.scan(spark.read.parquet(f"{tmp_path}/docs"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan
    got = {r["doc_id"]: (r["license_id"], r["n_license_lines"], r["licenses"]) for r in found.collect()}
    assert got == {0: (None, 2, "MIT"), 1: (None, 2, "MIT"), 2: (None, 1, "MIT"), 3: ("MIT", 1, "MIT"), 4: (None, 1, "CC-BY-NC-4.0,MIT"), 5: (None, 0, ""), 6: (None, 0, "")}
    parts = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r[0]: r[1] for r in parts.select("doc_id", F.sha2(licences.canonical(F.col("text")), 256)).collect()}
    assert {r["doc_id"]: r["digest"] for r in found.collect()} == whole


def test_packing_encodes_frequent_words_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words, learned = packing.WordIds(path), []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: learned.extend(new) or learn(new))
    for k in range(10):
        text = "so the herse, " + " ".join(f"x{k}y{i}" for i in range(40)) + " of the\nherse, "[:-1]
        assert np.frombuffer(words.texts([text])[0], "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words) + len(words.aside) <= 2 * (50 + 44)
    assert len(learned) == len(set(learned)) == 10 * 40 + 4


def test_a_stretch_looks_each_word_up_once(monkeypatch):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    texts = ["the cat, the\nhat " * 300 + "end", "the cat", "", " ", "a  b", "\u00fcber 12 \u2581the cat\u3000x"]
    for kind, path, name in ((packing.WordIds, paths[0], "texts"), (alignment.SideA, paths[0], "ids"), (alignment.SideB, paths[1], "ids")):
        looked_up = []

        class Counting(kind):
            def __getitem__(self, word):
                looked_up.append(word)
                return dict.__getitem__(self, word)

        words = Counting(path)
        got = [np.frombuffer(b, "<u4").tolist() for b in getattr(words, name)(texts)]
        if kind is alignment.SideB:
            assert got == words.model.encode(texts)
        else:
            space = " " if kind is alignment.SideA else ""
            assert got == [words.tokenizer.encode(space + t, add_special_tokens=False).ids for t in texts]
        assert len(looked_up) < 20


def test_components_of_few_edges_are_few_tasks(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = common.components(spark.createDataFrame(edges, "a long, b long"))
        assert dict(found.collect()) == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100) | {200: 200, 201: 200}
        stars = found.groupBy(F.spark_partition_id()).count().count()
        assert stars <= found.rdd.getNumPartitions() <= common.LEAST_TASKS + 40  # the second part are the distinct centres
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
