"""Substring dedup, BPE, SimHash, quality and language model against brute force on awkward rows."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, hmm_lm, quality, simhash, substring_dedup
from corpusloom.llm import textbytes as tb
from tests.llm.helpers import awkward, frame, lower_ascii, with_clashes, words


def brute_windows(rows, width):
    first = {}
    for r in rows:
        w = words(r[1])
        for p in range(len(w) - width + 1):
            if r[0] is not None:
                key = tuple(w[p : p + width])
                first[key] = min(first.get(key, r[0]), r[0])
    out = Counter()
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[p : p + width])] < r[0]:
                gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def mosaic(seed):
    rng = random.Random(seed)
    words_ = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(words_) for _ in range(rng.randrange(20, 150))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(len(p))] if rng.random() < 0.5 else p
            if rng.random() < 0.2:
                w += ["z"] * rng.randrange(1, 120)
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i * 7 % 83, " ".join(w), "en", "a", 1))
    return rows


@pytest.mark.parametrize("rows", [awkward(), mosaic(1), mosaic(2)])
def test_substring_dedup(spark, rows):
    found = substring_dedup.without_repeats(with_clashes(frame(spark, rows)))
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(rows, 50)


def test_substring_dedup_other_width_and_empty(spark):
    rows = mosaic(3)
    found = substring_dedup.without_repeats(frame(spark, rows), window=12, text=True)
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(rows, 12)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found.collect())
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0


def test_automaton_finds_every_occurrence():
    low = np.array([1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8, 1], dtype=np.uint64)
    phrases = substring_dedup.phrase_keys(low, np.arange(10))
    assert substring_dedup.letters(phrases[:1]) == ["AbAcAdAeAfAgAhAi"]
    text, place = substring_dedup.spelled(low, np.array([17]))
    assert text.startswith(b"AbAcAdAeAfAgAhAiAbAc") and text.endswith(b"Ab.")
    found = substring_dedup.occurrences(substring_dedup.automaton_of(phrases[:2]), text.decode())
    assert sorted(found.tolist()) == place[[0, 1, 8, 9]].tolist()
    assert len(substring_dedup.occurrences(substring_dedup.automaton_of(phrases[:0]), text.decode())) == 0
    two, place = substring_dedup.spelled(low, np.array([4, 13]))  # no phrase runs from one text into the next
    assert place[4] == 9 and sorted(substring_dedup.occurrences(substring_dedup.automaton_of(phrases[:2]), two.decode()).tolist()) == place[[8, 9]].tolist()


def test_occurrences_that_are_no_anchors():
    """Whole texts stream: a confirmed phrase is found where it is the anchor of no window of its text, too."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)).encode() for _ in range(6)]
    seeds = (3, 4)
    (words,), per_text = substring_dedup._word_hashes(texts, seeds[0])
    anchors = substring_dedup.Anchored.of(words, per_text, 50)
    phrase = anchors.phrase[5]
    there = substring_dedup.tb.run_hashes(words, 8)
    # the phrase's words between words whose phrases have lesser hashes: no window of the new text is anchored at it
    first = int(np.flatnonzero(there == anchors.hashes[5])[0])
    said = b" ".join(texts).split()[first : first + 8]
    low = int(np.argmin(there))
    least = b" ".join(texts).split()[low : low + 8]
    text = b" ".join([*least, *said, *least, *(f"x{i}".encode() for i in range(20))])
    (words,), per_text = substring_dedup._word_hashes([text], seeds[0])
    own = substring_dedup.Anchored.of(words, per_text, 30)
    spelt, place = substring_dedup.spelled(words, per_text)
    found = substring_dedup.occurrences(substring_dedup.automaton_of(np.array([phrase])), spelt.decode())
    assert found.tolist() == [place[8]] and phrase not in own.phrase


def test_automata_decide(spark, monkeypatch):
    """Without what the automata locate nothing is removed; with many shards and small blocks all of it is."""
    docs = frame(spark, mosaic(1))
    assert substring_dedup.without_repeats(docs).agg({"n_removed": "sum"}).first()[0] > 0
    monkeypatch.setattr(substring_dedup, "compiled", lambda phrases, folder, shard=5, real=substring_dedup.compiled: real(phrases, folder, 5))
    monkeypatch.setattr(substring_dedup, "streamed", lambda *a, real=substring_dedup.streamed, **k: real(*a, **k, block=100))
    found = substring_dedup.without_repeats(docs)
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(mosaic(1), 50)
    monkeypatch.setattr(substring_dedup, "compiled", lambda phrases, folder: [])
    assert substring_dedup.without_repeats(docs).agg({"n_removed": "sum"}).first()[0] == 0


def test_classifier_samples_reach_the_driver_packed(spark, monkeypatch):
    """Three bytes for each distinct bucket of a text, and the same buckets and counts."""
    texts = [" ".join(f"w{(i * 7919 + k * k) % 5000}" for k in range(400)) for i in range(6)] + ["again " * 400, ""]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", seen.append)
    quality.fit(docs, labels)
    (samples,) = seen
    ids = sorted((i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert len(samples) == len(ids) > 2
    number = 0
    for (buckets, counts, label), i in zip(samples, ids, strict=True):
        expected = quality.bucket_counts(texts[i])
        assert buckets.tolist() == expected[0].tolist() and counts.tolist() == expected[1].tolist() and label == i % 2
        number += len(buckets)
    assert sum(len(memoryview(x)) for x in samples.data) < 3.2 * number
    for wide in ([1, 70000], [300, 2**33]), ([0, 65535, 65536, 200000, 262143], [1] * 5), ([], []):
        found = quality.unpacked(quality.packed(*(np.array(x, np.int64) for x in wide)))
        assert [x.tolist() for x in found] == [list(x) for x in wide]


def test_automata_of_a_block_follow_its_words(tmp_path, monkeypatch):
    """However many phrases are confirmed, a block's automata hold those said in it, and its texts pass each once."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(4)]
    (words,), per_text = substring_dedup._word_hashes([t.encode() for t in texts], 3)
    said = np.unique(substring_dedup.Anchored.of(words, per_text, 50).phrase)
    names, passed = [], []
    for k in range(6):
        phrases = np.concatenate([said[k::6], np.random.default_rng(k).integers(-(2**62), 2**62, 1000)])
        (tmp_path / str(k)).write_bytes(np.sort(phrases).astype("<i8").tobytes())
        names.append(str(k))

    class Rows:
        schema = StructType([StructField("doc_id", LongType())])

        def mapInArrow(self, scan, schema):
            columns = [pa.array([1, 2, 3, 4]), pa.array([0, 0, 0, 0]), pa.array(texts)]
            return list(scan(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "text"])])))

    search = substring_dedup.occurrences
    monkeypatch.setattr(substring_dedup, "occurrences", lambda automaton, text: passed.append((len(automaton), len(text))) or search(automaton, text))
    (found,) = substring_dedup.streamed(Rows(), tmp_path.as_uri(), names, 50, (3, 4))
    assert passed == [(len(said), 2 * len(words) + 4)]
    assert sum(s["windows"] for row in found.column(3).to_pylist() for s in row) == 4 * 251


def colliding(seed):
    """Two different words of 16 bytes with one span hash under a known seed."""
    mask = 2**64 - 1
    state = lambda half: int(tb.mixed(np.array([tb.mixed(np.array([(16 + seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & mask], np.uint64))[0] ^ np.uint64(int.from_bytes(half, "little"))]))[0])
    rng, x = random.Random(5), b"abcdefghijklmnop"
    while True:
        half = bytes(rng.randrange(97, 123) for _ in range(8))
        rest = (state(x[:8]) ^ int.from_bytes(x[8:], "little") ^ state(half)).to_bytes(8, "little")
        try:
            word = (half + rest).decode()
        except UnicodeDecodeError:
            continue
        if len(words(word)) == 1 and words(word)[0] == word:
            return x.decode(), word


def test_words_made_to_collide(spark):
    """Words that share a hash under one seed do not under others, and windows that differ in them are not the same."""
    x, y = colliding(0)
    raw, _ = tb.joined([x.encode(), y.encode()])
    spans = tb.word_spans(raw)
    assert len(set(tb.span_hashes(raw, *spans).tolist())) == 1 and len(set(tb.span_hashes(raw, *spans, 77).tolist())) == 2
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{line} {x} {line}", "en", "a", 1), (2, f"{line} {y} {line}", "en", "a", 1)]
    for seeds in (None, (0, 1)):  # the second hash holds against a first that is known
        found = substring_dedup.without_repeats(frame(spark, rows), seeds=seeds)
        assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(rows, 50)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_alike_in_polynomials_differ(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64."""
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    raw, _ = tb.joined([x.encode(), y.encode()])
    starts, ends = tb.word_spans(raw)
    assert len(set(tb.span_hashes(raw, starts, ends).tolist())) == 2
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{line} {x} {line}", "en", "a", 1), (2, f"{line} {y} {line}", "en", "a", 1)]
    found = substring_dedup.without_repeats(frame(spark, rows))
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(rows, 50)
    rows = [(d, t, "en", "a", 1) for d, t in ((2, x), (3, y), (4, x))]
    found = hmm_lm.hmm_scores(frame(spark, rows), rounds=1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == brute_base(rows)


ODD = ["", "   ", "aaaaaaaa" * 9, "***!!!***" * 9, "ΟΔΥΣΣΕΥΣ", "İstanbul I don't we'LL", "a\x1cb\x1fc \x85 d", "é ﬁ", "<|endoftext|> hi<|startoftext|>there <|ENDOFTEXT|>", "日本語 12345 ½ Ⅷ", "😀👩‍👩‍👧", "\x00﻿", "Ა ⴰ", "ꟊ 𐵐"]


def test_bpe(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = awkward() + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    found = bpe.encode_documents(with_clashes(frame(spark, rows)), decoded=True)
    want = Counter()
    for r in rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text] += 1
    assert Counter((r[0], r[1], r[2], r[3], tuple(r["ids"]), r["decoded"]) for r in found.collect()) == want
    assert bpe.encode_documents(frame(spark, [])).count() == 0


def test_bpe_of_marks():
    """Every combining mark, alone, in pairs with two accents on either side, and in mixes of scripts."""
    encoder, reference = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path())), Tokenizer.from_file(bpe.default_path())
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    texts = [f"{a}{m}{b} {a}{b}{m}x" for m in marks for a, b in (("e\u0301", "\u0323"), ("q\u0323", "\u0301"), ("", "\u0301"))]
    rng = random.Random(4)
    some = [*marks, *"aeou\u00e9\u0d15\u0928\u0915\u05d0\u1100\u1161\u11a8\U00011935\U00011930\U00011938 "]
    texts += ["".join(rng.choice(some) for _ in range(12)) for _ in range(3000)]
    want = reference.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, got, ref in zip(texts, encoder.encode(texts), want, strict=True) if got.tolist() != ref.ids]
    assert not wrong, (len(wrong), [t.encode("unicode_escape") for t in wrong[:5]])


def test_bpe_warns_of_other_tables(monkeypatch):
    monkeypatch.setattr(bpe, "MADE_FOR", ("1.0", *bpe.MADE_FOR[1:]))
    with pytest.warns(UserWarning, match="Unicode"):
        bpe.Vocabulary.read(bpe.default_path())


def test_bpe_forgets_words(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path()))
    reference = Tokenizer.from_file(bpe.default_path())
    for text in ("alpha beta gamma delta", "epsilon zeta", "alpha epsilon"):
        assert encoder.encode([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def brute_fingerprint(text):
    w = words(lower_ascii(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps):
    left, names = set(fps), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        for x in group:
            names[x] = group
    return names


def test_simhash(spark):
    rows = [r for r in awkward(n=150)]
    found = simhash.near_duplicates(with_clashes(frame(spark, rows))).collect()
    fps = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows}
    groups = brute_components(set(fps.values()))
    ids = defaultdict(set)
    for (doc, _), fp in fps.items():
        if doc is not None:
            ids[fp].add(doc)
    want = Counter()
    for r in rows:
        fp = fps[r[0], r[1]]
        members = set().union(*(ids[x] for x in groups[fp]))
        want[r[0], f"{fp:016x}", min(members) if members else None] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_lose_nothing(spark, bucket):
    """Dense clusters around a few centres, also when buckets have to be dealt into blocks."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, bucket=bucket)).collect()}
    groups = brute_components(fps)
    for x in fps:
        s = x - 2**64 if x >= 2**63 else x
        group = {y - 2**64 if y >= 2**63 else y for y in groups[x]}
        assert roots.get(s, s) == min(group)


def test_recall_on_edited_copies():
    """Share of copies with a few words changed that lie within the radius of the contract: what README states."""
    rng, recall = random.Random(6), {}
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    for least, most in ((100, 300), (300, 1000), (1000, 10**6)):
        some = [t for t in texts if least <= len(t.split()) < most][:200]
        for edits in (1, 2, 5, 10):
            hits = 0
            for t in some:
                w = t.split()
                for i in rng.sample(range(len(w)), edits):
                    w[i] = f"edit{rng.randrange(10**6)}"
                hits += (simhash.fingerprint(simhash.shingle_hashes(t)) ^ simhash.fingerprint(simhash.shingle_hashes(" ".join(w)))).bit_count() <= 4
            recall[least, edits] = hits / len(some)
    assert recall[1000, 1] > 0.9 and recall[1000, 2] > 0.9 and recall[300, 1] > 0.8 and recall[100, 1] > 0.5
    assert recall[100, 5] < recall[300, 5] < recall[1000, 5]


def test_dense_buckets_are_divided(spark, monkeypatch):
    """A ball of fingerprints that fills buckets far beyond their size, linked as by brute force."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(300)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bucket=16)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    for x, group in brute_components(fps).items():
        assert roots.get(signed(x), signed(x)) == min(map(signed, group))
    assert edges.count() < 31 * len(fps)  # forests, not pairs


def test_masks_cover():
    masks = [int(m) for m in simhash.covering_masks(4)]
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & bits for m in masks)


def test_near_stage_keeps_one(spark):
    docs = with_clashes(frame(spark, awkward()))
    left = simhash.drop_near_duplicates(docs)
    names = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(n for n in names if n is not None)


def test_near_stage_loses_no_component(spark):
    """Distinct texts without an id, or under one id, all stay; of near or equal copies one row does."""
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a, "en", "a", 1), (None, b, "en", "a", 1), (None, b, "en", "a", 1), (7, c, "en", "a", 1), (7, d, "en", "a", 1), (3, d.upper(), "en", "a", 1), (None, d, "en", "a", 1)]
    docs = with_clashes(frame(spark, rows))
    left = corpus_pipeline.near_stage(spark, docs, SF)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(None, a), (None, b), (7, c), (3, d.upper())])
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(docs).collect() if r["doc_id"] is None) == sorted([a, b])
    rows = awkward()
    groups = brute_components({brute_fingerprint(r[1]) for r in rows})
    kept = [brute_fingerprint(r["text"]) for r in corpus_pipeline.near_stage(spark, frame(spark, rows), SF).collect()]
    assert len(kept) == len({min(groups[x]) for x in kept}) == len({min(g) for g in groups.values()})


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.quality_scores(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def slow_score(model, text):
    """One text by plain loops: its words, repeated words, and n-grams of code points inside words with their borders."""
    spaces = " \t\n\x0b\x0c\r"
    found = words(text)

    def bucket(word):
        raw, _ = tb.joined([word.encode()])
        return int(tb.span_hashes(raw, *tb.word_spans(raw))[0]) % quality.BUCKETS

    def gram(points):
        g = len(points)
        for p in points:
            g = (g ^ p) * 2654435761 % 2**32
            g ^= g >> 15
        return g % quality.BUCKETS

    buckets = [bucket(w) for w in found] + [0 for a, b in zip(found, found[1:], strict=False) if a == b]
    line = [32 if c in spaces else ord(c) for c in f" {text} "]
    for n in (3, 4):
        buckets += [gram(line[i : i + n]) for i in range(len(line) - n + 1) if 32 not in line[i + 1 : i + n - 1]]
    mean = sum(int(model.weights[b]) for b in buckets) / (max(len(buckets), 1) * quality.UNIT)
    return 1 / (1 + math.exp(-model.bias - mean))


def test_quality_is_the_same_in_any_batch(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", " ", "ab", "", "ab ab", "日本語 é", "ab"]
    together = model.scores(texts)
    assert [model.scores([t])[0] for t in texts] == together.tolist()
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    assert model.scores([texts[i] for i in order]).tolist() == together[order].tolist()
    assert together[texts.index("")] == pytest.approx(1 / (1 + math.exp(-model.bias)), abs=1e-12)
    for i in [*range(0, 60), *range(len(texts) - 7, len(texts))]:
        if len(texts[i]) < 20000:
            assert together[i] == pytest.approx(slow_score(model, texts[i]), abs=1e-12)


def test_quality_bounds_the_sample_by_texts(spark):
    """A doc_id of many texts and many rows alike: neither is learned from beyond the sample."""
    rows = [(5, f"text {i % 40}", "en", "a", 1) for i in range(400)] + [(6, "other", "en", "a", 1)]
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int")
    seen = []
    train = quality.train
    try:
        quality.train = lambda samples: seen.extend(samples) or train(samples)
        quality.fit(frame(spark, rows), labels, sample=30)
    finally:
        quality.train = train
    assert len(seen) <= 30


def test_quality_does_not_read_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_quality_awkward(spark):
    docs = with_clashes(frame(spark, awkward()))
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert all(r["score"] == 1 and r["predicted"] == 1 for r in none)
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.quality_scores(frame(spark, []), labels).count() == 0


def brute_base(rows, digits=4):
    tokens = {i: [*words(lower_ascii(r[1])), None] for i, r in enumerate(rows)}
    held = {i: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for i, r in enumerate(rows)}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for i, r in enumerate(rows):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        out[r[0], held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, round(base, digits)] += 1
    return out


@pytest.mark.parametrize("head", [10, 65536])
def test_language_model_base(spark, monkeypatch, head):
    monkeypatch.setattr(hmm_lm, "HEAD", head)
    rows = awkward()
    found = hmm_lm.hmm_scores(with_clashes(frame(spark, rows)), rounds=1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == brute_base(rows)
    assert all(r["score"] < 0 for r in found)


def test_language_model_score(spark):
    """The query's score against a plain forward recursion of each text, with the fitted model's parameters."""
    rows = awkward()
    docs = frame(spark, rows)
    texts = hmm_lm._texts(docs)
    counts = hmm_lm.cut(hmm_lm.token_counts(texts.filter("not held_out")))
    fitted = hmm_lm.fit(texts.filter("not held_out"), counts, 1)
    hmm = fitted.hmm
    want = Counter()
    for (doc_id, _held, _n, _known, _train, base), n in brute_base(rows, digits=9).items():
        for r in rows:
            if r[0] == doc_id and len(words(r[1])) + 1 == _n:
                tokens, _, _ = hmm_lm.tokens_of([(r[1] or "").encode()])
                now, total = hmm.start.tolist(), base
                for t, c in enumerate(hmm_lm.classes_of(tokens).tolist()):
                    if t:
                        now = [sum(now[i] * float(hmm.moves[i, j]) for i in range(len(now))) for j in range(len(now))]
                    now = [x * float(e) for x, e in zip(now, hmm.emits[c], strict=True)]
                    total += math.log10(sum(now)) - float(fitted.shares[c])
                    now = [x / sum(now) for x in now]
                want[doc_id, round(total, 5)] += n
                break
    found = hmm_lm.scores(texts, counts, fitted).collect()
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in found) == want


def test_language_model_empty(spark):
    assert hmm_lm.hmm_scores(frame(spark, []), rounds=1).count() == 0
    assert hmm_lm.hmm_scores(frame(spark, [(1, None, "en", "a", 0)]), rounds=1).count() == 1


def test_forward_is_exact():
    """The scaled recursion against a sum over all state paths."""
    rng = np.random.default_rng(0)
    model = hmm_lm.Hmm.from_counts(rng.random(3), rng.random((3, 3)), rng.random((hmm_lm.CLASSES + 1, 3)))
    sequences = [np.array([5, 9, hmm_lm.END]), np.array([hmm_lm.END]), np.array([7, 7, 1, 2, hmm_lm.END])]
    side = hmm_lm.Side.of(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    found = np.empty(3)
    found[side.order] = model.forward(side)[0]
    for s, value in zip(sequences, found, strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emits[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.moves[path[t - 1], path[t]] * model.emits[s[t], path[t]]
            total += p
        assert value == pytest.approx(math.log10(total), rel=1e-12)
    starts, moves, emits, _ = model.expected(side)
    assert starts.sum() == pytest.approx(3, rel=1e-6) and moves.sum() == pytest.approx(6, rel=1e-6) and emits.sum() == pytest.approx(9, rel=1e-6)


def test_language_model_beats_its_base(spark):
    rows = hmm_lm.hmm_scores(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").collect()
    gain = (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.08  # log10 per token


def test_hash_helpers():
    texts = ["the cat the", "", "x the"]
    raw, offsets = tb.joined([t.encode() for t in texts])
    starts, ends = tb.word_spans(raw)
    hashes = tb.span_hashes(raw, starts, ends)
    assert tb.words_per_text(starts, offsets).tolist() == [3, 0, 2]
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    values = np.array([5, 3, 3, 9, 1, 1, 7])
    assert tb.sliding_argmin(values, 3).tolist() == [2, 2, 4, 5, 5]
    runs = tb.run_hashes(np.array([1, 2, 1, 2, 1], dtype=np.uint64), 2)
    assert runs[0] == runs[2] and runs[1] == runs[3] and runs[0] != runs[1]


def test_very_long_texts(spark):
    """A text of 60,000 words, among them one of 100,000 letters, through every operator on texts."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(60000)) + " " + "x" * 100000
    rows = [(1, long, "en", "a", 1), (2, "short one", "en", "b", 1), (3, "a " + long, "en", "a", 1), (4, None, "en", None, 0)]
    docs = frame(spark, rows)
    found = substring_dedup.without_repeats(docs)
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_windows(rows, 50)
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()} == {r[0]: f"{brute_fingerprint(r[1]):016x}" for r in rows}
    reference = Tokenizer.from_file(bpe.default_path())
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(docs, ids=False).collect()} == {r[0]: len(reference.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    scored = hmm_lm.hmm_scores(docs, rounds=1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in scored) == brute_base(rows, 3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).count() == 4


def test_long_words_are_quick(monkeypatch):
    """Words of up to a million letters have the library's ids, whether they are merged by rounds or by a heap."""
    import time

    library = Tokenizer.from_file(bpe.default_path())
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path()))
    rng = random.Random(9)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (255, 256, 257, 1000, 100_000)]
    made += ["a" * 3001, "ab" * 700 + "c", "aab" * 500, "é" * 400, "日本語" * 300, "the" * 1000 + " the " + "of" * 300, "".join(chr(c) for c in range(0x4E00, 0x4E00 + 20_000))]
    assert [x.tolist() for x in encoder.encode(made)] == [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    short = [w.encode() for w in made[0].split("e") if w] + [b"a" * 300, b"abc" * 101]
    both = [encoder.vocabulary.merge(short), encoder.vocabulary.merge_rounds(short)]
    assert all(np.array_equal(a, b) for a, b in zip(*both, strict=True))
    began = time.monotonic()
    text = "".join(rng.choice("acgt") for _ in range(1_000_000))
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert time.monotonic() - began < 60
