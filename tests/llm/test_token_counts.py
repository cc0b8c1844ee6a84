"""Token counts against the tokenizers library."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import token_counts as tc
from tests.llm.helpers import awkward, frame, with_clashes


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tc.default_path())


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counter(words=()):
    with open(tc.default_path(), encoding="utf-8") as file:
        spec = file.read()
    specials = tc.checked(spec)
    tokens = tc.Splitter(spec, specials).tokens
    return tc.Counter(spec, specials, tc.Lengths(list(words), [tokens(w) for w in words]))


def counts(found, texts):
    out = [0] * len(texts)
    for rows, pieces, extra in tc.chunks(found.splitter, pa.array(texts)):
        for row, n, more in zip(rows, found.of(pieces).tolist(), extra, strict=True):
            out[row] += n + more
    return out


def test_pre_tokens(library):
    rng = random.Random(5)
    marks = ["'", "'", " ", " ", "s", "t", "ll", "re", "ve", "l", "a", "'S", "1", "\n", "\t", "!", "<|endoftext|>", "<|endof", "é", "\xa0", "\x85", "²", "日", "́", "😀", "\x00", "\x1c", "᠎"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    assert counts(counter(), texts) == want(library, texts)


def test_every_kind_of_character(library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)} b" for c in codes]
    assert counts(counter(), texts) == want(library, texts)


def test_table_and_cache_agree(library):
    """Words of the table, of its length limit, beyond it, and many that fall into one slot."""
    words = [b"a" * n for n in range(1, 18)] + [f" w{i}".encode() for i in range(3000)]
    short = [w for w in words if len(w) <= tc.SHORT]
    found = counter(short)
    raw = b"".join(short)
    ends = tc.np.cumsum([len(w) for w in short])
    low, high = tc.short_keys(raw, ends - [len(w) for w in short], ends)
    assert [tc.word_of(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)] == short
    known = found.lengths.of(low, high)
    assert (known > 0).mean() > 0.8 and all(n == found.splitter.tokens(w) for n, w in zip(known.tolist(), short, strict=True) if n)
    texts = [w.decode() for w in words] + ["x".join(w.decode() for w in words[:500])]
    assert counts(found, texts) == want(library, texts)


def test_very_long_texts(library):
    rng = random.Random(2)
    texts = ["word " * 500_000, "x" * 1_500_000, " " * 1_200_000 + "a", "".join(rng.choice("ab'\n 1.") for _ in range(2_500_000)), "<|endoftext|>" * 1000]
    assert counts(counter(), texts) == want(library, texts)


def test_rows(spark, library):
    rows = awkward()
    out = tc.token_counts(with_clashes(frame(spark, rows)), limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = want(library, [r[1] for r in rows])
    expect = [(r[0], len((r[1] or "").encode()), k, k > 100) for r, k in zip(rows, n, strict=True)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expect, key=repr)
    assert tc.token_counts(frame(spark, [])).collect() == []
    assert [r["n_tokens"] for r in tc.token_counts(frame(spark, [(1, None, None, None, None)])).collect()] == [0]


def test_frequent(spark, monkeypatch):
    """The merged summaries hold the frequent pre-tokens of all partitions."""
    monkeypatch.setattr(tc, "FAN", 2)
    texts = [(i, " common" * 5 + f" rare{i}" + (" half" if i % 2 else ""), None, None, None) for i in range(300)]
    with open(tc.default_path(), encoding="utf-8") as file:
        spec = file.read()
    found = tc.frequent(frame(spark, texts, 9).select("text"), spec, tc.checked(spec))
    assert found[:3] == [b" common", b" rare", b" half"]


def test_summary_forgets_the_rare(monkeypatch):
    monkeypatch.setattr(tc, "COUNTED", 50)
    summary = tc.Summary()
    for i in range(40):
        words = [b"often"] * 20 + [f"w{i}-{j}".encode() for j in range(30)]
        ends = tc.np.cumsum([len(w) for w in words])
        summary.add(*tc.short_keys(b"".join(words), ends - [len(w) for w in words], ends))
    row = summary.row(10).to_pylist()[0]
    assert tc.word_of(*(int(tc.np.frombuffer(row[c], tc.np.uint64)[0]) for c in ("low", "high"))) == b"often"
    assert tc.np.frombuffer(row["counts"], tc.np.int64)[0] == 800


def test_query_is_the_contract(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = want(library, [r["text"] for r in rows])
    expect = sorted((r["doc_id"], len((r["text"] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True))
    assert sorted(map(tuple, tc.op12(spark, sf).collect())) == expect


def test_other_files_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        tc.checked(file.read())
