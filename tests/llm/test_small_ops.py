"""Mixing, WARC, media, exact dedup and chat against brute force on awkward rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from corpusloom.llm import blobs, chat, exact_dedup, media, mixing, warc
from corpusloom.llm.common import fresh_dir
from tests.llm.helpers import awkward, frame, with_clashes, words


def fill(sizes, weights, share=1.5, cap=2.0):
    """Water filling by repeated resharing."""
    total, full, target = share * sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(cap * sizes[i] for i in full)
        target = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if target[i] > cap * sizes[i] or sizes[i] == 0]
        if not over:
            return [cap * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full |= set(over)


def test_mixing(spark):
    rows = awkward()
    docs = with_clashes(frame(spark, rows))
    found = mixing.words_taken(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(names, fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in names)
    again = mixing.words_taken(frame(spark, rows, 7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in found)


def test_mixing_spreads_sources(spark):
    rows = [(i, "w " * 40, "en", "abc"[i % 3], 1) for i in range(300)]
    made = mixing.mix(frame(spark, rows), max_block=40)
    stream = [r["source"] for r in made.segments.orderBy("slot", "begin_word").collect()]
    share = Counter(stream)
    for source in "abc":
        for stop in (60, 150, 300):
            assert abs(stream[:stop].count(source) - stop * share[source] / len(stream)) <= 6


def test_mixing_empty(spark):
    assert mixing.words_taken(frame(spark, [])).collect() == []
    only = [(1, None, "en", None, 0), (2, "", "en", "a", 0)]
    assert [(r["doc_id"], r["taken"]) for r in mixing.words_taken(frame(spark, only)).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    assert mixing.mixed_documents(frame(spark, only)).count() == 2


def test_mixed_documents(spark):
    docs = with_clashes(frame(spark, awkward()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter((r["doc_id"], r["text"]) for r in out.collect()).values()) <= 4  # a repeated row may play twice each


PAGES = [(5, "http://a\r\nb", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "u", None), (9, "u", ""), (7, "u", "é€😀"), (8, "u", "x" * 50000), (3, "z", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone")]


@pytest.mark.parametrize("least", [0, 5, 20])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages, least).collect())
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        revisit = len(data) >= least and first is not None and page != first
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert found == want


def test_warc_html_comes_back(spark):
    pages = spark.createDataFrame(PAGES[:7], "page_id long, url string, html string")
    folder = fresh_dir(spark, "warc-test")
    index = warc.write_warc(pages, folder, archive_bytes=2000)
    assert index.select("file").distinct().count() >= 1
    back = warc.resolved(warc.read_warc(index.filter("page_id <> 9"), folder))
    assert Counter((r["page_id"], r["html"]) for r in back.collect()) == Counter((p, h or "") for p, _, h in PAGES[:7] if p != 9)


def test_warc_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_media(spark):
    rows = awkward()
    found = media.media_round_trip(with_clashes(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    by_text = defaultdict(set)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").encode())
    for r in found:
        data = next(d for d in texts[r["doc_id"]] if len(d) == r["n_bytes"])
        whole = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert (r["width"], r["height"], r["depth"]) == (192, len(whole) // 192, 8)
        by_text[whole].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_round_trip(frame(spark, [])).count() == 0


def test_media_headers_alone(spark, monkeypatch):
    """Headers are read by ranges of their own: far fewer bytes than the images have, and the same columns."""
    rng = random.Random(1)
    rows = [(i, "".join(chr(rng.randrange(32, 126)) for _ in range(4000)), "en", "a", 1) for i in range(30)] + awkward()
    folder = fresh_dir(spark, "media-test")
    places = media.stored(media.places(media.store_media(frame(spark, rows), folder)), "places-test")
    headed = media.stored(media.header_columns(places, folder), "headed-test")
    whole = media.media_features(headed, folder).select("digest", "width", "height", "depth").collect()
    assert sorted(map(tuple, media.header_columns(places, folder).select("digest", "width", "height", "depth").collect())) == sorted(map(tuple, whole))
    index = sorted((r.asDict() for r in places.collect()), key=lambda r: (r["file"], r["offset"]))
    read = []

    class Counted:
        def __init__(self, file):
            self.file, self.close = file, file.close

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            return Counted(self.system.open_input_file(path))

    class Fs:
        @staticmethod
        def from_uri(uri):
            system, path = fs.FileSystem.from_uri(uri)
            return System(system), path

    monkeypatch.setattr(blobs, "fs", type("F", (), {"FileSystem": Fs}))
    assert len(list(blobs.read_ranges(folder, [r | {"__head": 33} for r in index], length="__head", gap=media.HEADER_GAP))) == len(index)
    assert sum(read) < 0.2 * sum(r["length"] for r in index)


def test_reads_are_dealt_by_bytes(spark):
    index = spark.createDataFrame([("f", i * 1000, 1000) for i in range(100)], "file string, offset long, length long")
    assert blobs.striped(index, 10_000).rdd.getNumPartitions() == 10


def test_png_is_lossless():
    for data in (b" " * 192, bytes(range(192)) * 5):
        image = media.png(data)
        assert media.png_samples(image) == data and media.png_header(image) == (192, len(data) // 192, 8)


def test_exact_dedup(spark):
    rows = awkward()
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    found = exact_dedup.exact_dedup(with_clashes(frame(spark, rows))).collect()
    want = Counter()
    for r in rows:
        members = sorted(groups[strip(r[1])], key=lambda m: m[:3])
        less, _, _, keep = members[0]
        want[r[0], keep, len(members), r[0] == keep and -less == len(r[1] or ""), hashlib.sha256(strip(r[1]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want
    left = exact_dedup.drop_exact_duplicates(with_clashes(frame(spark, rows)))
    assert left.count() == len(groups) and len({strip(r["text"]) for r in left.collect()}) == len(groups)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


CHAT = "conv_id long, turn long, role string, text string"


def talk(conv, *texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def test_chat(spark):
    rows = talk(1, "hi", "yo") + talk(2, "hi", "yo", "more") + talk(3, "hi", "other") + talk(4, "hi", "yo", "more") + talk(5, None, "<|end|>") + talk(6, "") + talk(7, None)
    rows += [rows[0], (None, 0, None, "x")]
    found = chat.chat_texts(spark.createDataFrame(rows, CHAT).repartition(3))
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["part"], r["text"]) for r in found.collect()}
    assert set(got) == {2, 3, 5, 6, None}
    assert got[2] == (3, 2, 0, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user|>\nmore\n<|end|>\n")
    assert got[5][3] == "<|user|>\n\n<|end|>\n<|assistant|>\n< |end|>\n<|end|>\n"
    assert got[None][3].startswith("<|unknown|>")
    assert chat.chat_texts(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_ties_nulls_and_clashes(spark):
    """Turns of one number go by MD5 as in the SQL; null, empty and "\\x00" texts differ; other columns do not matter."""
    rows = [(1, 0, "user", t) for t in ("b", "a", None, "", "\x00")] + [(2, None, None, "x"), (2, None, "", "x"), (2, 5, "user", "w " * 70000)]
    turns = spark.createDataFrame(rows, CHAT)
    key = lambda role, text: hashlib.md5(f"{str(text is None).lower()}:{-1 if role is None else len(role)}:{role or ''}:{text or ''}".encode()).hexdigest()
    line = lambda role, text: f"<|{'unknown' if role is None else role}|>\n{text or ''}\n<|end|>\n"
    want = {}
    for conv in (1, 2):
        said = sorted(((t is not None, t or 0, key(r, x), r, x) for c, t, r, x in rows if c == conv), key=lambda s: s[:3])
        want[conv] = "".join(line(r, x) for *_, r, x in said)
    found = chat.chat_texts(with_clashes(turns).withColumn("position", turns["turn"]).withColumn("h", turns["text"]).repartition(3))
    assert {r["conv_id"]: r["text"] for r in found.collect()} == want


def test_warc_ignores_other_columns(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    clash = with_clashes(pages).withColumns({c: pages["url"] for c in ("sha", "digest", "payload", "record_type", "refers_to", "length", "stripe")})
    one, two = (Counter(map(tuple, warc.warc_round_trip(df).collect())) for df in (pages, clash))
    assert one == two


def test_mix_meets_its_targets(spark):
    """Words of the mixed documents by source against the targets: whole documents come within 5 %."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {r["source"]: r["target"] for r in mixing.source_targets(mixing.measured(docs, "mix")).collect()}
    taken = defaultdict(int)
    for r in mixing.mixed_documents(docs).select("source", "text").collect():
        taken[r["source"]] += len(words(r["text"]))
    for source, want in target.items():
        assert taken[source] == pytest.approx(want, rel=0.05), source


def test_chat_in_parts(spark):
    long = talk(1, *map(str, range(25)))
    rows = long + talk(2, *map(str, range(11)))
    found = chat.chat_texts(spark.createDataFrame(rows, CHAT), part=4).orderBy("part").collect()
    assert [r["conv_id"] for r in found] == [1] * 7
    whole = chat.chat_texts(spark.createDataFrame(long, CHAT)).first()["text"]
    assert "".join(r["text"] for r in found) == whole


def test_media_takes_headers_from_their_own_reads(spark, monkeypatch):
    """The query's metadata columns are those of the header reads, which the content pass holds against the images."""
    docs = frame(spark, [(1, "a", "en", "a", 1), (2, "b" * 500, "en", "a", 500)])
    true, asked = media.header_columns, []

    def headers(index, folder):
        asked.append(index.columns)
        return true(index, folder)

    monkeypatch.setattr(media, "header_columns", headers)
    assert sorted((r["width"], r["height"], r["depth"]) for r in media.media_round_trip(docs).collect()) == [(192, 1, 8), (192, 3, 8)]
    assert asked
    monkeypatch.setattr(media, "header_columns", lambda index, folder: true(index, folder).withColumn("depth", F.lit(7)))
    with pytest.raises(Exception, match="header"):
        media.media_round_trip(docs).collect()


def test_header_reads_fetch_headers_alone(spark, tmp_path):
    """With everything but the headers of the shards overwritten, the header columns are the same."""
    folder = fresh_dir(spark, "media")
    docs = frame(spark, [(i, f"{i} " * 3000, "en", "a", 1) for i in range(12)])
    index = media.places(media.store_media(docs, folder))
    want = sorted(map(tuple, media.header_columns(index, folder).collect()))
    path = folder.removeprefix("file://")
    for name in {r["file"] for r in index.collect()}:
        rows = [r for r in index.collect() if r["file"] == name]
        with open(f"{path}/{name}", "r+b") as shard:
            data = bytearray(len(shard.read()))
            for r in rows:
                shard.seek(r["offset"])
                data[r["offset"] : r["offset"] + media.HEADER] = shard.read(media.HEADER)
            shard.seek(0)
            shard.write(data)
    assert sorted(map(tuple, media.header_columns(index, folder).collect())) == want


def test_mixing_spreads_rows_without_ids(spark):
    """Rows without an id, and of one id, lie all over their source's stream; equal rows are placed one after the other."""
    rows = [(None, f"text {i}", "en", "a", 1) for i in range(400)] + [(7, f"t {i}", "en", "a", 1) for i in range(400)] + [(8, "same row", "en", "a", 1)] * 50
    docs = frame(spark, rows)
    keys = mixing.measured(docs, "mix").collect()
    assert len({r["key"] for r in keys}) == 801 and max(Counter(r["key"][:1] for r in keys).values()) < 120
    found = mixing.words_taken(docs).collect()
    assert len(found) == 850 and sum(r["taken"] for r in found) == 850 * 3
    assert Counter(r["text"] for r in mixing.mixed_documents(docs).collect())["same row"] in (50, 100)


def test_mixed_documents_plays_each_text_by_its_own_slots(spark):
    """Texts of one id and size are not mixed up: what is played follows their own places."""
    rows = [(1, f"a{i} b c d", "en", "a", 1) for i in range(30)] + [(2, "x " * 5, "en", "b", 1)]
    docs = frame(spark, rows)
    made = mixing.mix(docs)
    out = Counter(r["text"] for r in mixing.mixed_documents(docs).collect() if r["source"] == "a")
    target = next(r["target"] for r in made.documents.collect() if r["source"] == "a")
    assert set(out.values()) <= {1, 2} and len(out) == 30 and abs(4 * sum(out.values()) - target) <= 2
