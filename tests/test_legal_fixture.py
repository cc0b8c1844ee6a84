"""Hand-written legal records with exact expected values."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import amendments, changes, graph, mining, reports
from corpusloom.sources import files


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


REFS = [
    ("a", "articolo 5 della legge 290/2006"),
    ("b", "legge n. 77/85"),
    ("c", "d.lgs. 50/2016 e ancora d.lgs. 50/2016"),
    ("d", "D.P.R. 394/1990"),
    ("e", "legge 27 dicembre 2006, n. 290"),
    ("f", "art. 3 bis del d.l. 19/2020"),
    ("g", "ordinanza 12/2001"),
    ("h", "legge 12/123"),
    ("i", "reg. (eu) 2016/679"),
    ("j", None),
]


def test_citations(spark):
    found = mining.extract_citations(spark.createDataFrame(REFS, "urn string, text string"))
    urn = "urn:nir:stato:"
    assert rows(found, "citing_urn", "target_urn", "article", "pass") == sorted(
        [
            ("a", urn + "legge:2006;290", "5", 1),
            ("a", urn + "legge:2006;290", None, 2),
            ("b", urn + "legge:1985;77", None, 2),
            ("c", urn + "decreto.legislativo:2016;50", None, 2),
            ("d", urn + "decreto.del.presidente.della.repubblica:1990;394", None, 2),
            ("e", urn + "legge:2006;290", None, 3),
            ("f", urn + "decreto.legge:2020;19", "3 bis", 1),
            ("f", urn + "decreto.legge:2020;19", None, 2),
            ("h", urn + "legge:123;12", None, 2),
        ],
        key=repr,
    )
    ref = {r["citing_urn"]: r["ref"] for r in found.filter("pass = 3").collect()}
    assert ref == {"e": "legge 27 dicembre 2006, n. 290"}


def test_typed_and_raw_citations(spark):
    laws = spark.createDataFrame(
        [("a", "vedi art. 3 della Costituzione e legge 112/2018", None), ("b", "Codice civile art. 123", ""), ("c", "Reg. (EU) 2016/679", None), ("d", "D.Lgs 5/2021", "d.l. 7/2020")],
        "urn string, text string, title string",
    )
    assert rows(mining.extract_typed_citations(laws)) == sorted(
        [("a", "112-2018", "legge"), ("a", "COST-3", "cost"), ("b", "CODICE CIVILE ART. 1-123", "codice"), ("d", "5-2021", "dlgs"), ("d", "7-2020", "legge")], key=repr
    )
    raw = {r["urn"]: (r["cited"], r["raw"]) for r in mining.extract_raw_citations(laws).collect()}
    assert raw == {"a": (["112/2018"], ["legge 112/2018"]), "d": (["5/2021", "7/2020"], ["d.l. 7/2020", "d.lgs 5/2021"])}


def test_inline_urns(spark):
    laws = spark.createDataFrame(
        [("urn:nir:stato:legge:1985;77", "T" * 100, "see urn:nir:stato:legge:2000;1 and urn:nir:stato:legge:1985;77 and urn:nir:stato:legge:2000;1"), ("urn:nir:stato:legge:2000;1", "short", None)],
        "urn string, title string, text string",
    )
    assert rows(mining.urn_references(laws), "pos", "ref", "ref_title") == [(0, "urn:nir:stato:legge:2000;1", "short"), (1, "urn:nir:stato:legge:1985;77", "T" * 60)]


def test_amounts(spark):
    laws = spark.createDataFrame([("a", "€ 1.234,56"), ("b", "eur 100"), ("c", "€12.50"), ("d", "€ 1.000.000"), ("e", "nothing"), ("f", None)], "urn string, text string")
    assert rows(mining.extract_amounts(laws), "urn", "n_amounts", "max_amount") == [("a", 1, 1234.56), ("b", 1, 100.0), ("c", 1, 1250.0), ("d", 1, 1000000.0), ("e", 0, None), ("f", 0, None)]


def test_periods(spark):
    years = [1947, 1948, 1953, 1960, 1987, 1988, 2012, 2023, 2024, 2027, None]
    found = {r["year"]: (r["legislature"], r["government"], r["era"]) for r in mining.with_periods(spark.createDataFrame([(y,) for y in years], "year int")).collect()}
    assert found[1947] == (None, None, "Early Republic (1948-1960)")
    assert found[1948] == (1, "De Gasperi", "Early Republic (1948-1960)")
    assert found[1953][:2] == (2, "Pella")
    assert found[1960] == (3, "Fanfani III", "First Republic I (1960-1980)")
    assert found[1987][:2] == (10, None)
    assert found[1988][:2] == (10, None)
    assert found[2012][:2] == (16, None)
    assert found[2023][:2] == (19, "Meloni")
    assert found[2024][:2] == (19, None)
    assert found[2027][:2] == (20, None)
    assert found[None] == (None, None, None)


def test_statuses(spark):
    df = spark.createDataFrame([(" Vigente\n",), ("A",), ("repealed",), ("boh",), ("",), (None,)], "status string")
    assert [r[0] for r in df.select(fx.normalized_status(F.col("status"))).collect()] == ["in_force", "abrogated", "abrogated", "boh", "unknown", "unknown"]
    assert [r[0] for r in df.select(fx.status_label(F.col("status"))).collect()] == ["In force", "Abrogated", "Abrogated", "? boh", "? N/A", "? N/A"]


def test_urn_parts(spark):
    df = spark.createDataFrame([("urn:nir:stato:legge:1985-03-07;77",), ("urn:nir:stato:legge:x",), ("other",), (None,)], "urn string")
    found = {r["urn"]: (r["valid_urn"], r["law_type"], r["year"], r["number"], r["legislature"]) for r in mining.parse_urn(df).collect()}
    assert found["urn:nir:stato:legge:1985-03-07;77"] == (True, "legge", 1985, "77", 9)
    assert found["other"] == (False, None, None, None, None)
    assert found[None][0] is False
    lines = {r["urn"]: r["line"] for r in mining.format_metadata(mining.parse_urn(df)).collect()}
    assert lines["other"] == "Invalid URN"
    assert lines["urn:nir:stato:legge:1985-03-07;77"] == "Year: 1985 | Type: legge | Legislature: 9 | Government: Fanfani IV | Era: First Republic II (1980-2000)"


def test_resolution(spark):
    laws = spark.createDataFrame([("urn:nir:stato:legge:1985-03-07;77",), ("urn:nir:stato:legge:1985-04-07;77",), ("urn:x",)], "urn string")
    cit = spark.createDataFrame(
        [("p", "urn:nir:stato:legge:1985;77"), ("q", "urn:nir:stato:legge:1985;77"), ("q", "urn:nir:stato:legge:1985-03-07;77"), ("r", "urn:nir:stato:decreto:1985;77"), ("s", "urn:noend")], "citing_urn string, cited_urn string"
    )
    found = graph.resolve(cit, laws)
    assert rows(found) == [("p", "urn:nir:stato:legge:1985-03-07;77", True), ("q", "urn:nir:stato:legge:1985-03-07;77", True), ("r", "urn:nir:stato:decreto:1985;77", False), ("s", "urn:noend", False)]
    assert rows(graph.resolve_stats(found)) == [(4, 2, 2)]


def test_chains(spark):
    laws = spark.createDataFrame(
        [("n1", ["o1", "o2"], "2001-01-01", "legge", "T1"), ("n2", ["o1"], None, "legge", "T2"), ("n3", None, "1999-01-01", "legge", "T3"), ("o1", [], "1990-01-01", "legge", "O")],
        "urn string, modifies array<string>, date string, type string, title string",
    )
    chains = {r["original"]: [(x["date"], x["law_id"]) for x in r["chain"]] for r in amendments.amendment_chains(laws).collect()}
    assert chains == {"o1": [(None, "n2"), ("2001-01-01", "n1")], "o2": [("2001-01-01", "n1")]}
    stats = amendments.chain_stats(amendments.amendment_chains(laws)).first()
    assert (stats["acts_amended"], stats["amendments"], stats["mean_length"]) == (2, 3, 1.5)


def test_jsonl_scan(spark, tmp_path):
    lines = [
        json.dumps({"urn": "u1", "title": "A", "type": "legge", "date": "2006-12-27", "year": "2006", "text": "x", "citations": [{"target_urn": "u2", "ref": "r", "article": "5"}]}),
        "",
        "{broken",
        json.dumps({"id": "u2", "titolo": "B", "year": 1999, "testo": "y", "citations": ["u1", "u3"], "modifies": ["u1"]}),
        json.dumps({"urn": None, "title": "C", "citations": [{"cited_urn": "u9"}], "modifies": "u2"}),
    ]
    (tmp_path / "acts.jsonl").write_text("\n".join(lines))
    laws, bad = files.read_laws(spark, str(tmp_path))
    assert bad.first()[0] == 1
    found = {r["title"]: r for r in laws.collect()}
    assert {t: (r["urn"], r["year"], r["text"]) for t, r in found.items()} == {"A": ("u1", 2006, "x"), "B": ("u2", 1999, "y"), "C": (None, None, None)}
    assert found["B"]["modifies"] == ["u1"] and found["C"]["modifies"] == ["u2"]
    edges = graph.build_edges(laws)
    assert rows(edges, "citing_urn", "cited_urn", "context") == [("u1", "u2", "art. 5 | r"), ("u2", "u1", None), ("u2", "u3", None)]
    assert rows(changes.dedupe_counts(laws)) == [(2, 0, 1)]


AKN = 'xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0" xmlns:nrdfa="http://example.org/rdfa/"'


def akn(urn, title="Title ", kind="http://x#legge", date="2001-02-03", body=None):
    alias = f'<FRBRalias name="urn:nir" value="{urn}"/>' if urn else ""
    body = body or (
        '<part><article eId="a1"><heading>Art. 1</heading><p> one <b>two</b> </p></article></part><article eId="a2"><p>three</p></article>'
    )
    return (
        f"<akomaNtoso {AKN}><act><meta><identification>{alias}<FRBRdate date=\"{date}\"/><nrdfa:span property=\"eli:title\" content=\"{title}\"/>"
        f'<nrdfa:span property="eli:type_document" resource="{kind}"/></identification></meta><body>{body}</body></act></akomaNtoso>'
    )


def test_zip_of_xml(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "acts.zip", "w") as z:
        z.writestr("1.xml", akn("urn:nir:stato:legge:2001-02-03;1"))
        z.writestr("2.xml", f"<akomaNtoso {AKN}><doc/></akomaNtoso>")
        z.writestr("3.xml", akn("", kind="plain"))
        z.writestr("4.xml", "<not closed")
        z.writestr("readme.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    entries = files.read_zip_entries(spark, str(tmp_path))
    assert entries.count() == 4
    acts = files.parse_akn(entries)
    found = {r["entry"]: r for r in acts.collect()}
    assert set(found) == {"1.xml", "3.xml"}
    one = found["1.xml"]
    assert (one["urn"], one["title"], one["date"], one["type"], one["year"]) == ("urn:nir:stato:legge:2001-02-03;1", "Title", "2001-02-03", "legge", 2001)
    assert one["text"] == "Art. 1one twothree" and one["article_count"] == 2
    assert found["3.xml"]["urn"] is None and found["3.xml"]["type"] == "plain"
    arts = files.explode_articles(acts.filter("entry = '1.xml'"))
    assert rows(arts, "pos", "num", "eId") == [(0, "Art. 1", "a1"), (1, "a2", "a2")]
    gone = files.parse_akn(entries, variant="abrogated", most=5).collect()
    assert [(r["status"], r["text"], r["text_length"] > 5, r["year"]) for r in gone] == [("abrogated", "Art. ", True, 2001)]


def test_xml_directory_and_feed(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "a.xml").write_text('<a eid="it/legge/2018/112" date="2018-01-01"/>')
    xml = files.read_xml_dir(spark, str(tmp_path / "x"))
    ids = mining.scrape_akn_id(xml.select("file", "size_bytes", "sha256", "xml")).first()
    assert (ids["file"], ids["law_id"], ids["akn_uri"], ids["size_bytes"]) == ("a.xml", "2018-112", "it/legge/2018/112", 46)
    assert rows(mining.extract_dates(xml.select("file", "xml"))) == [("a.xml", "2018-01-01")]
    (tmp_path / "feed.xml").write_text(f"<rss><channel><item><title>A</title><pubDate>d</pubDate><link>l</link></item><item><title>B</title><description>{'z' * 300}</description></item></channel></rss>")
    assert rows(files.read_feed(spark, str(tmp_path / "feed.xml")), "title", "link", "description") == [("A", "l", ""), ("B", None, "z" * 240)]


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        json.dumps(
            [
                {"nomeCollezione": "Codici", "formatoCollezione": "O", "numeroAtti": 3},
                {"nomeCollezione": "Codici", "formatoCollezione": "V", "numeroAtti": 3, "dataCreazione": "2024-01-02"},
                {"nomeCollezione": "Codici", "formatoCollezione": "M", "numeroAtti": 9, "dataCreazione": "2024-01-03"},
                {"nome": "Solo", "formato": "O", "numeroAtti": 1},
                {"nomeCollezione": "Atti abrogati", "formatoCollezione": "O", "numeroAtti": 7},
            ]
        )
    )
    cat = files.read_catalogue(spark, str(tmp_path / "c.json"))
    assert rows(reports.catalogue_tracks(cat)) == [("abrogato", 7, None), ("multivigente", 9, "2024-01-03"), ("vigente", 3, "2024-01-02")]
    matrix = {r["collection"]: (r["has_o"], r["has_v"], r["has_m"], r["acts"], r["all_three"]) for r in reports.variant_matrix(cat).collect()}
    assert matrix == {"Codici": (True, True, True, 15, True), "Solo": (True, False, False, 1, False), "Atti abrogati": (True, False, False, 7, False)}


def test_tags(spark):
    old = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("nulled", "1")], "collection string, tag string")
    new = spark.createDataFrame([("same", "1"), ("changed", "2"), ("fresh", "1"), ("nulled", None)], "collection string, tag string")
    assert rows(changes.tag_diff(old, new)) == [("changed", "2", "1", False), ("fresh", "1", None, True)]


def test_html(spark):
    page = (
        '<html><style>x</style><script>var a="</p>";</script><h2 class="preamble-title-akn">Pre &egrave;</h2><div class="bodyTesto"><h2 class="article-num-akn">Art. 1</h2>one&nbsp;<br>two &#8217;&#65;\n\n\n\nx</div>\n<div class="d-flex">no</div></html>'
    )
    other = '<h2 class="article-num-akn">Art. 2</h2><span class="art-just-text-akn">plain</span>'
    pages = spark.createDataFrame([(1, page), (2, other), (3, "")], "page_id long, html string")
    found = {r["page_id"]: r["fragment"] for r in mining.extract_fragment(pages).collect()}
    assert found == {1: "Pre è\nArt. 1\none \ntwo ’A\n\nx", 2: "Art. 2\nplain", 3: ""}
    text = pages.select(fx.html_to_text(F.lit("a&#0;&#55296;&#128512;b"))).first()[0]
    assert text == "a&#0;&#55296;😀b"


def test_domains_and_labels(spark):
    laws = spark.createDataFrame([("a", "Legge privata", "l'imposta sul valore aggiunto e il reato"), ("b", None, "niente")], "urn string, title string, text string")
    found = {r["urn"]: (r["domain_cluster"], r["keywords"]) for r in mining.detect_domains(laws).collect()}
    assert found == {"a": ("diritto_penale", ["diritto_penale", "diritto_tributario"])}
    assert rows(mining.tag_labels(laws)) == [("a", "IVA")]
    assert rows(mining.tag_labels(spark.createDataFrame([("c", "privata")], "urn string, text string"))) == [("c", "IVA")]
    assert rows(mining.tag_labels(spark.createDataFrame([("c", "privata")], "urn string, text string"), whole_word=True)) == []


def test_versions(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "urn string, n int")
    files.promote(old, str(tmp_path), "20240101000000-x")
    assert rows(files.current(spark, str(tmp_path))) == [("a", 1)]
    files.promote(spark.createDataFrame([("a", 2)], "urn string, n int"), str(tmp_path), "20240102000000-y")
    assert rows(files.current(spark, str(tmp_path))) == [("a", 2)] and len(list((tmp_path / "CURRENT").glob("part-*"))) == 2
    log = spark.createDataFrame([("c", None, "n1", dt.datetime(2024, 1, 1))], "collection string, old_etag string, new_etag string, detected_at timestamp")
    assert changes.record_changes(log, log).count() == 0
