"""Text mining: citations, domains, labels, amounts, row enrichment."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dims
from corpusloom.functions import text as fx

#: The forms in which acts cite acts.
ARTICLE_OF_ACT = (
    r"(?:articol[oi]|art\.?)\s+(\d+(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies))?)\s+(?:della|del|di|dei|dello)\s+"
    r"(legge|decreto|decr\.?|d\.lgs\.?|d\.l\.?|d\.p\.r\.?|d\.p\.c\.m\.?|d\.m\.?|r\.d\.?|l\.cost\.?)\s+(\d{1,5})\s*/\s*(\d{2,4})"
)
ACT = r"\b(legge|decreto|decr\.?|d\.lgs\.?|d\.l\.?|d\.p\.r\.?|d\.p\.c\.m\.?|d\.m\.?|r\.d\.?|l\.cost\.?)\s+(?:n\.?\s*)?(\d{1,5})\s*/\s*(\d{2,4})\b"
ACT_OF_DATE = r"\b(legge|decreto|d\.lgs\.?|d\.l\.?|d\.p\.r\.?)\s+(\d{1,2})\s+(" + "|".join(dims.MONTHS) + r")\s+(\d{4})\s*,?\s*n\.?\s*(\d{1,5})\b"

#: Typed forms on lower-cased text, with the kind they show.
TYPED = [
    (r"(?:l\.?|legge)\s*(?:n\.?|numero)?\s*(\d+)\s*(?:/|del)\s*(\d{4})", "legge"),
    (r"(?:d\.?\s*lgs\.?|decreto\s*legislativo)\s*(?:n\.?|numero)?\s*(\d+)\s*(?:/|del)\s*(\d{4})", "dlgs"),
    (r"(?:dpr|decreto\s*presidentziale)\s*(?:n\.?|numero)?\s*(\d+)\s*(?:/|del)\s*(\d{4})", "dpr"),
    (r"(?:art|articolo|artt|articoli)\.?\s*([ivxIVX]+|(?:[0-9]+[a-z]?))(?:\s*(?:della|della|e\s+seguenti|ss\.?))?\s*(?:della\s*)?(?:cost\.?|costituzione)", "cost"),
    (r"(?:codice\s+(?:civile|penale|procedura|procedura\s+civile|procedura\s+penale|commercio|della\s+navigazione))\s*(?:art|articolo)?\.?\s*([0-9]+)", "codice"),
]

#: Raw forms on lower-cased text.
RAW = [
    r"articolo\s+(\d+)\s+(?:della|del|d[ei]lla)\s+(?:legge|decreto|d\.lgs|d\.l\.)\s+(\d+/\d+)",
    r"art\.\s+(\d+)\s+(?:L\.|D\.L\.)\s+(\d+/\d+)",
    r"(?:legge|decreto|d\.lgs)\s+(\d+/\d+)",
    r"d\.lgs\.?\s+(\d+/\d+)",
    r"d\.l\.?\s+(\d+/\d+)",
]


def _matches(*scans: tuple[Column, str]) -> Column:
    """All matches of (text, pattern) pairs as one array of (n, pos, ref), n from 1 by pair: the rows are read once."""

    def tagged(n: int, text: Column, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), 0)
        return F.transform(found, lambda ref, pos: F.struct(F.lit(n).alias("n"), pos.alias("pos"), ref.alias("ref")))

    return F.concat(*(tagged(n, *scan) for n, scan in enumerate(scans, 1)))


def _group(pattern: str, n: int) -> Column:
    return F.regexp_extract("ref", "(?iU)" + pattern, n)


def _by_pattern(choices: list[Column]) -> Column:
    """The choice of the pattern that found the row."""
    first, *rest = choices
    return reduce(lambda c, x: c.when(F.col("n") == x[0], x[1]), enumerate(rest, 2), F.when(F.col("n") == 1, first))


def extract_citations(laws: DataFrame, text: str = "text") -> DataFrame:
    """Citations of acts: citing_urn, target_urn, ref, article, pass, pos.

    Pass 1 finds articles of acts, pass 2 acts by number, pass 3 acts by date, in one scan of the texts. The first of
    equal (target, article) stays, in order of pass and position."""
    none = F.lit(None).cast("string")
    forms = ((ARTICLE_OF_ACT, 1, 2, 3, 4), (ACT, 0, 1, 2, 3), (ACT_OF_DATE, 0, 1, 5, 4))
    src = laws.select(F.col("urn").alias("citing_urn"), F.explode(_matches(*((F.coalesce(text, F.lit("")), f[0]) for f in forms))).alias("m")).select("citing_urn", "m.*")
    target = _by_pattern([fx.canonical_urn(_group(p, kind), _group(p, number), _group(p, year)) for p, _, kind, number, year in forms])
    article = _by_pattern([F.trim(_group(p, of)) if of else none for p, of, *_ in forms])
    rows = src.select("citing_urn", target.alias("target_urn"), F.trim("ref").alias("ref"), article.alias("article"), F.col("n").alias("pass"), "pos")
    first = Window.partitionBy("citing_urn", "target_urn", "article").orderBy("pass", "pos")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def extract_typed_citations(laws: DataFrame) -> DataFrame:
    """Distinct (urn, cite_id, kind): number-year, COST-article, or CODE-article; one scan of the texts."""
    text = F.lower(F.concat_ws(" ", "text", "title"))
    rows = laws.select("urn", F.explode(_matches(*((text, p) for p, _ in TYPED))).alias("m")).select("urn", "m.*")
    forms = {
        "cost": lambda p: F.concat(F.lit("COST-"), _group(p, 1)),
        "codice": lambda p: F.concat(F.left(F.upper("ref"), F.lit(20)), F.lit("-"), _group(p, 1)),
    }
    number = lambda p: F.concat(_group(p, 1), F.lit("-"), _group(p, 2))
    cite = _by_pattern([forms.get(kind, number)(p) for p, kind in TYPED])
    return rows.select("urn", cite.alias("cite_id"), F.element_at(F.array(*(F.lit(kind) for _, kind in TYPED)), F.col("n")).alias("kind")).distinct()


def extract_raw_citations(laws: DataFrame) -> DataFrame:
    """urn, cited (distinct normalised n/yyyy, sorted) and raw (every form found, sorted); one scan of the texts."""
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("text", "title")]
    rows = laws.select("urn", F.explode(_matches(*((text, p) for p in RAW for text in texts))).alias("m"))
    rows = rows.select("urn", "m.ref").withColumn("id", F.regexp_extract("ref", r"(\d+/\d+)", 1))
    return rows.groupBy("urn").agg(F.sort_array(F.collect_set("id")).alias("cited"), F.sort_array(F.collect_set("ref")).alias("raw"))


def urn_references(laws: DataFrame, k: int = 30, pattern: str = r"urn:nir:[\w.:;\-]+") -> DataFrame:
    """Inline URNs of each act in first-seen order, at most k, with the title (60 characters) of those known."""
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("(" + pattern + ")"), 1)), 1, k)
    rows = laws.select("urn", F.posexplode(found).alias("pos", "ref"))
    titles = laws.select(F.col("urn").alias("ref"), F.left("title", F.lit(60)).alias("ref_title"))
    return rows.join(titles, "ref").select("urn", "pos", "ref", "ref_title")


def detect_domains(laws: DataFrame, table: dict[str, list[str]] | None = None, most_chars: int = 2000, whole_word: bool = False) -> DataFrame:
    """Acts with a domain: urn, domain_cluster (first), tags (first five), keywords (all)."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.left(F.coalesce("text", F.lit("")), F.lit(most_chars))))
    # exploded from an array of one, so that the filter reads the labels instead of finding them again
    rows = laws.select("urn", F.explode(F.array(fx.labels_of(text, table or dims.DOMAINS, whole_word))).alias("keywords")).filter(F.size("keywords") > 0)
    return rows.select("urn", F.element_at("keywords", 1).alias("domain_cluster"), F.slice("keywords", 1, 5).alias("tags"), "keywords")


def tag_labels(laws: DataFrame, table: dict[str, list[str]] | None = None, whole_word: bool = False) -> DataFrame:
    """One row per act and label whose words its text holds."""
    labels = fx.labels_of(F.lower(F.coalesce("text", F.lit(""))), table or dims.TAXES, whole_word)
    return laws.select("urn", F.explode(labels).alias("label"))


def extract_amounts(laws: DataFrame) -> DataFrame:
    """urn, number and largest of the euro amounts, and the amounts."""
    return laws.select("urn", fx.amounts(F.coalesce("text", F.lit(""))).alias("amounts")).select(
        "urn", F.size("amounts").cast("long").alias("n_amounts"), F.array_max("amounts").alias("max_amount"), "amounts"
    )


def keyword_context(laws: DataFrame, words: list[str]) -> DataFrame:
    return laws.select("urn", fx.keyword_context(F.coalesce("text", F.lit("")), words).alias("context"))


def fiscal_registry(laws: DataFrame, table: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per act (labels, amounts) and per act and label (context, amounts) of the acts with a label."""
    table = table or dims.TAXES
    text = F.coalesce("text", F.lit(""))
    rows = laws.select("urn", "title", "year", fx.normalized_status(F.col("status")).alias("status"), text.alias("text"), fx.labels_of(F.lower(text), table).alias("labels"))
    rows = rows.filter(F.size("labels") > 0).withColumn("amounts", fx.amounts(F.col("text")))
    numbers = [F.size("amounts").cast("long").alias("n_amounts"), F.array_max("amounts").alias("max_amount")]
    per_law = rows.select("urn", "title", "year", "status", "labels", *numbers)
    context = F.lit("")
    for label, words in table.items():
        context = F.when(F.col("label") == label, fx.keyword_context(F.col("text"), words)).otherwise(context)
    per_label = rows.withColumn("label", F.explode("labels")).select("urn", "title", "year", "status", "label", context.alias("context"), *numbers)
    return per_law, per_label


def top_terms(laws: DataFrame, k: int = 500, most_titles: int | None = None) -> DataFrame:
    """Words of over three characters in titles; with most_titles, of the first acts by urn."""
    rows = laws.orderBy("urn").limit(most_titles) if most_titles else laws
    words = rows.select(F.explode(F.split(F.lower("title"), r"\s+")).alias("term")).filter(F.length("term") > 3)
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def enrich_rows(laws: DataFrame) -> DataFrame:
    """text_length and year from text and date."""
    return laws.withColumns({"text_length": F.length(F.coalesce("text", F.lit(""))).cast("long"), "year": fx.year_of(F.col("date"))})


def with_periods(df: DataFrame, year: str = "year") -> DataFrame:
    """legislature, government and era of the year."""
    y = F.col(year)
    return df.withColumns({"legislature": fx.legislature(y), "government": fx.cabinet(y), "era": fx.era(y)})


def parse_urn(df: DataFrame) -> DataFrame:
    """urn, valid_urn, law_type, year, number, legislature, government, era of nir URNs."""
    tail = F.split_part("urn", F.lit(":"), F.lit(5))
    year = F.left(F.split_part(tail, F.lit(";"), F.lit(1)), F.lit(4)).try_cast("int")
    rows = df.select("urn", F.nullif(F.split_part("urn", F.lit(":"), F.lit(4)), F.lit("")).alias("law_type"), year.alias("year"), F.nullif(F.split_part(tail, F.lit(";"), F.lit(2)), F.lit("")).alias("number"))
    valid = F.coalesce(F.col("urn").startswith("urn:nir:") & F.col("year").isNotNull(), F.lit(False))
    rows = with_periods(rows.withColumn("valid_urn", valid))
    return rows.select("urn", "valid_urn", *(F.when(F.col("valid_urn"), F.col(c)).alias(c) for c in ("law_type", "year", "number", "legislature", "government", "era")))


def format_metadata(parsed: DataFrame) -> DataFrame:
    """One line per URN; absent parts are left out."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name + ": "), F.col(c).cast("string")))
    line = F.concat_ws(" | ", part("Year", "year"), part("Type", "law_type"), part("Legislature", "legislature"), part("Government", "government"), part("Era", "era"))
    return parsed.select("urn", F.when(F.col("valid_urn"), line).otherwise("Invalid URN").alias("line"))


def extract_links(pages: DataFrame, key: str = r"^[^#?]*") -> DataFrame:
    """Links of each page in first-seen order, one per key (the part of the address that the pattern finds)."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"']"), 1)
    rows = pages.select("page_id", F.posexplode(links).alias("pos", "href")).withColumn("key", F.regexp_extract("href", key, 0))
    return rows.groupBy("page_id", "key").agg(F.min("pos").alias("pos"), F.min_by("href", "pos").alias("href"))


#: How article pages mark their headings, body and plain text.
HEADING = r'(?is)<h2[^>]*class="{name}"[^>]*>(.*?)</h2>'
BODY = r'(?is)<div[^>]*class="bodyTesto"[^>]*>(.*?)(?:</div>\s*<div[^>]*class="d-flex)'
BODY_HEADING = r'(?is)<h2[^>]*class="(?:article-num|preamble)[^"]*"[^>]*>.*?</h2>'
PLAIN = r'(?is)<span[^>]*class="art-just-text-akn"[^>]*>(.*?)</span>'


def extract_fragment(pages: DataFrame) -> DataFrame:
    """Preamble, number and body of an article page, present parts on lines of their own."""
    head = lambda name: F.regexp_extract("html", HEADING.format(name=name), 1)
    body = F.regexp_replace(F.regexp_extract("html", BODY, 1), BODY_HEADING, "")
    text = F.when(F.col("html").rlike(BODY), body).otherwise(F.regexp_extract("html", PLAIN, 1))
    parts = [fx.html_to_text(c) for c in (head("preamble-title-akn"), head("article-num-akn"), text)]
    return pages.select("page_id", F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts)).alias("fragment"))


def assemble_document(fragments: DataFrame) -> DataFrame:
    """doc, text (fragments over 5 characters in order, a blank line between) and articles (those with "Art. n")."""
    good = fragments.filter(F.length("fragment") > 5)
    parts = F.array_sort(F.collect_list(F.struct("pos", "fragment"))).alias("parts")
    rows = good.groupBy("doc").agg(parts, F.count_if(F.col("fragment").rlike(r"Art\.\s*\d+")).alias("articles"))
    return rows.select("doc", F.array_join(F.col("parts.fragment"), "\n\n").alias("text"), "articles")


#: Where XML has dates.
DATES = [r'date="(\d{4}-\d{2}-\d{2})"', r"<date[^>]*>(\d{4}-\d{2}-\d{2})<", r'anno="(\d{4})"', r'number="\d+/(\d{4})"']


def extract_dates(df: DataFrame, text: str = "xml") -> DataFrame:
    """One row per date in XML: by attribute, element, year attribute and number/year, in that order."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in DATES))
    return df.select("*", F.explode(found).alias("date")).drop(text)


def scrape_akn_id(df: DataFrame, text: str = "xml") -> DataFrame:
    """akn_uri and law_id from the first eid within 500 characters; no id for addresses of under three parts."""
    uri = F.nullif(F.regexp_extract(F.left(text, F.lit(500)), r'eid="([^"]+)"', 1), F.lit(""))
    parts = F.split("akn_uri", "/")
    law_id = F.when(F.size(parts) >= 3, F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("-"), F.try_element_at(parts, F.lit(-1))))
    return df.withColumn("akn_uri", uri).withColumn("law_id", law_id).drop(text)


def query_words(query: str) -> list[str]:
    """Terms of a query: runs of word characters of more than one."""
    return [w for w in re.sub(r"[^\w\s]", " ", query).split() if len(w) > 1]
