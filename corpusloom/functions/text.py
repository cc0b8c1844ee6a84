"""Column functions over texts, names, dates and statuses. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import dims

_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}


#: Lower-case accented Latin letters and the letters they fold to.
FOLDED = {k: v for k, v in _ACCENTED.items() if k == k.lower()}


def unaccented(text: Column) -> Column:
    """Lower-case text without the accents of Latin letters."""
    return F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return unaccented(F.lower(text))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; an array."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def raw_tokens(text: Column) -> Column:
    """The same, in lower case only: folding them one by one, once they are rows, is cheaper."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def folded_token(token: Column) -> Column:
    """A lower-case token without accents."""
    return F.when(F.octet_length(token) > F.length(token), unaccented(token)).otherwise(token)


def query_terms(query: Column) -> Column:
    """Folded terms of a column of queries, distinct in order: runs of word characters longer than one, split at _."""
    runs = F.regexp_extract_all(folded(query), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    parts = F.flatten(F.transform(F.filter(runs, lambda w: F.length(w) > 1), lambda w: F.split(w, "_")))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def stripped(text: Column) -> Column:
    """Without white space at either end, tabs and line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_status(status: Column) -> Column:
    """in_force, abrogated, the lower-cased value, or unknown for null and empty."""
    key = F.lower(stripped(status))
    named = F.when(key.isin(dims.IN_FORCE), "in_force").when(key.isin(dims.ABROGATED), "abrogated").otherwise(key)
    return F.when(F.coalesce(status, F.lit("")) == "", "unknown").otherwise(named)


def status_label(status: Column) -> Column:
    """In force, Abrogated, or the raw value."""
    known = normalized_status(status)
    raw = F.coalesce(F.nullif(status, F.lit("")), F.lit("N/A"))
    return F.when(known == "in_force", "In force").when(known == "abrogated", "Abrogated").otherwise(F.concat(F.lit("? "), raw))


def dataset_track(source: Column, status: Column) -> Column:
    """abrogato, multivigente or vigente."""
    low = F.lower(F.coalesce(source, F.lit("")))
    gone = low.contains("abrogat") | (normalized_status(status) == "abrogated")
    return F.when(gone, "abrogato").when(low.contains("multivigente"), "multivigente").otherwise("vigente")


def legislature(year: Column) -> Column:
    """Number of the parliamentary term; null outside all terms."""
    chain = reduce(lambda c, t: c.when((year >= t[1]) & (year < t[2]), t[0]), dims.LEGISLATURES[1:], F.when((year >= dims.LEGISLATURES[0][1]) & (year < dims.LEGISLATURES[0][2]), dims.LEGISLATURES[0][0]))
    return chain.when(year >= dims.OPEN_TERM[1], dims.OPEN_TERM[0])


def cabinet(year: Column) -> Column:
    """The first cabinet of the list whose years hold the year; null in gaps."""
    first, *rest = dims.CABINETS
    return reduce(lambda c, t: c.when((year >= t[1]) & (year < t[2]), t[0]), rest, F.when((year >= first[1]) & (year < first[2]), first[0]))


def era(year: Column) -> Column:
    """Historical era of a year; null for null."""
    (top, label), *rest = dims.ERAS
    chain = reduce(lambda c, t: c.when(year < t[0], t[1]), rest, F.when(year < top, label))
    return chain.when(year.isNotNull(), dims.LAST_ERA)


def year_of(date: Column) -> Column:
    """The first four characters as a year; null if they are none."""
    return F.left(date, F.lit(4)).try_cast("int")


def canonical_urn(kind: Column, number: Column, year: Column) -> Column:
    """urn:nir:stato:<type>:<year>;<number> of a citation's parts.

    Unknown types count as legge; two-digit years over 50 are of the 1900s."""
    key = F.regexp_replace(F.lower(F.trim(kind)), r"\.+$", "")
    table = F.create_map(*(F.lit(x) for pair in dims.ACT_TYPES.items() for x in pair))
    short = F.length(year) == 2
    century = F.when(year.try_cast("int") > 50, "19").otherwise("20")
    whole = F.when(short, F.concat(century, year)).otherwise(year)
    return F.concat(F.lit("urn:nir:stato:"), F.coalesce(F.try_element_at(table, key), F.lit("legge")), F.lit(":"), whole, F.lit(";"), number)


def matched(text: Column, words: list[str], whole_word: bool = False) -> Column:
    """Whether the (lower-cased) text holds one of the words, as part of a word unless whole_word."""
    if whole_word:
        import re

        return F.coalesce(text.rlike(r"(?U)\b(?:" + "|".join(map(re.escape, words)) + r")\b"), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(False))


def labels_of(text: Column, table: dict[str, list[str]], whole_word: bool = False) -> Column:
    """Labels, in the table's order, of which the text holds a word.

    The text is the one element of an array, so that it is computed once for all labels."""
    marks = lambda t: F.filter(F.array(*(F.when(matched(t, words, whole_word), F.lit(label)) for label, words in table.items())), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.array(text), marks))


#: Fixed value: a euro amount in lower-case text.
AMOUNT = r"(?:€\s*|eur\s*)(\d{1,3}(?:[\.,]\d{3})*(?:[\.,]\d{1,2})?|\d+(?:[\.,]\d{1,2})?)"


def amounts(text: Column) -> Column:
    """Euro amounts of a text. Dots are thousands marks and a comma is the decimal mark, so 12.50 reads 1250."""
    found = F.regexp_extract_all(F.lower(text), F.lit(AMOUNT), 1)
    values = F.transform(found, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))
    return F.filter(values, lambda x: x.isNotNull())


def keyword_context(text: Column, words: list[str], before: int = 80, after: int = 220, most: int = 280) -> Column:
    """The text around the first word of the list that it holds; empty if there is none."""
    low = F.lower(text)
    cases = []
    for word in words:
        at = F.instr(low, word)
        start = F.greatest(at - before, F.lit(1))
        stop = F.least(F.length(text), at - 1 + after)
        cut = F.substring(text, start, stop - start + 1)
        cases.append(F.when(at > 0, F.left(F.trim(F.replace(cut, F.lit("\n"), F.lit(" "))), F.lit(most))))
    return F.coalesce(*cases, F.lit(""))


#: What is replaced in pages, in this order, and the named characters that are decoded after it.
PAGE_STEPS = [(r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", "")]
ENTITIES = [("nbsp", " "), ("egrave", "è"), ("agrave", "à"), ("igrave", "ì"), ("ograve", "ò"), ("ugrave", "ù"), ("amp", "&"), ("lt", "<"), ("gt", ">")]


def html_to_text(html: Column) -> Column:
    """Text of a page: no scripts, styles and tags, entities decoded, blanks squeezed."""
    steps = PAGE_STEPS + [(f"&{name};", char) for name, char in ENTITIES]
    text = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, html)
    text = decoded_numbers(text)
    return stripped(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def decoded_numbers(text: Column) -> Column:
    """&#n; as the character n; numbers beyond Unicode stay as they are.

    The text is cut before each mark and the pieces are joined with their first mark decoded."""
    pieces = F.split(text, r"(?=&#\d{1,7};)")
    number = lambda p: F.regexp_extract(p, r"^&#(\d{1,7});", 1).try_cast("int")
    # a code point as UTF-32 bytes
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    fine = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.array_join(F.transform(pieces, lambda p: F.when(fine(number(p)), F.concat(char(number(p)), F.regexp_replace(p, r"^&#\d{1,7};", ""))).otherwise(p)), "")


def blunt_text(html: Column, most: int = 50000) -> Column:
    """Tags become blanks, white space is squeezed, and the text is cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")), F.lit(most))
