"""Small documents with every awkward case, and words as the contracts count them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those the operators use inside.
CLASH = {"size": "int", "score": "double", "fp": "long", "part": "string", "offset": "string", "kept": "string", "target": "string", "n": "int", "file": "string", "key": "string"}


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, a long text, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Élan", "the", "THE", "x,", "e=mc²", "日本", "a" * 300]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = make(70)
    rows = [(0, None, "en", None, None), (1, "", "en", "b", 0), (2, " \t\n\x0b\x0c\r ", None, "b", 7), (3, "one", "en", "a", 3), (4, "a\x00b \x85 c\xa0d", "en", "a", 9)]
    for i in range(5, n):
        kind = i % 6
        text = make(rng.randrange(1, 90))
        if kind == 0:
            text = rows[rng.randrange(3, len(rows))][1]
        elif kind == 1 and rows[-1][1]:
            text = rows[-1][1].replace(" ", "  ")
        elif kind == 2:
            text = text + "\n" + passage + " " + make(5)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None, "", "é"]), len(text or "")))
    rows.append((n, make(9000), "en", "a", 1))
    rows.append(rows[7])  # a repeated row
    rows.append((9, "another text under the same id", "en", "c", 5))
    rows.append((None, "text without an id", "en", "a", 5))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in CLASH.items()})
