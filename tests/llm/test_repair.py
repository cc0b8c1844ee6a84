"""Conversation repair against a plain dynamic program, and the damage against zlib."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import repair as rp
from tests.llm.helpers import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
TEXT = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """(role, text) in order to the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        marks = TEXT.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired lines: all states after each row with the best (cost, audit, lines)."""

    def inserted(front):
        for _ in range(3):
            for (q, (cost, audit, lines)), r in itertools.product(list(front.items()), "ua"):
                to = MOVES.get((q, r))
                way = (cost + 3, audit + "I", (*lines, {"u": "user", "a": "assistant"}[r] + ":"))
                if to is not None and (to not in front or way < front[to]):
                    front[to] = way
        return front

    front = inserted({0: (0, "", ())})
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def offer(q, way, new=new):
            if q is not None and (q not in new or way < new[q]):
                new[q] = way

        more = 3 * (fault == "truncated")
        for q, (cost, audit, lines) in front.items():
            offer(q, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                offer(MOVES.get((q, role[:1])), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    offer(MOVES.get((q, r)), (cost + 3 + more, audit + "R", (*lines, f"{name}:{text}")))
        front = inserted(new)
    return min(front[q] for q in (0, 3) if q in front)


def brute(rows):
    """Results by conv_id of rows in any order."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).digest()))
        said = [t[1:] for t in turns]
        found = faults(said)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [role[:1] for role, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(said)
        out[conv] = (gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, parts=3):
    out = rp.repair(with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(parts))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    collected = [tuple(r) for r in out.collect()]
    assert len({r[0] for r in collected}) == len(collected)
    return {r[0]: r[1:] for r in collected}


def conversations(seed=1, n=120, longest=12):
    rng = random.Random(seed)
    texts = ["Fine.", "Yes!", "Why?", "cut off", "Well. ", " \t\n", "", None, "é…", "a" * 500 + "."]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "Userly", None, "", "ü"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}" + rng.choice([".", "", "?"])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), text))
    return rows + [rows[3]] * 3 + [(7, 3, "system", "x."), (7, 3, "user", "x."), (10**9, -5, "user", "only"), (10**9 + 1, None, "user", None)]


def test_against_a_plain_program(spark):
    rows = conversations()
    assert found(spark, rows) == brute(rows)


def test_long_conversations(spark, monkeypatch):
    """Segments, several partitions a conversation, and one that holds a third of all rows."""
    monkeypatch.setattr(rp, "SHORT", 20)
    rng = random.Random(4)
    rows = conversations(9, 40)
    rows += [(500, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", f"b{t}.", f"c{t}"])) for t in range(900)]
    rows += [(501, 1, "user", "same.")] * 2500 + [(501, 2, "assistant", "end.")]
    rows += [(502, None, "user", f"t{t}.") for t in range(400)]
    assert found(spark, rows, 7) == brute(rows)


def test_every_short_sequence(spark):
    """All sequences of up to three kinds of rows: ties between audits."""
    kinds = [("system", "."), ("user", "."), ("assistant", "."), ("user", ""), ("assistant", "-"), ("x", "."), ("user", None)]
    rows, conv = [], 0
    for n in (1, 2, 3, 4):
        for some in itertools.product(kinds[: 7 if n < 4 else 5], repeat=n):
            conv += 1
            rows += [(conv, t, role, text and f"{t}{text}") for t, (role, text) in enumerate(some)]
    assert found(spark, rows) == brute(rows)


def test_front_in_parts_and_matrices():
    """Vectors over rules, over terminals and a plain program agree, whatever the grammar is."""
    rng = random.Random(6)
    for _ in range(300):
        symbols = [rng.randrange(9) for _ in range(rng.randrange(1, 40))]
        grammar = rp.Grammar()
        for _ in range(4):
            ranked = [p for p, k in rp.digrams(grammar.reduced(symbols)).most_common() if k > 1]
            if ranked:
                grammar.add(rp.apart(ranked, 5))
        assert sum(len(grammar.reduced(symbols)) for _ in "x") <= len(symbols)
        matrices, answers = grammar.matrices(), []
        for parts in (symbols, grammar.reduced(symbols)):
            front = rp.Front()
            for s in parts:
                front.step(matrices[s])
            answers.append(front.best())
        said = [("sua?"[s >> 1] if s < 8 else "u", "" if s == 8 else f"{i}" + ("" if s & 1 else ".")) for i, s in enumerate(symbols)]
        assert answers[0] == answers[1] == cheapest(said)[:2]


def test_grammar_is_used(spark, monkeypatch):
    """Rules decide results: with another matrix for one of them, the audits differ."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(30) for t in range(8)]
    cut = rp.segments(rp.entries(rp._rows(spark.createDataFrame(rows, SCHEMA))))
    grammar = rp.learned(cut.groupBy("symbols").agg(F.count("*").alias("n")))
    assert grammar.rules and len(grammar.reduced([2, 4] * 4)) == 1
    assert {(r["cost"], r["audit"]) for r in rp.audits(cut, grammar).collect()} == {(0, "K" * 8)}
    true = rp.Grammar.matrices
    monkeypatch.setattr(rp.Grammar, "matrices", lambda self: true(self)[:-1] + [true(self)[8]])
    assert {(r["cost"], r["audit"]) for r in rp.audits(cut, grammar).collect()} == {(4, "D")}


def test_damage(spark):
    rows = [(c if c else None, t if t else None, ("user", None)[t % 2], "A. b? c!") for c in range(40) for t in range(6)]
    out = [tuple(r) for r in rp.damaged(with_clashes(spark.createDataFrame(rows, SCHEMA))).collect()]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role or " ", "" if kind == 1 else "A b c" if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("awkward", [False, True])
def test_query_and_its_sql(spark, tmp_path, awkward):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if awkward:
        sf = str(tmp_path)
        spark.createDataFrame(conversations(21, 60), SCHEMA).write.parquet(f"{sf}/conversations.parquet")
    name = f"{sf}/conversations.parquet" + "/*.parquet" * awkward
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{name}'")
    want = con.execute(rp.OP11_SQL)
    names = [d[0] for d in want.description]
    got = rp.op11(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert got.count() == con.execute("select count(*) from (select distinct conv_id from conversations)").fetchall()[0][0]
