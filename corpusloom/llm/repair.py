"""Conversation structure repair: the cheapest edits that give each conversation the turns `(s?(ua)+)?`.

Edits: Keep a row (0), Rerole it to user or assistant (3), Delete it (4; blank and duplicate rows must go), Insert an
empty row of user or assistant (3); a truncated row that stays adds 3. Of the cheapest edits those whose initials, in
order, come first in ASCII are taken; edits of equal cost never begin one another, so minima of parts give the minimum
of the whole.

1. Symbols. A row is a role class and a fault. Rows are grouped by (conversation, turn, role, hash of the text), so
   repeated ones are one row each before anything moves, and sorted by range: a long conversation lies in several
   partitions. Runs of up to PART symbols are segments. No text moves up to here.
2. Grammar. Re-Pair over the distinct segments: each round counts digrams with Spark and names the most frequent ones
   that cannot overlap; ROUNDS rounds and RULES rules at most, what is left stays as it is.
3. Matrices. Every terminal has a 4 x 4 min-plus transfer matrix over the states (start, after system, after user,
   after assistant), whose entries are a cost and the rope of an audit; a rule's is the product of its parts', bottom
   up, with the parts' ropes shared. They are broadcast; their number is bounded by RULES.
4. Conversations. The segments of a conversation pass in order through a vector of four states; each state keeps its
   cost and a link to what it came from, and pairs of states how their audits compare, so memory follows the number of
   segments. Equal sequences are evaluated once a worker.
5. Texts. Rows move once, to their conversation, behind its audit, and pass as a sorted stream into the hash: it is a
   SHA-256, which has to see them in order.

Defined cases: a null role or text is one space; turns are in order, null first, rows of one turn by role, then by the
text's MD5; a role that begins with none of s, u, a (the empty one, too) must be rerolled or deleted; rows with a null
conv_id are one conversation; repeated rows are duplicates; very long texts pass whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table

PART = 256
ROUNDS = 10
RULES = 2_048
#: Distinct sequences whose repairs a worker keeps, and symbols up to which a sequence is one of them.
SEEN = 50_000
SHORT = 512
COPIES = 1_024
#: Costs of the edits, and what truncation adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = "sua"
#: Transitions of the grammar by role: from state to state. 0 is the start, then what the last row was.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, FINAL = range(4), (0, 3)
#: Symbols: class of the role (s, u, a, other) times 2, plus 1 if truncated; GONE must be deleted.
OTHER, GONE = 3, 8

NOTHING = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


class Rope:
    """Two audits one after the other, written out when first compared."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | str, right: Rope | str):
        self.left, self.right, self._text = left, right, None

    def __reduce__(self):
        return Rope, (self.left, self.right)

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = text_of(self.left) + text_of(self.right)
        return self._text


def text_of(rope: Rope | str) -> str:
    return rope if isinstance(rope, str) else rope.text


#: A matrix: by (from, to), the cost and audit of the cheapest way.
Matrix = dict[tuple[int, int], tuple[int, "Rope | str"]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest ways through both, the first audit of equals."""
    out: Matrix = {}
    for p in STATES:
        for q in STATES:
            ways = [(a[p, r][0] + b[r, q][0], r) for r in STATES if (p, r) in a and (r, q) in b]
            if ways:
                least = min(ways)[0]
                ropes = [Rope(a[p, r][1], b[r, q][1]) if a[p, r][1] and b[r, q][1] else a[p, r][1] or b[r, q][1] for cost, r in ways if cost == least]
                out[p, q] = (least, ropes[0] if len(ropes) == 1 else min(ropes, key=text_of))
    return out


def insertions() -> Matrix:
    """Ways by insertions alone."""
    out: Matrix = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, r), (cost, audit) in list(out.items()):
            for role in "ua":
                q = MOVES[role].get(r)
                if q is not None and cost + INSERT < out.get((p, q), (10**9, ""))[0]:
                    out[p, q] = (cost + INSERT, audit + "I")
    return out


def terminal(symbol: int) -> Matrix:
    """Insertions, then one row."""
    row: Matrix = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != GONE:
        more = TRUNCATED * (symbol & 1)
        for role in "ua":
            row |= {way: (REROLE + more, "R") for way in MOVES[role].items()}
        if symbol >> 1 != OTHER:
            row |= {way: (more, "K") for way in MOVES[ROLES[symbol >> 1]].items()}
    return product(insertions(), row)


class Grammar:
    """Rules by round; rule k is symbol GONE + 1 + k."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.rules: list[tuple[int, int]] = []

    def add(self, digrams: list[tuple[int, int]]) -> None:
        first = GONE + 1 + len(self.rules)
        self.rounds.append({pair: first + k for k, pair in enumerate(digrams)})
        self.rules += digrams

    def reduced(self, symbols: list[int]) -> list[int]:
        """A sequence with the rules applied, round by round, from the left."""
        for names in self.rounds:
            out, at, end = [], 0, len(symbols) - 1
            while at < end:
                name = names.get((symbols[at], symbols[at + 1]))
                if name is None:
                    out.append(symbols[at])
                    at += 1
                else:
                    out.append(name)
                    at += 2
            symbols = out + symbols[at:]
        return symbols

    def matrices(self) -> list[Matrix]:
        """One a symbol, bottom up."""
        out = [terminal(s) for s in range(GONE + 1)]
        for a, b in self.rules:
            out.append(product(out[a], out[b]))
        return out


def digrams(symbols: list[int]) -> Counter:
    """Occurrences of adjacent pairs; of overlapping ones (a a a) every other one counts."""
    found: Counter = Counter()
    last, again = None, False
    for pair in zip(symbols, symbols[1:], strict=False):
        again = pair == last and pair[0] == pair[1] and not again
        found[pair] += not again
        last = pair
    return found


def apart(ranked: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The first pairs of which no two can overlap: a symbol is on one side only."""
    lefts, rights, taken = set(), set(), []
    for a, b in ranked:
        if len(taken) < most and (a not in rights and b not in lefts if a != b else a not in lefts | rights):
            taken.append((a, b))
            lefts.add(a)
            rights.add(b)
    return taken


def learned(kinds: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Re-Pair over distinct segments (symbols, n: how often there are)."""
    grammar = Grammar()
    for _ in range(rounds):
        so_far = grammar

        def count(batches: Iterator[pa.RecordBatch], so_far: Grammar = so_far) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for pair, k in digrams(so_far.reduced(list(symbols))).items():
                        total[pair] += k * n
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in total], pa.int32()), pa.array([p[1] for p in total], pa.int32()), pa.array(total.values(), pa.int64())], ["a", "b", "k"])

        counted = kinds.select("symbols", "n").mapInArrow(count, "a int, b int, k long").groupBy("a", "b").agg(F.sum("k").alias("k"))
        best = counted.filter("k > 1").orderBy(F.desc("k"), "a", "b").limit(rules).collect()
        taken = apart([(r["a"], r["b"]) for r in best], rules - len(grammar.rules))
        if not taken:
            break
        grammar.add(taken)
    return grammar


#: How one audit compares with another: it comes "<" before or ">" after, or the other is it with something added ("+")
#: or it is the other with something added ("-").
Order = tuple[str, str]


def order_of(a: str, b: str) -> Order:
    if b.startswith(a):
        return "+", b[len(a) :]
    if a.startswith(b):
        return "-", a[len(b) :]
    return ("<" if a < b else ">"), ""


class Front:
    """The cheapest way from the start of a conversation to each state, after some of its symbols."""

    def __init__(self):
        self.ways: dict[int, tuple[int, tuple | None]] = {0: (0, None)}  # cost and (earlier link, piece of the audit)
        self.orders: dict[tuple[int, int], Order] = {}

    def _order(self, p: int, s: str, q: int, t: str) -> Order:
        """How the audit of p with s added compares with that of q with t added."""
        if p == q:
            return order_of(s, t)
        kind, more = self.orders[p, q]
        if kind in "<>":
            return kind, ""
        return order_of(s, more + t) if kind == "+" else order_of(more + s, t)

    def step(self, matrix: Matrix) -> None:
        chosen: dict[int, tuple[int, int, str]] = {}
        for q in STATES:
            ways = [(self.ways[p][0] + matrix[p, q][0], p) for p in self.ways if (p, q) in matrix]
            if not ways:
                continue
            least = min(ways)[0]
            best = None
            for cost, p in ways:
                if cost == least:
                    piece = text_of(matrix[p, q][1])
                    if best is None or self._order(p, piece, *best)[0] in "<+":
                        best = (p, piece)
            chosen[q] = (least, *best)
        orders = {(q, r): self._order(*chosen[q][1:], *chosen[r][1:]) for q in chosen for r in chosen if q != r}
        self.ways = {q: (cost, (self.ways[p][1], piece) if piece else self.ways[p][1]) for q, (cost, p, piece) in chosen.items()}
        self.orders = orders

    def best(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        self.step(insertions())
        ends = [q for q in FINAL if q in self.ways]
        end = ends[0]
        for q in ends[1:]:
            if self.ways[q][0] < self.ways[end][0] or self.ways[q][0] == self.ways[end][0] and self._order(q, "", end, "")[0] in "<+":
                end = q
        cost, link = self.ways[end]
        pieces = []
        while link is not None:
            link, piece = link
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


def _rows(turns: DataFrame) -> DataFrame:
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role"), one_space("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the CRC-32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text,
    2 removes its full stops, question and exclamation marks, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _rows(turns).withColumn("kind", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).filter("kind <> 0")
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.expr("explode(sequence(0, if(kind = 3, 1, 0))) as copy"))
    return rows.drop("copy")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def entries(rows: DataFrame) -> DataFrame:
    """Distinct rows with what the rest needs: conv_id, turn, role, said, n (how many), blank, first, symbol, cls."""
    text = F.col("text")
    marked = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("said"), (~text.rlike(NOTHING)).alias("blank"), (~text.rlike(ENDED)).alias("cut"))
    grouped = stored(marked.groupBy("conv_id", "turn", "role", "said").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "turns")
    firsts = grouped.groupBy("conv_id", "role", "said").agg(F.min(F.struct(F.isnotnull("turn"), F.coalesce("turn", F.lit(0)))).alias("x"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), F.col("x.col1").alias("named"), F.col("x.col2").alias("t"))
    out = grouped.join(firsts, same("conv_id", "c") & same("role", "r") & same("said", "s")).withColumn("first", (F.isnotnull("turn") == F.col("named")) & (F.coalesce("turn", F.lit(0)) == F.col("t")))
    cls = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.expr("substring(role, 1, 1)")), F.lit(0)) - 1, F.lit(OTHER))
    cls = F.when(F.length("role") == 0, OTHER).otherwise(cls)
    symbol = F.when(F.col("blank") | ~F.col("first"), GONE).otherwise(cls * 2 + F.col("cut").cast("int"))
    return out.select("conv_id", "turn", "role", "said", "n", "blank", "first", symbol.cast("int").alias("symbol"), cls.cast("int").alias("cls"))


def counts(found: DataFrame) -> DataFrame:
    """c (conv_id), gaps, blank, duplicate, truncated."""
    cut = F.col("symbol").isin(1, 3, 5, 7)
    again = F.when(F.col("blank"), 0).when(F.col("first"), F.col("n") - 1).otherwise(F.col("n"))
    by_turn = found.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"), F.sum(cut.cast("long")).alias("truncated"))
    total = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    return by_turn.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *total)


def segments(found: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, place (in order), symbols, head and tail (role classes) and illegal (pairs inside) of runs of rows."""
    kind = found.schema["conv_id"].dataType.simpleString()
    split = found.select("conv_id", "turn", "role", "said", "symbol", "cls", "first", F.col("n").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("piece"))
    split = split.withColumn("n", F.least(F.lit(COPIES), F.expr(f"all - piece * {COPIES}")).cast("int")).withColumn("whole", F.col("piece") > 0).drop("all", "first")
    keys = ["conv_id", "turn", "role", "said", "piece"]
    dealt = split.repartitionByRange(*keys).sortWithinPartitions(*keys)
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            copies = batch.column("n").to_numpy()
            upto = np.cumsum(copies)
            while at < len(batch):  # some rows at a time, for they may stand for many
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000)))
                some = batch.slice(at, stop - at)
                at = stop
                n = some.column("n").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                head = np.zeros(len(row), bool)
                head[np.cumsum(n) - n] = ~some.column("whole").to_numpy(zero_copy_only=False)
                symbol = np.where(head, some.column("symbol").to_numpy()[row], GONE).astype(np.uint8)
                cls = some.column("cls").to_numpy()[row].astype(np.uint8)
                codes = some.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy()[row]
                change = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                bounds = np.concatenate([change, [len(row)]])
                starts = np.concatenate([np.arange(a, b, part) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                ends = np.concatenate([starts[1:], [len(row)]])
                bad = np.concatenate([[0], np.cumsum(~legal[cls[:-1], cls[1:]])])
                columns = [
                    some.column("conv_id").take(pa.array(row[starts])),
                    pa.array(place + np.arange(len(starts))),
                    pa.array([symbol[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array(cls[starts].astype(np.int32)),
                    pa.array(cls[ends - 1].astype(np.int32)),
                    pa.array(bad[ends - 1] - bad[starts]),
                ]
                place += len(starts)
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "symbols", "head", "tail", "illegal"])

    return stored(dealt.mapInArrow(cut, f"conv_id {kind}, place long, symbols binary, head int, tail int, illegal long"), "segments")


def audits(cut: DataFrame, grammar: Grammar) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation, from its stored segments."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    shared = cut.sparkSession.sparkContext.broadcast((grammar, grammar.matrices()))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, matrices = shared.value
        reduced: dict[bytes, list[int]] = {}
        seen: dict[tuple, tuple[int, str]] = {}
        front, pending, at, illegal, tail, begun = None, [], None, 0, 0, False

        def flush() -> None:
            nonlocal front
            front = front or Front()
            for s in pending:
                front.step(matrices[s])
            pending.clear()

        def finished() -> pa.RecordBatch:
            nonlocal front
            if front is None:
                key = tuple(pending)
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    flush()
                    seen[key] = front.best()
                cost, audit = seen[key]
                pending.clear()
            else:
                flush()
                cost, audit = front.best()
            front = None
            return at, illegal, cost, audit

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "illegal", "cost", "audit"])

        types, rows = None, []
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string()]
            for r in batch.to_pylist():
                if begun and r["conv_id"] != at:
                    rows.append(finished())
                    begun = False
                if not begun:
                    begun, at, illegal = True, r["conv_id"], r["illegal"]
                else:
                    illegal += r["illegal"] + ((tail, r["head"]) not in ((0, 1), (1, 2), (2, 1)))
                tail, symbols = r["tail"], r["symbols"]
                if symbols not in reduced:
                    if len(reduced) >= SEEN:
                        reduced.clear()
                    reduced[symbols] = grammar.reduced(list(symbols))
                pending += reduced[symbols]
                if len(pending) > SHORT:
                    flush()
            if sum(len(x[3]) for x in rows) > 1 << 20 or len(rows) > 5000:
                yield packed(rows)
                rows = []
        if begun:
            rows.append(finished())
        if rows:
            yield packed(rows)

    dealt = cut.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "symbols", "head", "tail", "illegal")
    return stored(dealt.mapInArrow(evaluate, f"conv_id {kind}, illegal long, cost long, audit string"), "audits")


class Repaired:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.with_system = (len(audit) - audit.count("D")) % 2
        self.lines, self.hash = 0, hashlib.sha256()

    def _line(self, line: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + line).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _due(self) -> str:
        return ("user", "assistant")[(self.lines - self.with_system) % 2]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._due() + ":")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(f"{role if edit == 'K' else self._due()}:{text}")

    def digest(self) -> str:
        self._inserted()
        if self.at != len(self.audit):
            raise ValueError("an audit has more edits than its conversation has rows")
        return self.hash.hexdigest()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of audits() with repaired_sha256, from the conversations' rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("said"), "text", F.lit(0).cast("long").alias("illegal"), F.lit(0).cast("long").alias("cost"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("said"), F.col("audit").alias("text"), "illegal", "cost")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "said")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            done = []
            for conv, kind, role, text, illegal, cost in zip(*(batch.column(c) for c in ("conv_id", "kind", "role", "text", "illegal", "cost")), strict=True):
                if kind.as_py() == 0:
                    if now:
                        done.append((*now[:4], now[4].digest()))
                    audit = text.as_py()
                    now = (conv.as_py(), illegal.as_py(), cost.as_py(), audit, Repaired(audit))
                else:
                    now[4].add(role.as_py(), text.as_py())
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            if done:
                yield packed(done, types)
        if now:
            yield packed([(*now[:4], now[4].digest())], types)

    def packed(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    return stream.mapInArrow(apply, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    rows = _rows(turns)
    found = entries(rows)
    cut = segments(found)
    kinds = stored(cut.groupBy("symbols").agg(F.count("*").alias("n")), "segment-kinds")
    done = repaired(rows, audits(cut, learned(kinds)))
    out = done.join(counts(found), same("conv_id", "c"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    out = every.join(done, same("every", "conv_id"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("every").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


OP11_SQL = r"""
with recursive
crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda y: ascii(y)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as k from conversations, crc),
e as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
  case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k = 3 then [0, 1] else [0] end) as copy from d where k <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, left(role, 1) as initial,
  case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from e),
w as (select *, lag(initial) over (partition by conv_id order by i) as before from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from w group by 1),
ins(p, r, cost, audit) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
moves(role, r, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits as (select 'K' as edit, role, r, q, 0 as cost from moves union all select 'R', null, r, q, 3 from moves where role <> 's' union all select 'D', null, x, x, 4 from (select unnest(range(4)) as x)),
dp as (select conv_id, 0::bigint as i, 0::bigint as q, {'cost': 0::bigint, 'audit': ''} as way from c
  union all
  select dp.conv_id, o.i, edits.q::bigint, min({'cost': (dp.way.cost + ins.cost + edits.cost + case when edits.edit <> 'D' and o.fault = 'truncated' then 3 else 0 end)::bigint, 'audit': dp.way.audit || ins.audit || edits.edit})
  from dp join ins on ins.p = dp.q join o on o.conv_id is not distinct from dp.conv_id and o.i = dp.i + 1
  join edits on edits.r = ins.r and (edits.edit = 'D' or o.fault not in ('blank', 'duplicate') and (edits.edit = 'R' or edits.role = o.initial))
  group by 1, 2, 3),
z as (select c.conv_id, min({'cost': (dp.way.cost + ins.cost)::bigint, 'audit': dp.way.audit || ins.audit}) as way
  from c join dp on dp.conv_id is not distinct from c.conv_id and dp.i = c.n join ins on ins.p = dp.q and ins.r in (0, 3) group by 1),
letters as (select conv_id, way.audit as audit, unnest(range(1, length(way.audit) + 1)) as pos from z),
placed as (select conv_id, audit, pos, audit[pos] as edit, length(replace(audit[:pos], 'I', '')) as i, length(replace(audit[:pos], 'D', '')) as place, length(replace(audit, 'D', '')) as total from letters),
lines as (select p.conv_id, p.pos, case when p.edit = 'K' then o.role when (p.place - p.total % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || case when p.edit = 'I' then '' else o.text end as line
  from placed p join o on o.conv_id is not distinct from p.conv_id and o.i = greatest(p.i, 1) where p.edit <> 'D'),
h as (select conv_id, string_agg(line, chr(10) order by pos) as whole from lines group by 1),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(z.way.cost, 0) as cost, coalesce(z.way.audit, '') as audit, sha256(coalesce(h.whole, '')) as repaired_sha256
from every left join c on c.conv_id is not distinct from every.conv_id left join z on z.conv_id is not distinct from every.conv_id left join h on h.conv_id is not distinct from every.conv_id
"""
