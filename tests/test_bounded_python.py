"""What a Python worker holds is bounded by bytes, or is small for each row."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from corpusloom.sources import files
from corpusloom.streaming import keyed


class State(list):
    """A list or value state in memory."""

    def exists(self):
        return bool(self)

    def get(self):
        return iter([*self]) if self and isinstance(self[0], tuple) and len(self[0]) == 3 else self[0]

    def appendList(self, rows):
        assert len(rows) <= keyed.SOME
        self.extend(rows)

    def put(self, rows):
        assert len(rows) <= keyed.SOME
        self[:] = rows

    def update(self, row):
        self[:] = [row]


def test_a_hot_key_takes_few_bytes_a_row():
    states = {"last": State(), "early": State()}
    timers = []
    handle = SimpleNamespace(getValueState=lambda n, _: states[n], getListState=lambda n, _: states[n], registerTimer=timers.append)
    work = keyed.transitions(True)
    work.init(handle)
    rng = random.Random(1)
    n = 200_000
    rows = [(f"v{rng.randrange(9)}", i if i % 5 else None, rng.randrange(n)) for i in range(n)]
    list(work.handleInputRows(("k",), (SimpleNamespace(value=v, seq=s, at=t) for v, s, t in rows), None))
    assert timers == [min(r[2] for r in rows) // 1000]
    # the state's own copy of the rows is a list of references, 8 bytes a row
    tracemalloc.start()
    out = work.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: n), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * n
    want, was = [], None
    for v, s, t in sorted(rows, key=lambda h: (h[2], h[1] is not None, h[1] or 0, h[0])):
        if v != was:
            want.append((was, v, s, t, was is None))
        was = v
    assert [(r.was, r.to, r.seq, r.at, r.is_new) for r in out] == want
    assert states["last"] == [(was,)] and not states["early"]


def test_acts_are_parsed_some_bytes_at_a_time(monkeypatch):
    monkeypatch.setattr(files, "TOGETHER", 1000)
    act = lambda i: f'<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><body><article eId="a{i}"><p>text {i}</p></article></body></act></akomaNtoso>'.encode()
    frame = pa.RecordBatch.from_pydict({"zip": ["z"] * 50, "entry": [f"e{i}" for i in range(50)], "content": [act(i) if i % 10 else b"<broken" for i in range(50)]})
    found = list(files._acts_of(iter([frame]), ""))
    assert len(found) > 5
    rows = [r for f in found for r in f.to_pylist()]
    assert [(r["entry"], r["text"], r["articles"][0]["eId"]) for r in rows] == [(f"e{i}", f"text {i}", f"a{i}") for i in range(50) if i % 10]
