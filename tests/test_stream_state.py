"""The rate limit's state: one entry for the requests of a key that arrive together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T

from evirank.streaming import limits


class _State:
    def __init__(self):
        self.rows, self.timers = [], []

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.single else iter(self.rows)

    single = False

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_requests_that_arrive_together_are_one_entry():
    p = limits._InOrder("k", "tie", T.StringType(), 2, 10_000)
    p.pending, p.accepted, p.handle = _State(), _State(), _State()
    p.accepted.single = True
    rows = pd.DataFrame({"us": [5000, 1000, 9000, 2000, 30_000], "tie": ["b", "a", "c", "d", "e"]})
    list(p.handleInputRows(("x",), iter([rows]), None))
    assert len(p.pending.rows) == 1 and p.handle.timers == [1]
    first = pd.concat(p.handleExpiredTimer(("x",), _Now(9), None))
    assert list(first["tie"]) == ["a", "d", "b", "c"] and list(first["accepted"]) == [True, True, False, False]
    assert p.pending.rows == [([30_000], ["e"])] and p.accepted.rows == [([1000, 2000],)] and p.handle.timers[-1] == 30
    last = pd.concat(p.handleExpiredTimer(("x",), _Now(30), None))
    assert last.values.tolist() == [["x", "e", 30_000, True, 0.0]] and not p.pending.rows
