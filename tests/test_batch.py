"""The batch over every event against a plain fold."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from tidelog import catalog
from tidelog.sources.tables import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are missing")
def test_batch_takes_every_event(spark):
    state, expected = {}, []
    events = table(spark, DATA, "events").select("event_id", "user_id", "value").orderBy("event_id").collect()
    for r in events:
        pos, key, op = r["event_id"], f"b:{r['user_id'] % 7}", ("get", "set", "delete", "incr", "exists")[r["event_id"] % 5]
        if op == "set":
            state[key], result = math.floor(r["value"]), "ok"
        elif op == "delete":
            result = "0" if state.pop(key, None) is None else "1"
        elif op == "exists":
            result = "1" if key in state else "0"
        else:
            if op == "incr":
                state[key] = state.get(key, 0) + 1
            result = str(state.get(key, "nil"))
        expected.append((pos, key, op, result))
    assert len(expected) > 500
    assert sorted(map(tuple, catalog.queries()["batch_all"](spark, DATA).collect())) == expected
