"""Retries by lots: one state exchange for many cases, each of them treated as if it were alone."""

import json

import pytest
from pyspark.sql import Row

from remedia.streaming import feeds


class Store:
    def __init__(self):
        self.value, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


def work(case, attempt):
    if case["name"] == "never" or (case["name"] == "third" and attempt < 3):
        raise ValueError(case["name"])


def run(processor, *rows):
    given = [Row(key=str(k), payload='{"name": "%s"}' % name) for k, name in rows]
    return sorted((r.key, r.attempts, r.state) for r in processor.handleInputRows((7,), iter(given), None))


def test_state_is_exchanged_once_a_lot_and_batch():
    lot = feeds.AttemptsOfLot(work, 3)
    lot.state = Store()
    assert len(run(lot, *[(i, "fine") for i in range(500)])) == 500
    assert (lot.state.reads, lot.state.writes) == (1, 1)
    assert run(lot, *[(i, "fine") for i in range(500)]) == [] and lot.state.writes == 1  # ended cases are left out


@pytest.mark.parametrize("remember", [True, False])
def test_a_lot_treats_its_cases_as_if_each_were_alone(remember):
    batches = [[(1, "fine"), (2, "third"), (3, "never"), (1, "fine"), (4, "third"), (4, "third"), (3, "never")],
               [(2, "third"), (3, "never"), (1, "fine"), (4, "third"), (3, "never")],
               [(2, "third"), (4, "third"), (5, "never"), (5, "never"), (5, "never"), (5, "never")]]
    lot = feeds.AttemptsOfLot(work, 3, remember)
    lot.state = Store()
    alone = {}
    for batch in batches:
        want = []
        for key in sorted({k for k, _ in batch}):
            case = alone.setdefault(key, feeds.Attempts(work, 3, remember))
            case.state = getattr(case, "state", None) or Store()
            rows = [Row(payload='{"name": "%s"}' % name) for k, name in batch if k == key]
            want += [(r.key, r.attempts, r.state) for r in case.handleInputRows((str(key),), iter(rows), None)]
        assert run(lot, *batch) == sorted(want)
    states = {str(k): c.state.value for k, c in alone.items() if c.state.value}
    assert json.loads(lot.state.value[0]) == {k: -made if ended else made for k, (made, ended) in states.items()}
    assert len(states) == (5 if remember else 1)
