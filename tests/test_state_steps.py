"""Steps of keyed streams: right over several batches of a key, and without sorting a frame for each key."""

import pandas as pd
import pytest

from thinmarket.streaming import streams as Z


class State:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


@pytest.fixture(autouse=True)
def no_sorted_frames(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a frame is sorted for one key")

    monkeypatch.setattr(pd.DataFrame, "sort_values", refuse)


def at(*hours):
    return pd.to_datetime("2024-01-01") + pd.to_timedelta(list(hours), unit="h")


def test_insights_open_by_time_over_batches_of_a_key():
    state = State()
    first = [pd.DataFrame({"insight_id": [5, 2], "created_at": at(30, 0)}), pd.DataFrame({"insight_id": [1, 9], "created_at": at(24, 30)})]
    rows = [tuple(r) for f in Z._opened((7, "sale"), iter(first), state) for r in f.itertuples(index=False)]
    assert rows == [(2, 7, "sale", 2, "insert"), (1, 7, "sale", 2, "update"), (5, 7, "sale", 5, "insert"), (9, 7, "sale", 5, "update")]
    later = [pd.DataFrame({"insight_id": [11, 10], "created_at": at(55, 20)})]
    rows = [tuple(r) for f in Z._opened((7, "sale"), iter(later), state) for r in f.itertuples(index=False)]
    assert rows == [(10, 7, "sale", 5, "update"), (11, 7, "sale", 11, "insert")]


def test_the_first_hit_of_all_batches_fires_once():
    state = State()
    hits = [pd.DataFrame({"event_id": [4, 3], "ts": at(5, 5), "price": [1.0, 2.0], "fired": ["above", "below"]}), pd.DataFrame({"event_id": [9], "ts": at(6), "price": [3.0], "fired": ["above"]})]
    assert [tuple(r) for f in Z._first_fire((1,), iter(hits), state) for r in f.itertuples(index=False)] == [(1, 3, 2.0, "below")]
    assert list(Z._first_fire((1,), iter(hits), state)) == []
