"""Positions folded in one pass: equal to a plain loop, resumable, and small in memory for a position that is never flat."""

import random
import resource

import pyarrow as pa

from thinmarket.operators import ledger as L

SCHEMA = "trade_id long, portfolio_id long, card_id long, side string, quantity int, price double, strategy string, executed_at timestamp"


def plain(rows):
    state = {}
    for trade, portfolio, card, side, n, price, by, at in sorted(rows, key=lambda r: (r[7], r[0])):
        q, avg, entry, strategy = state.get((portfolio, card), (0, 0.0, None, None))
        if q == 0:
            avg, entry, strategy = 0.0, at, by
        if side == "buy":
            avg = round((avg * q + price * n) / (q + n) + 1e-9, 2)
        state[portfolio, card] = (q + n if side == "buy" else q - n, avg, entry, strategy)
    return {k: v for k, v in state.items() if v[0] > 0}


def fills(rng, n):
    from datetime import datetime, timedelta

    held, rows = {}, []
    for i in range(n):
        key = (rng.randrange(4), rng.randrange(3))
        have, at = held.get(key, 0), datetime(2001, 1, 1) + timedelta(hours=i // 3)
        sell = have and rng.random() < 0.5
        q = rng.choice([have, rng.randint(1, have)]) if sell else rng.randint(1, 5)
        held[key] = have - q if sell else have + q
        rows.append((i, *key, "sell" if sell else "buy", q, round(rng.uniform(1, 90), 2), f"s{i % 5}", at))
    return rows


def as_dict(df):
    return {(r.portfolio_id, r.card_id): (r.quantity, r.avg_entry_price, r.entry_date, r.strategy) for r in df.collect()}


def test_equals_a_loop_and_goes_on_from_a_snapshot(spark, tmp_path):
    rows = fills(random.Random(2), 600)
    want = plain(rows)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    assert as_dict(L.positions_from_trades(df)) == want and want
    L.position_snapshot(df.filter("trade_id < 333")).write.parquet(f"{tmp_path}/positions")
    before = spark.read.parquet(f"{tmp_path}/positions")
    assert as_dict(L.positions_from_trades(df.filter("trade_id >= 333"), before)) == want
    assert as_dict(L.positions_from_trades(df.filter("trade_id >= 200"), before)) == want  # fills that came twice
    assert as_dict(L.positions_from_trades(df.filter("false"), before)) == plain(rows[:333])
    assert as_dict(L.positions_from_trades(df.filter("false"))) == {}


def test_long_position_in_constant_memory():
    """Two million fills of one position that is never flat, in batches, through the fold itself."""
    n, size = 2_000_000, 10_000
    names = ["portfolio_id", "card_id", "us", "trade_id", "side", "quantity", "price", "strategy", "opened"]

    def batches():
        for i in range(0, n, size):
            k = range(i, i + size)
            yield pa.RecordBatch.from_arrays([
                pa.array([1] * size, pa.int64()), pa.array([1] * size, pa.int64()), pa.array(k, pa.int64()), pa.array(k, pa.int64()), pa.array(["buy" if x % 3 else "sell" for x in k] if i else ["buy"] * size),
                pa.array([1 + x % 2 for x in k], pa.int64()), pa.array([10 + x % 7 for x in k], pa.float64()), pa.array(["s"] * size), pa.array([None] * size, pa.int64()),
            ], names)

    start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(L._fold(batches())).to_pylist()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start < 200_000  # kilobytes
    q, avg = 0, 0.0
    for x in range(n):
        k = 1 + x % 2
        if x < size or x % 3:
            avg, q = round((avg * q + (10 + x % 7) * k) / (q + k) + 1e-9, 2), q + k
        else:
            q -= k
    assert [(r["quantity"], r["avg_entry_price"], r["entry_us"]) for r in out] == [(q, avg, 0)] and q > size
