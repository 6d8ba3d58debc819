"""Positions at the steps of a panel: peaks as by hand, and no window over what positions yield."""

import datetime as dt
import random

from pyspark.sql import functions as F

from thinmarket.operators import history as H


def test_peaks_equal_all_pairs_without_a_window(spark):
    rng, start, step = random.Random(3), dt.date(2024, 1, 10), 5
    day = lambda n: start + dt.timedelta(days=n)
    bars = [(c, day(n), float(rng.randint(1, 99))) for c in range(4) for n in sorted(rng.sample(range(60), 14))]
    panel = [(c, day(k * step), float(k), "x") for c in range(5) for k in range(12) if rng.random() < 0.8]
    held = [(p, rng.randrange(5), dt.datetime.combine(day(rng.randint(-12, 62)), dt.time(9)), "s") for p in range(60)] + [(99, 1, None, "s")]
    got = H.held_at_steps(
        spark.createDataFrame(held, "portfolio_id long, card_id long, entry_date timestamp, strategy string"),
        spark.createDataFrame(panel, "card_id long, sim_date date, current_price double, strategy string"),
        spark.createDataFrame(bars, "card_id long, date date, price double"), F.lit(start), step,
    )
    want = set()
    for p, c, at, _ in held:
        for card, sim, price, _ in panel:
            if at and card == c and sim >= at.date():
                want.add((p, c, sim, price, max((x for b, d, x in bars if b == c and at.date() <= d <= sim), default=None)))
    rows = [(r.portfolio_id, r.card_id, r.sim_date, r.current_price, r.peak) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
