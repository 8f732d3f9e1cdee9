"""The day-blocked budget equals one sequence over all calls."""

import random

from pyspark.sql import functions as F

from tidewire.operators import admission


def plain(rows, interval, per_group, total):
    out, state = set(), {}
    for g, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if admission._reserve(state, g, at, interval, per_group, total):
            out.add(i)
    return out


def test_budget_by_days_equals_one_sequence(spark):
    rng = random.Random(1)
    for interval, per_group, total, n in ((7200, 5, 9, 400), (86400, 2, 100, 200), (100_000, 3, 4, 300), (300_000, 3, 100, 300), (0, 4, 6, 200), (40_000, 50, 60, 300)):
        rows = [(f"g{rng.randrange(4)}", float(rng.randrange(12 * 86400)), k) for k in range(n)]
        # calls close to midnight, so that what a day starts from decides, day after day
        rows += [("m", d * 86400.0 + rng.choice([-300, 0, 300, 1200]), 1000 + d) for d in range(1, 12)]
        df = spark.createDataFrame(rows, "group_id string, at_s double, id long").repartition(5).withColumn("extra", F.lit("x"))
        out = admission.reservations_with_total(df, interval, per_group, total)
        assert out.columns == ["group_id", "at_s", "id", "extra", "accepted"] and out.count() == len(rows)
        assert {r.id for r in out.where("accepted").collect()} == plain(rows, interval, per_group, total)
    assert admission.reservations_with_total(df.where("FALSE"), 60, 1, 1).count() == 0
