"""States of dated facts: brute force, and no join of all dates with all facts."""

import random

from tidemark.operators import pit


def test_states_equal_brute_force(spark):
    rng = random.Random(4)
    facts = {(rng.choice("ab"), rng.choice(["x_a", "y_a"]), rng.randint(1, 30), rng.randint(2000, 2006)): rng.choice([None, *map(float, range(9))]) for _ in range(150)}
    frame = spark.createDataFrame([(*k, v) for k, v in facts.items()], "instrument string, field string, pub_date int, period int, value double")
    expect = set()
    for i in "ab":
        for day in {k[2] for k in facts if k[0] == i}:
            seen = [k for k in facts if k[0] == i and k[2] <= day]
            for n in range(min(k[3] for k in seen), max(k[3] for k in seen) + 1):
                newest = (max((k for k in seen if k[1] == f and k[3] == n), key=lambda k: k[2], default=None) for f in ("x_a", "y_a"))
                expect.add((i, day, n, *(facts.get(k) for k in newest)))
    got = pit.states(frame, ["x_a", "y_a"], False)
    rows = got.collect()
    assert len(rows) == len(expect) and {tuple(r) for r in rows} == expect
    assert "<=" not in got._jdf.queryExecution().optimizedPlan().toString()  # dates weren't joined with all earlier facts
