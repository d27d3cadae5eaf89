"""Random small tables against plain Python loops."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import COLUMNS, day, moment, tables

from firstmonth.operators import friction, journey, support, tools
from firstmonth.plans.first_month import prepare


def random_rows(seed):
    rng = random.Random(seed)
    people = [f"e{i}" for i in range(6)] + [None]
    statuses = ["Completed", "Delayed", "In Progress", None]

    def when(top=45):
        return rng.randrange(top)

    onb = [
        (rng.choice(people), rng.choice(["S1", "S2", None]), rng.choice(statuses), day(d),
         rng.choice([None, day(d + rng.randrange(-2, 9))]))
        for d in (when(35) for _ in range(60))
    ]
    tool = [
        (rng.choice(people + ["hot"] * 5), rng.choice(["T1", "T2", "T3", None]),
         moment(when(), rng.randrange(24)), rng.choice(["Success", "Success", "Failed", "Timeout", None]))
        for _ in range(150)
    ]
    sup = [
        (str(rng.randrange(40)), rng.choice(people + ["new"]), rng.choice(["C1", "C2", None]),
         moment(when(), rng.randrange(3)), rng.choice(["Resolved", "Closed", None]),
         rng.choice([None, math.nan, -3.0, round(rng.uniform(0, 60), 1)]))
        for _ in range(90)
    ]
    return [rows + rng.choices(rows, k=len(rows) // 3) for rows in (onb, tool, sup)]


def key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


def first_month(onb, tool, sup):
    """Distinct rows of Day 0 to 30 with their day, in plain Python."""
    onb, tool, sup = ({key(r): r for r in rows}.values() for rows in (onb, tool, sup))
    zero = {}
    dated = [(r[0], r[3]) for r in onb] + [(r[0], r[2].date()) for r in tool] + [(r[1], r[3].date()) for r in sup]
    for person, at in dated:
        if person is not None:
            zero[person] = min(at, zero.get(person, at))

    def cut(rows, person, at):
        with_day = [(*r, (at(r) - zero[r[person]]).days) for r in rows if r[person] is not None]
        return [r for r in with_day if 0 <= r[-1] <= 30]

    def hours(value):
        return 0.0 if value is None or math.isnan(value) or value < 0 else value

    support_rows = cut(sup, 1, lambda r: r[3].date())
    return (
        cut(onb, 0, lambda r: r[3]),
        cut(tool, 0, lambda r: r[2].date()),
        [(*r[:5], hours(r[5]), r[6]) for r in support_rows],
    )


def expected_points(onb, tool, sup):
    total = max(1, len({r[0] for r in onb}))
    points = {}

    def add(label, rows, person, metric, divisor, weight):
        people = len({r[person] for r in rows})
        share = people / total
        score = round(len(rows) * share * (1 + metric / divisor) * weight, 1)
        points[label] = (len(rows), people, round(share * 100, 1), score)

    groups = defaultdict(list)
    for r in onb:
        if r[2] == "Delayed" and r[1] is not None:
            groups[r[1]].append(r)
    for name, rows in groups.items():
        days = [(r[4] - r[3]).days for r in rows if r[4] is not None]
        metric = round(sum(days) / len(days) if days else 4.0, 1)
        add(f"Onboarding Stage Delay: {name}", rows, 0, metric, 5.0, 10.0)
    for name in {r[1] for r in tool} - {None}:
        rows = [r for r in tool if r[1] == name]
        failed = [r for r in rows if r[3] != "Success"]
        if failed:
            metric = round(len(failed) / len(rows) * 100, 1)
            add(f"Tool Usage Failure: {name}", failed, 0, metric, 20.0, 8.0)
    for name in {r[2] for r in sup} - {None}:
        rows = [r for r in sup if r[2] == name]
        metric = round(math.fsum(r[5] for r in rows) / len(rows), 1)
        add(f"Support Dependency: {name}", rows, 1, metric, 12.0, 9.0)
    return points


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("way", ["broadcast", "shuffled", "heavy"])
def test_against_plain_loops(spark, seed, way):
    limits = {
        "broadcast": {},
        "shuffled": {"broadcast_bytes": 1},
        "heavy": {"broadcast_bytes": 1500, "heavy_rows": 30},
    }[way]
    raw = random_rows(seed)
    onb, tool, sup = first_month(*raw)
    assert onb and tool and sup
    month = prepare(tables(spark, *raw), **limits)
    t, zero = month.tables, month.day_zero
    assert zero.fits_broadcast == (way == "broadcast")
    assert (zero.most_rows > zero.heavy_threshold) == (way == "heavy")

    got = t.support_requests.select(*COLUMNS["support_requests"], "days_since_joining").collect()
    assert Counter(map(tuple, got)) == Counter(sup)

    points = {
        p.friction_point: (p.frequency, p.affected_employees, p.affected_pct, p.friction_score)
        for p in friction.friction_points(t).collect()
    }
    assert points == expected_points(onb, tool, sup)

    supported = {r[1] for r in sup}
    overlap = Counter(r[1] for r in tool if r[0] in supported and r[1] is not None)
    got = tools.tool_support_overlap(t.tool_usage, t.support_requests).collect()
    assert {r.tool_name: r.events_by_supported_employees for r in got} == overlap

    repeats = Counter((r[1], r[2]) for r in sup if r[2] is not None)
    assert support.repeated_issues(t.support_requests).first()[0] == sum(n - 1 for n in repeats.values())

    daily = {r.days_since_joining: tuple(r)[1:] for r in journey.journey_daily(t).collect()}
    counts = [Counter(r[-1] for r in rows) for rows in (onb, tool, sup)]
    assert daily == {d: tuple(c[d] for c in counts) for d in range(31)}
