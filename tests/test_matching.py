"""One-to-one matching against the plain rule, on random and on crowded inputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from triledger.operators import matching
from triledger.operators.matching import NEAREST, OTHER_AGENT, match_one_to_one

EPOCH = datetime.date(1970, 1, 1)


def plain(proposers, seats, mode, tolerance, days):
    """The rule read literally: walk the proposers, scan every seat."""
    taken, pairs = set(), set()
    for pid, agent, cents, day, o1 in sorted(proposers, key=lambda p: (p[4], p[0])):
        best = None
        for sid, s_agent, s_cents, s_day, s_o1 in seats:
            if sid in taken or abs(s_cents - cents) > tolerance or abs(s_day - day) > days:
                continue
            if (s_agent == agent) != (mode == NEAREST):
                continue
            liking = (abs(s_day - day), s_day, s_cents) if mode == NEAREST else (s_agent, s_cents, s_day)
            if best is None or (liking, s_o1, sid) < best:
                best = (liking, s_o1, sid)
        if best:
            taken.add(best[2])
            pairs.add((pid, best[2]))
    return pairs


def random_case(seed, n, amounts, days, agents):
    rng = random.Random(seed)

    def rows(start):
        return [(start + i, f"A{rng.randrange(agents)}", rng.choice(amounts), rng.randrange(days), rng.randrange(10_000))
                for i in range(n)]

    return rows(0), rows(100_000)


def run(spark, proposers, seats, mode, days, island_rows, hot_rows=1_000_000, chunk=200_000):
    schema = "id bigint, agent string, cents bigint, day_no int, o1 bigint"
    frame = lambda rows: spark.createDataFrame(rows, schema).selectExpr(
        "id", "agent", "cast(cents / 100 as decimal(18,2)) as amount", "date_from_unix_date(day_no) as day", "o1")
    out = match_one_to_one(
        frame(proposers), frame(seats), mode=mode, tolerance="1", days=days, turn=["o1", "id"], place=["o1", "id"],
        island_rows=island_rows, hot_rows=hot_rows, chunk=chunk)
    return {(r.proposer, r.seat) for r in out.collect()}


CASES = [
    (1, 120, list(range(0, 3000, 37)), 200, 3),       # sparse: many islands
    (2, 50, list(range(1000, 1400, 20)), 40, 2),      # one chain of amounts and days
    (3, 60, [10000, 10050, 10100, 10200], 12, 1),     # a crowd of round amounts
]


@pytest.mark.parametrize("seed,n,amounts,days,agents", CASES)
def test_fold_equals_plain_rule(spark, seed, n, amounts, days, agents):
    p, s = random_case(seed, n, amounts, days, agents)
    assert run(spark, p, s, NEAREST, 7, 10_000) == plain(p, s, NEAREST, 100, 7)


@pytest.mark.parametrize("seed,n,amounts,days,agents", CASES[1:])
def test_deferred_acceptance_equals_plain_rule(spark, seed, n, amounts, days, agents):
    p, s = random_case(seed, n, amounts, days, agents)
    # Every island counts as oversized, every key as hot.
    assert run(spark, p, s, NEAREST, 7, 1, hot_rows=3) == plain(p, s, NEAREST, 100, 7)


def test_large_groups_are_cut_into_chunks(spark):
    p, s = random_case(4, 40, [10000], 3, 4)
    for mode in (NEAREST, OTHER_AGENT):
        assert run(spark, p, s, mode, 1, 1, chunk=7) == plain(p, s, mode, 100, 1)


def test_a_crowd_of_equal_leftovers(spark, monkeypatch):
    """A thousand agents with equal amounts on one day: one list of classes, few rounds."""
    lists, rounds = [], []
    menus, handed = matching._menus, matching._handed_out
    monkeypatch.setattr(matching, "_menus", lambda *a: lists.append(menus(*a)) or lists[-1])
    monkeypatch.setattr(matching, "_handed_out", lambda *a: rounds.append(1) or handed(*a))
    agents = 1_000
    p = [(i, f"A{i * 7 % agents:04}", 10000, 5, i) for i in range(agents)]
    s = [(100_000 + i, f"A{i:04}", 10000, 5, i) for i in range(agents)]
    assert run(spark, p, s, OTHER_AGENT, 10, 1) == plain(p, s, OTHER_AGENT, 100, 10)
    assert lists[0].count() == agents and len(rounds) == 1


def test_the_fold_stays_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 5, 2)], "id bigint, agent string, amount int, o1 bigint").withColumn("day", F.current_date())
    out = match_one_to_one(rows, rows, mode=NEAREST, tolerance="1", days=7, turn=["o1"], place=["o1"], island_rows=100, hot_rows=100, at_most=4)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and out.count() == 2


def test_other_agent_mode(spark):
    p, s = random_case(5, 24, [10000, 10050, 10100, 30000], 30, 3)
    expected = plain(p, s, OTHER_AGENT, 100, 10)
    assert run(spark, p, s, OTHER_AGENT, 10, 10_000) == expected
    assert run(spark, p, s, OTHER_AGENT, 10, 1) == expected


def test_a_call_of_python_takes_many_groups(spark, monkeypatch):
    """Small groups share a call; the turns of large ids stay exact."""
    buckets = []
    handed = matching._handed_out
    monkeypatch.setattr(matching, "_handed_out", lambda *a: buckets.append(a[-1]) or handed(*a))
    far = 2 ** 53
    p = [(far + i, f"A{i % 30}", 10000 * (1 + i % 4), 20 * (i % 3), i) for i in range(120)]
    s = [(100_000 + i, f"A{i % 30}", 10000 * (1 + i % 4), 20 * (i % 3), i) for i in range(60)]
    monkeypatch.setattr(matching, "CALL_ROWS", 10)
    assert run(spark, p, s, NEAREST, 7, 1) == plain(p, s, NEAREST, 100, 7)
    assert set(buckets) == {13}
