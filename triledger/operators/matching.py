"""One-to-one matching within an amount and a date tolerance, first come first served.

Proposers take their turn in a fixed order; each takes the seat it likes best among those still
free.  Seats of equal (agent, amount, day) form a class and are handed out in place order.

Most data falls apart into islands: no pair within the tolerances crosses a gap in the amounts or
in the days, so each island is folded on its own, as a column expression over its sorted members.

An island above the row limit is matched by deferred acceptance.  Proposers that see the same
classes in the same order form a group: equal (agent, amount, day), or equal (amount, day) where
seats of other agents are wanted.  Each group hands its members to the classes as if it were alone;
that is the best that any member can hope for.  Classes that are overbooked keep their earliest
proposers and get a cutoff turn, and the groups with rejected members do it again, leaving out what
the cutoffs close, until no class is overbooked.  A group lists the classes it sees once, whatever
the number of its agents and members, and a large group is cut into chunks of consecutive turns.
Because all seats rank proposers by the same turn, both ways give the same, unique result.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.operators.durable import durable, known_rows
from triledger.operators.ordered import gap_islands, ordered_scan
from triledger.operators.skew import salted_join

# Functions used inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAREST = "nearest day"        # same agent; nearest day, then the earlier day, then the lower amount
OTHER_AGENT = "other agent"    # another agent; by agent, amount and day

CLASS = ["agent", "cents", "day_no"]
TURN = ["o1", "o2", "id"]
# Proposers of one group that one task takes.
CHUNK = 200_000
# Rows of proposers and of menus that a call takes, as long as its groups are smaller.
CALL_ROWS = 20_000


def _standard(rows: DataFrame, side: int, order: list[str]) -> DataFrame:
    second = F.col(order[1]) if len(order) > 1 else F.lit(0)
    return rows.filter(F.col("day").isNotNull() & F.col("amount").isNotNull() & F.col("agent").isNotNull()).select(
        F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"), "agent",
        F.round(F.col("amount") * 100).cast("bigint").alias("cents"), F.unix_date("day").alias("day_no"),
        F.col(order[0]).cast("bigint").alias("o1"), second.cast("bigint").alias("o2"))


def islands(members: DataFrame, mode: str, tolerance_cents: int, days: int, skew: dict) -> DataFrame:
    """Per class, the island it belongs to and how many proposers and seats the island holds."""
    scope = ["agent"] if mode == NEAREST else []
    classes = members.groupBy(*CLASS).agg(
        F.count_if(F.col("side") == 0).alias("proposers"), F.count_if(F.col("side") == 1).alias("seats"))
    classes = durable(classes.withColumn("cell", F.floor(F.col("cents") / max(tolerance_cents, 1))))
    by_amount = gap_islands(classes, scope, "cell", 1, "amount_island")
    classes = durable(salted_join(classes, by_amount, [*scope, "cell"], how="inner", **skew))
    by_day = gap_islands(classes, [*scope, "amount_island"], "day_no", days, "day_island")
    classes = salted_join(classes, by_day, [*scope, "amount_island", "day_no"], how="inner", **skew)
    island = [*scope, "amount_island", "day_island"]
    sizes = classes.groupBy(*island).agg(
        F.sum("proposers").alias("island_proposers"), F.sum("seats").alias("island_seats"))
    sizes = sizes.filter((F.col("island_proposers") > 0) & (F.col("island_seats") > 0))
    joined = salted_join(classes, sizes, island, how="inner", **skew)
    return joined.select(
        *CLASS, "cell", "proposers", "seats", "island_proposers", "island_seats",
        F.struct(*([F.col("agent")] if scope else [F.lit("").alias("agent")]), "amount_island", "day_island").alias("island"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def take_turns(proposers: Column, seats: Column, mode: str, tolerance_cents: int, days: int) -> Column:
    """The plain rule, for one island: pairs of a sorted array of proposers and an array of seats.

    Each proposer takes the best of the free seats that it accepts; what is taken is not looked at again.
    """
    def accepts(p):
        return lambda s: ((F.abs(s["cents"] - p["cents"]) <= tolerance_cents) & (F.abs(s["day_no"] - p["day_no"]) <= days)
                          & ((s["agent"] == p["agent"]) if mode == NEAREST else (s["agent"] != p["agent"])))

    def liking(p):
        def of(s):
            first = (F.abs(s["day_no"] - p["day_no"]), s["day_no"], s["cents"]) if mode == NEAREST else (s["agent"], s["cents"], s["day_no"])
            return F.struct(*[c.alias(f"l{i}") for i, c in enumerate(first)], *[s[c].alias(c) for c in TURN])
        return of

    def turn(state, p):
        best = F.array_min(F.transform(F.filter(state["free"], accepts(p)), liking(p)))
        return _let(best, lambda b: F.when(b.isNull(), state).otherwise(F.struct(
            F.filter(state["free"], lambda s: s["id"] != b["id"]).alias("free"),
            F.concat(state["pairs"], F.array(F.struct(p["id"].alias("proposer"), b["id"].alias("seat")))).alias("pairs"))))

    begin = F.struct(seats.alias("free"), F.array().cast("array<struct<proposer:bigint,seat:bigint>>").alias("pairs"))
    return F.aggregate(proposers, begin, turn)["pairs"]


def _fold_islands(members: DataFrame, classes: DataFrame, mode: str, tolerance_cents: int, days: int, skew: dict) -> DataFrame:
    inside = salted_join(members, classes.select(*CLASS, "island"), CLASS, how="inner", **skew)
    one = F.struct(*TURN, *CLASS)
    # Bounded: only islands below the row limit come here.
    gathered = inside.groupBy("island").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, one))).alias("proposers"), F.collect_list(F.when(F.col("side") == 1, one)).alias("seats"))
    pairs = take_turns(F.col("proposers"), F.col("seats"), mode, tolerance_cents, days)
    return gathered.select(F.explode(pairs).alias("pair")).select("pair.proposer", "pair.seat")


def group_columns(mode: str) -> list[str]:
    return [f"g_{c}" for c in (CLASS if mode == NEAREST else CLASS[1:])]


def _menus(classes: DataFrame, mode: str, tolerance_cents: int, days: int) -> DataFrame:
    """The classes of seats that a group of proposers sees, found through neighbouring cells; the likings order them."""
    group = group_columns(mode)
    bucket = F.floor(F.col("day_no") / (days + 1)).cast("bigint")
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    groups = (
        classes.filter(F.col("proposers") > 0).select(*[F.col(c[2:]).alias(c) for c in group], "cell", bucket.alias("own")).distinct()
        .select(*group, around(F.col("cell")).alias("cell"), "own").select("*", around(F.col("own")).alias("bucket")).drop("own"))
    seats = classes.filter(F.col("seats") > 0).select(*CLASS, "cell", bucket.alias("bucket"), F.col("seats").alias("capacity"))
    on = ["cell", "bucket"]
    if mode == NEAREST:
        groups, on = groups.withColumn("agent", F.col("g_agent")), ["agent", *on]
    apart = F.abs(F.col("day_no") - F.col("g_day_no"))
    near = groups.join(seats, on).filter((F.abs(F.col("cents") - F.col("g_cents")) <= tolerance_cents) & (apart <= days))
    liking = (apart, "day_no", "cents") if mode == NEAREST else ("agent", "cents", "day_no")
    return near.select(*group, *[F.col(c).alias(f"l{i}") if isinstance(c, str) else c.alias(f"l{i}") for i, c in enumerate(liking)],
                       *[F.col(c).alias(f"s_{c}") for c in CLASS], "capacity")


def hand_out(turns: list[tuple], agents: list[str], classes: list[tuple], other: bool) -> list[int]:
    """For each proposer, in order of turn, the class it gets if the group is alone, or -1.

    `classes` are (agent, capacity, cutoff turn or None) in the order of liking; `other` leaves out those of the own agent.
    What is full, or closed to this turn, is so for all later turns and is passed over for good.
    """
    left = [c for _, c, _ in classes]
    after = list(range(1, len(classes) + 1))
    head, out = 0, []
    for turn, agent in zip(turns, agents, strict=True):
        i, before, found = head, -1, -1
        while i < len(classes):
            cutoff = classes[i][2]
            if left[i] == 0 or (cutoff is not None and turn > cutoff):
                if before < 0:
                    head = after[i]
                else:
                    after[before] = after[i]
            elif other and classes[i][0] == agent:
                before = i
            else:
                left[i] -= 1
                found = i
                break
            i = after[i]
        out.append(found)
    return out


def _handed_out(proposers: DataFrame, menus: DataFrame, group: list[str], mode: str, buckets: int) -> DataFrame:
    """Proposals (group, chunk, turn, class and its capacity) of all groups, each alone.

    Most groups are small and a call of Python costs more than they do, so a call takes a bucket of whole groups.
    """
    key = [*group, "chunk"]
    turn_at, seat = len(key), [f"s_{c}" for c in CLASS]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values([*key, *TURN]), right.sort_values([*key, "l0", "l1", "l2"])
        lists = [right[c].tolist() for c in [*key, "s_agent", "capacity"]]
        closed = right["closed"].tolist()
        cutoffs = list(zip(*(right[f"c_{c}"].tolist() for c in TURN), strict=True))
        listed: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(*lists[:turn_at], strict=True)):
            listed.setdefault(at, []).append(i)
        members: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(*(left[c].tolist() for c in key), strict=True)):
            members.setdefault(at, []).append(i)
        turns, agents = list(zip(*(left[c].tolist() for c in TURN), strict=True)), left["agent"].tolist()
        of_agent, capacity = lists[turn_at:]
        takers, taken = [], []
        for at, own in members.items():
            seen = listed.get(at, [])
            classes = [(of_agent[i], capacity[i], cutoffs[i] if closed[i] else None) for i in seen]
            places = hand_out([turns[i] for i in own], [agents[i] for i in own], classes, mode == OTHER_AGENT)
            for i, place in zip(own, places, strict=True):
                if place >= 0:
                    takers.append(i)
                    taken.append(seen[place])
        found, seats = left.iloc[takers], right.iloc[taken]
        return pd.DataFrame({**{c: found[c].to_numpy() for c in [*key, *TURN]}, **{c: seats[c].to_numpy() for c in [*seat, "capacity"]}})

    kinds = {f.name: f.dataType.simpleString() for f in [*proposers.schema, *menus.schema]}
    columns = [*key, *TURN, *seat, "capacity"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
    return proposers.groupBy(bucket).cogroup(menus.groupBy(bucket)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _deferred_acceptance(members: DataFrame, classes: DataFrame, mode: str, tolerance_cents: int, days: int, skew: dict, chunk: int) -> DataFrame:
    group, seat = group_columns(mode), [f"s_{c}" for c in CLASS]
    inside = durable(salted_join(members, classes.select(*CLASS), CLASS, how="inner", **skew))
    menus = durable(_menus(classes, mode, tolerance_cents, days))
    seen = menus.select(*group).distinct()
    proposers = inside.filter("side = 0").select(*[F.col(c[2:]).alias(c) for c in group], "agent", *TURN)
    proposers = durable(ordered_scan(proposers, group, TURN, number="_n").join(seen, group, "left_semi").withColumn(
        "chunk", F.floor((F.col("_n") - 1) / chunk).cast("bigint")).drop("_n"))
    chunks = durable(proposers.groupBy(*group, "chunk").agg(F.min(F.struct(*TURN)).alias("first")))
    cutoffs = proposals = None
    again = chunks.select(*group, "chunk")
    # Every chunk of a group lists the group's menu.
    listed = menus.groupBy(*group).count().join(chunks.groupBy(*group).agg(F.count("*").alias("chunks")), group)
    menu_rows = listed.agg(F.sum(F.col("count") * F.col("chunks"))).first()[0] or 0
    buckets = max(known_rows(proposers), menu_rows) // CALL_ROWS + 1
    while True:
        offered = menus.join(chunks.join(again, [*group, "chunk"], "left_semi"), group)
        if cutoffs is None:
            offered = offered.withColumn("cutoff", F.lit(None).cast("struct<o1:bigint,o2:bigint,id:bigint>"))
        else:
            # Classes closed to the first turn of a chunk are closed to all of it.
            offered = offered.join(cutoffs, seat, "left").filter(F.col("cutoff").isNull() | (F.col("first") <= F.col("cutoff")))
        # Numbers without nulls stay whole numbers in pandas.
        offered = offered.drop("first").withColumns({
            "closed": F.col("cutoff").isNotNull(), **{f"c_{c}": F.coalesce(f"cutoff.{c}", F.lit(0)) for c in TURN}}).drop("cutoff")
        new = _handed_out(proposers.join(again, [*group, "chunk"], "left_semi"), offered, group, mode, buckets)
        kept = None if proposals is None else proposals.join(again, [*group, "chunk"], "left_anti")
        proposals = durable(new if kept is None else kept.unionByName(new))
        crowded = proposals.groupBy(*seat).agg(F.count("*").alias("demand"), F.max("capacity").alias("most")).filter("demand > most").select(*seat)
        ranked = durable(ordered_scan(proposals.join(crowded, seat, "left_semi"), seat, TURN, number="rank"))
        if ranked.isEmpty():
            break
        # The last admitted turn of every overbooked class; a cutoff only ever moves to earlier turns.
        new_cutoffs = ranked.filter("rank = capacity").select(*seat, F.struct(*TURN).alias("new"))
        if cutoffs is not None:
            new_cutoffs = cutoffs.join(new_cutoffs, seat, "full").select(*seat, F.coalesce("new", "cutoff").alias("new"))
        cutoffs = durable(new_cutoffs.withColumnRenamed("new", "cutoff"))
        again = durable(ranked.filter("rank > capacity").select(*group, "chunk").distinct())
    ranked = ordered_scan(proposals.select(*seat, *TURN), seat, TURN, number="rank")
    placed = ordered_scan(
        inside.filter("side = 1").select(*[F.col(c).alias(f"s_{c}") for c in CLASS], F.col("id").alias("seat"), "o1", "o2"),
        seat, ["o1", "o2", "seat"], number="rank").select(*seat, "rank", "seat")
    return ranked.select(*seat, "rank", F.col("id").alias("proposer")).join(placed, [*seat, "rank"]).select("proposer", "seat")


def match_one_to_one(
    proposers: DataFrame,
    seats: DataFrame,
    *,
    mode: str,
    tolerance: str,
    days: int,
    turn: list[str],
    place: list[str],
    island_rows: int,
    hot_rows: int,
    at_most: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """(proposer, seat) ids.  Both inputs have id, agent, amount and day; `turn` and `place` order them.

    `at_most` is an upper bound of the rows of both inputs, if one is known.
    """
    cents = int(round(float(tolerance) * 100))
    skew = {"hot_rows": hot_rows, "at_most": at_most}
    members = _standard(proposers, 0, turn).unionByName(_standard(seats, 1, place))
    classes = durable(islands(members, mode, cents, days, skew))
    size = F.col("island_proposers") + F.col("island_seats")
    if at_most is not None and at_most <= island_rows:
        return _fold_islands(members, classes, mode, cents, days, skew)
    pairs = _fold_islands(members, classes.filter(size <= island_rows), mode, cents, days, skew)
    large = classes.filter(size > island_rows)
    if not large.isEmpty():
        pairs = pairs.unionByName(_deferred_acceptance(members, large, mode, cents, days, skew, chunk))
    return pairs
