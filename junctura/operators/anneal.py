"""Seeded simulated annealing of compatible, evenly spaced primer sets."""

from __future__ import annotations

import math
import time
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Most moves of a run, and least, as the reference has them.
CAP = 100_000_000
FLOOR = 1_000_000


Region = tuple[float, float, bool]


class Cost:
    """Cost of a set, a sum over its regions. One of your own needs ``of`` alone; changes by one point, and those by each of many, are worked out from it unless they are given too."""

    def of(self, points: list[float], region: Region) -> float:
        """Cost of a region with these points, in ascending order."""
        raise NotImplementedError

    def inserted(self, points: list[float], i: int, x: float, region: Region) -> float:
        """What putting ``x`` before the ``i``-th point adds."""
        return self.of([*points[:i], x, *points[i:]], region) - self.of(points, region)

    def removed(self, points: list[float], i: int, region: Region) -> float:
        """What taking the ``i``-th point out adds."""
        return self.of([*points[:i], *points[i + 1 :]], region) - self.of(points, region)

    def inserted_each(self, points: list[float], at: np.ndarray, xs: np.ndarray, region: Region) -> np.ndarray:
        """What putting each of ``xs`` alone before the point of that number in ``at`` adds."""
        return np.array([self.inserted(points, int(i), float(x), region) for i, x in zip(at, xs)], float)


class Tiling(Cost):
    """Bases further than ``d`` from the next point count, and overlaps beyond the share ``rho`` of ``d``; see ``primers.tiling_cost``. A point changes the gaps on its two sides."""

    def __init__(self, d: float, rho: float):
        self.d, self.rho = d, rho

    def _gap(self, width: float, outer: bool) -> float:
        gap = width if outer else width - self.d
        return gap if gap > 0 else max(0.0, -gap - self.d * self.rho)

    def of(self, points: list[float], region: Region) -> float:
        start, end, forward = region
        ends = [start, *points, end]
        last = len(points)
        return sum(self._gap(ends[k + 1] - ends[k], k == 0 if forward else k == last) for k in range(last + 1))

    def _split(self, points: list[float], i: int, after: int, x: float, region: Region) -> tuple[float, float]:
        """The cost of the gap between the points before ``i`` and from ``after`` on, and that of its two parts with ``x`` in it."""
        start, end, forward = region
        low, high = points[i - 1] if i else start, points[after] if after < len(points) else end
        first, last = i == 0, after == len(points)
        whole = self._gap(high - low, first if forward else last)
        return whole, self._gap(x - low, forward and first) + self._gap(high - x, not forward and last)

    def inserted(self, points: list[float], i: int, x: float, region: Region) -> float:
        whole, parts = self._split(points, i, i, x, region)
        return parts - whole

    def removed(self, points: list[float], i: int, region: Region) -> float:
        whole, parts = self._split(points, i, i + 1, points[i], region)
        return whole - parts

    def _gaps(self, width: np.ndarray, outer: np.ndarray | bool) -> np.ndarray:
        gap = np.where(outer, width, width - self.d)
        return np.where(gap > 0, gap, np.maximum(0.0, -gap - self.d * self.rho))

    def inserted_each(self, points: list[float], at: np.ndarray, xs: np.ndarray, region: Region) -> np.ndarray:
        start, end, forward = region
        ends = np.array([start, *points, end], float)
        low, high, first, last = ends[at], ends[at + 1], at == 0, at == len(points)
        parts = self._gaps(xs - low, first & forward) + self._gaps(high - xs, last & (not forward))
        return parts - self._gaps(high - low, first if forward else last)


class MultiTarget(Cost):
    """A region's length while it has no point; otherwise the sum of all points' distances from its inner end, which is the end of a forward region and the start of another."""

    def _far(self, x: float, region: Region) -> float:
        return region[1] - x if region[2] else x - region[0]

    def of(self, points: list[float], region: Region) -> float:
        return sum(self._far(x, region) for x in points) if points else region[1] - region[0]

    def inserted(self, points: list[float], i: int, x: float, region: Region) -> float:
        return self._far(x, region) - (0.0 if points else region[1] - region[0])

    def removed(self, points: list[float], i: int, region: Region) -> float:
        return (region[1] - region[0] if len(points) == 1 else 0.0) - self._far(points[i], region)

    def inserted_each(self, points: list[float], at: np.ndarray, xs: np.ndarray, region: Region) -> np.ndarray:
        return (region[1] - xs if region[2] else xs - region[0]) - (0.0 if points else region[1] - region[0])


def iterations(cap: int, slope: float, intercept: float, floor: int = FLOOR) -> int:
    """Length of a run whose temperature falls from ``intercept`` by ``slope`` a step."""
    return int(max(min(cap, 2 * intercept + abs(round(intercept / slope))), floor))


def temperature(step: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Linear schedule: slope * step + intercept, 1 at least."""
    return F.greatest(F.lit(slope) * step + F.lit(intercept), F.lit(1.0))


class _Known:
    """What was worked out for a set: what moves add, the chances to take them once the temperature is 1, and the sets that they lead to."""

    __slots__ = ("chosen", "gains", "all_gains", "chances", "dead", "alive", "few", "block", "hits", "next")

    def __init__(self, chosen: tuple[int, ...]):
        self.chosen = chosen
        self.gains: dict[int, float] = {}
        self.all_gains: np.ndarray | None = None
        self.chances: np.ndarray | None = None
        self.dead = self.few = False
        self.alive: np.ndarray | None = None
        self.block, self.hits = -1, []
        self.next: dict[int, _Known] = {}


class _Set:
    """The set at hand: each region's points in order, and what each move would add to the cost, worked out when it is first tried.

    What was worked out for a set is remembered within a bound: a cooled run comes back to the same few sets.
    """

    def __init__(self, spots: list[tuple[int, float]], regions: list[Region], near: dict[int, set[int]], apart: float, cost: Cost):
        self.spots, self.regions, self.near, self.apart, self.rule = spots, regions, near, apart, cost
        self.points: list[list[float]] = [[] for _ in regions]
        self.members: list[list[int]] = [[] for _ in regions]
        self.inside = bytearray(len(spots))
        self.cost = 0.0
        self.memory: dict[tuple[int, ...], _Known] = {}
        self.worked_out = 0
        xs = [x for _, x in spots]
        self.ranges = []
        for r in range(len(regions)):
            own = range(bisect_left(spots, r, key=lambda s: s[0]), bisect_right(spots, r, key=lambda s: s[0]))
            self.ranges.append((np.arange(own.start, own.stop), np.array(xs[own.start : own.stop], float)))
        self.driving: dict[int, list[int]] = {}
        for u, others in near.items():
            for v in others:
                self.driving.setdefault(v, []).append(u)
        self._recall()

    def _recall(self) -> None:
        """What is known of the moves from the set that now is."""
        if self.worked_out > REMEMBERED:
            self.memory.clear()
            self.worked_out = 0
        chosen = tuple(u for m in self.members for u in m)
        self.known = self.memory.get(chosen)
        if self.known is None:
            self.known = self.memory[chosen] = _Known(chosen)
        self.worked_out += 16
        self.behind = False

    def _catch_up(self) -> None:
        """Points and members of the set at hand, after ``follow`` has only looked it up."""
        if self.behind:
            self._fill(self.known.chosen)
            self.behind = False

    def every_gain(self) -> np.ndarray:
        """What each move adds: those of members and of what drives others out one by one, all others together."""
        known = self.known
        if known.all_gains is None:
            self._catch_up()
            gains = np.empty(len(self.spots))
            alone = [*known.chosen, *(u for v in known.chosen for u in self.driving.get(v, ()))]
            for (own, xs), points, members, region in zip(self.ranges, self.points, self.members, self.regions):
                gains[own] = self.rule.inserted_each(points, np.searchsorted(members, own) if members else np.zeros(len(own), int), xs, region)
                if self.apart > 0 and points:
                    close = np.searchsorted(points, xs + self.apart, "left") > np.searchsorted(points, xs - self.apart, "right")
                    alone += own[close].tolist()
            for u in set(alone):
                gains[u] = self.gain(u)
            known.all_gains = gains
            self.worked_out += len(self.spots)
        return known.all_gains

    def cold_chances(self) -> np.ndarray:
        """The chance to take each move at a temperature of 1; one that no draw can be below is 0."""
        known = self.known
        if known.chances is None:
            chances = np.where(self.every_gain() <= 0, 1.0, np.exp(-np.maximum(self.every_gain(), 0.0)))
            known.chances = np.where(chances > LEAST, chances, 0.0)
            known.alive = known.chances > 0
            known.dead, known.few = not known.alive.any(), bool(8 * known.alive.sum() <= len(self.spots))
            self.worked_out += 2 * len(self.spots)
        return known.chances

    def follow(self, u: int) -> None:
        """As ``move``, of a set of which every gain is known. Where the move was made before, it is looked up."""
        known = self.known
        further = known.next.get(u)
        if further is None:
            self._catch_up()
            self.move(u)
            if self.memory.get(known.chosen) is known:
                known.next[u] = self.known
        else:
            self.cost += float(known.all_gains[u])
            self.known, self.behind = further, True

    def _fill(self, chosen: tuple[int, ...]) -> None:
        self.inside = bytearray(len(self.spots))
        for r in range(len(self.regions)):
            self.members[r] = [u for u in chosen if self.spots[u][0] == r]
            self.points[r] = [self.spots[u][1] for u in self.members[r]]
        for u in chosen:
            self.inside[u] = 1

    def become(self, chosen: tuple[int, ...]) -> None:
        """Starts over with another set; its cost is summed up anew."""
        self._fill(chosen)
        self.cost = self.whole()
        self._recall()

    def whole(self) -> float:
        return sum(self.rule.of(p, r) for p, r in zip(self.points, self.regions))

    def chosen(self) -> tuple[int, ...]:
        return self.known.chosen

    def driven_out(self, u: int) -> list[int]:
        """Members that don't go with ``u``: its incompatible ones, and those of its region at another place less than ``apart`` away."""
        out = [v for v in self.near.get(u, ()) if self.inside[v]]
        if self.apart > 0:
            r, x = self.spots[u]
            at, members = self.points[r], self.members[r]
            for k in range(bisect_right(at, x - self.apart), bisect_left(at, x + self.apart)):
                if at[k] != x and members[k] not in out:
                    out.append(members[k])
        return out

    def _place(self, u: int) -> int:
        r, x = self.spots[u]
        k = bisect_left(self.points[r], x)
        members = self.members[r]
        while k < len(members) and self.points[r][k] == x and members[k] < u:
            k += 1
        return k

    def gain(self, u: int) -> float:
        """What the move of ``u`` adds: its own change, after those of the members it drives out."""
        known = self.known.gains.get(u)
        if known is None:
            self._catch_up()
            r, x = self.spots[u]
            if self.inside[u]:
                known = self.rule.removed(self.points[r], self._place(u), self.regions[r])
            else:
                out = self.driven_out(u)
                if out:
                    held = [(list(p), list(m)) for p, m in zip(self.points, self.members)]
                    known = sum(self._take(v) for v in out)
                    known += self.rule.inserted(self.points[r], self._place(u), x, self.regions[r])
                    for k, (p, m) in enumerate(held):
                        self.points[k], self.members[k] = p, m
                else:
                    known = self.rule.inserted(self.points[r], self._place(u), x, self.regions[r])
            self.known.gains[u] = known
            self.worked_out += 1
        return known

    def _take(self, v: int) -> float:
        r, k = self.spots[v][0], self._place(v)
        change = self.rule.removed(self.points[r], k, self.regions[r])
        del self.points[r][k], self.members[r][k]
        return change

    def move(self, u: int) -> None:
        self._catch_up()
        self.cost += self.gain(u)
        if self.inside[u]:
            self._take(u)
            self.inside[u] = 0
        else:
            for v in self.driven_out(u):
                self._take(v)
                self.inside[v] = 0
            r, x = self.spots[u]
            k = self._place(u)
            self.points[r].insert(k, x)
            self.members[r].insert(k, u)
            self.inside[u] = 1
        self._recall()


#: Moves that are drawn at a time, and how many such blocks are kept.
BLOCK, KEPT_BLOCKS = 1 << 16, 32


class _Block:
    """Drawn moves and chances; on its second use also where each move is, as runs of equal seed and as many spots share their draws."""

    def __init__(self, moves: np.ndarray, chances: np.ndarray, spots: int):
        self.moves, self.chances, self.spots, self.uses = moves, chances, spots, 0
        self.order: np.ndarray | None = None

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where the draws of the moves are that ``wanted`` holds true."""
        if self.order is None and self.uses > 1:
            kind = np.int16 if self.spots < 1 << 15 else np.int32
            self.order = np.argsort(self.moves.astype(kind), kind="stable").astype(np.int32)
            self.starts = np.searchsorted(self.moves[self.order], np.arange(self.spots + 1))
        if self.order is None:
            return np.flatnonzero(wanted.take(self.moves))
        return np.sort(np.concatenate([self.order[self.starts[u] : self.starts[u + 1]] for u in np.flatnonzero(wanted)]))


#: What the last run of this process has drawn: its key, the blocks, and the generator's state after them.
_DRAWN: list = [None, [], None]


def _blocks(draw: np.random.Generator, spots: int, steps: int) -> Iterator[_Block]:
    """The draws of a run. The first blocks are kept for the next run, which has the same ones if its generator is in the same state."""
    state = draw.bit_generator.state
    key = (spots, steps, repr(state))
    if _DRAWN[0] != key:
        _DRAWN[:] = [key, [], state]
    kept, at = _DRAWN[1], 0
    while at * BLOCK < steps:
        if at < len(kept):
            found = kept[at]
        else:
            if at == len(kept):
                draw.bit_generator.state = _DRAWN[2]
            n = min(BLOCK, steps - at * BLOCK)
            found = _Block(draw.integers(spots, size=n, dtype=np.int32), draw.random(n), spots)
            if at < KEPT_BLOCKS:
                kept.append(found)
                _DRAWN[2] = draw.bit_generator.state
        found.uses += 1
        at += 1
        yield found


#: Moves without a change after which moves are looked at together, and most of them at a time.
SETTLED, TOGETHER = 64, 1 << 14
#: Changes of cost that are remembered.
REMEMBERED = 1_000_000
#: The step between chances that are drawn: at a temperature of 1, a move with no better chance is never taken.
LEAST = 2.0**-53


def anneal(spots: list[tuple[int, float]], regions: list[Region], near: dict[int, set[int]], apart: float, cost: Cost, slope: float, intercept: float, steps: int, seed: int, patience: int = 300_000, every: int = 0, trace: list[tuple[int, float, float, float]] | None = None) -> tuple[float, float, list[int]]:
    """Initial cost, best cost and best set of ``spots``, (region, position) pairs in order.

    Starts from a random primer in each region, in six of them at most, drawn again until they are compatible.
    A move takes a random primer: a member leaves; another one enters and drives out what it is incompatible with,
    that is its ``near`` ones and those of its region at another position less than ``apart`` away. Better
    or equal sets are taken, worse ones with a chance by temperature max(slope * i + intercept, 1).
    After ``patience`` steps without a better set the search goes back to the best.

    A move's cost is a change at the places it touches. Once a set has stayed for ``SETTLED`` moves, all moves' changes are worked out, and
    the following moves are held against the temperature together, up to the first that is taken: a cooled run refuses nearly all. While
    the temperature stays at 1, a set's chances stay the same and are kept, and where only few moves have any, a block's draws are searched for those alone. A best set
    that no move can leave any more ends the run: what is left of its moves is refused.
    With ``every``, ``(step, seconds, best cost, cost)`` are added to ``trace`` each so many steps.
    """
    draw = np.random.default_rng(seed)
    none: set[int] = set()

    def clash(u: int, v: int) -> bool:
        return v in near.get(u, none) or spots[u][0] == spots[v][0] and 0 < abs(spots[u][1] - spots[v][1]) < apart

    within: dict[int, list[int]] = {}
    for u, (r, _) in enumerate(spots):
        within.setdefault(r, []).append(u)
    first: list[int] = []
    for _ in range(1000):
        used = sorted(within) if len(within) <= 6 else sorted(draw.choice(sorted(within), 6, replace=False).tolist())
        first = [within[r][int(draw.integers(len(within[r])))] for r in used]
        if not any(clash(u, v) for u in first for v in first if u < v):
            break
    else:  # hardly any compatible ones: what goes with those before it
        first = [u for k, u in enumerate(first) if not any(clash(u, v) for v in first[:k])]

    began = time.perf_counter()
    held = _Set(spots, regions, near, apart, cost)
    held.become(tuple(sorted(first)))
    begun, best = held.cost, (held.cost, held.chosen())
    age, still, i = 0, 0, 0

    def settle(taken: bool) -> None:
        """After a move: the best set, and the way back to it."""
        nonlocal best, age, still
        still = 0 if taken else still
        if taken and held.cost < best[0]:
            best, age = (held.cost, held.chosen()), 0
        if age > patience:
            held.become(best[1])
            age, still = 0, 0

    blocks, likelier = 0, np.zeros(len(spots), bool)
    for drawn in _blocks(draw, len(spots), steps):
        moves, chances, n = drawn.moves, drawn.chances, len(drawn.moves)
        blocks, k = blocks + 1, 0
        likelier[:] = False
        while k < n:
            known = held.known
            if still < SETTLED and known.all_gains is None:
                u, worse = int(moves[k]), held.gain(int(moves[k]))
                taken = bool(worse <= 0 or chances[k] < math.exp(-worse / max(slope * i + intercept, 1.0)))
                if taken:
                    held.move(u)
                age, still, k, i = age + 1, still + 1, k + 1, i + 1
            else:
                cold = slope <= 0 and slope * i + intercept <= 1
                m = min(n - k, patience + 1 - age, every - i % every if every else n)
                if cold and known.chances is None:
                    held.cold_chances()
                if cold and known.dead:
                    if not every and known.chosen == best[1]:
                        break
                    taken = False
                elif cold and known.few:
                    if known.block != blocks:
                        if (known.alive & ~likelier).any():
                            likelier |= known.alive
                            places = drawn.places(likelier)
                            their_moves, their_chances = moves[places], chances[places]
                        known.block, known.hits = blocks, places[their_chances < known.chances[their_moves]].tolist()
                    at = bisect_left(known.hits, k)
                    taken = at < len(known.hits) and known.hits[at] < k + m
                    m = known.hits[at] - k + 1 if taken else m
                else:
                    m = min(m, max(4 * SETTLED, 2 * still), TOGETHER)
                    if cold:
                        good = chances[k : k + m] < known.chances[moves[k : k + m]]
                    else:
                        worse = held.every_gain()[moves[k : k + m]]
                        heat = np.maximum(slope * np.arange(i, i + m) + intercept, 1.0)
                        good = (worse <= 0) | (chances[k : k + m] < np.exp(-np.maximum(worse, 0) / heat))
                    at = int(good.argmax())
                    taken = bool(good[at])
                    m = at + 1 if taken else m
                if taken:
                    held.follow(int(moves[k + m - 1]))
                age, still, k, i = age + m, still + m, k + m, i + m
            settle(taken)
            if every and i % every == 0 and trace is not None:
                trace.append((i, time.perf_counter() - began, best[0], held.cost))
        if k < n:
            break
    return begun, best[0], list(best[1])


def _schedules(grid: list[tuple[float, float, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(float(m)).alias("slope"), F.lit(float(b)).alias("intercept"), F.lit(seed).cast("long").alias("seed")) for m, b, seed in grid]))


def _spread(runs: DataFrame, design: str, candidates: str) -> DataFrame:
    """Runs are long and their rows small: spread them evenly, in ranges, so that runs of one seed and as many candidates, which have the same draws, follow each other."""
    order = ["seed", "slope", "intercept", F.size(candidates), design]
    return runs.repartitionByRange(_partitions(runs.sparkSession), *order).sortWithinPartitions(*order)


#: From so many designs a partition on, runs of a design may stay together: tasks take about as long, and have designs of one size, whose draws are shared.
MANY = 256
#: Rows that a worker tells at a time.
TOLD = 64
#: Bytes of designs that a worker is given at a time: as Python objects they take ten times as much.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Designs of a primer that are sent as they are, if there are more, and the values that stand for designs otherwise.
_SENT_WHOLE, _MARKS = 1000, 1 << 16


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def many(spark: SparkSession, designs: int) -> bool:
    """Whether so many designs may be dealt to tasks as wholes."""
    return designs >= MANY * _partitions(spark)


def _pairs_within(members: DataFrame, design: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``design, __p, __q`` of rows ``design, __p``, which may repeat: the edges, the lesser end first, that a design holds both ends of, and some that it holds ``__q`` of alone, to be dropped where its primers are known.

    An edge meets the designs of one end, then those of the other. The first ones go along as marks of 16 bits, a row for each edge; a row for each edge
    and design would be as many times more as a primer has designs. Marks let one design in 2^16 / (designs of a primer) too many through.
    """
    held = members.repartition("__p").groupBy("__p").agg(F.collect_set(design).alias("__held"))
    mark = lambda d: (F.pmod(F.xxhash64(d), F.lit(_MARKS)) - _MARKS // 2).cast("smallint")
    few = F.size("__held") <= _SENT_WHOLE
    first = held.select("__p", F.when(few, F.transform("__held", mark)).alias("__marks"), F.when(~few, F.col("__held")).alias("__all"))
    second = held.select(F.col("__p").alias("__q"), "__held")
    ends = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("__p"), F.greatest(src, dst).alias("__q"))
    met = ends.repartition("__p").distinct().join(first, "__p").join(second, "__q")
    both = F.when(F.col("__all").isNull(), F.filter("__held", lambda d: F.array_contains("__marks", mark(d)))).otherwise(F.array_intersect("__held", "__all"))
    return met.select(F.explode(both).alias(design), "__p", "__q")


def anneal_designs(primers: DataFrame, design: str, position: str, start: float, end: float, forward: bool, d: float, rho: float, min_apart: float, grid: list[tuple[float, float, int]], steps: int | None = None) -> DataFrame:
    """One annealing run per design and member of ``grid`` (slope, intercept, seed), of designs that have one region and no graph.

    Primers of a design closer than ``min_apart`` are incompatible. The input of a run is the array of
    its design's candidate positions, and runs of all designs go in parallel. Runs have ``iterations`` moves unless ``steps`` is given.
    Returns ``design, slope, intercept, seed, first_cost, cost, chosen``.
    """
    kind = primers.schema[design].dataType.simpleString()
    names = [design, "slope", "intercept", "seed", "first_cost", "cost", "chosen"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, at, slope, intercept, seed in zip(*[batch[c] for c in (design, "__at", "slope", "intercept", "seed")]):
                x = np.unique(np.asarray(at, float)).tolist()
                moves = iterations(CAP, slope, intercept) if steps is None else steps
                first, cost, held = anneal([(0, v) for v in x], [(start, end, forward)], {}, min_apart, Tiling(d, rho), slope, intercept, moves, int(seed))
                out.append((name, slope, intercept, seed, first, cost, [x[k] for k in held]))
            yield pd.DataFrame(out, columns=names)

    designs = primers.groupBy(design).agg(F.collect_set(F.col(position).cast("double")).alias("__at"))
    runs = designs.select(design, "__at", _schedules(grid).alias("g")).select(design, "__at", "g.*")
    return _spread(runs, design, "__at").mapInPandas(run, f"`{design}` {kind}, slope double, intercept double, seed long, first_cost double, cost double, chosen array<double>")


def anneal_graphs(primers: DataFrame, regions: DataFrame, edges: DataFrame, design: str, primer: str, region: str, position: str, start: str, end: str, forward: str, src: str, dst: str, d: float, rho: float, grid: list[tuple[float, float, int]], cap: int = CAP, floor: int = FLOOR, patience: int = 300_000, cost: Cost | None = None, every: int = 0, dealt: bool = False, members: DataFrame | None = None) -> DataFrame:
    """One annealing run per design and member of ``grid`` (slope, intercept, seed), over its regions and its incompatible pairs.

    The cost is ``Tiling(d, rho)`` unless another ``cost`` is given. With ``dealt``, designs are many (see ``many``), and ``primers`` and ``regions`` already are in as many
    partitions as the session shuffles into, by design: they stay there, and all runs of a design are its task's. Otherwise a design goes once for each run, and runs are spread evenly.
    ``members`` may give the designs and primers of ``primers`` alone, repeated ones too, if they are to be had at less cost.

    ``primers`` has a design's primers, each once, with region and position; ``regions`` its regions; ``edges`` pairs of
    primers that no set may hold together, for all designs alike. A primer that is incompatible with itself is no candidate. A run
    has ``iterations(cap, slope, intercept, floor)`` moves; the reference's ``floor`` is a million. A design
    is the unit of work: its primers, and its pairs out of ``edges``, meet in one task.
    Returns ``design, slope, intercept, seed, steps, first_cost, cost, chosen``; ``chosen`` are primers. With ``every``, rows of the trace come in the same stream: they have
    ``iteration, seconds, min_cost, curr_cost`` instead, each so many moves. ``results_of`` and ``traces_of`` tell them apart.
    """
    rule = cost or Tiling(d, rho)
    kinds = {f.name: f.dataType.simpleString() for f in primers.schema}
    names = [design, "slope", "intercept", "seed", "steps", "first_cost", "cost", "chosen"]
    more = ["iteration", "seconds", "min_cost", "curr_cost"] if every else []

    def rows_of(name, of, at, ps, qs, slope: float, intercept: float, seed: int) -> list[tuple]:
        place = {r["r"]: k for k, r in enumerate(of)}
        pairs = [] if ps is None else sorted(zip(np.asarray(ps).tolist(), np.asarray(qs).tolist()))
        alone = {p for p, q in pairs if p == q}
        found = sorted(((place[p["r"]], p["x"], p["p"]) for p in at if p["r"] in place and p["p"] not in alone))
        index = {p: k for k, (_, _, p) in enumerate(found)}
        near: dict[int, set[int]] = {}
        for p, q in pairs:
            if p in index and q in index:
                near.setdefault(index[p], set()).add(index[q])
                near.setdefault(index[q], set()).add(index[p])
        if not found:
            return []
        steps = iterations(cap, slope, intercept, floor)
        trace: list = []
        first, least, held = anneal([f[:2] for f in found], [(r["a"], r["b"], bool(r["f"])) for r in of], near, 0.0, rule, slope, intercept, steps, int(seed), patience, every, trace)
        result = (name, slope, intercept, seed, steps, first, least, [found[k][2] for k in held], *[None] * len(more))
        return [result, *((name, slope, intercept, seed, None, None, None, None, *t) for t in trace)]

    def told(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names + more)
        return out.astype({c: "Int64" for c in ("steps", "iteration") if c in out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            # runs of one seed follow each other, as they share draws
            for schedule in grid if dealt else [()]:
                for row in zip(*[batch[c] for c in inputs]):
                    rows += rows_of(*row, *schedule)
                    if len(rows) >= TOLD:
                        yield told(rows)
                        rows = []
        if rows:
            yield told(rows)

    spark = primers.sparkSession
    own = primers.select(design, F.struct(F.col(region).alias("r"), F.col(position).cast("double").alias("x"), F.col(primer).alias("p")).alias("__primer"))
    designs = own.groupBy(design).agg(F.collect_list("__primer").alias("__primers"))
    of = regions.groupBy(design).agg(F.array_sort(F.collect_list(F.struct(F.col(region).alias("r"), F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"), F.col(forward).alias("f")))).alias("__regions"))
    pairs = _pairs_within((primers if members is None else members).select(design, F.col(primer).alias("__p")), design, edges, src, dst)
    # each design's pairs lie together before they are gathered, so rows are packed in memory alone
    pairs = (pairs.repartition(_partitions(spark), design) if dealt else pairs.repartition(design)).groupBy(design).agg(F.collect_list("__p").alias("__ps"), F.collect_list("__q").alias("__qs"))
    designs = designs.join(of, design).join(pairs, design, "left")
    inputs = [design, "__regions", "__primers", "__ps", "__qs"]
    if dealt:
        if int(spark.conf.get(_BYTES_SETTING).removesuffix("B").removesuffix("b")) > BATCH_BYTES:
            spark.conf.set(_BYTES_SETTING, BATCH_BYTES)
        runs = designs.select(*inputs).sortWithinPartitions(F.size("__primers"), design)
    else:
        runs = designs.select("*", _schedules(grid).alias("g")).select(*inputs, "g.*")
        inputs += ["slope", "intercept", "seed"]
        runs = _spread(runs, design, "__primers")
    return runs.mapInPandas(run, f"`{design}` {kinds[design]}, slope double, intercept double, seed long, steps long, first_cost double, cost double, chosen array<{kinds[primer]}>" + (", iteration long, seconds double, min_cost double, curr_cost double" if every else ""))


def results_of(runs: DataFrame) -> DataFrame:
    """The results in a stream of results and traces."""
    return runs.filter(F.col("iteration").isNull()).drop("iteration", "seconds", "min_cost", "curr_cost")


def traces_of(runs: DataFrame, design: str) -> DataFrame:
    """The traces: ``design, m, b, run, iteration, seconds, min_cost, curr_cost``."""
    return runs.filter(F.col("iteration").isNotNull()).select(design, F.col("slope").alias("m"), F.col("intercept").alias("b"), F.col("seed").alias("run"), "iteration", "seconds", "min_cost", "curr_cost")


def average_traces(traces: DataFrame) -> DataFrame:
    """Mean curves of runs of one schedule: ``m, b, iteration, min_cost, curr_cost, seconds``."""
    return traces.groupBy("m", "b", "iteration").agg(*[F.avg(c).alias(c) for c in ("min_cost", "curr_cost", "seconds")])
