"""Choosing ballots that join the aggregate: for its size, for each contest's size, and against unanimity.

Scores are DataFrames over all ballots. The greedy choices are sequential by nature; the driver makes them over heads of
rankings that stay in Spark: equal ballots of a style are interchangeable but for their order, and bounds that hold whatever
is picked tell when no class outside the head can be better."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import styles as S
from pollveil.operators import tally as T
from pollveil.plans.model import CvrError, Layout
from pollveil.plans.store import cut, numbered

COVERAGE_WEIGHT = 10.0
#: Profiles, and classes of equal ballots of one, that are fetched at once.
HEAD = 2000
#: Profiles of equal score whose classes are fetched in one job.
TIED = 64
#: Contrasting ballots wanted for each contest.
CONTRAST = 3
#: Ranges that a ranking is summed up by at most, and ballots of a range at least.
RANGES, LEAST_RANGE = 1000, 1000


def largest() -> Column:
    """Of styles with is_rare (styles.rare_common): the common one with most ballots, of equals the first seen; null if
    there is none. An aggregate."""
    return F.max(F.when(~F.col("is_rare"), F.struct(F.col("n"), (-F.col("style_ord")).alias("down"), F.col("sig"))))


def largest_common_style(groups: DataFrame, min_ballots: int) -> DataFrame:
    """The common style with most ballots, of equals the first seen: one row or none."""
    return groups.where(F.col("n") >= min_ballots).orderBy(F.desc("n"), "style_ord").limit(1)


def borrow_for_minimum(styled: DataFrame, min_ballots: int) -> DataFrame:
    """Ballots of the largest common style that bring the rare ones up to the minimum: the first ones that are missing,
    or the whole style where fewer than the minimum would be left. No rows if nothing is rare or nothing is missing."""
    found = shortage(styled, min_ballots)
    return borrow(styled, min_ballots, found.rare, found.largest)


def shortage(styled: DataFrame, min_ballots: int) -> Row:
    """rare (how many ballots are), largest."""
    groups = S.rare_common(styled, min_ballots)
    return groups.agg(F.coalesce(F.sum(F.when(F.col("is_rare"), F.col("n"))), F.lit(0)).alias("rare"), largest().alias("largest")).first()


def borrow(styled: DataFrame, min_ballots: int, rare: int, donor: Row | None) -> DataFrame:
    """borrow_for_minimum where the number of rare ballots and `largest` are known."""
    if not 0 < rare < min_ballots:
        return styled.where(F.lit(False))
    if donor is None:
        raise CvrError(f"{rare} rare ballots, fewer than {min_ballots}, and no common style to borrow from")
    needed = min_ballots - rare
    left = donor.n - needed
    own = styled.where(F.col("sig") == donor.sig)
    return own if 0 < left < min_ballots else own.orderBy("ord").limit(needed)


def pool_after(styled: DataFrame, borrowed: DataFrame, min_ballots: int) -> DataFrame:
    """Ballots of common styles without the borrowed ones and without styles that fell below the minimum; n is what is
    left of the style."""
    common = S.with_rarity(styled, min_ballots).where("not is_rare").drop("n", "is_rare")
    rest = common.join(borrowed.select("ord"), "ord", "left_anti")
    left = rest.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= min_ballots)
    return rest.join(left, "sig")


def gain(cells: Column, contest: str, layout: Layout, counts: dict[str, int]) -> Column:
    """How much a ballot narrows a contest's gap between its leading choice and all others."""
    own = layout.contests[contest]
    names = list(dict.fromkeys([*counts, *(layout.choice_name(i) for i in own)]))
    added = {n: sum((((C.strip(F.get(cells, i)) != "") & (C.strip(F.get(cells, i)) != "0")).cast("int") for i in own if layout.choice_name(i) == n), start=F.lit(0)) for n in names}
    total, most = sum(counts.values()), max(counts.values(), default=0)
    new_total = sum((counts.get(n, 0) + added[n] for n in names), start=F.lit(0))
    new_most = F.greatest(*(counts.get(n, 0) + added[n] for n in names), F.lit(0))
    better = F.lit(2 * most - total) - (2 * new_most - new_total)
    return F.when(new_total == total, 0.0).otherwise(F.greatest(better.cast("double"), F.lit(0.0)))


def balancing_scores(pool: DataFrame, layout: Layout, needs: dict[str, int], counts: dict[str, dict[str, int]], min_ballots: int) -> DataFrame:
    """pool's ballots of styles above the minimum that have a needed contest, with covered, coverage, gain, score."""
    wanted = [c for c in layout.contests if needs.get(c, 0) > 0]
    on = {c: F.exists(F.lit(layout.contests[c]), lambda i: C.is_present(F.get("cells", i))) for c in wanted}
    own = pool.where(F.col("n") > min_ballots).withColumn("covered", C.contests_on(F.col("cells"), layout, wanted))
    gains = sum((F.when(on[c], gain(F.col("cells"), c, layout, counts.get(c, {}))).otherwise(0.0) for c in wanted), start=F.lit(0.0))
    own = own.where(F.size("covered") > 0).withColumns({"coverage": F.size("covered"), "gain": gains})
    return own.withColumn("score", COVERAGE_WEIGHT * F.col("coverage") + F.col("gain"))


def find_with_contest(pool: DataFrame, layout: Layout, contest: str, wanted: int, min_ballots: int) -> DataFrame:
    """The first ballots of styles above the minimum that have the contest."""
    has = F.exists(F.lit(layout.contests[contest]), lambda i: C.is_present(F.get("cells", i)))
    return pool.where((F.col("n") > min_ballots) & has).orderBy("style_ord", "ord").limit(wanted)


def as_counts(found: DataFrame) -> dict[str, dict[str, int]]:
    """contest -> choice -> n; as many as a ballot has choices."""
    out: dict[str, dict[str, int]] = {}
    for r in found.collect():
        out.setdefault(r.contest, {})[r.choice] = r.n
    return out


def _row_votes(cells: list[str], layout: Layout) -> tuple[dict[str, Counter], dict[str, Counter]]:
    """Votes by contest and choice: cells that are filled, and what they amount to."""
    ones, amounts = {}, {}
    for contest, own in layout.contests.items():
        for i in own:
            cell = (cells[i] if i < len(cells) else "").strip()
            if cell and cell != "0":
                name = layout.choice_name(i)
                ones.setdefault(contest, Counter())[name] += 1
                try:
                    amount = int(float(cell))
                except ValueError:
                    amount = 1
                amounts.setdefault(contest, Counter())[name] += amount
    return ones, amounts


def _narrows(now: dict[str, int], ones: Counter) -> float:
    if not ones:
        return 0.0
    new = Counter(now) + ones
    gap = lambda c: 2 * max(c.values(), default=0) - sum(c.values())
    return float(max(0, gap(now) - gap(new)))


@dataclass
class _Class:
    """Equal ballots of a style, with their places in order."""

    sig: str
    style_ord: int
    cells: list[str]
    ords: deque[int]

    @property
    def key(self) -> tuple[int, int]:
        return self.style_ord, self.ords[0]


class _Profile:
    """Classes that agree in all contests that are needed, and so in their score. They are loaded by blocks in order of
    style and first place; `low` is the least key that a class not loaded yet can have."""

    def __init__(self, cells: list[str], bound: float, low: tuple[int, int]):
        self.cells, self.bound, self.low, self.after = cells, bound, low, None
        self.loaded: list[tuple[tuple[int, int], int, _Class]] = []
        self.done = False


class Ranking:
    """Classes of equal ballots by profile, and profiles ranked by an upper bound of their score: COVERAGE_WEIGHT for each
    needed contest and one for each vote in such a contest, since a vote narrows a gap by one at most, whatever has been
    picked. So a bound stays true while picks change the counts, and only heads are fetched: of the profiles, until one
    scores more than the bound of the first that was not fetched, and of the classes of the profile that is chosen."""

    def __init__(self, covering: DataFrame, layout: Layout, most: int, min_ballots: int, head: int):
        """covering: the ballots that can be picked at all; most: how many picks there can be."""
        self.layout, self.head, self.min_ballots, self.jobs = layout, head, min_ballots, 0
        # A class gives as many places as picks there can be at most; Spark keeps the first ones before it shuffles.
        first = covering.withColumn("k", F.row_number().over(Window.partitionBy("sig", "cells").orderBy("ord"))).where(F.col("k") <= most)
        self.classes = cut(first.groupBy("sig", "cells").agg(F.min("style_ord").alias("style_ord"), F.min("n").alias("n"), F.sort_array(F.collect_list("ord")).alias("ords")))
        self.picked: set[int] = set()
        self.left: dict[str, int] = {}

    def restart(self, needed: list[str]) -> None:
        """Ranks by the contests that are needed now."""
        columns = [i for c in needed for i in self.layout.contests[c]]
        votes = F.size(F.filter("profile", lambda c: (c != "") & (c != "0")))
        bound = COVERAGE_WEIGHT * F.size(C.contests_on(F.col("cells"), self.layout, needed)) + votes
        self.rank(columns, F.transform(F.lit(columns), lambda i: C.strip(F.get("cells", i))), bound, COVERAGE_WEIGHT)

    def rank(self, columns: list[int], profile: Column, bound: Column, least: float) -> None:
        """Ranks classes of a bound of `least` or more; bound may use the column profile."""
        self.columns = columns
        self.ranked = self.classes.withColumns({"profile": profile, "first": F.get("ords", F.lit(0))}).withColumn("bound", bound).where(F.col("bound") >= least)
        self.profiles: list[_Profile] = []  # by bound
        self.last: tuple[float, int, int] | None = None
        self.all_fetched = False
        self.fetch()

    def fetch(self) -> None:
        """The next profiles."""
        rows = self.ranked.groupBy("profile").agg(F.min(F.struct("style_ord", "first")).alias("low"), F.min("bound").alias("bound")).select("profile", "bound", "low.*")
        if self.last is not None:
            down, style_ord, first = (F.lit(x) for x in self.last)
            rows = rows.where((F.col("bound") < -down) | (F.col("bound") == -down) & _behind(style_ord, first))
        found = rows.orderBy(F.desc("bound"), "style_ord", "first").limit(self.head).collect()
        self.jobs += 1
        self.all_fetched = len(found) < self.head
        for r in found:
            self.profiles.append(_Profile(list(r.profile), r.bound, (r.style_ord, r.first)))
            self.last = -r.bound, r.style_ord, r.first

    def load(self, of: list[_Profile]) -> None:
        """The next classes of some profiles, in one order over all of them."""
        wanted = [F.col("profile") == F.lit(p.cells) if p.after is None else (F.col("profile") == F.lit(p.cells)) & _behind(*map(F.lit, p.after)) for p in of]
        found = self.ranked.where(reduce(or_, wanted)).orderBy("style_ord", "first").limit(self.head).select("profile", "sig", "cells", "n", "ords", "style_ord", "first").collect()
        self.jobs += 1
        by_cells = {tuple(p.cells): p for p in of}
        for r in found:
            self.left.setdefault(r.sig, r.n)
            own = _Class(r.sig, r.style_ord, r.cells, deque(o for o in r.ords if o not in self.picked))
            if own.ords:
                heapq.heappush(by_cells[tuple(r.profile)].loaded, (own.key, id(own), own))
        for p in of:
            p.done = len(found) < self.head
            if found and (p.after is None or p.after < (found[-1].style_ord, found[-1].first)):
                p.low = p.after = found[-1].style_ord, found[-1].first

    def key(self, p: _Profile) -> tuple[tuple[int, int] | None, bool]:
        """The least key that a class of the profile can have (None: it has none left), and whether it is loaded."""
        while p.loaded and self.left[p.loaded[0][2].sig] <= self.min_ballots:
            heapq.heappop(p.loaded)
        if p.done:
            return (p.loaded[0][0], True) if p.loaded else (None, True)
        return (p.loaded[0][0], True) if p.loaded and p.loaded[0][0] <= p.low else (p.low, False)

    def best(self, score) -> _Profile | None:
        """The profile with the best score, of equals that of the first class by style and place, which is loaded; None if
        no class can give."""
        while True:
            found, best, ready, tied = None, None, False, []
            for p in self.profiles:
                if best is not None and p.bound < -best[0]:
                    break
                low, loaded = self.key(p)
                if low is None:
                    continue
                own = (-score(p.cells), *low)
                if not loaded:
                    tied.append((own, p))
                if best is None or own < best:
                    found, best, ready = p, own, loaded
            if not self.all_fetched and (best is None or best > self.last):
                self.fetch()
            elif found is not None and not ready:
                equal = sorted((x for x in tied if x[0][0] == best[0]), key=lambda x: x[0])
                self.load([p for _, p in equal[:TIED]])  # those of equal score come next
            else:
                return found

    def take(self, p: _Profile) -> tuple[int, _Class]:
        """The place of the profile's first class, which is gone then."""
        _, _, own = heapq.heappop(p.loaded)
        place = own.ords.popleft()
        self.picked.add(place)
        self.left[own.sig] -= 1
        if own.ords:
            heapq.heappush(p.loaded, (own.key, id(own), own))
        return place, own


def _behind(style_ord: Column, first: Column) -> Column:
    return (F.col("style_ord") > style_ord) | (F.col("style_ord") == style_ord) & (F.col("first") > first)


def cover_contests(pool: DataFrame, layout: Layout, needs: dict[str, int], counts: dict[str, dict[str, int]], min_ballots: int, head: int = HEAD) -> list[int]:
    """Places of ballots picked one by one: each time the best score under what was picked before, of equals the first
    by style and place, until no contest needs more or no style can give. A style gives while it is above the minimum.
    The pool stays in Spark: a job or two for each contest that has enough, and one for each further head."""
    return _cover(pool, layout, needs, counts, min_ballots, head)[0]


def _cover(pool: DataFrame, layout: Layout, needs: dict[str, int], counts: dict[str, dict[str, int]], min_ballots: int, head: int) -> tuple[list[int], int]:
    """The picks, and how many jobs they took besides the classes' table."""
    needs, counts = {c: n for c, n in needs.items() if n > 0}, {c: dict(x) for c, x in counts.items()}
    picked: list[int] = []
    if not needs:
        return picked, 0
    covering = pool.where((F.col("n") > min_ballots) & (F.size(C.contests_on(F.col("cells"), layout, list(needs))) > 0))
    ranking, ranked_for = Ranking(covering, layout, sum(needs.values()), min_ballots, head), None
    while needs:
        if ranked_for != set(needs):
            ranked_for = set(needs)
            ranking.restart([c for c in layout.contests if c in needs])
        at = {i: (c, layout.choice_name(i)) for c in needs for i in layout.contests[c]}

        def score(profile: list[str]) -> float:
            present, ones = set(), {}
            for i, cell in zip(ranking.columns, profile, strict=True):
                if cell:
                    present.add(at[i][0])
                    if cell != "0":
                        ones.setdefault(at[i][0], Counter())[at[i][1]] += 1
            return COVERAGE_WEIGHT * len(present) + sum(_narrows(counts.get(c, {}), own) for c, own in ones.items())

        profile = ranking.best(score)
        if profile is None:
            break
        place, own = ranking.take(profile)
        covered = [c for c in needs if any(i < len(own.cells) and own.cells[i].strip() for i in layout.contests[c])]
        picked.append(place)
        for contest, votes in _row_votes(own.cells, layout)[1].items():
            for name, n in votes.items():
                counts.setdefault(contest, {})[name] = counts.get(contest, {}).get(name, 0) + n
        for contest in covered:
            needs[contest] -= 1
            if needs[contest] <= 0:
                del needs[contest]
    return picked, ranking.jobs


def contrast_scores(pool: DataFrame, layout: Layout, winners: dict[str, str], min_ballots: int) -> DataFrame:
    """pool's ballots of styles above the minimum that vote against the winner in a flagged contest, with satisfied (the
    contests) and score (how many)."""
    each = []
    for contest, winner in winners.items():
        own = layout.contests.get(contest, [])
        first = next((i for i in own if layout.columns[i].choice == winner), None)
        if first is None:
            continue
        others = [i for i in own if i != first]
        against = (C.strip(F.get("cells", F.lit(first))) != "1") & (F.size("cells") > first) & (F.exists(F.lit(others), lambda i: C.strip(F.get("cells", i)) == "1") if others else F.lit(False))
        each.append(F.when(against, F.lit(contest)))
    satisfied = F.array_compact(F.array(*each)) if each else F.expr("cast(array() as array<string>)")
    own = pool.where(F.col("n") > min_ballots).withColumn("satisfied", satisfied)
    return own.where("size(satisfied) > 0").withColumn("score", F.size("satisfied"))


def pick_contrast(scored: DataFrame, winners: dict[str, str], min_ballots: int, mode: str) -> list[int]:
    """Places of contrasting ballots, by score and place.

    spec: up to CONTRAST ballots for each flagged contest, and no style gives more than it has above the minimum; of each
    style and set of contests only the first few can be picked, and only those reach the driver.
    compat: keeps the historical stopping rule, which looks at the first rows of the ranking and not at the rows that were
    picked; the ranking stays in Spark."""
    ranked = ["score", "style_ord", "ord"]
    if mode == "spec":
        few = CONTRAST * len(winners)
        top = scored.withColumn("k", F.row_number().over(Window.partitionBy("sig", "satisfied").orderBy("ord"))).where(F.col("k") <= few)
        have, given, picked = Counter(), Counter(), []
        for r in top.orderBy(F.desc("score"), "style_ord", "ord").select("sig", "n", "satisfied", *ranked).toLocalIterator():
            if given[r.sig] < r.n - min_ballots and any(have[c] < CONTRAST for c in r.satisfied):
                picked.append(r.ord)
                given[r.sig] += 1
                have.update(r.satisfied)
        return picked
    return _pick_historical(scored, winners)


class _RankIndex:
    """The ranking of ballots by ranges of ranks: how many of each set of contests a range holds. Single ranks come from
    the one range that is looked at. What the driver holds is bounded by the sets times RANGES, and by one range."""

    def __init__(self, scored: DataFrame):
        ranked = numbered(scored.select((-F.col("score")).alias("down"), "style_ord", "ord", "satisfied"), "down", "style_ord", "ord", to="rank")
        self.rows = cut(ranked.select("rank", "ord", "satisfied"))
        n = self.rows.count()
        self.width = max(LEAST_RANGE, -(-n // RANGES))
        found = self.rows.groupBy(F.floor((F.col("rank") - 1) / self.width).cast("int").alias("range"), "satisfied").agg(F.count("*").alias("n")).collect()
        self.counts: dict[int, dict[tuple[str, ...], int]] = {}
        for r in found:
            self.counts.setdefault(r.range, {})[tuple(r.satisfied)] = r.n
        self.before = [Counter()]  # contests in all ranges before each
        for k in range(len(self.counts)):
            total = Counter(self.before[-1])
            for names, n in self.counts[k].items():
                for c in names:
                    total[c] += n
            self.before.append(total)
        self.able = set(self.before[-1])
        self._held: dict[int, list[tuple[int, tuple[str, ...]]]] = {}

    def range(self, k: int) -> list[tuple[int, tuple[str, ...]]]:
        """(place, contests) of a range's ballots, in order."""
        if k not in self._held:
            while len(self._held) > 1:  # the one that is read and the one that is counted
                self._held.pop(next(iter(self._held)))
            found = self.rows.where((F.col("rank") > k * self.width) & (F.col("rank") <= (k + 1) * self.width)).orderBy("rank").collect()
            self._held[k] = [(r.ord, tuple(r.satisfied)) for r in found]
        return self._held[k]

    def next(self, rank: int, needed: set[str]) -> tuple[int, int, tuple[str, ...]] | None:
        """(rank, place, contests) of the first ballot behind `rank` (from 0) that has a needed contest."""
        for k in range(rank // self.width, len(self.counts)):
            if any(needed.intersection(names) for names in self.counts[k]):
                for i, (place, names) in enumerate(self.range(k)):
                    if k * self.width + i >= rank and needed.intersection(names):
                        return k * self.width + i, place, names
        return None

    def prefix(self, n: int) -> Counter:
        """How many of the first n ballots have each contest."""
        k, rest = divmod(n, self.width)
        total = Counter(self.before[min(k, len(self.before) - 1)])
        if rest and k < len(self.counts):
            for _, names in self.range(k)[:rest]:
                total.update(names)
        return total


def _pick_historical(scored: DataFrame, winners: dict[str, str]) -> list[int]:
    """Ballots in order of the ranking, each if it has a needed contest. Once none is needed, those are needed again that
    have fewer than CONTRAST among the first rows of the ranking, as many as were picked: the historical rule."""
    index, needed, picked, rank = _RankIndex(scored), set(winners), [], 0
    while needed & index.able:
        found = index.next(rank, needed)
        if found is None:
            break
        at, place, names = found
        picked.append(place)
        rank = at + 1
        needed -= set(names)
        if not needed:
            prefix = index.prefix(len(picked))
            needed = {c for c in winners if prefix[c] < CONTRAST}
    return picked
