"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Capacity in
words flows from patterns to the quotas of their sources; each further pass over a pattern's
documents costs more than the one before (convex), so repetition is spread and comes last.
The whole passes of a pattern take all of its documents; the rest takes documents in a seeded
order up to a cut, which is found by counting, digit by digit, without sorting documents. A
document that crosses the rest is passed over, and the cut goes on over those that still fit,
until none does. Where larger ones are left then, one of them is tried before the others.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lendlens.llm.common import WORD, free_name, local_table
from lendlens.session import materialize

REPEATS = 3
WEIGHTS = (1, 2, 3)
DIGIT, DIGITS = 12, 5  # the seeded rank has 60 bits; a round sums at most 4096 counts per pattern
RANKS = 1 << DIGIT * DIGITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pattern_of(members: Column) -> Column:
    """The set of sources as text; a null source is a source of its own, a null array the empty set."""
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(members))), F.lit("[]"))


def seeded_rank(docs: DataFrame, key: str, text: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(docs[key], docs[text], F.lit(seed)), 4)


def quotas(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS) -> dict[str | None, float]:
    """Shares of the total by weight; a target stops at `most` times its size, the excess is reshared.

    Sources stand in code point order, null last, and take the weights in turn.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        target.update({s: float(most * sizes[s]) for s in over})
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return {s: target[s] for s in names}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a cheapest greatest flow.

    Successive shortest paths with potentials.
    """
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
    height = [0] * nodes
    while True:
        far, via, queue = [float("inf")] * nodes, [-1] * nodes, [(0, source)]
        far[source] = 0
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and (new := d + cost[e] + height[x] - height[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if via[sink] < 0:
            return [room[2 * i + 1] for i in range(len(arcs))]
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def route(patterns: dict[str, int], target: dict[str | None, float], most: int = REPEATS) -> dict[str, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources."""
    names, keys = list(target), list(patterns)
    source, sink = 0, 1
    of_pattern = {p: 2 + i for i, p in enumerate(keys)}
    of_source = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    arcs = [(source, of_pattern[p], patterns[p], again * again) for p in keys for again in range(most)]
    routes = [(p, s) for p in keys for s in json.loads(p) if s in of_source]
    first = len(arcs)
    arcs += [(of_pattern[p], of_source[s], most * patterns[p], 0) for p, s in routes]
    arcs += [(of_source[s], sink, round(target[s]), 0) for s in names]
    flow = min_cost_flow(arcs, source, sink, 2 + len(keys) + len(names))
    found: dict[str, dict[str | None, int]] = {p: {} for p in keys}
    for (p, s), f in zip(routes, flow[first:]):
        found[p][s] = f
    return found


@dataclass
class Mix:
    """For each pattern its whole passes and the steps of the rest; for each source size and target.

    A step (from, upto, limit) takes the documents of a rank in [from, upto) and of at most `limit`
    words, none if it is -1. The steps of a pattern cover all ranks once.
    """

    passes: list[tuple[str, int, int, int, int]]
    sources: list[tuple[str | None, int, float]]
    seed: int

    def table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.passes, pa.schema([
            ("_pattern", pa.string()), ("_whole", pa.int64()), ("_from", pa.int64()), ("_upto", pa.int64()), ("_limit", pa.int64())]))

    def source_table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.sources, pa.schema([
            ("_source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())]))


@dataclass
class Cut:
    """How far the rest of a pattern is filled: the words missing, where to go on, the steps so far."""

    gap: int
    start: int = 0
    steps: tuple[tuple[int, int, int], ...] = ()


def next_cuts(sizes: DataFrame, state: dict[str, Cut], forced: dict[str, int]) -> dict[str, Cut]:
    """One step more for each pattern: the documents in the seeded order, of at most the words missing, up to the one that crosses.

    Each round counts words by the next digit of the rank within the digit where the last
    count crossed, and ends when a single document is left there. Patterns without a document
    that fits are left out.
    """
    spark, found = sizes.sparkSession, {}
    inner = [(p, 0, c.gap, c.start, c.gap, forced.get(p)) for p, c in state.items()]
    for level in range(DIGITS):
        if not inner:
            break
        below = DIGIT * (DIGITS - 1 - level)
        known = local_table(spark, inner, pa.schema([
            ("pattern", pa.string()), ("prefix", pa.int64()), ("rest", pa.int64()), ("start", pa.int64()),
            ("limit", pa.int64()), ("forced", pa.int64())]))
        counted = sizes.join(known, "pattern") \
            .where("size > 0 and size <= limit and rank >= start and not rank <=> forced") \
            .where(F.shiftrightunsigned("rank", below + DIGIT) == F.col("prefix")) \
            .groupBy("pattern", "rest", F.shiftrightunsigned("rank", below).alias("digit")) \
            .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("digit"))
        crossing = counted.withColumn("upto", upto).groupBy("pattern").agg(
            F.sum("words").alias("words"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", "words", "docs", "upto", "rest"))).alias("c"))
        inner = []
        for pattern, words, c in crossing.collect():
            was = state[pattern]
            if c is None:
                found[pattern] = Cut(was.gap - words, RANKS, was.steps + ((was.start, RANKS, was.gap),))
                continue
            cut, gap = max(c["digit"] << below, was.start), c["rest"] - (c["upto"] - c["words"])
            # Rows of one rank are taken alike; where they cross together, they are passed over.
            alike = c["docs"] > 1 and not below
            steps = ((was.start, cut, was.gap),) + ((cut, cut + 1, -1),) * alike
            found[pattern] = Cut(gap, cut + alike, was.steps + steps)
            if c["docs"] > 1 and below:
                inner.append((pattern, c["digit"], gap, was.start, was.gap, forced.get(pattern)))
    return found


def seeded_cuts(sizes: DataFrame, rest: dict[str, int], forced: dict[str, int] | None = None) -> dict[str, Cut]:
    """For each pattern the documents in the seeded order that fit into the rest, each that does not being passed over.

    What is missing in the end is less than any document left, or than rows of one rank together.
    The forced document of a pattern is not looked at.
    """
    cuts = {p: Cut(r) for p, r in rest.items()}
    state = {p: c for p, c in cuts.items() if c.gap > 0}
    while state:
        found = next_cuts(sizes, state, forced or {})
        cuts.update(found)
        state = {p: c for p, c in found.items() if c.gap > 0 and c.start < RANKS}
    return cuts


def exchanged(sizes: DataFrame, rest: dict[str, int], cuts: dict[str, Cut]) -> tuple[dict[str, Cut], dict[str, int]]:
    """Where documents are left that are larger than the words missing, the smallest of them is taken first
    and the others fill up, if fewer words are missing then. Returns all cuts, and the ranks taken first."""
    spark = sizes.sparkSession
    open_ = [(p, c.gap, rest[p], f, u, w) for p, c in cuts.items() if c.gap > 0 for f, u, w in c.steps + ((c.start, RANKS, -1),)]
    if not open_:
        return cuts, {}
    known = local_table(spark, open_, pa.schema([
        ("pattern", pa.string()), ("gap", pa.int64()), ("rest", pa.int64()), ("from", pa.int64()), ("upto", pa.int64()), ("limit", pa.int64())]))
    # Rows of one rank are taken alike, so they are one document here.
    left = sizes.join(known, "pattern").where("rank >= from and rank < upto and size > limit and size > 0 and size <= rest") \
        .groupBy("pattern", "rank", "rest", "gap").agg(F.sum("size").alias("size")).where("size <= rest and size > gap") \
        .groupBy("pattern").agg(F.min(F.struct("size", "rank")).alias("c"))
    first = {p: c for p, c in left.collect()}
    forced = {p: c["rank"] for p, c in first.items()}
    again = seeded_cuts(sizes, {p: rest[p] - c["size"] for p, c in first.items()}, forced)
    better = {p: c for p, c in again.items() if c.gap < cuts[p].gap}
    return cuts | better, {p: forced[p] for p in better}


def covering(cut: Cut, forced: int | None) -> list[tuple[int, int, int]]:
    """The steps over all ranks, none twice; the forced rank has a step of its own that takes any size."""
    found = []
    for start, upto, limit in cut.steps + ((cut.start, RANKS, -1),):
        if forced is not None and start <= forced < upto:
            found += [(start, forced, limit), (forced, forced + 1, RANKS), (forced + 1, upto, limit)]
        else:
            found.append((start, upto, limit))
    return [x for x in found if x[0] < x[1]]


def plan_mix(docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text",
             weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS, seed: int = 1) -> Mix:
    """Quotas, flow and cuts for documents that belong to one or more sources.

    `members` is an array of sources; the size of a source is that of all its documents. Texts
    that are null or empty have size 0 and are taken with 0 words. Rows that repeat count each
    and are taken alike. An empty table gives an empty mix.
    """
    sizes = materialize(docs.select(
        pattern_of(members).alias("pattern"), word_count(docs[text]).alias("size"),
        seeded_rank(docs, key, text, seed).alias("rank")), "sizes")
    patterns = {r[0]: r[1] for r in sizes.groupBy("pattern").agg(F.sum("size")).collect()}
    of_source: dict[str | None, int] = {}
    for pattern, size in patterns.items():
        for s in json.loads(pattern):
            of_source[s] = of_source.get(s, 0) + size
    target = quotas(of_source, weights, most)
    given = {p: sum(f.values()) for p, f in route(patterns, target, most).items()}
    whole = {p: given[p] // patterns[p] if patterns[p] else 0 for p in patterns}
    rest = {p: given[p] - whole[p] * patterns[p] for p in patterns}
    cuts, forced = exchanged(sizes, rest, seeded_cuts(sizes, rest))
    return Mix([(p, whole[p], *step) for p in sorted(patterns) for step in covering(cuts[p], forced.get(p))],
               [(s, of_source[s], float(target[s])) for s in target], seed)


def with_copies(docs: DataFrame, mix: Mix, members: Column, key: str = "doc_id", text: str = "text",
                name: str = "copies") -> DataFrame:
    """Adds how often each document is taken (0 to the number of repeats)."""
    passes = mix.table(docs.sparkSession)
    # The document travels as one struct, so that none of its columns can clash with those of the plan.
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_document")
    ranked = docs.select(whole, seeded_rank(docs, key, text, mix.seed).alias("_rank"), pattern_of(members).alias("_of"),
                         word_count(docs[text]).alias("_size"))
    joined = ranked.join(passes, (F.col("_of") == F.col("_pattern")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
    copies = F.col("_whole") + (F.col("_size") <= F.col("_limit")).cast("long")
    return joined.select("_document.*", copies.alias(name))


def mixed(docs: DataFrame, members: Column, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    mix, name = plan_mix(docs, members, **how), free_name("_copies_in_mix", docs)
    keys = {k: v for k, v in how.items() if k in ("key", "text")}
    rows = with_copies(docs, mix, members, name=name, **keys).where(F.col(name) > 0)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(docs.columns)
