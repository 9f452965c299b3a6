"""Items packed into containers of fixed capacity by a grouping genetic algorithm.

Items are dealt by hash to shards of about SHARD items; equal ones are numbered first, so no key fills one. On every shard some islands
evolve packings of the same items apart from each other: a crossover injects whole
well-filled containers of one packing into another, drops the containers that hold
an injected item, and puts the displaced items where they fit best. Then each
island's best packing moves to the next island, all evolve again, and the best is
kept. Containers that stayed slack are pooled over all shards, dealt and packed anew.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.session import stage, unstage

#: Items of a shard, on the average; islands of a shard; packings of an island; crossovers of each of two epochs.
SHARD, ISLANDS, PACKINGS, CROSSOVERS = 1_000, 2, 4, 12
#: Most kinds of containers; more are an error.
CAPACITIES = 1_000
#: Islands that one task evolves.
ISLANDS_A_TASK = 8
#: Equal items are numbered in runs of so many.
RUN = 4_096
#: A container filled less is packed anew with those of other shards, so often at most.
SLACK, ROUNDS = 0.98, 2


def _best_fit(sizes: np.ndarray, items: list[int], bins: list[list[int]], left: list[int], capacity: int) -> None:
    """Put items, largest first, into the fullest bin that has room, else into a new one."""
    room = sorted((x, i) for i, x in enumerate(left))
    for j in sorted(items, key=lambda j: (-sizes[j], j)):
        n = int(sizes[j])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            x, i = room.pop(at)
            bins[i].append(j)
        else:
            x, i = capacity, len(bins)
            bins.append([j])
            left.append(0)
        left[i] = x - n
        insort(room, (x - n, i))


def _fitness(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> float:
    return float(np.mean([(sum(sizes[j] for j in b) / capacity) ** 2 for b in bins])) if bins else 1.0


def _cross(sizes: np.ndarray, a: list[list[int]], b: list[list[int]], capacity: int, r: np.random.Generator) -> list[list[int]]:
    """A child of a that has some of b's fullest bins."""
    fill = [sum(int(sizes[j]) for j in x) for x in b]
    order = np.lexsort((r.random(len(b)), [-f for f in fill]))
    n = max(1, int(len(b) * r.uniform(0.2, 0.6)))
    given = [list(b[i]) for i in order[:n]]
    taken = {j for x in given for j in x}
    kept = [list(x) for x in a if taken.isdisjoint(x)]
    bins = given + kept
    have = taken | {j for x in kept for j in x}
    # mutation: the slackest bin and a random one are emptied too
    if len(kept) > 2:
        worst = max(range(len(given), len(bins)), key=lambda i: capacity - sum(int(sizes[j]) for j in bins[i]))
        for i in sorted({worst, int(r.integers(len(given), len(bins)))}, reverse=True):
            have -= set(bins.pop(i))
    left = [capacity - sum(int(sizes[j]) for j in x) for x in bins]
    _best_fit(sizes, [j for j in range(len(sizes)) if j not in have], bins, left, capacity)
    return bins


def _seed(sizes: np.ndarray, capacity: int, r: np.random.Generator, plain: bool) -> list[list[int]]:
    """Best fit by decreasing size, of which a blurred one unless plain."""
    bins: list[list[int]] = []
    if plain:
        _best_fit(sizes, list(range(len(sizes))), bins, [], capacity)
        return bins
    blurred = sizes * r.uniform(0.8, 1.25, len(sizes))
    left: list[int] = []
    room: list[tuple[int, int]] = []
    for j in np.argsort(-blurred, kind="stable").tolist():
        n = int(sizes[j])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            x, i = room.pop(at)
            bins[i].append(j)
        else:
            x, i = capacity, len(bins)
            bins.append([j])
            left.append(0)
        insort(room, (x - n, i))
    return bins


def _evolve(sizes: np.ndarray, capacity: int, packings: list[list[list[int]]], r: np.random.Generator) -> list[list[list[int]]]:
    scored = sorted(((_fitness(sizes, p, capacity), i, p) for i, p in enumerate(packings)), key=lambda x: (-x[0], x[1]))
    least = -(-int(sizes.sum()) // capacity)
    for k in range(CROSSOVERS):
        if len(scored[0][2]) <= least:
            break
        i, j = r.integers(0, len(scored), 2)
        child = _cross(sizes, scored[min(i, j)][2], scored[max(i, j) if i != j else (i + 1) % len(scored)][2], capacity, r)
        scored.append((_fitness(sizes, child, capacity), len(packings) + k, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:PACKINGS]
    return [p for _, _, p in scored]


def _genome(bins: list[list[int]], n: int) -> list[int]:
    g = [0] * n
    for i, b in enumerate(bins):
        for j in b:
            g[j] = i
    return g


def _bins(genome) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(max(genome, default=-1)) + 1)]
    for j, i in enumerate(genome):
        bins[i].append(j)
    return [b for b in bins if b]


def _epoch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of islands (capacity, sizes, packings, seed), with their packings evolved, the best first, and its number of bins and fitness."""
    for df in it:
        out = []
        for x in df.itertuples():
            sizes = np.asarray(x.sizes, np.int64)
            r = np.random.default_rng(np.asarray([x.seed & 0xFFFFFFFF, x.island], np.uint32))
            given = [_bins(np.asarray(g)) for g in x.packings]
            given += [_seed(sizes, x.capacity, r, plain=not given and k == 0) for k in range(max(0, PACKINGS - len(given)))]
            best = _evolve(sizes, x.capacity, given, r)
            out.append(([_genome(p, len(sizes)) for p in best], len(best[0]), _fitness(sizes, best[0], x.capacity)))
        yield df.assign(packings=[o[0] for o in out], bins=[o[1] for o in out], fitness=[o[2] for o in out]).drop(columns=["seed"])


def _numbered(sizes: DataFrame) -> DataFrame:
    """(k, n, o): o tells equal items (same key, same size) apart. They are counted with a map-side combine and written out in runs, so many equal ones are no burden to one task's memory."""
    counted = sizes.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c"))
    runs = counted.select("k", "n", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / RUN))).alias("r"))
    return runs.select("k", "n", F.explode(F.sequence(F.col("r") * RUN, F.least(F.col("c"), (F.col("r") + 1) * RUN) - 1)).alias("o"))


def _pack_once(items: DataFrame, name: str, turn: int) -> DataFrame:
    """(pack_name, capacity, k, part, n, o, container): items (pack_name, capacity, k, part, n, o), each in a container of its shard."""
    count = items.groupBy("pack_name").count()
    shards = {r.pack_name: max(1, -(-r["count"] // SHARD)) for r in count.collect()}  # a row a kind of container
    if not shards:
        return stage(items.withColumn("container", F.lit("")), f"{name}-packed")
    tasks = -(-sum(shards.values()) * ISLANDS // ISLANDS_A_TASK)  # a number of partitions that is given is not merged by size
    many = F.create_map(*(F.lit(x) for kv in shards.items() for x in kv))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(turn), "k", "part", "n", "o"), many[F.col("pack_name")]))
    base = dealt.groupBy("pack_name", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("k", "part", "n", "o"))).alias("items"))
    schema = "pack_name string, capacity int, shard bigint, island int, sizes array<bigint>, packings array<array<int>>, bins int, fitness double"
    base = stage(base, f"{name}-shards")
    seed = F.xxhash64("pack_name", "shard", F.lit(turn))
    spread = lambda d: d.repartition(tasks, "pack_name", "shard", "island")
    start = base.select("pack_name", "capacity", "shard", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), F.col("items.n").alias("sizes"))
    start = spread(start.withColumn("packings", F.array().cast("array<array<int>>")))
    first = stage(start.withColumn("seed", seed).mapInPandas(_epoch, schema), f"{name}-epoch")
    guests = first.select("pack_name", "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("packings")[0].alias("guest"))
    met = spread(first).join(spread(guests), ["pack_name", "shard", "island"]).withColumn("packings", F.concat(F.array("guest"), F.slice("packings", 1, PACKINGS - 1)))
    met = met.withColumn("seed", seed + 1).select("pack_name", "capacity", "shard", "island", "sizes", "packings", "seed")
    second = met.mapInPandas(_epoch, schema)
    best = second.groupBy("pack_name", "shard").agg(F.max_by(F.col("packings")[0], F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("genome"))
    rows = base.join(best, ["pack_name", "shard"]).select("pack_name", "capacity", "shard", F.explode(F.arrays_zip("items", "genome")).alias("x"))
    out = stage(
        rows.select("pack_name", "capacity", "x.items.k", "x.items.part", "x.items.n", "x.items.o", F.concat_ws("-", F.lit(f"r{turn}"), "shard", "x.genome").alias("container")), f"{name}-packed"
    )
    unstage(base, first)
    return out


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(pack_name, container, key, part, size): every item in a container of each capacity.

    An item larger than the capacity is split: full parts, each a container of its
    own, and a rest that is packed; part is 0 for whole items, else counts from 1.
    A null size counts as 0, and items of size 0 take no room in the container they
    are dealt to; null keys are kept, and rows of a repeated key are items of their
    own, also where their sizes are equal. Capacities that are null or not positive
    give no rows; over CAPACITIES kinds of containers are an error. Container names
    are unique within a pack_name and don't depend on partitioning.

    A shard's items (SHARD on the average, dealt by hash of key, size and number)
    are all that one task holds at once, and a task evolves ISLANDS_A_TASK islands;
    items are shuffled once a round and capacity. Slack containers, a few a shard,
    are pooled for a second round.
    """
    kinds = containers.select("pack_name", F.col("capacity").cast("int").alias("capacity")).where("capacity > 0").distinct()
    caps = sorted((r.pack_name, r.capacity) for r in kinds.limit(CAPACITIES + 1).collect())
    if len(caps) > CAPACITIES:
        raise ValueError(f"over {CAPACITIES} kinds of containers")
    every = F.array(*(F.struct(F.lit(p).alias("pack_name"), F.lit(c).alias("capacity")) for p, c in caps)) if caps else F.array().cast("array<struct<pack_name string, capacity int>>")
    known = stage(_numbered(sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("n"))), "sizes")
    items = known.select("k", "n", "o", F.explode(every).alias("c")).select("c.pack_name", "c.capacity", "k", "n", "o")
    whole = items.where("n <= capacity").select("pack_name", "capacity", "k", F.lit(0).alias("part"), "n", "o")
    large = items.where("n > capacity").select("pack_name", "capacity", "k", "n", "o", F.floor(F.col("n") / F.col("capacity")).cast("int").alias("full"))
    full = large.select("pack_name", "capacity", "k", "o", F.col("n").alias("size"), F.explode(F.sequence(F.lit(1), F.col("full"))).alias("part"), F.col("capacity").cast("bigint").alias("n"))
    rest = large.where("n % capacity > 0").select("pack_name", "capacity", "k", (F.col("full") + 1).alias("part"), (F.col("n") % F.col("capacity")).alias("n"), "o")
    todo = stage(whole.unionByName(rest), "items")
    named = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("k").cast("string"), F.lit("null")), "size", "o", "part")
    out = full.select("pack_name", named.alias("container"), "k", "part", "n")
    for turn in range(1, ROUNDS + 1):
        packed = _pack_once(todo, f"round{turn}", turn)
        unstage(todo)
        if turn < ROUNDS:
            slack = packed.groupBy("pack_name", "capacity", "container").agg(F.sum("n").alias("fill")).where(F.col("fill") < SLACK * F.col("capacity")).select("pack_name", "container")
            todo = stage(packed.join(slack, ["pack_name", "container"], "left_semi").select("pack_name", "capacity", "k", "part", "n", "o"), "slack")
            packed = packed.join(slack, ["pack_name", "container"], "left_anti")
        out = out.unionByName(packed.select("pack_name", "container", "k", "part", "n"))
    return out.select("pack_name", "container", F.col("k").alias(key), "part", F.col("n").alias(size))


def report(packed: DataFrame, containers: DataFrame, size: str = "tokens") -> DataFrame:
    """(pack_name, capacity, containers, least, unused): containers used, the fewest that could do, and the share of room left unused."""
    fill = packed.groupBy("pack_name", "container").agg(F.sum(size).alias("fill"))
    total = fill.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("fill"))
    caps = containers.select("pack_name", "capacity").distinct()
    return total.join(F.broadcast(caps), "pack_name").select(
        "pack_name", "capacity", "containers", F.ceil(F.col("fill") / F.col("capacity")).alias("least"),
        (1 - F.col("fill") / (F.col("containers") * F.col("capacity"))).alias("unused"),
    )
