"""Best-fit packing of documents into fixed-length token sequences by a grouping genetic algorithm.

Pieces of one length are interchangeable, so the search works on how many pieces there are of each length (at most
`capacity` numbers, however many documents) and on bins as (pattern of lengths, how many such bins). Islands evolve in
separate tasks: crossover injects whole well-filled bins of one parent into the other, the bins that now hold pieces
twice are removed, and what they lose besides is put back by best fit, longest first. A child is then settled: a few of its
bins are emptied and filled anew, again and again, and an exchange that pays is made as often as there are such bins. The
elite of each island migrates to the next one in a ring. Best-fit decreasing gives the first plan; the search ends where no
plan can be shorter, or after PATIENCE epochs that saved no bin. Its effort depends on the lengths, not on the documents.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed each for
itself; an empty table gives no rows; columns besides doc_id and text are ignored. A row's place among pieces of equal
length is arbitrary.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from . import common, tokens

CAPACITY, END_ID = 1024, 2
ISLANDS, EPOCHS, PATIENCE, GENERATIONS, POPULATION = 6, 10, 3, 25, 6
#: Bins that one try to settle a plan empties, and tries for each child.
GROUPS, TRIES = (4, 8, 16, 32, 64), 30

Plan = dict[tuple[int, ...], int]  # from lengths in a bin, longest first, to the number of such bins

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts, add the end id, and cut only what is longer than a sequence; the first piece may be short."""
    path = vocabulary or tokens.vocabulary()

    def start():
        encode, end, seen, part = tokens.encoder(path), np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()

        def step(cols: dict) -> dict:
            rows = []
            for doc, ids in zip(cols["doc_id"], encode(cols["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            return dict(zip([f.split()[0] for f in PIECES.split(", ")], map(list, zip(*rows)), strict=True))

        return step

    return common.map_columns(docs.select("doc_id", "text"), PIECES, start)


def best_fit(counts: dict[int, int], capacity: int, plan: Plan | None = None) -> Plan:
    """Put `counts` pieces of each length into the bins of `plan` and new ones: longest first, each to the fullest bin
    that still takes it. Equal pieces and equal bins are handled together."""
    room: list[Plan] = [{} for _ in range(capacity + 1)]
    open_ = 0  # bit r is set if some bin has room r

    def add(lengths: tuple[int, ...], bins: int, free: int) -> None:
        nonlocal open_
        if bins:
            group = room[free]
            group[lengths] = group.get(lengths, 0) + bins
            open_ |= 1 << free

    for lengths, bins in (plan or {}).items():
        add(lengths, bins, capacity - sum(lengths))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            fits = open_ >> length
            if not fits:
                each = capacity // length
                add((length,) * each, left // each, capacity - length * each)
                if left % each:
                    add((length,) * (left % each), 1, capacity - length * (left % each))
                break
            free = length + (fits & -fits).bit_length() - 1
            lengths, bins = room[free].popitem()
            if not room[free]:
                open_ ^= 1 << free
            each = free // length
            full = min(bins, left // each)
            add(_with(lengths, length, each), full, free - length * each)
            left -= full * each
            if full < bins:
                more = left if left < each else 0
                if more:
                    add(_with(lengths, length, more), 1, free - length * more)
                    left = 0
                add(lengths, bins - full - bool(more), free)
    return {lengths: bins for group in room for lengths, bins in group.items()}


def _with(lengths: tuple[int, ...], length: int, times: int) -> tuple[int, ...]:
    """Lengths in order, longest first, with one of them added some times."""
    if not lengths or lengths[-1] >= length:
        return lengths + (length,) * times
    return tuple(sorted(lengths + (length,) * times, reverse=True))


def score(plan: Plan, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; then bins of uneven filling, which leave the most usable room."""
    bins = sum(plan.values())
    return bins, -sum(n * (sum(p) / capacity) ** 2 for p, n in plan.items()) / max(bins, 1)


def crossover(taker: Plan, giver: Plan, capacity: int, rng: random.Random) -> Plan:
    """Inject well-filled bins of `giver`, remove from `taker` the bins that hold their pieces, refit the displaced."""
    filled = sorted(giver, key=lambda p: (sum(p), rng.random()), reverse=True)
    chosen = [p for p in filled[: max(1, len(filled) // 2)] if rng.random() < 0.5] or filled[:1]
    child: Plan = {p: rng.randint(1, giver[p]) for p in chosen}
    owed = Counter()
    for p, n in child.items():
        for length, k in Counter(p).items():
            owed[length] += n * k
    displaced: Counter = Counter()
    for p in sorted(taker, key=lambda p: (sum(p), rng.random())):
        inside, bins = Counter(p), taker[p]
        need = max((-(-owed[x] // k) for x, k in inside.items() if owed[x] > 0), default=0)
        gone = min(bins, need)
        if gone:
            for x, k in inside.items():
                paid = min(max(owed[x], 0), gone * k)
                owed[x] -= paid
                displaced[x] += gone * k - paid
        if bins > gone:
            child[p] = child.get(p, 0) + bins - gone
    return best_fit({x: n for x, n in displaced.items() if n}, capacity, child)


def fill(pieces: list[int], capacity: int) -> Plan:
    """Bins that begin with the longest piece left and take those of the others that fill them best (sums that can be
    reached are the bits of a number); of equal fillings that of the longest pieces."""
    rest, out = sorted(pieces, reverse=True), Counter()
    while rest:
        free = capacity - rest[0]
        mask, reach, some = (1 << (free + 1)) - 1, [1], []
        for k in range(1, len(rest)):
            if rest[k] <= free:
                some.append(k)
                reach.append((reach[-1] | reach[-1] << rest[k]) & mask)
                if reach[-1] >> free:
                    break
        total, taken = reach[-1].bit_length() - 1, {0}
        for k, before in zip(reversed(some), reversed(reach[:-1]), strict=True):
            if not before >> total & 1:
                taken.add(k)
                total -= rest[k]
        out[tuple(rest[k] for k in sorted(taken))] += 1
        rest = [x for k, x in enumerate(rest) if k not in taken]
    return dict(out)


def mutate(plan: Plan, capacity: int, rng: random.Random) -> Plan:
    """Empty some of the least filled bins and refit what they held."""
    weak = sorted(plan, key=lambda p: (sum(p), rng.random()))[: max(2, len(plan) // 4)]
    rest, displaced = dict(plan), Counter()
    for p in rng.sample(weak, max(1, len(weak) // 2)):
        n = rng.randint(1, rest[p])
        rest[p] -= n
        for x in p:
            displaced[x] += n
    return best_fit(displaced, capacity, {p: n for p, n in rest.items() if n})


def settle(plan: Plan, capacity: int, rng: random.Random, tries: int = TRIES) -> Plan:
    """Again and again empty a few bins, half of them among the least filled, and fill as many anew from their pieces. What
    takes fewer bins, or leaves fuller ones beside emptier ones, stays, and is done as often as there are such bins."""
    plan = dict(plan)
    order = sorted(plan, key=lambda p: (sum(p), p))
    room = [plan[p] * (capacity - sum(p)) + 1e-3 for p in order]
    common = list(plan.values())
    for _ in range(tries):
        some = rng.choice(GROUPS)
        taken = Counter(p for p in [*rng.choices(order, room, k=some // 2), *rng.choices(order, common, k=some // 2)] if plan.get(p))
        if not taken:
            continue
        taken = Counter({p: min(n, plan[p]) for p, n in taken.items()})
        made = fill([x for p, n in taken.items() for x in p * n], capacity)
        if _worth(made, capacity) <= _worth(taken, capacity):
            continue
        times = min(plan[p] // n for p, n in taken.items())
        for p, n in taken.items():
            plan[p] -= n * times
            if not plan[p]:
                del plan[p]
        for p, n in made.items():
            plan[p] = plan.get(p, 0) + n * times
    return plan


def _worth(bins: Plan, capacity: int) -> tuple[int, int]:
    return -sum(bins.values()), sum(n * sum(p) ** 2 for p, n in bins.items())


def evolve(population: list[Plan], capacity: int, seed: int, generations: int, least: int) -> list[Plan]:
    rng = random.Random(seed)
    size = len(population)
    for _ in range(generations):
        if score(population[0], capacity)[0] <= least:
            break
        a, b = rng.sample(range(size), 2) if size > 1 else (0, 0)
        child = crossover(population[a], population[b], capacity, rng) if rng.random() < 0.5 else population[a]
        if rng.random() < 0.2:
            child = mutate(child, capacity, rng)
        child = settle(child, capacity, rng)
        if child not in population:
            population = sorted([*population, child], key=lambda p: score(p, capacity))[:size]
    return population


def bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any plan takes: for each size up to half a bin, the pieces too long to share a bin with one of that size,
    those longer than half, and what the rest needs beyond the room beside these (the bound L2 of Martello and Toth)."""
    n = np.zeros(capacity + 2, np.int64)
    for x, k in counts.items():
        n[x + 1] = k
    many, much = np.cumsum(n), np.cumsum(n * (np.arange(capacity + 2) - 1))  # pieces, and their lengths, below each length
    half, best = capacity // 2 + 1, 0
    for a in range(capacity // 2 + 1):
        long = max(capacity - a + 1, half)
        alone, wide = many[-1] - many[long], many[long] - many[half]
        need = (much[half] - much[a]) - (wide * capacity - (much[long] - much[half]))
        best = max(best, int(alone + wide + max(0, -(-need // capacity))))
    return best


def _frame(island: int, population: list[Plan]) -> dict:
    return {"island": island, "plans": pickle.dumps([list(p.items()) for p in population])}


def search(
    spark, counts: dict[int, int], capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS,
    patience: int = PATIENCE, generations: int = GENERATIONS, population: int = POPULATION, seed: int = 7,
) -> Plan:
    """The best plan found for `counts`; islands are tasks, whose elites migrate between epochs."""
    if not counts:
        return {}
    first = best_fit(counts, capacity)
    least = bound(counts, capacity)
    if score(first, capacity)[0] <= least:
        return first
    rng = random.Random(seed)
    everyone = [[first, *(mutate(first, capacity, rng) for _ in range(population - 1))] for _ in range(islands)]
    bins, since = score(first, capacity)[0], 0
    for epoch in range(epochs):

        def run(frames, epoch=epoch):
            for frame in frames:
                made = []
                for island, plans in zip(frame["island"], frame["plans"], strict=True):
                    group = sorted((dict(p) for p in pickle.loads(plans)), key=lambda p: score(p, capacity))
                    made.append(_frame(island, evolve(group, capacity, seed + 1000 * epoch + int(island), generations, least)))
                yield pd.DataFrame(made, columns=["island", "plans"])

        sent = spark.createDataFrame([_frame(i, p) for i, p in enumerate(everyone)], "island long, plans binary")
        back = sent.mapInPandas(run, "island long, plans binary").collect()  # `islands` rows, each in a slice of its own
        everyone = [[dict(p) for p in pickle.loads(r["plans"])] for r in sorted(back, key=lambda r: r["island"])]
        elites = [min(group, key=lambda p: score(p, capacity)) for group in everyone]
        for i, group in enumerate(everyone):
            group[-1] = elites[i - 1]  # from the neighbour in the ring
        now = min(score(e, capacity)[0] for e in elites)
        bins, since = now, 0 if now < bins else since + 1
        if bins <= least or since >= patience:
            break
    return min((p for group in everyone for p in group), key=lambda p: score(p, capacity))


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on its pieces go to bins from which number on, and to which offset there."""
    out: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    first = 0
    for lengths, bins in sorted(plan.items()):
        offset = 0
        for x in lengths:
            out[x].append((ranks[x], first, offset))
            ranks[x] += bins
            offset += x
        first += bins
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, **search_args) -> DataFrame:
    """One row a piece with the sequence and the offset that it goes to."""
    spark = docs.sparkSession
    common.tune(spark)
    cut, _ = common.written(pieces(docs, capacity, end_id, vocabulary), "pieces")
    counts = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity
    plan = search(spark, {x: n for x, n in counts.items() if x < capacity}, capacity, **search_args)
    if counts.get(capacity):
        plan[(capacity,)] = counts[capacity]
    where = slots(plan)

    # Ranks among equal lengths: a piece knows its number among those of its length in the task that cut it, to which the
    # pieces of the tasks before are added. No task sees all pieces of a length. A row per length and task, beside texts.
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("number") + F.col("before"))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def start():
        def place(batch: pa.RecordBatch) -> pa.RecordBatch:  # in Arrow, where a null among the ids rounds no others
            lengths, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                ranks, bins, offsets = where[int(x)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = bins[k] + rank[at] - ranks[k], offsets[k]
            own = batch.select(columns)
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

        return place

    return common.map_batches(ranked.select(*columns, F.col("rank").cast("long").alias("rank")), start, _parse_datatype_string(PACKED))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
