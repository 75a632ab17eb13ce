"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most `capacity` tokens.  A full piece is a sequence of its
own; the others are dealt by hash into shards of about `SHARD` pieces.  Each shard is solved on
several islands, each with a population of packings.  Crossover injects whole well-filled bins of
one packing into another, removes the bins that hold a piece twice, and best-fits the displaced
pieces; after each epoch an island's elite migrates to the next island.  Pieces of the bins that
stay poorly filled are pooled over all shards and dealt again, until one shard holds them.

Every stage is written to the shared folder; a shard is bounded whatever the input.

Defined cases: a null text counts as empty, and an empty text is one piece that holds the
end-of-document id alone; repeated rows are packed as often as they occur; broken UTF-8
is read as U+FFFD; no rows, no pieces.
"""

from __future__ import annotations

import itertools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.bytesops import chunked, string_bytes
from docspend.llm.common import clean_text, written
from docspend.shipping import ship

CAPACITY, END = 1024, 2
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 3, 2, 5, 6
#: A bin filled less than this fraction is dealt again.
WELL_FILLED = 0.985

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_encoder = None


def encoder():
    """One per Python worker, so that its table of pieces stays warm between tasks."""
    global _encoder
    if _encoder is None:
        from docspend.llm.tokens import Encoder

        _encoder = Encoder()
    return _encoder


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than capacity."""
    first = size % capacity or capacity
    return [(0, min(first, size)), *((at, capacity) for at in range(first, size, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document under the 50k byte-level vocabulary, with the end id after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, uid = encoder(), TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            ids_of = batch.column("doc_id").to_pylist()
            for lo, hi in chunked(offsets):
                ids, ends = enc.batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, out, tail = ids.astype("<u4"), [], np.array([end], "<u4")
                for k in range(hi - lo):
                    whole = np.concatenate([ids[ends[k] : ends[k + 1]], tail])
                    for n, (at, size) in enumerate(cut(len(whole), capacity)):
                        out.append((uid, ids_of[lo + k], n, at, size, zlib.crc32(whole[at : at + size].tobytes())))
                        uid += 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), clean_text().alias("text")).mapInArrow(run, PIECES)


class Packing:
    """One packing of a shard: the bin of each piece, and the free space of each bin."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []

    def fills(self) -> list[int]:
        return [sum(self.sizes[i] for i in b) for b in self.bins]

    def fitness(self) -> float:
        """Mean of the squared fill: full bins beside empty ones are better than equal ones."""
        return sum((f / self.capacity) ** 2 for f in self.fills()) / max(len(self.bins), 1)

    def best_fit(self, items: list[int]) -> None:
        """Put each piece into the bin with the least free space that holds it, else into a new one."""
        free: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fills()):
            if f < self.capacity:
                free.setdefault(self.capacity - f, []).append(b)
                mask |= 1 << (self.capacity - f)
        for i in items:
            s = self.sizes[i]
            above = mask >> s
            if above:
                room = s + (above & -above).bit_length() - 1
                b = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
            if room > s:
                free.setdefault(room - s, []).append(b)
                mask |= 1 << (room - s)

    @classmethod
    def of(cls, sizes: list[int], capacity: int, bin_of: np.ndarray) -> Packing:
        out = cls(sizes, capacity)
        out.bins = [[] for _ in range(int(bin_of.max(initial=-1)) + 1)]
        for i, b in enumerate(bin_of.tolist()):
            out.bins[b].append(i)
        return out

    def bin_of(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def crossed(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """A child of a: well-filled bins of b are injected whole, a's bins that share a piece with them go."""
    fills = b.fills()
    good = [k for k, f in enumerate(fills) if f >= b.capacity * 0.99] or [max(range(len(fills)), key=fills.__getitem__)]
    chosen = rng.sample(good, max(1, len(good) // rng.randint(3, 8)))
    child, taken = Packing(a.sizes, a.capacity), bytearray(len(a.sizes))
    for k in chosen:
        for i in b.bins[k]:
            taken[i] = 1
    displaced: list[int] = []
    for items in a.bins:
        if any(taken[i] for i in items):
            displaced += [i for i in items if not taken[i]]
        else:
            child.bins.append(items[:])
    child.bins += [b.bins[k][:] for k in chosen]
    # mutation: the worst bins are opened too
    worst = sorted(range(len(child.bins)), key=lambda k: sum(child.sizes[i] for i in child.bins[k]))[: rng.randint(1, 4)]
    for k in sorted(worst, reverse=True):
        displaced += child.bins.pop(k)
    displaced.sort(key=lambda i: -a.sizes[i] + rng.random())
    child.best_fit(displaced)
    return child


def evolved(sizes: list[int], capacity: int, seeds: list[np.ndarray], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> list[Packing]:
    """The best packings of one island after some generations; it ends early at the lower bound."""
    rng, least = random.Random(seed), max(-(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))
    pool = [Packing.of(sizes, capacity, x) for x in seeds]
    for k in range(population - len(pool)):
        fresh = Packing(sizes, capacity)
        noise = 0 if k == 0 and not seeds else capacity / 16
        fresh.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] + noise * rng.random()))
        pool.append(fresh)
        if len(fresh.bins) <= least:
            break
    rank = lambda p: (len(p.bins), -p.fitness())
    pool.sort(key=rank)
    for _ in range(generations):
        if len(pool[0].bins) <= least or len(pool) < 2:
            break
        a, b = sorted(rng.sample(range(len(pool)), 2))
        pool += [crossed(pool[a], pool[b], rng), crossed(pool[b], pool[a], rng)]
        pool = sorted(pool, key=rank)[:population]
    return pool


ISLAND = "shard long, island int, lengths array<int>, n_bins int, fitness double, elites array<binary>"


def _evolve(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                sizes = [int(x) for x in row.lengths]
                seeds = [np.frombuffer(x, np.int32) for x in (row.seeds if row.seeds is not None else [])]
                pool = evolved(sizes, capacity, seeds, hash((int(row.shard), int(row.island), epoch)))
                out.append((row.shard, row.island, sizes, len(pool[0].bins), pool[0].fitness(), [p.bin_of().tobytes() for p in pool[:2]]))
            yield pd.DataFrame(out, columns=["shard", "island", "lengths", "n_bins", "fitness", "elites"])

    return run


def _placed(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                bin_of, sizes = np.frombuffer(row.best, np.int32), np.asarray(row.lengths, np.int64)
                order = np.argsort(bin_of, kind="stable")
                total = np.concatenate([[0], np.cumsum(sizes[order])])
                head = np.searchsorted(bin_of[order], np.arange(bin_of.max(initial=-1) + 2))
                fill = np.diff(total[head])
                b = bin_of[order]
                yield pd.DataFrame(
                    {
                        "uid": np.asarray(row.uids, np.int64)[order], "length": sizes[order], "shard": row.shard, "bin": b,
                        "offset": total[:-1] - total[head[b]], "fill": fill[b]
                    }
                )

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """uid, sequence_id, offset for every row of items (uid, length); lengths are 1 to capacity.

    What stands in poorly filled bins is dealt again until one shard holds it, or a round places
    less than a tenth of it: then its bins can hardly be filled better.
    """
    spark, width = items.sparkSession, 1 << 22
    done = items.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    n, before = rest.count(), None
    for r in itertools.count():
        if not n:
            break
        shards = -(-n // shard)
        dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(shards)).alias("shard"))
        base = written(
            dealt.agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("x")).select(
                "shard", F.col("x.uid").alias("uids"), F.expr("transform(x.length, y -> int(y))").alias("lengths")
            ),
            "shards"
        )
        state = base.select(
            "shard", "lengths", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.lit(None).cast("array<binary>").alias("seeds")
        )
        for epoch in range(epochs):
            # a task per few islands, however small the rows are
            spread = state.repartition(min(shards * islands, 4096), "shard", "island")
            state = written(spread.mapInPandas(_evolve(capacity, epoch), ISLAND), "islands")
            if epoch + 1 < epochs:
                migrant = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("migrant"))
                state = state.join(migrant, ["shard", "island"]).select("shard", "lengths", "island", F.concat("migrant", "elites").alias("seeds"))
        best = state.groupBy("shard").agg(
            F.max_by(F.struct(F.element_at("elites", 1).alias("best"), "lengths"), F.struct(-F.col("n_bins"), "fitness", "island")).alias("b")
        )
        solved = best.select("shard", "b.best", "b.lengths").join(base.select("shard", "uids"), "shard")
        placed = written(solved.mapInPandas(_placed(capacity), "uid long, length long, shard long, bin int, offset long, fill long"), "placed")
        last = shards == 1 or before is not None and n > 0.9 * before
        good = F.lit(True) if last else F.col("fill") >= F.lit(int(capacity * WELL_FILLED))
        number = F.lit((r + 1) << 54) + F.col("shard") * F.lit(width) + F.col("bin")
        done = done.unionByName(placed.where(good).select("uid", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = placed.where(~good).select("uid", "length")
        n, before = rest.count(), n
    return done


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with the sequence and the offset of each."""
    cut_up = written(pieces(docs, capacity), "pieces")
    return cut_up.join(packed(cut_up.select("uid", "length"), capacity), "uid").drop("uid")
