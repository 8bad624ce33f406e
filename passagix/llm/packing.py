"""Best-fit packing: a grouping genetic algorithm.

Documents become token pieces of at most a sequence's length. Full pieces are sequences of their own. The
others are dealt by a hash into cells of about CELL pieces, so that a packing fits one task whatever the
corpus. Each cell is packed by several islands, each with a population of packings: crossover injects whole
well-filled bins of one packing into another, takes out the bins that hold a piece twice, and best-fits the
displaced pieces. Between epochs each island keeps its population, and its best packing moves on to the next
island, where it takes the place of the worst; at the end the best of all is the cell's. Where an epoch ends,
its populations are written to the shared folder. Epochs end when every cell is at its lower bound.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagix.llm.common import discarded, settled, ship, table
from passagix.llm.tokens import encoder, public

LENGTH = 2048
#: Pieces of a cell, islands of a cell, epochs (one migration fewer), packings of an island, crossovers of an epoch.
CELL, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 16384, 2, 4, 6, 40
SEED = 31


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document: its ids, then id 0. Null texts count as empty."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t or ""), 0).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), length)):
                    rows.append(i)
                    out.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            x = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(x[:, 0].astype(np.int32)), *(pa.array(x[:, j]) for j in (1, 2, 3))], names=[f.name for f in schema.fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fills: list[int], length: int, largest_first: bool = True) -> None:
    """Puts items, largest first or as they come, each into the fullest bin that has room, or a new one. Changes bins and fills."""
    room = sorted((length - f, i) for i, f in enumerate(fills))
    for x in sorted(items, key=lambda i: (-sizes[i], i)) if largest_first else items:
        s = sizes[x]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, i = room.pop(at)
            bins[i].append(x)
            fills[i] += s
        else:
            i, r = len(bins), length
            bins.append([x])
            fills.append(s)
        insort(room, (r - s, i))


def fitness(fills: list[int], length: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those that are less even."""
    return -len(fills), float(np.square(np.asarray(fills, float) / length).sum())


def crossover(sizes: list[int], into: tuple[list, list], of: tuple[list, list], rng: np.random.Generator, length: int) -> tuple[list[list[int]], list[int]]:
    """A packing of all items: into's, with some of the better filled bins of `of` instead of those that they overlap."""
    bins, fills = of
    order = np.argsort(-np.asarray(fills), kind="stable")
    good = order[: max(1, len(order) * 3 // 4)]
    # Bins that the other has as well would change nothing.
    own = {tuple(sorted(b)) for b in into[0]}
    good = [int(i) for i in good if tuple(sorted(bins[int(i)])) not in own]
    if not good:
        good = [int(order[0])]
    take = rng.choice(len(good), size=max(1, min(len(good), int(len(bins) * rng.uniform(0.02, 0.3)))), replace=False)
    new = [list(bins[good[int(i)]]) for i in take]
    inside = {x for b in new for x in b}
    loose: list[int] = []
    kept, kept_fills = [], []
    for b, f in zip(*into, strict=True):
        if any(x in inside for x in b):
            loose += [x for x in b if x not in inside]
        else:
            kept.append(list(b))
            kept_fills.append(f)
    # The emptiest bin's items look for room elsewhere too.
    if kept:
        i = min(range(len(kept)), key=kept_fills.__getitem__)
        loose += kept.pop(i)
        kept_fills.pop(i)
    kept += new
    kept_fills += [sum(sizes[x] for x in b) for b in new]
    best_fit(sizes, loose, kept, kept_fills, length)
    return kept, kept_fills


def from_labels(sizes: list[int], labels: list[int]) -> tuple[list[list[int]], list[int]]:
    bins: dict[int, list[int]] = {}
    for i, g in enumerate(labels):
        bins.setdefault(g, []).append(i)
    return list(bins.values()), [sum(sizes[i] for i in b) for b in bins.values()]


def evolve(sizes: list[int], given: list[list[int]], seed: tuple[int, ...], length: int = LENGTH, population: int = POPULATION, crossovers: int = CROSSOVERS) -> list[int]:
    """The bin of each item in the best packing found (see evolved)."""
    return evolved(sizes, given, seed, length, population, crossovers)[0]


def evolved(sizes: list[int], given: list[list[int]], seed: tuple[int, ...], length: int = LENGTH, population: int = POPULATION, crossovers: int = CROSSOVERS) -> list[list[int]]:
    """The population after so many crossovers, the bin of each item in each packing, best packing first; only that one if it is at the lower bound.

    given: packings to start from, of which the best are kept if they are too many; the rest of the population are shuffled best fits.
    """
    rng = np.random.default_rng(list(seed))
    n = len(sizes)
    lower = -(-sum(sizes) // length)
    group = [from_labels(sizes, g) for g in given]
    if not group:
        bins, fills = [], []
        best_fit(sizes, list(range(n)), bins, fills, length)
        group.append((bins, fills))
    group = sorted(group, key=lambda g: fitness(g[1], length), reverse=True)[:population]
    while len(group) < population and len(group[0][0]) > lower:
        # Some pieces come first, in no order; the rest are best-fitted around them.
        bins, fills = [], []
        best_fit(sizes, rng.permutation(n)[: int(n * rng.uniform(0.02, 0.2))].tolist(), bins, fills, length, largest_first=False)
        done = {x for b in bins for x in b}
        best_fit(sizes, [x for x in range(n) if x not in done], bins, fills, length)
        group.append((bins, fills))
    score = [fitness(f, length) for _, f in group]
    for _ in range(crossovers):
        top = max(range(len(group)), key=score.__getitem__)
        if len(group[top][0]) <= lower or len(group) < 2:
            break
        a, b = (max(rng.choice(len(group), 2, replace=False).tolist(), key=score.__getitem__) for _ in range(2))
        if a == b:
            b = int(rng.integers(len(group)))
        child = crossover(sizes, group[a], group[b], rng, length)
        got = fitness(child[1], length)
        worst = min(range(len(group)), key=score.__getitem__)
        if got > score[worst] and got not in score:
            group[worst], score[worst] = child, got
    order = sorted(range(len(group)), key=score.__getitem__, reverse=True)
    if len(group[order[0]][0]) <= lower:
        order = order[:1]
    out = []
    for g in order:
        labels = [0] * n
        for i, b in enumerate(group[g][0]):
            for x in b:
                labels[x] = i
        out.append(labels)
    return out


#: labels: of each packing of an island, best first; over: bins of the best beyond the lower bound.
ISLAND = "cell long, island int, items array<long>, sizes array<int>, labels array<array<int>>, n_bins int, over int"


def _island(cell: int, island: int, ids: list[int], sizes: list[int], labels: list[list[int]], length: int) -> pd.DataFrame:
    bins = max(labels[0], default=-1) + 1
    return pd.DataFrame({"cell": [cell], "island": [island], "items": [ids], "sizes": [sizes], "labels": [labels], "n_bins": [bins], "over": [bins + sum(sizes) // -length]})


def pack_items(items: DataFrame, length: int = LENGTH, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS, seed: int = SEED) -> DataFrame:
    """(item long, length) -> (item, sequence_id, offset); items are distinct and no longer than length."""
    ship(items.sparkSession)
    full = items.where(F.col("length") >= length).select("item", F.shiftleft(F.col("item"), 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < length)
    cells = max(1, -(-rest.count() // CELL))
    dealt = rest.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(cells))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    def begin(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("item")
        sizes = x["length"].tolist()
        return _island(int(key[0]), int(key[1]), x["item"].tolist(), sizes, evolved(sizes, [], (seed, 0, int(key[0]), int(key[1])), length, crossovers=crossovers), length)

    best = settled(dealt.select("cell", "island", "item", "length").groupBy("cell", "island").applyInPandas(begin, ISLAND), "islands")
    for epoch in range(1, epochs if islands > 1 else 1):
        if best.groupBy("cell").agg(F.min("over").alias("over")).where("over > 0").isEmpty():
            break
        guests = best.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.get("labels", F.lit(0)).alias("guest"))

        def go_on(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    sizes, own = [int(v) for v in r.sizes], [p.tolist() for p in r.labels]
                    # The guest takes the place of the worst.
                    given = [*own[: POPULATION - 1], r.guest.tolist()]
                    yield _island(int(r.cell), int(r.island), r.items.tolist(), sizes, evolved(sizes, given, (seed, epoch, int(r.cell), int(r.island)), length, crossovers=crossovers), length)

        after = settled(best.join(guests, ["cell", "island"]).mapInPandas(go_on, ISLAND), "islands")
        discarded(best)
        best = after
    chosen = best.groupBy("cell").agg(F.min_by(F.struct("items", "sizes", F.get("labels", F.lit(0)).alias("labels")), F.struct("n_bins", "island")).alias("e"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                size, label = np.asarray(r.sizes, np.int64), np.asarray(r.labels, np.int64)
                order = np.argsort(label, kind="stable")
                ends = np.cumsum(size[order])
                new = np.concatenate(([True], np.diff(label[order]) != 0))
                before = ends - size[order]
                base = np.maximum.accumulate(np.where(new, before, 0))
                yield pd.DataFrame({"item": np.asarray(r.items, np.int64)[order], "sequence_id": (((int(r.cell) << 20) | label[order]) << 1) | 1, "offset": before - base})

    laid = chosen.select("cell", "e.*").mapInPandas(lay, "item long, sequence_id long, offset long")
    return full.unionByName(laid)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most length tokens without a gap. Null and empty texts are the one token 0; ids may be
    null; rows that repeat are packed each. Other columns are not read. An empty table gives an empty one.
    """
    cuts = settled(pieces(docs, tokenizer, doc_id, text, length).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(cuts.select("item", F.col("length").cast("int").alias("length")), length)
    return cuts.join(placed, "item").drop("item")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))
