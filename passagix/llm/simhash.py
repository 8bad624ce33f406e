"""SimHash near-dedup: pigeonhole blocks.

Fingerprints of 64 bits are cut into five blocks; two that differ in at most three bits agree in at
least two of them. For each of the ten pairs of blocks, equal block values are brought together and
the Hamming distance is checked, so no link is lost. Copies share a fingerprint and are joined as one.
Groups over MAX_GROUP distinct fingerprints are cut into parts and each pair of parts becomes a task of
its own: memory stays bounded, and from each part only a spanning forest of its links is emitted, which
has the same components as all its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagix.llm.common import discarded, own_name, settled, ship, table

BITS = 64
#: Widths of the blocks, lowest bits first.
WIDTHS = (13, 13, 13, 13, 12)
MAX_BITS = 3
MAX_GROUP = 2048


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """The SimHash of a text, unsigned. Null and texts without a word: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = 3, to: str = "fingerprint_bits", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all) with the fingerprint as a signed long. Whole texts; each row by itself."""
    ship(docs.sparkSession)
    columns = list(keep if keep is not None else docs.columns)
    passed = docs.select(*columns, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint_of(x.as_py(), shingle_words) for x in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bits.view(np.int64))], names=[*columns, to])

    return passed.mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a (same) or between a and b; a and b are sorted and distinct."""
    n = len(a)
    every = a if same else np.concatenate([a, b])
    root = np.arange(len(every))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    step = max(1, 1_000_000 // max(1, len(b)))
    for lo in range(0, n, step):
        near = np.bitwise_count(a[lo : lo + step, None] ^ b[None, :]) <= max_bits
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            i += lo
            if same and j <= i:
                continue
            x, y = find(i), find(j if same else n + j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(a[i]), int(b[j])))
    return out


def links(bits: DataFrame, column: str = "fingerprint_bits", max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links at max_bits or fewer.

    bits: one row for each distinct fingerprint. With max_bits + 2 blocks, close pairs share two.
    """
    if max_bits != len(WIDTHS) - 2:
        raise ValueError(f"the blocks are cut for {len(WIDTHS) - 2} bits")
    low = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    block = [F.shiftrightunsigned(F.col(column), low[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1)) for i in range(len(WIDTHS))]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block[i], WIDTHS[j])).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))]
    rows = bits.select(F.col(column).alias("f"), F.explode(F.array(*keys)).alias("key"))
    # A group's size is known before its rows meet: large groups are dealt out in pairs of parts.
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / MAX_GROUP).cast("int")
    own = F.pmod(F.xxhash64("f"), parts.cast("long")).cast("int")
    dealt = (
        rows.join(sizes, "key")
        .select("key", "f", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", "f", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q", "part", "f")
        .select("key", "p", "q", "part", "f")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(x: np.ndarray) -> list[tuple[int, int]]:
            f, part = x[:, 4].view(np.uint64), x[:, 3]
            if x[0, 1] == x[0, 2]:
                return _forest(f, f, True, max_bits)
            return _forest(f[part == x[0, 1]], f[part == x[0, 2]], False, max_bits)

        rest = np.empty((0, 5), np.int64)
        for batch in batches:
            x = np.concatenate([rest, np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], 1)])
            if not len(x):
                continue
            cuts = np.nonzero((x[1:, :3] != x[:-1, :3]).any(1))[0] + 1
            ends = [*cuts.tolist()]
            found, at = [], 0
            for e in ends:
                found += solve(x[at:e])
                at = e
            rest = x[at:]
            if found:
                yield _pairs(found)
        if len(rest):
            yield _pairs(solve(rest))

    return dealt.mapInArrow(run, "a long, b long").where("a != b").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge; root: one member of v's component. Rounds of contraction, each written to the shared folder.

    In each round every vertex points to its smallest neighbour (or itself), edges are renamed after the
    pointers, and loops and repeats go; the edges that are left fall fast. Nothing is gathered at the driver.
    """
    edges = settled(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("o")))
        hop = settled(both.groupBy("v").agg(F.min("o").alias("o")).select("v", F.least("v", "o").alias("to")), "hop")
        # Two steps along the pointers at once; the pointers only fall, so there is no circle.
        far = settled(hop.join(hop.select(F.col("v").alias("to"), F.col("to").alias("to2")), "to", "left").select("v", F.coalesce("to2", "to").alias("to")), "far")
        hops.append(far)
        left, right = far.select(F.col("v").alias("a"), F.col("to").alias("a2")), far.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        fewer = edges.join(left, "a").join(right, "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        fewer = settled(fewer, "edges")
        discarded(edges, hop)
        edges = fewer
    if not hops:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # A vertex that ends as a root of one round may point on in a later one.
    roots = hops[-1].select("v", F.col("to").alias("root"))
    for hop in reversed(hops[:-1]):
        on = roots.select(F.col("v").alias("to"), F.col("root"))
        roots = hop.join(on, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return roots


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, group_docs (rows of the component).

    Null, empty and blank texts have fingerprint zero and are linked like any other. component_id is the
    smallest id of the component, nulls aside (null if there is no other); repeated rows stay repeated;
    columns other than the two named are not looked at. An empty table gives an empty one.
    """
    base = settled(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], shingle_words=shingle_words), "fingerprints")
    classes = settled(base.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    roots = settled(components(links(classes.select("fingerprint_bits"))), "roots")
    grouped = classes.join(roots.withColumnRenamed("v", "fingerprint_bits"), "fingerprint_bits", "left").withColumn("root", F.coalesce("root", "fingerprint_bits"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("group_docs"))
    named = grouped.join(least, "root").select("fingerprint_bits", "component_id", "group_docs")
    return base.join(named, "fingerprint_bits").select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id", "group_docs")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest id (rows that share that id: the one of the smallest hash of the text). Columns stay.

    Fingerprints travel with ids and text hashes; the texts move once, to meet those that are kept.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    bits = settled(fingerprints(base, "text", keep=["id", "h"]), "bits")
    classes = settled(bits.groupBy("fingerprint_bits").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "h")).alias("first")), "classes")
    discarded(bits)
    roots = settled(components(links(classes.select("fingerprint_bits"))), "roots")
    grouped = classes.join(roots.withColumnRenamed("v", "fingerprint_bits"), "fingerprint_bits", "left").withColumn("root", F.coalesce("root", "fingerprint_bits"))
    zero = F.lit(0).cast(docs.schema[doc_id].dataType)
    kept = settled(grouped.groupBy("root").agg(F.min("first").alias("k")).select(F.coalesce("k.id", zero).alias("k1"), F.col("k.null_id").alias("k2"), F.col("k.h").alias("k3")), "kept")
    discarded(classes, roots)
    a, b, c, turn = (own_name(docs, x) for x in ("__k1", "__k2", "__k3", "__turn"))
    keyed = docs.withColumn(a, F.coalesce(doc_id, zero)).withColumn(b, F.col(doc_id).isNull()).withColumn(c, F.xxhash64(text))
    chosen = keyed.join(kept, (F.col(a) == F.col("k1")) & (F.col(b) == F.col("k2")) & (F.col(c) == F.col("k3")), "left_semi")
    # Of rows that repeat as a whole one stays.
    chosen = chosen.withColumn(turn, F.row_number().over(Window.partitionBy(a, b, c).orderBy(c)))
    return chosen.where(F.col(turn) == 1).select(*docs.columns)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "group_docs")
