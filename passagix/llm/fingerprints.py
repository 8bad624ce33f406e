"""Document fingerprints: threshold-scaled sketch.

Of the 64-bit hashes of a text's word shingles, those below a fixed fraction of the range are kept, all of
them. The number kept grows with the text, so the sketch of a union is the union of the sketches, and
containment can be estimated between texts of very different length. A text of which no hash falls below
the threshold has its smallest one instead, so that short texts are told apart; being above the threshold it
equals no kept hash, and it goes when its sketch is merged with one that has kept hashes, as it would in the
sketch of the union. An empty text has an empty sketch. A sketch is written as its hashes, ascending, in
sixteen hex digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagix.llm.common import ship, table

SHINGLE_WORDS = 5
#: One hash in SCALE is kept.
SCALE = 8
SEED = 0
#: Bytes of input for each range of ids, about; texts take a few times as much.
RANGE_BYTES = 32 << 20
#: Bytes of results that a Python worker hands on at once.
BATCH_BYTES = 4 << 20


def sketch(text: str | None, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> np.ndarray:
    """The kept hashes, ascending, or the smallest hash if none is kept. Words are split at ASCII white space, A-Z in lower case."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    if n == 1:
        h = np.array([digest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)
    return thinned(h, scale)


def thinned(h: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """What a sketch keeps of hashes."""
    kept = h[h <= np.uint64((1 << 64) // scale - 1)]
    return np.unique(kept if len(kept) else h[h == h.min()]) if len(h) else h


def to_text(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of what two sketches cover together: that of the union of their shingles."""
    return thinned(np.union1d(a, b), scale)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity as the sketches show it. Two empty sketches: 1; one: 0."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """How much of a is in b. a empty: 1."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its sketch, that of its edited text, and their likenesses to it and to the next document.

    The next document is the one of the next larger id, after the last the first; rows of one id follow
    each other by their text's hash, null ids come first, a null text counts as empty. Repeated rows are
    documents of their own; a table of one row is followed by itself, an empty one gives no rows. Other
    columns are not looked at. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_hashes.

    Texts move once, into ranges of ids; what a range needs of the next one is its first document alone.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # Rows without an id stand first, by their text's hash, so they are as many ranges as they need.
    rows = rows.withColumn("known", F.col("doc_id").isNotNull()).withColumn("id", F.coalesce("doc_id", "h"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, -(-size // RANGE_BYTES)) if size < 1 << 62 else 1)
    ranged = _numbered(rows, *_bounds(rows, ranges))
    # One row for each range, of which there are no more than twice as many as partitions: its first document, and which range comes before.
    # The driver holds them, as it does the bounds: a table of them would be a file, and processes that set its mode, for each range.
    heads = sorted(ranged.groupBy("range").agg(F.min(F.struct("id", "h")).alias("first")).selectExpr("range", "first.id", "first.h").collect())
    columns = list(zip(*((r, i, h, heads[at - 1][0]) for at, (r, i, h) in enumerate(heads)), strict=True)) or [()] * 4
    kinds = {"range": pa.int32(), "head_id": pa.int64(), "head_h": pa.int64(), "before": pa.int32()}
    before = spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)}))
    copies = F.when((F.col("id") == F.col("head_id")) & (F.col("h") == F.col("head_h")), F.array(F.struct(F.col("range"), F.lit(0).alias("last")), F.struct(F.col("before").alias("range"), F.lit(1).alias("last")))).otherwise(F.array(F.struct(F.col("range"), F.lit(0).alias("last"))))
    both = (
        ranged.join(F.broadcast(before), "range")
        .select("doc_id", "id", "h", "text", F.inline(copies))
        # By number, not by its hash, which puts several ranges into one task and none into others.
        .repartitionById(ranges, F.pmod("range", F.lit(ranges)))
        .sortWithinPartitions("range", "last", "id", "h")
        .select("range", "last", "doc_id", "text")
    )
    return both.mapInArrow(_edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long")


def _bounds(rows: DataFrame, ranges: int) -> tuple[list[int], list[int]]:
    """Hashes of rows without an id, and ids of the others, that cut them into ranges of about equal counts; at most ranges - 1 of each."""
    at = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.agg(*(F.percentile_approx(F.when(F.col("known") == known, F.col("id")), at, 10 * ranges) for known in (False, True))).first()
    return tuple(sorted(set(c or [])) for c in cuts)


def _numbered(rows: DataFrame, hashes: list[int], ids: list[int]) -> DataFrame:
    """rows with range, the number of bounds below id, by binary search: one step, one column."""

    def below(bounds: list[int]) -> Column:
        found, array = F.lit(0), F.lit(bounds) if bounds else F.array().cast("array<long>")

        def up(step: int) -> Column:
            # A one-element array binds what is found so far.
            return F.get(F.transform(F.array(found), lambda at: F.when(F.get(array, at + F.lit(step - 1)) < F.col("id"), at + F.lit(step)).otherwise(at)), F.lit(0))

        step = 1 << max(0, len(bounds).bit_length() - 1)
        while step and bounds:
            found = up(step)
            step >>= 1
        return found

    return rows.withColumn("range", F.when(F.col("known"), below(ids) + F.lit(len(hashes) + 1)).otherwise(below(hashes)))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are taken from a batch one at a time, and results go on by their bytes, so that a worker's memory does not grow with a batch's rows."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"]
    types = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64())
    full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    before: tuple | None = None
    at = None
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            group, last, doc, text = (batch.column(i)[row].as_py() for i in range(4))
            if group != at or (last and before is None):
                at, before = group, None
            if last and before is None:
                continue
            own = sketch(text)
            if before is not None:
                doc0, text0, own0 = before
                half = len(text0) // 2
                edited = text0[: len(text0) - half] + text[:half]
                changed = sketch(edited)
                out.append((doc0, len(text0), hashlib.sha256(edited.encode()).hexdigest(), to_text(own0), to_text(changed), likeness(own0, changed), likeness(own0, own), len(own0)))
                held += 16 * (len(own0) + len(changed)) + 200
                if held >= BATCH_BYTES:
                    yield full()
                    out, held = [], 0
            before = None if last else (doc, text, own)
    if out:
        yield full()


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
