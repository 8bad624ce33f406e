"""Token counts: digest cache.

Texts are known by the digest of their normalised content, tokenizers by that of their file. Counts that
are stored under both are taken from the cache, a table; only distinct digests that it lacks are encoded,
and their counts are appended to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagix.llm.common import exists, shared_dir, ship, table

#: The pattern that byte-level BPE files of this kind split by; a file that says use_regex means it.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
CACHE_SCHEMA = "digest string, version string, n_bytes long, n_tokens long"


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def version(path: str) -> str:
    """The digest of a tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by bytes, if the file is plain byte-level BPE, whose ids a rank-based encoder gives as well; else None."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {x["content"] for x in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    return ranks if ids == sorted(ids) and len(ranks) == 256 + len(ids) else None


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Whole text -> ids as the file's own library gives them, without begin, end or other added tokens.

    .json: tokenizers; .model: sentencepiece; .tiktoken: tiktoken. Plain byte-level BPE in a .json is run by
    tiktoken's core, which gives the same ids several times faster; texts that hold a special string, and
    any that this core refuses, go to tokenizers itself.
    """
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(sp.encode(text), np.uint32)
    import tiktoken

    if path.endswith(".tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
        own = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(own.encode_ordinary(text), np.uint32)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    spec = json.loads(Path(path).read_text())
    if (ranks := _byte_level_ranks(spec)) is None:
        return slow
    core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe
    special = [x["content"] for x in spec.get("added_tokens") or []]
    # Runs this long of one kind of character are left to the library.
    long = re.compile(r"\s{2000}|\S{20000}")

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special) or long.search(text):
            return slow(text)
        return np.array(core.encode_ordinary(text), np.uint32)

    return fast


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """The columns in keep with n_bytes, n_tokens and over_limit, one row for each row of docs.

    The normalised content is the text itself, with null as the empty text: anything more would change
    counts. cache_path names the cache's folder, which is made if there is none; two runs may append at
    once, repeats of a digest do no harm. The result reads the cache; the misses are encoded and appended
    when this is called. A shuffle brings equal digests together after each task has made its own distinct,
    so a text of many copies is encoded once and read once for each task. Texts are encoded whole; rows that
    repeat stay repeated; ids may be null. An empty table gives an empty one, and an empty cache. Columns other
    than keep and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    v = version(tokenizer)
    known = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__digest", F.sha2("__text", 256))
    if exists(spark, cache_path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == v)
        misses = known.join(stored.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
    else:
        misses = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [len(encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v] * len(texts), pa.string()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["digest", "version", "n_bytes", "n_tokens"])

    distinct = misses.groupBy("__digest").agg(F.first("__text").alias("__text"))
    distinct.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == v).groupBy(F.col("digest").alias("__digest")).agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))
    return known.select(*keep, "__digest").join(counts, "__digest").select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts by byte_bpe_50k.json. Each call starts an empty cache, so that what it costs is the whole job; name one of your own to keep it."""
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/token_counts-{uuid.uuid4().hex[:12]}"
    return count_tokens(table(spark, sf_dir, "documents"), at, public("byte_bpe_50k.json"))
