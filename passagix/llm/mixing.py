"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's documents stand in a hashed order, one after the other, as a stream of words that is cut into
blocks of equal length. A source's target is so many passes over all of its blocks and a number of blocks of
one pass more, the last of them cut to a length: its quota. How many blocks of each source go to each output
shard is drawn by a binary tree: a node holds the sources' exact block quotas and sends half of its blocks
left, by one multivariate-hypergeometric draw; quotas stay exact at every level. The blocks of each pass
stand in an order of their own, a permutation, and each shard draws the next ones of it. What is taken of a
document are its words in blocks that were drawn, and it goes where they go. Each shard is shuffled by
itself. What does not depend on documents (sources, shards) stays in small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagix.llm.common import own_name, settled, table

#: Weights by turns of the sources, the share of all sizes that is taken, the most a source repeats.
WEIGHTS, TOTAL_SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: A source's order is that of 60 bits of an MD5; their first twelve are buckets: sums run over buckets first, then within each.
HASH_BITS, BUCKET_BITS = 60, 12
#: Blocks of all sources together, about; a block has at least LEAST_BLOCK words.
BLOCKS, LEAST_BLOCK = 1 << 14, 256
#: Output shards: 2 ** DEPTH.
DEPTH = 3
#: Primes for the permutation of block numbers; one that does not divide the number of blocks is taken.
PRIMES = (1_000_000_007, 998_244_353, 754_974_721)


def size_of(text: str) -> Column:
    """Words of a text; null: 0."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def digits(n: int, *parts: Column) -> Column:
    """The first n hex digits of an MD5 of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, n), 16, 10).cast("long")


def order_of(doc_id: str, text: str, seed: int) -> Column:
    """A document's place in its source's order, by its id; without one by its text."""
    return digits(HASH_BITS // 4, F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: by weight, but at most `most` times the size, the excess reshared by weight.

    The fixed point of resharing gives min(most * size, level * weight) to each source, with one level for
    all. Sources are ordered by their cap over their weight; the level is that after the last one capped.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    t = sizes.withColumn("weight", F.get(w, ((F.row_number().over(turn) - 1) % len(weights)).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = (
        t.withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(total_share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("open"))
    )
    # The first source whose cap is not below the level that would then hold; all above it share by weight.
    level = F.min_by(F.when(F.col("at") >= F.col("level"), F.col("level")), F.when(F.col("at") >= F.col("level"), F.col("at"))).over(every)
    return t.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among so many draws without replacement, by inversion at u in [0, 1).

    Sums over twelve deviations to either side of the mean; what lies beyond is below double precision.
    """
    n = (good + bad).cast("double")
    mean = draws * good / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (bad / F.greatest(n, F.lit(1.0))) * ((n - draws) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - spread * 12 - 2))
    high = F.greatest(low, F.least(good, draws, F.ceil(mean + spread * 12 + 2)))
    # Weights relative to that of low, by logarithm: w(k + 1) / w(k).
    def rise(k: Column) -> Column:
        return F.log(((good - k) * (draws - k)).cast("double")) - F.log(((k + 1) * (bad - draws + k + 1)).cast("double"))

    ks = F.sequence(low, high)
    start = F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))

    def gather(s: Column, k: Column) -> Column:
        top = F.greatest(s["top"], s["lw"])
        total = s["sum"] * F.exp(s["top"] - top) + F.exp(s["lw"] - top)
        return F.struct(F.when(k < high, s["lw"] + rise(k)).otherwise(s["lw"]).alias("lw"), top.alias("top"), total.alias("sum"))

    whole = F.aggregate(ks, start, gather)
    first = F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("k"))

    def find(goal: Column, top: Column):
        def step(s: Column, k: Column) -> Column:
            total = s["sum"] + F.exp(s["lw"] - top)
            return F.struct(F.when(k < high, s["lw"] + rise(k)).otherwise(s["lw"]).alias("lw"), total.alias("sum"), F.coalesce(s["k"], F.when(total > goal, k)).alias("k"))

        return step

    # One-element arrays bind the totals once.
    return F.get(F.transform(F.array(whole), lambda t: F.coalesce(F.aggregate(ks, first, find(u * t["sum"], t["top"]))["k"], high)), 0)


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, quota), one row for each source -> (shard, at, quota): at is the source's place in the order of code points."""
    gathered = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.col("source"), F.col("quota")))).alias("s"))
    nodes = gathered.select(F.lit(1).cast("long").alias("node"), F.transform("s", lambda x: x["quota"]).alias("q"))
    for _ in range(depth):
        zero = F.lit(0).cast("long")
        total = F.aggregate("q", zero, lambda a, x: a + x)
        # The node's hash decides which side gets the odd block.
        half = F.floor((total + digits(1, F.lit("half"), F.lit(str(seed)), F.col("node").cast("string")) % 2) / 2).cast("long")
        begin = F.struct(F.array().cast("array<bigint>").alias("left"), total.alias("rest"), half.alias("draws"))

        def draw(s: Column, x: Column) -> Column:
            u = digits(13, F.lit(str(seed)), F.col("node").cast("string"), F.size(s["left"]).cast("string")) / F.lit(float(1 << 52))
            got = F.array(hypergeometric(x, s["rest"] - x, s["draws"], u))
            return F.get(F.transform(got, lambda g: F.struct(F.concat(s["left"], F.array(g)).alias("left"), (s["rest"] - x).alias("rest"), (s["draws"] - g).alias("draws"))), 0)

        nodes = nodes.withColumn("left", F.aggregate("q", begin, draw)["left"])
        right = F.zip_with("q", "left", lambda a, b: a - b)
        nodes = nodes.select(F.inline(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))))
    return nodes.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.posexplode("q").alias("at", "quota"))


def quotas_of(sizes: DataFrame, seed: int) -> DataFrame:
    """(key, source, source_size) -> with target, block_words, n_blocks, passes, quota, keep, prime, turns, at.

    quota: blocks of all passes; the last of them is cut to its first keep words. turns: where the permutation
    of each pass begins. at: the source's place in the order of code points.
    """
    zero = F.lit(0).cast("long")
    goals = sizes.join(targets(sizes.select("source", "source_size")).select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = goals.withColumn("whole", F.round("target").cast("long"))
    block = F.greatest(F.lit(LEAST_BLOCK).cast("long"), F.ceil(F.sum("whole").over(Window.partitionBy()) / BLOCKS))
    goals = goals.withColumn("block_words", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.greatest("source_size", F.lit(1).cast("long")))).otherwise(zero))
    goals = goals.withColumn("rest", F.col("whole") - F.col("passes") * F.col("source_size"))
    prime = F.lit(PRIMES[-1]).cast("long")
    for p in PRIMES[-2::-1]:
        prime = F.when(F.col("n_blocks") % p != 0, F.lit(p).cast("long")).otherwise(prime)
    goals = goals.withColumn("prime", prime).withColumn("turns", F.transform(F.sequence(zero, F.col("passes")), lambda i: digits(8, F.lit(str(seed)), F.col("key"), i.cast("string"))))
    goals = goals.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    # The last block of a pass may be short: where it stands in the pass that is not whole decides how many blocks that pass needs.
    lack = F.col("n_blocks") * F.col("block_words") - F.col("source_size")
    short = F.pmod((F.col("n_blocks") - 1) * F.col("prime") + F.get("turns", F.col("passes").cast("int")), F.greatest("n_blocks", F.lit(1).cast("long")))
    words = lambda n: n * F.col("block_words") - F.when(F.col("short") < n, F.col("lack")).otherwise(zero)
    goals = goals.withColumn("lack", lack).withColumn("short", short).withColumn("few", F.ceil(F.col("rest") / F.col("block_words")).cast("long"))
    goals = goals.withColumn("last", F.col("few") + F.when(words(F.col("few")) < F.col("rest"), 1).otherwise(0))
    keep = F.when(F.col("last") > 0, F.col("rest") - words(F.col("last") - 1)).otherwise(F.col("block_words"))
    return goals.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.col("last")).withColumn("keep", keep).select("key", "source", "source_size", "target", "block_words", "n_blocks", "passes", "quota", "keep", "prime", "turns", "at")


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, depth: int) -> DataFrame:
    """docs with size, source_size, target, passes and parts, each under a leading '__'. parts: (copy, shard, words) of each block that is drawn and holds words of the document."""
    zero = F.lit(0).cast("long")
    rows = docs.withColumn("__size", size_of(text)).withColumn("__h", order_of(doc_id, text, seed)).withColumn("__text_h", F.xxhash64(text))
    rows = rows.withColumn("__bucket", F.shiftright("__h", HASH_BITS - BUCKET_BITS).cast("int")).withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")))
    buckets = rows.groupBy("__key", "__bucket").agg(F.first(F.col(source).cast("string")).alias("source"), F.sum("__size").alias("words"))
    sums = buckets.groupBy(F.col("__key").alias("key"), "source").agg(F.sum("words").alias("source_size"))
    # The draws are made once, whatever reads them.
    goals = settled(quotas_of(sums, seed), "goals")
    ends = split_quotas(goals.select("source", "quota"), depth, seed).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("by_shard"))
    so_far = F.aggregate("by_shard", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), zero) + x["quota"])))
    goals = goals.join(ends.withColumn("ends", so_far).select("at", "ends"), "at", "left")
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = ["source_size", "target", "block_words", "n_blocks", "passes", "quota", "keep", "prime", "turns", "ends"]
    placed = buckets.select("__key", "__bucket", F.coalesce(F.sum("words").over(before), zero).alias("__skip"))
    placed = placed.join(goals, F.col("__key") == F.col("key")).select("__key", "__bucket", "__skip", *(F.col(c).alias(f"__{c}") for c in names))
    joined = rows.join(placed, ["__key", "__bucket"])
    inner = Window.partitionBy("__key", "__bucket").orderBy("__h", doc_id, "__size", "__text_h").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("__offset", F.col("__skip") + F.coalesce(F.sum("__size").over(inner), zero))
    return joined.withColumn("__parts", _parts())


def _parts() -> Column:
    """The blocks of each pass that hold words of a document and are drawn: (copy, shard, words)."""
    zero, block = F.lit(0).cast("long"), F.col("__block_words")
    stop = F.col("__offset") + F.col("__size")
    numbers = F.when(F.col("__size") > 0, F.sequence(F.floor(F.col("__offset") / block), F.floor((stop - 1) / block)))

    def of_copy(copy: Column) -> Column:
        def part(b: Column) -> Column:
            place = copy * F.col("__n_blocks") + F.pmod(b * F.col("__prime") + F.get("__turns", copy.cast("int")), F.col("__n_blocks"))
            shard = F.aggregate("__ends", F.lit(0), lambda a, e: a + F.when(e <= place, 1).otherwise(0))
            long = F.when(shard >= F.size("__ends"), zero).when(place == F.col("__quota") - 1, F.col("__keep")).otherwise(block)
            words = F.greatest(zero, F.least(stop, b * block + long) - F.greatest("__offset", b * block))
            return F.struct(copy.alias("copy"), shard.alias("shard"), words.alias("words"))

        return F.transform(numbers, part)

    parts = F.flatten(F.transform(F.sequence(zero, F.col("__passes")), of_copy))
    return F.coalesce(F.filter(parts, lambda x: x["words"] > 0), F.array().cast("array<struct<copy:bigint,shard:int,words:bigint>>"))


def _words(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["words"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., which clash with nothing, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, depth: int = DEPTH) -> DataFrame:
    """docs with size, source_size, target, taken, first_shard and shards; where docs has such a name itself, the new one ends in '_'.

    taken counts the document's words in blocks that shards drew, repeats too; first_shard is that of the first
    of them (null without any), shards all of them, ascending, joined by commas. Each source's taken words add
    up to its target, rounded. Null is a source of its own, after all others. Null and empty texts have size 0
    and are taken 0 times; texts of any length are counted to their ends. Rows that repeat are documents of
    their own; null ids stand in the order of their texts. An empty table gives an empty one.
    """
    rows, names = _numbered(docs)
    plan = _plan(rows, names[doc_id], names[text], names[source], seed, depth)
    shards = F.array_sort(F.array_distinct(F.transform("__parts", lambda x: x["shard"])))
    plan = plan.withColumn("__taken", _words(F.col("__parts"))).withColumn("__first_shard", F.get("__parts", F.lit(0))["shard"]).withColumn("__shards", F.array_join(F.transform(shards, lambda i: i.cast("string")), ","))
    return plan.select(*(F.col(n).alias(c) for c, n in names.items()), *(F.col(f"__{c}").alias(own_name(docs, c)) for c in ("size", "source_size", "target", "taken", "first_shard", "shards")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, depth: int = DEPTH) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with docs' columns, copy (from 0), shard, and place, its order in the shard.

    A document is taken whole in a pass if at least half of its words lie in blocks that were drawn in it, and
    goes to the shard of the first of them; documents without a word are taken once, to a shard by their hash.
    Sort a shard by place: that is its local shuffle. Nulls, repeated rows and empty tables are as in mix_plan.
    """
    rows, names = _numbered(docs)
    plan = _plan(rows, names[doc_id], names[text], names[source], seed, depth)
    zero = F.lit(0).cast("long")

    def of_copy(copy: Column) -> Column:
        own = F.filter("__parts", lambda x: x["copy"] == copy)
        return F.struct(copy.alias("copy"), F.get(own, F.lit(0))["shard"].alias("shard"), _words(own).alias("words"))

    copies = F.filter(F.transform(F.sequence(zero, F.col("__passes")), of_copy), lambda x: x["words"] * 2 >= F.col("__size"))
    empty = F.array(F.struct(zero.alias("copy"), (F.col("__h") % (1 << depth)).cast("int").alias("shard"), zero.alias("words")))
    dealt = plan.withColumn("__copy", F.explode(F.when(F.col("__size") == 0, empty).otherwise(copies)))
    place = F.xxhash64(F.lit(seed + 1), names[doc_id], "__text_h", "__copy.copy")
    return dealt.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("__copy.copy").alias(own_name(docs, "copy")), F.col("__copy.shard").alias(own_name(docs, "shard")), place.alias(own_name(docs, "place")))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "shards")


def _md5(n: int, parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, {n}))::bigint"


_PRIME = "CASE " + " ".join(f"WHEN n_blocks % {p} != 0 THEN {p}" for p in PRIMES[:-1]) + f" ELSE {PRIMES[-1]} END"
#: DuckDB SQL for op3_source_mixing. tree walks the sources of each node in turn; its weights of a draw come from log-gamma.
OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, {_md5(15, "'17', coalesce(doc_id::varchar, md5(coalesce(text, '')))")} AS h FROM documents),
s AS (SELECT source, key, sum(size)::bigint AS source_size FROM d GROUP BY source, key),
w AS (SELECT *, [5.0::double, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::int] AS weight FROM s),
c AS (SELECT *, source_size * 2.0::double AS cap, source_size * 2.0::double / weight AS rate, sum(source_size) OVER () * 1.5::double AS all_words FROM w),
l AS (SELECT *, (all_words - coalesce(sum(cap) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
v AS (SELECT min_by(level, rate) AS level FROM l WHERE rate >= level),
t AS (SELECT source, key, source_size, least(cap, v.level * weight) AS target FROM l, v),
b AS (SELECT *, round(target)::bigint AS whole, greatest({LEAST_BLOCK}, ceil(sum(round(target)) OVER () / {BLOCKS}.0))::bigint AS block_words, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS pos FROM t),
n AS (SELECT *, ceil(source_size / block_words::double)::bigint AS n_blocks, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM b),
p AS (SELECT *, whole - passes * source_size AS rest, {_PRIME} AS prime, n_blocks * block_words - source_size AS lack FROM n),
q AS (SELECT *, CASE WHEN n_blocks > 0 THEN ((n_blocks - 1) * prime + {_md5(8, "'17', key, passes")}) % n_blocks ELSE 0 END AS short, ceil(rest / block_words::double)::bigint AS few FROM p),
r AS (SELECT *, few + (few * block_words - CASE WHEN short < few THEN lack ELSE 0 END < rest)::int AS last FROM q),
g AS (SELECT *, passes * n_blocks + last AS quota, CASE WHEN last > 0 THEN rest - ((last - 1) * block_words - CASE WHEN short < last - 1 THEN lack ELSE 0 END) ELSE block_words END AS keep FROM r),
tree AS (
  SELECT 0 AS level, 1::bigint AS node, (SELECT list(quota::bigint ORDER BY pos) FROM g) AS q, 0 AS pos, []::bigint[] AS lft
  UNION ALL
  SELECT CASE WHEN pos < len(q) THEN level ELSE level + 1 END, CASE WHEN pos < len(q) THEN node ELSE node * 2 + side END,
    CASE WHEN pos < len(q) OR side IS NULL THEN q WHEN side = 0 THEN lft ELSE list_transform(q, lambda x, i: x - lft[i]) END,
    CASE WHEN pos < len(q) THEN pos + 1 ELSE 0 END,
    CASE WHEN pos < len(q) THEN list_append(lft, lo + len(list_filter(ws, lambda x, i: list_sum(ws[1:i]) <= u * list_sum(ws)))) ELSE [] END
  FROM (SELECT *, list_transform(lw, lambda x: exp(x - list_max(lw))) AS ws FROM (
    SELECT *, list_transform(range(lo, hi + 1), lambda k: -lgamma(k + 1) - lgamma(good - k + 1) - lgamma(draws - k + 1) - lgamma(bad - draws + k + 1)) AS lw FROM (
    SELECT *, greatest(0, draws - bad, floor(mean - spread * 12 - 2)::bigint) AS lo, greatest(greatest(0, draws - bad, floor(mean - spread * 12 - 2)::bigint), least(good, draws, ceil(mean + spread * 12 + 2)::bigint)) AS hi FROM (
    SELECT *, draws * good / greatest(good + bad, 1)::double AS mean,
      sqrt(greatest(0, draws * good / greatest(good + bad, 1)::double * (bad / greatest(good + bad, 1)::double) * ((good + bad - draws) / greatest(good + bad - 1, 1)::double))) AS spread FROM (
    SELECT *, coalesce(q[pos + 1], 0) AS good, (list_sum(q) - coalesce(list_sum(q[1:pos + 1]), 0))::bigint AS bad,
      ((list_sum(q) + {_md5(1, "'half', '17', node")} % 2) // 2 - coalesce(list_sum(lft), 0))::bigint AS draws, {_md5(13, "'17', node, len(lft)")} / {float(1 << 52)}::double AS u
    FROM tree WHERE level < {DEPTH}))))) x LEFT JOIN (VALUES (0), (1)) y(side) ON pos = len(q)),
leaf AS (SELECT node - {1 << DEPTH} AS shard, unnest(range(len(q))) AS pos, unnest(q) AS quota FROM tree WHERE level = {DEPTH}),
ends AS (SELECT pos, list(e ORDER BY shard) AS ends FROM (SELECT pos, shard, sum(quota) OVER (PARTITION BY pos ORDER BY shard) AS e FROM leaf) GROUP BY pos),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS skip FROM d),
j AS (SELECT o.doc_id, o.size, o.skip, g.*, ends.ends FROM o JOIN g ON o.key = g.key JOIN ends ON ends.pos = g.pos),
copies AS (SELECT *, unnest(range(passes + 1)) AS copy FROM j WHERE size > 0),
blocks AS (SELECT *, unnest(range(skip // block_words, (skip + size - 1) // block_words + 1)) AS k FROM copies),
drawn AS (SELECT *, copy * n_blocks + (k * prime + {_md5(8, "'17', key, copy")}) % n_blocks AS place FROM blocks),
part AS (SELECT doc_id, copy, k, len(list_filter(ends, lambda e: e <= place)) AS shard, least(skip + size, k * block_words + CASE WHEN place >= quota THEN 0 WHEN place = quota - 1 THEN keep ELSE block_words END) - greatest(skip, k * block_words) AS words FROM drawn),
sums AS (SELECT doc_id, sum(words) AS taken, min_by(shard, (copy, k)) AS first_shard, string_agg(DISTINCT shard::varchar, ',' ORDER BY shard::varchar) AS shards FROM part WHERE words > 0 GROUP BY doc_id)
SELECT j.doc_id, j.size::bigint AS size, j.source_size, j.target, coalesce(sums.taken, 0)::bigint AS taken, sums.first_shard::int AS first_shard, coalesce(sums.shards, '') AS shards
FROM j LEFT JOIN sums USING (doc_id)
"""
