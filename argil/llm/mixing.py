"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Each source's documents are put in a shuffled order, and each gets a virtual finish time: the words of its source up to its end,
divided by the source's target. In the order of finish times every source advances at its own rate, and at time one each has
given its target; the order is cut where the total budget is spent. A source whose target exceeds its size goes round again.

Running sums never cross a whole source or the whole corpus in one task. A source of n documents is split by its shuffle key into
about sqrt(n) buckets: bucket totals are summed up over the source, and documents within their bucket. Finish times are treated
likewise: totals of narrow bands of time are summed up, and entries only within the band in which the budget ends. The shuffle key
is a digest of id and text, so that rows without an id, or of one id, spread; rows equal in both are one entry of so many copies
until they are all placed, and are then dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argil.llm._text import cut, read

WEIGHTS = (3, 1, 2)
#: Budget as a part of all sizes, and how many times a source may be used.
SHARE, ROUNDS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 60
#: Copies of one row that one task unfolds.
BLOCK = 1 << 16


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Add ``rank``, ``weight``, ``budget`` and ``target`` to ``sizes(source, source_size, ...)``, which has one row per source.

    Sources in the order of code points, null last, take the weights in turn. They share ``share`` times all sizes by weight, but
    none more than ``rounds`` times its size; what is over goes to the others by weight. The common level is found in one pass: in
    the order of limit by weight it is the first that its own source's limit allows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(rounds)))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    summed = limited.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("budget"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"),
    )
    level = (F.col("budget") - F.col("limit_before")) / F.col("weight_left")
    held = F.when(level <= F.col("limit") / F.col("weight"), level)
    whole = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = summed.withColumn("level", F.first(held, ignorenulls=True).over(whole))
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit"))
    return leveled.withColumn("target", target).drop("limit", "weight_left", "limit_before", "level")


def _band(finish: Column, bands: Column) -> Column:
    """Number of the band of a finish time; a finer scale up to time two, beyond which hardly anything is taken."""
    return F.floor(bands * F.when(finish <= 2, finish).otherwise(1 + F.log2(finish)))


def _key(id_column: str, text_column: str) -> Column:
    """Digest of id and text: the shuffle key, which tells rows of one id apart."""
    parts = F.concat_ws("/", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.md5(text_column), F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, _KEY_BITS // 4), 16, 10).cast("long").alias("key")


def _unfolded(groups: DataFrame, block: int) -> DataFrame:
    """A row for each of the ``n`` copies of an entry, numbered from 1 as ``nth``; many copies are unfolded by many tasks."""
    few = groups.filter(F.col("n") <= block).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    many = groups.filter(F.col("n") > block).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(block).cast("long")))).repartition("key", "at")
    return few.unionByName(many.withColumn("nth", F.explode(F.sequence("at", F.least(F.col("at") + block - 1, F.col("n"))))).drop("at"))


def _placed(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: Sequence[float], share: float, block: int) -> DataFrame:
    """``doc_id, source, key, nth, n, size, source_size, target, taken``: a row for each input row, the ``nth`` of ``n`` of one source,
    id and text."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key(id_column, text_column),
    )
    groups = cut(rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")))
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_groups"))
    sources = targets(sizes, weights, share, ROUNDS).withColumn("buckets", F.ceil(F.sqrt("n_groups"))).withColumnRenamed("source", "name")
    joined = groups.join(sources, groups.source.eqNullSafe(sources.name)).drop("name", "n_groups", "weight")
    empty = joined.filter("size = 0").drop("buckets", "budget", "rank")
    high = F.shiftright("key", _KEY_BITS - 31)
    placed = joined.filter("size > 0").withColumn("bucket", F.shiftright(high * F.col("buckets"), 31)).withColumn("whole", F.col("size") * F.col("n"))

    along = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("rank", "bucket").agg(F.sum("whole").alias("total"))
    starts = totals.select("rank", "bucket", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(starts, ["rank", "bucket"]).withColumn("start", F.col("begin") + F.coalesce(F.sum("whole").over(inside), F.lit(0)))
    unfolded = _unfolded(summed.drop("bucket", "buckets", "begin", "whole"), block)
    timed = cut(unfolded.withColumn("end", F.col("start") + F.col("nth") * F.col("size")).drop("start"))

    entries = timed.select("rank", "size", "target", "budget", F.explode(F.array(*(F.col("end") + F.lit(r) * F.col("source_size") for r in range(ROUNDS)))).alias("end"))
    bands = F.lit(float(max(1, round(timed.count() ** 0.5))))
    finish = (F.col("end") / F.col("target")).alias("finish")
    banded = entries.select("rank", "size", "end", "budget", finish, _band(F.col("end") / F.col("target"), bands).alias("band"))
    up = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    spent = banded.groupBy("band").agg(F.sum("size").alias("total"), F.first("budget").alias("budget"))
    spent = spent.withColumn("before", F.coalesce(F.sum("total").over(up), F.lit(0)))
    # the bands that the budget reaches, the last of them perhaps in part
    reached = spent.filter("before < budget").select("band", "before", (F.col("before") + F.col("total") > F.col("budget")).alias("part"))
    reached_entries = banded.join(reached, "band")
    order = F.struct("finish", "rank", "end")
    within = Window.partitionBy("band").orderBy("finish", "rank", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = reached_entries.filter("part").withColumn("sum", F.col("before") + F.sum("size").over(within)).filter("sum <= budget")
    last = reached_entries.filter("NOT part").select(order.alias("at")).union(fits.select(order.alias("at"))).agg(F.max("at").alias("at"))

    def is_taken(r: int) -> Column:
        end = F.col("end") + F.lit(r) * F.col("source_size")
        mine = F.struct((end / F.col("target")).alias("finish"), F.col("rank"), end.alias("end"))
        return F.when(mine <= last.scalar(), 1).otherwise(0)

    times = sum((is_taken(r) for r in range(1, ROUNDS)), is_taken(0))
    columns = ("doc_id", "source", "key", "nth", "n", "size", "source_size", "target")
    taken = timed.select(*columns, (F.col("size") * times).cast("long").alias("taken"))
    return taken.unionByName(_unfolded(empty, block).select(*columns, F.lit(0).cast("long").alias("taken")))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: ``doc_id, source, size, source_size, target, taken``. Sizes are words; a null text has size 0 and
    is never taken. Documents are taken whole, none or once or twice, so that a source is off its target by about a document at
    most. Documents go by the MD5 of their id and text, then by id; repeated rows are documents of their own, and a null id or
    source is a value like another. Reruns agree, as nothing depends on partitions. Other columns are neither read nor returned. An
    empty table gives no rows.
    """
    return _placed(docs, id_column, text_column, source_column, weights, share, block).drop("key", "nth", "n")


def take(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", block: int = BLOCK) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``size``, ``source_size``, ``target`` and ``taken``; columns of
    those names are replaced. Ids may be null or repeated: each input row comes out once at most. Of rows equal in source, id and
    text, which the mix doesn't tell apart, those with the smallest hash of all columns come first."""
    added = ("size", "source_size", "target", "taken")
    rest = [c for c in docs.columns if c not in added or c in (id_column, text_column, source_column)]
    mixed = cut(_placed(docs, id_column, text_column, source_column, WEIGHTS, SHARE, block).filter("taken > 0"))
    names = {"doc_id": "__id", "source": "__source", "key": "__key"}
    named = mixed.withColumnsRenamed(names | {c: f"__{c}" for c in ("nth", "n", *added)})
    keyed = docs.select(*rest, _key(id_column, text_column).alias("__own"))
    same = F.col(id_column).eqNullSafe(F.col("__id")) & F.col(source_column).eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__key"))
    found = [F.col(f"__{c}").alias(c) for c in added]
    own = [c for c in rest if c not in added]
    single = keyed.join(named.filter("__n = 1"), same).select(*own, *found)
    several = named.filter("__n > 1")
    if several.isEmpty():
        return single
    groups = several.select(*names.values()).distinct()
    alike = cut(keyed.join(groups, same).withColumn("__hash", F.xxhash64(*rest)))
    # numbered by share of the hash, then within it, so that no task has a whole group
    group, slot = list(names.values()), F.shiftright("__hash", 52)
    counted = alike.groupBy(*group, slot.alias("__slot")).agg(F.count("*").alias("__count"))
    before = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("__slot").alias("__slot_"), F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, "__slot").orderBy("__hash")
    nth = alike.withColumn("__slot", slot).withColumn("__place", F.row_number().over(within))
    match = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*group, "__slot")]
    placed = nth.join(begun, match).withColumn("__nth_", F.col("__before") + F.col("__place")).select(*own, "__nth_", *(F.col(c).alias(f"{c}_") for c in group))
    match = [F.col(f"{c}_").eqNullSafe(F.col(c)) for c in (*group, "__nth")]
    return single.unionByName(placed.join(several, match).select(*own, *found))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: words that the mix takes of every document."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same with plain windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
c AS (SELECT *, (SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE AS budget, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS weight_left, coalesce(sum(cap) OVER o, 0) AS cap_before
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cap_before) / weight_left AS level FROM c),
h AS (SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, budget, least(cap, coalesce((SELECT level FROM h) * weight, cap)) AS target FROM l),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget, t.rank, d.key, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS fin FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, fin + k * source_size AS ended FROM e CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY ended::DOUBLE / target, rank, ended ROWS UNBOUNDED PRECEDING) AS spent FROM p),
u AS (SELECT rank, key, doc_id, size, fin, count(*) AS times FROM q WHERE spent <= budget GROUP BY ALL)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * coalesce(u.times, 0) AS BIGINT) AS taken
FROM e LEFT JOIN u ON e.rank = u.rank AND e.key = u.key AND e.doc_id IS NOT DISTINCT FROM u.doc_id AND e.size = u.size AND e.fin = u.fin
"""
