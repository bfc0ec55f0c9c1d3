"""Mixing sources to target weights by systematic sampling.

Each source's target is a share of all words by weight, filled like water: a source that would pass its ceiling
stops there, and the excess goes to the others by weight. A document's expected copies are target / source size. Within
a source, documents stand in order of size and id; the prefix sum of expected copies plus one offset crosses integer
boundaries, and each crossing emits one copy. The offset is drawn for each source from a seeded hash, so another seed gives
another sample and the same seed the same. Ordering by size makes every stretch of the sample alike, so the words taken come near the
target.

The prefix sum needs a document's rank in its source. Rows are dealt by ranges of (source, size, id), so that a source
with any share of the rows is spread; ranges are counted, and offsets come from those counts. DataFrame functions
only; no text is shuffled.

Defined results. Null text has size 0. A null source is a source of its own, last in order. Null ids stand first among
equals, then a hash of the text decides; rows that repeat source, size, id and text are interchangeable. Very long texts count all
their words. A source of size 0 gets target 0 and no copies. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, ceiling: float) -> DataFrame:
    """(source, source_size) -> the same with target; one row a source."""
    at = Window.orderBy(F.col("source").asc_nulls_last())  # of one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(at) - 1) % len(weights) + 1).cast("double")
    s = sizes.select("source", "source_size", weight.alias("weight"))
    s = s.withColumn("most", F.col("source_size") * F.lit(ceiling))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(water * F.col("weight")).alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """In [0, 1): the first 32 bits of the MD5 of seed and source (a null source is a name of its own)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 1, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row; see the module's text.

    weights repeat over the sources in code point order; share: of all words; ceiling: times its source's size;
    seed: of the random offsets; row_col: a column that is passed on as ``row``.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), *row)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(parts, "source", "size", "doc_id", "mark").withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, ceiling)
    counts = counts.select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")).alias("c")
    goal = goal.withColumn("offset", random_offset(F.col("source"), seed)).alias("g")
    counts = counts.join(goal, F.col("c.source").eqNullSafe(F.col("g.source"))).select(F.col("c.source").alias("s"), F.col("part").alias("p"), "ahead", "source_size", "target", "offset")
    inner = Window.partitionBy("part", "source").orderBy("size", F.col("doc_id").asc_nulls_first(), "mark")
    ranked = dealt.withColumn("place", F.row_number().over(inner)).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("ahead") + F.col("place")
    crossed = F.floor(F.col("offset") + each * rank) - F.floor(F.col("offset") + each * (rank - 1))
    ranked = ranked.withColumn("copies", F.least(crossed, F.ceil(each)).cast("long"))
    return ranked.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row_col else []))
