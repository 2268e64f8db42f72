"""Mixing sources to target weights with Pareto order sampling.

Targets are found by filling to a common water level: sources share a total by weight, none above
its cap. The same filling inside a source gives every document an expected number of copies that
rises with the bit length of its size and stops at the cap. The whole part of that number is
allocated with certainty; the fractional part p is an inclusion probability. Documents are ranked by
(U / (1 - U)) / (p / (1 - p)), with U a keyed hash of the id, and the front of that ranking is taken
until the sample has the fixed number of words that the certain copies leave of the target.

Only sums by source, by (source, bit length) and by (source, rank bin) are ever gathered, so a hot
source is never sorted in one task: the bin in which the sample ends is found from sums, and only
that bin's places in the ranking are looked at one by one. The outcome is a row per source, and what a
document gives is a function of that row, its id, its size and its mark (a hash of its text).

Rows alike in all three share a place. The sample may end among them: then so many of them are
taken as still fit, numbered by the tasks that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, small_side, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Rank bins of a source; the last bin taken is ranked document by document.
BINS = 65536
#: Bins that are summed to one before the last stride taken is looked at bin by bin.
STRIDE = 256


#: What orders the ranking.
PLACE = ("rank", "doc_id", "size", "mark")


def _uniform(doc_id: Column, mark: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of md5 of the seed and the id (without one: '-' and the mark)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), mark))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _rank(doc_id: Column, mark: Column, p: Column, seed: str) -> Column:
    """The ranking odds q brought into [0, 1) as q / (1 + q)."""
    u = _uniform(doc_id, mark, seed)
    q = (u / (1 - u)) * ((1 - p) / p)
    return q / (1 + q)


def _level(rows: DataFrame, by: list[str], order: list[Column], cap: str, weight: str, total: str) -> DataFrame:
    """The level of each group ``by`` at which min(cap, weight * level) sums to ``total``; null where
    all caps together don't reach it. ``order``: ascending cap over weight."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("double")
    level = rows.withColumn("_level", left / F.sum(weight).over(after).cast("double"))
    fits = F.when(F.col("_level") * F.col(weight) <= F.col(cap), F.col("_level"))
    return level.groupBy(*by).agg(F.max(fits).alias("level"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and mark, which tells rows without an id, or of one id, apart by their texts."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size, a row for each source. Sources by
    code point, null last, have the weights in turn. There is a row per source here, never more, so
    windows over all rows stay as small as the list of sources."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1)))
    rows = rows.withColumn("_cap", F.col("source_size") * cap).withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * share).withColumn("_g", F.lit(0))
    level = _level(rows, ["_g"], [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()], "_cap", "_w", "_all")
    return rows.join(level, "_g").select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("level")), F.col("_cap")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the source, null included."""
    return left.join(right.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _bits(size: Column) -> Column:
    return F.length(F.bin(size))


def _copies(theta: Column, bits: Column, cap: float) -> Column:
    return F.coalesce(F.least(F.lit(cap), theta * bits), F.lit(cap))


def _upto(rows: DataFrame) -> DataFrame:
    """``rows`` with the words up to each bin of its source, from those ``before`` the first one."""
    window = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.col("before") + F.sum("words").over(window))


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, bins=BINS) -> DataFrame:
    """A row per source: source, source_size, target, theta (expected copies by bit of size; null: the
    cap) and cut, the last place of the ranking that is taken (null: none), with how many of its rows
    are (take) and how many it has (of; both null: all are).

    ``sizes``: doc_id, source, size, mark. A null source is one like any other; a source whose sizes are
    all null or zero has a target of zero. ``sizes`` is written once, since five small passes read it.
    """
    sizes = cut_lineage(sizes)
    by_bits = cut_lineage(sizes.where("size > 0").groupBy("source", _bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("words")))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(totals, weights, share, cap))
    parts = _by_source(by_bits, small_side(targets).select("source", "target"))
    parts = parts.withColumn("_cap", F.col("words") * cap).withColumn("_w", F.col("bits") * F.col("words"))
    theta = _level(parts, ["source"], [F.col("bits").desc()], "_cap", "_w", "target").withColumnRenamed("level", "theta")
    sure = F.floor(_copies(F.col("theta"), F.col("bits"), cap)) * F.col("words")
    sure = _by_source(by_bits, theta).groupBy("source").agg(F.sum(sure).alias("sure"), F.max("theta").alias("theta"))
    plan = _by_source(targets, sure, "left").withColumn("rest", F.col("target") - F.coalesce("sure", F.lit(0))).drop("sure")
    plan = cut_lineage(plan)
    drawn = _ranked(sizes, plan, cap, seed).where("rank is not null").withColumn("bin", F.floor(F.col("rank") * bins))
    ends = cut_lineage(drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max(F.struct(*PLACE)).alias("last")))
    # bins are summed by strides first, so that no window is longer than a stride or their number
    strides = ends.groupBy("source", F.floor(F.col("bin") / STRIDE).alias("bin")).agg(F.sum("words").alias("words"), F.max("rest").alias("rest"), F.max("last").alias("last"))
    strides = cut_lineage(_upto(strides.withColumn("before", F.lit(0))))
    halved = strides.where("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    halved = halved.select("source", F.col("edge.bin").alias("_stride"), "edge.before")
    ends = _upto(_by_source(ends, small_side(cut_lineage(halved))).where(F.floor(F.col("bin") / STRIDE) == F.col("_stride")).drop("_stride"))
    inside = strides.select("source", "upto", "rest", "last").unionByName(ends.select("source", "upto", "rest", "last"))
    whole = F.struct(*[F.col(f"last.{c}").alias(c) for c in PLACE], F.lit(None).cast("long").alias("take"), F.lit(None).cast("long").alias("of"))
    inside = inside.where("upto <= rest").select("source", whole.alias("cut"))
    edge = ends.where("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    edge = small_side(cut_lineage(edge.select("source", "edge.*"))).withColumnRenamed("bin", "_bin")
    before = Window.partitionBy("source").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    places = _by_source(drawn, edge).where("bin = _bin").groupBy("source", *PLACE).agg(F.count("*").alias("of"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    places = places.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("of")).over(before), F.lit(0)))
    # a row is taken if its middle doesn't pass the rest
    fit = F.floor((2 * F.col("rest") - 2 * F.col("ahead") - F.col("size")) / (2 * F.col("size"))) + 1
    last = places.withColumn("take", F.least(F.col("of"), fit).cast("long")).where("take > 0")
    cuts = inside.unionByName(last.select("source", F.struct(*PLACE, "take", "of").alias("cut"))).groupBy("source").agg(F.max("cut").alias("cut"))
    return cut_lineage(_by_source(plan, cuts, "left").select("source", "source_size", "target", "theta", "cut"))


def _ranked(sizes: DataFrame, plan: DataFrame, cap: float, seed: str) -> DataFrame:
    """``sizes`` with the columns of its source's plan, the expected copies and, where these have a
    fractional part, the place in the ranking."""
    out = _by_source(sizes, small_side(plan))
    out = out.withColumn("copies", F.when(F.col("size") > 0, _copies(F.col("theta"), _bits(F.col("size")), cap)).otherwise(0.0))
    part = F.col("copies") - F.floor("copies")
    return out.withColumn("rank", F.when(part > 0, _rank(F.col("doc_id"), F.col("mark"), part, seed)))


def mix(sizes: DataFrame, plan: DataFrame, cap=CAP, seed=SEED) -> DataFrame:
    """``sizes`` (doc_id, source, size, mark and any other columns) with source_size, target, copies
    (expected) and n_copies (allocated: the certain ones, and one more for a document of the sample)."""
    place, last = F.struct(*PLACE), F.struct(*[F.col(f"cut.{c}").alias(c) for c in PLACE])
    rows = _ranked(sizes, plan, cap, seed).withColumn("_drawn", F.coalesce(F.col("rank").isNotNull() & (place <= last), F.lit(False)))
    parted = plan.where("cut.take < cut.of")
    if not parted.isEmpty():
        split = F.coalesce((place == last) & (F.col("cut.take") < F.col("cut.of")), F.lit(False))
        # the rows of the place where the sample ends, written once, so that their numbers hold
        ties = cut_lineage(rows.where(split).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
        parts = ties.groupBy("source", "_part").agg(F.count("*").alias("_n"))
        ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = small_side(cut_lineage(parts.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), ahead.alias("_ahead"))))
        ties = ties.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
        number = F.col("_ahead") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("_row"))
        ties = ties.withColumn("_drawn", number <= F.col("cut.take"))
        rows = rows.where(~split).unionByName(ties.select(*rows.columns))
    more = F.when(F.col("_drawn"), 1).otherwise(0)
    return rows.withColumn("n_copies", (F.floor("copies") + more).cast("long")).drop("rank", "cut", "theta", "_drawn")


def mix_documents(docs: DataFrame, plan: DataFrame, cap=CAP, seed=SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, none for a document that isn't taken. An
    empty text has no words to take and isn't. All columns are kept, whatever their names."""
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), F.struct("*").alias("row"))
    taken = mix(packed, plan, cap, seed).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy")).select("row.*")


ORACLE = rf"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * CAST(2 AS DOUBLE) AS cap,
  CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total FROM totals),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / CAST(sum(w) OVER a AS DOUBLE) AS lv FROM weighed
  WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT max(lv) FROM levels WHERE lv * w <= cap)), cap) AS target FROM weighed),
bits AS (SELECT source, length(bin(size)) AS bits, CAST(sum(size) AS BIGINT) AS words FROM docs WHERE size > 0 GROUP BY ALL),
inner_levels AS (SELECT b.source, bits, words, words * CAST(2 AS DOUBLE) AS cap, bits * words AS w,
    (target - coalesce(sum(words * CAST(2 AS DOUBLE)) OVER p, 0)) / CAST(sum(bits * words) OVER f AS DOUBLE) AS lv
  FROM bits b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
  WINDOW p AS (PARTITION BY b.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY b.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
thetas AS (SELECT source, max(CASE WHEN lv * w <= cap THEN lv END) AS theta FROM inner_levels GROUP BY source),
rests AS (SELECT t.source, theta, target - coalesce(sure, 0) AS rest FROM targets t LEFT JOIN (
    SELECT b.source, max(theta) AS theta, sum(floor(coalesce(least(2, theta * bits), 2)) * words) AS sure FROM bits b JOIN thetas h ON b.source IS NOT DISTINCT FROM h.source GROUP BY b.source) s ON t.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT d.*, t.source_size, target, rest, CASE WHEN size > 0 THEN coalesce(least(2, theta * length(bin(size))), 2) ELSE 0 END AS c,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
odds AS (SELECT *, c - floor(c) AS p, (u / (1 - u)) * ((1 - (c - floor(c))) / nullif(c - floor(c), 0)) AS q FROM copies),
ranks AS (SELECT *, coalesce(sum(size) FILTER (p > 0) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM odds)
SELECT doc_id, source, size, source_size, target, CAST((floor(c) + CASE WHEN p > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM ranks
"""
