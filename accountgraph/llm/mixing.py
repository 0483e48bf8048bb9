"""A training mix whose source weights change over time.

Every source has a weight schedule over training time 0 to 1. Its integral is
the source's cumulative demand for tokens; a document is trained on at the time
when demand reaches the tokens of the source's documents before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountgraph.llm.common import fresh
from accountgraph.storage import stored

SEED = 7
MOST_EPOCHS = 3
# Weights of the sources in order of their names, and how much each one's schedule
# changes: its rate goes linearly from 1 - slope to 1 + slope times the mean.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
# Documents of all sources that one hash range has on average; a source's sizes are summed by range.
RANGE_ROWS = 2_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target, slope`` from ``source, source_size``.

    The targets share the sum of all sizes by weight. One above ``most`` times
    its source's size stops there and the excess goes to the others by weight,
    until none is above. Sources fill up in the order of capacity per weight:
    with those before it full, a source is full too if its share of the rest
    reaches its capacity, so one pass in that order settles all of them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("place") + 1)
    weighed = sizes.withColumn("place", place).select(
        "source", "source_size", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope")
    )
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole).cast("double")
    taken = F.coalesce(F.sum(F.col("source_size") * float(most)).over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - taken) / left
    full = level * F.col("weight") >= F.col("source_size") * float(most)
    stepped = weighed.select("*", level.alias("level"), full.alias("full"))
    # Beyond the full ones the level stays that of the first source that is not full.
    settled = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    share = settled["level"] * F.col("weight")
    capacity = F.col("source_size") * float(most)
    target = F.when(F.col("full"), capacity).otherwise(F.least(capacity, share))
    return stepped.select("source", "source_size", target.alias("target"), "slope")


def time_of(share: Column, slope: Column) -> Column:
    """Training time at which a source has met ``share`` of its demand.

    The rate ``1 - slope + 2 * slope * t`` integrates to
    ``(1 - slope) * t + slope * t * t``; this is its inverse.
    """
    a = F.lit(1.0) - slope
    root = F.sqrt(a * a + F.lit(4.0) * slope * share)
    return F.when(share <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * share / (a + root)))


def schedule(docs: DataFrame, most: float = MOST_EPOCHS, seed: int = SEED, ranges: int | None = None) -> DataFrame:
    """Columns of ``docs`` but for the text, with a struct column ``mix`` of size, source_size, target, taken, copies and times.

    The documents of a source form a stream in the order of a seeded hash of
    id and text; the stream is repeated until the target is met, and stops
    inside the last document it reaches, so ``taken`` of a source adds up to its
    target. ``copies`` counts the copies of which at least half is taken, and
    ``times`` has the training time at which each taken copy begins. Words of
    documents without any (null, empty or blank texts) add nothing: they have
    size 0 and are not taken, so they have no copies. Null sources form a source
    of their own. Rows that agree in id and text lie next to each other, and
    which of them comes first changes nothing. An empty table stays empty.

    Sizes and hashes are taken where the texts are; only they are sorted, in
    ``ranges`` parts of each source that grow in number with the rows.
    """
    mix, of, part, fact_of = (fresh(docs.columns, name) for name in ("mix", "part_source", "part_range", "fact"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    ranges = ranges or max(1, -(-docs.select("doc_id").count() // RANGE_ROWS))
    range_of = F.pmod(F.shiftrightunsigned(key, 20), F.lit(ranges))
    sized = docs.select(*others, F.struct(size_of(F.col("text")).alias("size"), key.alias("key"), range_of.alias("range")).alias(mix))
    plain = stored(sized, "sizes").df
    size = F.col(f"{mix}.size")
    parts = plain.groupBy("source", F.col(f"{mix}.range").alias(part)).agg(F.sum(size).alias("part"))
    up_to = Window.partitionBy("source").orderBy(part)
    offsets = parts.select(
        "source",
        part,
        (F.sum("part").over(up_to) - F.col("part")).alias("offset"),
        F.sum("part").over(Window.partitionBy("source")).alias("source_size"),
    )
    goals = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), most).drop("source_size")
    facts = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias(of), part, F.struct("offset", "source_size", "target", "slope").alias(fact_of)
    )
    joined = plain.join(facts, (F.col(f"{mix}.range") == F.col(part)) & F.col("source").eqNullSafe(F.col(of)))
    within = Window.partitionBy("source", f"{mix}.range").orderBy(f"{mix}.key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(f"{fact_of}.offset") + F.coalesce(F.sum(size).over(within), F.lit(0))
    placed = joined.withColumn(fact_of, F.col(fact_of).withField("start", start))
    fact = lambda name: F.col(f"{fact_of}.{name}")
    passes = F.sequence(F.lit(0), F.lit(int(most)))
    # Words of pass p are number p * source_size + start onward of the stream.
    goal = F.round(fact("target")).cast("bigint")
    begin = lambda p: p * fact("source_size") + fact("start")
    of_pass = F.transform(passes, lambda p: F.greatest(F.lit(0), F.least(size, goal - begin(p))))
    taken = F.least(F.aggregate(of_pass, F.lit(0).cast("bigint"), lambda a, b: a + b), size * int(most))
    copies = F.size(F.filter(of_pass, lambda w: (w > 0) & (2 * w >= size)))
    began = F.transform(
        F.filter(passes, lambda p: (size > 0) & (begin(p) < goal)), lambda p: time_of(begin(p) / fact("target"), fact("slope"))
    )
    made = F.struct(
        size.alias("size"), fact("source_size").alias("source_size"), fact("target").alias("target"), taken.alias("taken"),
        copies.alias("copies"), began.alias("times"),
    )
    return placed.select(*others, made.alias(mix))


def _scanned_plainly(docs: DataFrame) -> bool:
    """True for files that are read with columns or rows left out only, so that a place in a file is one row."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.nodeName() in ("LogicalRelation", "Relation")


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that tell every row from all others, the same ones however often it is read, and their names.

    Rows of files are known by file and place. Others are numbered and stored.
    """
    names = [fresh(docs.columns, n) for n in ("row_file", "row_check", "row_place")]
    if _scanned_plainly(docs):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        try:
            return docs.select("*", *[c.alias(n) for n, c in zip(names, (F.xxhash64(path), F.crc32(path), place))]), names
        except AnalysisException:
            pass  # a format without places
    return stored(docs.select("*", F.monotonically_increasing_id().alias(names[2])), "mixing").df, names[2:]


def curriculum(docs: DataFrame, most: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` in training order, each as often as the mix has copies of it.

    The schedule is made from narrow rows; the texts move once to meet it and
    once more, each row as often as it is taken, to be range-sorted by the time
    at which a copy begins.
    """
    rows, names = numbered(docs)
    mixed = schedule(rows.select(*names, "doc_id", "text", "source"), most, seed)
    mix = mixed.columns[-1]
    at = fresh([*docs.columns, *names], "at")
    times = F.slice(f"{mix}.times", 1, F.col(f"{mix}.copies"))
    plan = mixed.where(F.col(f"{mix}.copies") > 0).select(*names, times.alias(at))
    given = [F.col(f"`{c}`") for c in docs.columns]
    taken = rows.join(plan.hint("shuffle_hash"), names).select(*given, F.explode(at).alias(at))
    return taken.orderBy(at, "doc_id").select(*given)
