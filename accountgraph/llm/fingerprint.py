"""Bottom-k sketches of word shingles, as column expressions only.

A sketch is the ascending array of the ``k`` least distinct shingle hashes. The
sketch of a union is the bottom k of the sketches' union, so sketches of parts
merge into that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountgraph.llm.common import words

K = 128
SHINGLE = 5
# Parts that the sketches of one key are first merged in.
PARTS = 32
_HASHES = 2.0**64


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sketch of the word shingles of ``text``.

    A text of fewer words than a shingle has its whole sequence as the only
    shingle; null and blank texts have the empty sketch.
    """
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
        whole = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # The array of word hashes is bound once, as the element of a one-element array.
    return F.transform(F.array(hashed), lambda h: _bottom(F.array_distinct(shingles(h)), k))[0]


def serialised(sketch: Column) -> Column:
    """Sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return _bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, exact up to ``k`` shingles together; 1 for two empty sketches."""
    union = merged(a, b, k)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) > 0, F.size(both) / F.size(union)).otherwise(F.lit(1.0))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below ``k``."""
    # Hashes are signed: the share of the range up to the k-th least one.
    share = (F.element_at(sketch, -1).cast("double") + F.lit(_HASHES / 2)) / F.lit(_HASHES)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 when ``a`` is empty."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_count(a, k))).otherwise(F.lit(1.0))


def merge_by(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """``key, sketch`` merged over all rows of a key.

    The hashes of a key are first reduced to the bottom k of each of ``PARTS``
    parts, so a key with a large share of the rows is spread, and its last step
    meets at most ``PARTS * k`` hashes. Keys with empty sketches only are kept.
    """
    each = sketches.select(key, F.explode(column).alias("hash")).distinct()
    part = F.pmod(F.xxhash64("hash"), F.lit(PARTS))
    first = Window.partitionBy(key, "part").orderBy("hash")
    few = each.withColumn("part", part).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    least = few.groupBy(key).agg(F.collect_list("hash").alias("hashes")).select(key, _bottom(F.col("hashes"), k).alias("merged"))
    none = F.array().cast("array<bigint>")
    keys = sketches.select(key).distinct()
    found = keys.join(least.withColumnRenamed(key, "found"), F.col(key).eqNullSafe(F.col("found")), "left")
    return found.select(key, F.coalesce("merged", none).alias("sketch"))


def count_above(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are above ``value``, by halving steps: as many as the logarithm of their number."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    # One text literal, which Spark turns into an array once, however many bounds there are.
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << s for s in range(n.bit_length() - 1, -1, -1)]

    def step(below: Column, size: Column) -> Column:
        fits = (below + size <= n) & (F.get(table, below + size - 1) <= value)
        return F.when(fits, below + size).otherwise(below)

    return F.lit(n) - F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _prefix(text: Column) -> Column:
    """The first seven bytes of a text as a number that keeps the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def beside_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch`` of every row, null texts as empty ones.

    The next document has the next smaller id (ties by text, null ids last);
    after the last one comes the first. Rows are dealt to ranges of ids, those
    without an id to ranges of their texts' beginnings, and the first rows of
    each range also to the range before it, so no sort ever sees all rows. Only
    the bounds of the ranges, about twice ``buckets`` numbers, reach the driver.
    An empty table stays empty; repeated rows are each other's next. Rows
    without an id whose texts begin with the same seven bytes stay in one range.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    beginning = F.when(F.col("doc_id").isNull(), _prefix(F.col("text")))
    texts = texts.select("*", beginning.alias("beginning"))
    accuracy = F.lit(10 * buckets)
    of_ids, of_texts = texts.agg(F.percentile_approx("doc_id", cuts, accuracy), F.percentile_approx("beginning", cuts, accuracy)).first()
    ids, beginnings = sorted(set(of_ids or [])), sorted(set(of_texts or []))
    # Range 0 has the largest ids; rows without an id follow the smallest one, by text.
    behind = F.lit(len(ids) + 1 + len(beginnings)) - count_above(beginnings, F.col("beginning"))
    above = F.when(F.col("doc_id").isNull(), behind).otherwise(count_above(ids, F.col("doc_id"))).cast("int")
    ranged = texts.select("*", above.alias("range"))
    first = ranged.groupBy("range").agg(F.max("doc_id").alias("head"), F.min("beginning").alias("of"))
    heads = sorted((r["range"], r["head"], r["of"]) for r in first.collect()) or [(0, None, None)]
    last = heads[-1][0]
    places = [(after[1], after[2], before[0], False) for before, after in zip(heads, heads[1:])] + [(*heads[0][1:], last, True)]
    extra = spark.createDataFrame(places, "head bigint, of bigint, place int, wrapped boolean")
    by_head = extra.groupBy("head", "of").agg(F.collect_list(F.struct(F.col("place").alias("range"), "wrapped", F.lit(True).alias("extra"))).alias("also"))
    own = F.array(F.struct(F.col("range"), F.lit(False).alias("wrapped"), F.lit(False).alias("extra")))
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & F.col("beginning").eqNullSafe(F.col("of"))
    dealt = ranged.join(F.broadcast(by_head), is_head, "left").select(
        "doc_id", "text", F.inline(F.concat(own, F.coalesce("also", F.array().cast("array<struct<range:int,wrapped:boolean,extra:boolean>>"))))
    )
    order = Window.partitionBy("range").orderBy("wrapped", F.desc_nulls_last("doc_id"), "extra", "text")
    sketched = dealt.repartition("range").withColumn("sketch", sketch(F.col("text")))
    beside = sketched.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "sketch")])
    return beside.where("NOT extra").select("doc_id", "text", "sketch", "next_text", "next_sketch")
