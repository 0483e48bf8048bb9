"""SimHash near-duplicates by a grid range-join over segment bit counts.

A fingerprint is cut into 32 segments of two bits. The bit counts of the
segments embed it in a space where the Manhattan distance never exceeds the
Hamming distance. Points within distance 2 differ on two axes at most, so with
the axes in blocks they fall in the same cell of at least one of the grids that
each leave two blocks out. Cells are joined by equality, candidates must pass
the Manhattan bound, and survivors are checked on the fingerprints themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import computed, fresh, with_output
from accountgraph.storage import pin, stored

SEED = 42
SHINGLE = 3
DISTANCE = 2
AXES = 32
# Blocks of axes; more blocks make more grids with finer cells, for more documents.
BLOCKS = 6
# Members of a cell up to which its pairs are compared one by one.
CROWD = 32
_LOW = 0x5555555555555555


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``, 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, n, step = np.zeros(64, np.int64), len(starts), 1 << 15
    for at in range(0, n, step):
        spans = zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row; null and blank texts have fingerprint 0."""
    return computed(docs, lambda texts: {"fp": [fingerprint(t) for t in texts]}, {"fp": "bigint"})


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedded(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each written in unary in two bits.

    The Manhattan distance of two count vectors is the number of differing
    bits of their codes.
    """
    low, half = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(half).bitwiseAND(low)
    two = fp.bitwiseAND(half).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(blocks: int) -> list[int]:
    """For each grid the bits of the axes it keeps, as signed longs."""
    edges = [AXES * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << 2 * axis for axis in range(a, b)) for a, b in zip(edges, edges[1:])]
    kept = [sum(block) - sum(left_out) for left_out in combinations(block, DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def links(nodes: DataFrame, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """``a, b`` with ``a < b`` among distinct fingerprints ``fp``: enough links to connect what lies within distance 2.

    Every link is a true one. In cells of up to ``crowd`` members all true
    links are found. Members of fuller cells meet at the points of their balls
    of radius 1 instead: two fingerprints are within distance 2 exactly when
    their balls share a point, so each is linked to the least member at every
    point, in 65 rows each however full the cell is.
    """
    masks = F.array(*[F.lit(m) for m in _masks(blocks)])
    cells = nodes.select("fp", F.posexplode(masks).alias("grid", "mask")).select(
        "fp", "grid", embedded(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pin(cells.join(sizes, ["grid", "cell"]))
    members = shared.where(F.col("n") <= crowd).groupBy("grid", "cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def near(a: Column, b: Column) -> Column:
        return (a < b) & (differing(embedded(a), embedded(b)) <= DISTANCE) & (differing(a, b) <= DISTANCE)

    pairs = F.transform(
        "fps", lambda a: F.transform(F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    )
    compared = members.select(F.inline(F.flatten(pairs)))

    one_bit = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    balls = crowded.select("fp", F.explode(one_bit).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    hubs = balls.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubbed = balls.join(hubs, "point").where("hub < fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return compared.union(hubbed).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node connected to each node that has an edge ``a, b``.

    Alternates large and small stars: every node is joined to the least of its
    neighbours until nothing changes, which takes about as many rounds as the
    logarithm of the longest path. Each round is checkpointed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = around.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            ends = [F.struct(F.col("m").alias("a"), F.col(end).alias("b")) for end in ("u", "v")]
            out = met.select(F.inline(F.array(*ends)))
        return out.where("a < b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.expr("sum(CAST(xxhash64(a, b) AS DECIMAL(20, 0)))")).first())

    now = pin(edges)
    before, after = None, state(now)
    while before != after:
        now = pin(star(star(now, large=True), large=False))
        before, after = after, state(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    Rows with equal fingerprints are one node, so copies never multiply. The
    component id is the least non-null ``doc_id`` reachable over links of
    Hamming distance 2 or less; null when a component has none. Repeated rows
    stay repeated; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs), "simhash").df
    nodes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = pin(components(links(nodes.select("fp"), blocks, crowd)).withColumnRenamed("node", "fp"))
    linked = nodes.join(rooted, "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints with a link to another one are looked up there.
    moved = rooted.join(of_root, "root").select("fp", "component_id")
    ids = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``grouped``, which has ``doc_id, text_hash, root`` of every row.

    The least id decides, then the least hash of the text; a null id comes
    last. Of rows that agree in both, one stays. ``text_hash`` is Spark's
    ``xxhash64`` of the text.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = grouped.groupBy("root").agg(F.min(order).alias("least"))
    id_key, hash_key, own = (fresh(docs.columns, c) for c in ("kept_id", "kept_hash", "own_hash"))
    kept = pin(kept.select(F.col("least.doc_id").alias(id_key), F.col("least.text_hash").alias(hash_key)))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_key)) & (F.col(own) == F.col(hash_key))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def representatives(docs: DataFrame, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each component does.

    The row with the component's least id stays, of several with that id the
    one with the least hash of its text, so that every component keeps one
    even where an id stands for different texts. A row without an id stays
    only where its component has no id.
    """
    out, name = with_output(docs.select("doc_id", "text"), lambda texts: {"fp": [fingerprint(t) for t in texts]}, {"fp": "bigint"})
    prints = stored(out.select("doc_id", F.xxhash64("text").alias("text_hash"), f"{name}.fp"), "simhash").df
    rooted = pin(components(links(prints.select("fp").distinct(), blocks, crowd)).withColumnRenamed("node", "fp"))
    grouped = prints.join(rooted, "fp", "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))
    return keep_one_each(docs, grouped)
