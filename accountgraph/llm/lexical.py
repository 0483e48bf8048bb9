"""Ranked lexical search by branch and bound over a tree of document vectors.

Documents are reduced to the terms that some item asks for. Their vectors, with
frequent terms first, share the paths of a prefix tree, cut off where a subtree
is small. A node knows the largest frequency of every term and the least length
norm below it, which bound the score that an item can reach there. Each item
goes down the tree depth first, better bounds first, and leaves out subtrees
that cannot reach its best documents so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import first_ranks, tables_of, text_bytes
from accountgraph.storage import stored

# Score constants in 64-bit integers (fixed values): a document's norm is 100 - 75 +
# 75 * n * N / L, a term adds its weight times 10^9 * tf / (1000 * tf + 8 * norm).
LENGTH_SHARE = 75
SCALE = 1_000_000_000
TF_SCALE = 1_000
NORM_SCALE = 8
BEST = 10
# Items of one pass over the documents, and distinct terms of items on average.
ITEMS = 2_000
ITEM_TERMS = 200_000
# Documents of one tree, documents of a leaf, and cells of the table of term frequencies of all nodes.
BLOCK = 16_384
LEAF = 48
CELLS = 8_000_000

# Bytes between terms become spaces, A-Z become a-z (fixed classes).
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of letters, digits and all beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TABLE).split()


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """``key`` as ``item``, and each term with its number ``times``; rows without terms are left out.

    The rows' order numbers them in ``slot``, so items that repeat stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(terms(t), object), return_counts=True) for t in text_bytes(batch.column(2))]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([f[0].tolist() for f in found], pa.list_(pa.binary())),
                pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "item", "terms", "times"])

    kind = dict(rows.dtypes)[key]
    numbered = rows.select(F.monotonically_increasing_id().alias("slot"), F.col(f"`{key}`").alias("item"), "text")
    return numbered.mapInArrow(run, f"slot bigint, item {kind}, terms array<binary>, times array<bigint>").where("size(terms) > 0")


class Vectors(NamedTuple):
    """Rows of a block: ids, sizes and norms, and the restricted vectors one after the other, frequent terms first."""

    row: np.ndarray
    norm: np.ndarray
    start: np.ndarray
    term: np.ndarray
    tf: np.ndarray


class Tree(NamedTuple):
    """Prefix tree over rows in the order of their vectors.

    A node stands for the rows ``low`` to ``high``; its children are the nodes
    ``first`` to ``last``, none for a leaf.
    """

    low: list[int]
    high: list[int]
    first: list[int]
    last: list[int]
    most_tf: np.ndarray
    least_norm: np.ndarray


def in_path_order(vectors: Vectors) -> Vectors:
    """The same rows sorted by their vectors, so that rows with a common beginning are neighbours."""
    sizes = np.diff(vectors.start)
    # Big-endian bytes compare like the sequences of term numbers.
    packed = vectors.term.astype(">u4").tobytes()
    paths = [packed[4 * a : 4 * b] for a, b in zip(vectors.start[:-1].tolist(), vectors.start[1:].tolist())]
    order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
    start = np.concatenate([[0], np.cumsum(sizes[order])])
    at = np.arange(start[-1]) + np.repeat(vectors.start[:-1][order] - start[:-1], sizes[order])
    return Vectors(vectors.row[order], vectors.norm[order], start, vectors.term[at], vectors.tf[at])


def grown(vectors: Vectors, n_terms: int, leaf: int = LEAF, cells: int = CELLS) -> Tree:
    """Tree over ``vectors`` in path order.

    A node's rows agree in their first terms. It is split by the next term
    unless it has few rows; small neighbours among the parts stay together in
    one leaf. The table of term frequencies has at most ``cells`` cells: nodes
    that would go beyond stay leaves, the upper ones being split first.
    """
    n = len(vectors.row)
    most_nodes = max(1, cells // n_terms)
    sizes = np.diff(vectors.start)
    low, high, first, last, depth = [0], [n], [0], [0], [0]
    at = 0
    while at < len(low):
        a, b, d = low[at], high[at], depth[at]
        edges = np.zeros(0, np.int64)
        while b - a > leaf and not len(edges):
            # Path order puts rows that end here first, then the rows by their next term.
            index = np.minimum(vectors.start[a:b] + d, len(vectors.term) - 1)
            following = np.where(sizes[a:b] > d, vectors.term[index], -1)
            edges = np.flatnonzero(np.diff(following)) + a + 1
            if following[-1] < 0:
                break  # equal vectors
            d += 1  # a path without branches is no node of its own
        cuts = [a]
        for x, y in zip([a, *edges.tolist()], [*edges.tolist(), b]):
            if y - cuts[-1] > leaf and x > cuts[-1]:
                cuts.append(x)
        if len(cuts) > 1 and len(low) + len(cuts) <= most_nodes:
            first[at], last[at] = len(low), len(low) + len(cuts)
            for x, y in zip(cuts, [*cuts[1:], b]):
                low.append(x)
                high.append(y)
                first.append(0)
                last.append(0)
                depth.append(d)
        at += 1
    most_tf = np.zeros((len(low), n_terms), np.int32)
    least_norm = np.empty(len(low), np.int64)
    for node in range(len(low) - 1, -1, -1):
        a, b, x, y = low[node], high[node], first[node], last[node]
        if y > x:
            most_tf[node], least_norm[node] = most_tf[x:y].max(axis=0), least_norm[x:y].min()
        else:
            s = slice(vectors.start[a], vectors.start[b])
            np.maximum.at(most_tf[node], vectors.term[s], vectors.tf[s])
            least_norm[node] = vectors.norm[a:b].min()
    return Tree(low, high, first, last, most_tf, least_norm)


def gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What one unit of weight adds for a term with this frequency; grows with it and falls with the norm."""
    return SCALE * tf.astype(np.int64) // (TF_SCALE * tf.astype(np.int64) + NORM_SCALE * norm)


class Best:
    """An item's best rows so far: their scores and numbers, and the score that a further row has to reach."""

    def __init__(self, most: int, least: int = 0):
        self.most, self.least = most, least
        self.score = self.row = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, -score))[: self.most]
        self.score, self.row = score[order], row[order]
        if len(order) == self.most:
            self.least = max(self.least, int(self.score[-1]))


def searched(tree: Tree, vectors: Vectors, gains: np.ndarray, term: np.ndarray, weight: np.ndarray, look_up: np.ndarray, best: Best) -> int:
    """Add the tree's rows with the best scores to ``best``; the number of nodes visited.

    ``weight`` is that of each ``term`` times its number in the item, and
    ``look_up`` the same for every term, 0 for others. A subtree stays out when its
    bound is 0 or below the worst of enough rows; one that reaches it may
    hold a row that wins the tie.
    """

    def bounds(nodes: slice) -> np.ndarray:
        return gain(tree.most_tf[nodes, :][:, term], tree.least_norm[nodes, None]) @ weight

    visited = 0
    stack = [(int(bounds(slice(0, 1))[0]), 0)]
    while stack:
        bound, node = stack.pop()
        if bound <= 0 or bound < best.least:
            continue
        visited += 1
        x, y = tree.first[node], tree.last[node]
        if y > x:
            each = bounds(slice(x, y))
            order = np.argsort(each, kind="stable")
            keep = order[(each[order] > 0) & (each[order] >= best.least)]
            stack.extend(zip(each[keep].tolist(), (keep + x).tolist()))
            continue
        a, b = tree.low[node], tree.high[node]
        s, e = vectors.start[a], vectors.start[b]
        added = np.concatenate([[0], np.cumsum(look_up[vectors.term[s:e]] * gains[s:e])])
        score = added[vectors.start[a + 1 : b + 1] - s] - added[vectors.start[a:b] - s]
        good = (score > 0) & (score >= best.least)
        if good.any():
            best.add(score[good], vectors.row[a:b][good])
    return visited


class Question(NamedTuple):
    """Items of a pass: number and id of each, its terms by place in the frequency order, and term weights times counts."""

    slot: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_terms: int
    n_docs: int
    n_words: int


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, number ``n`` of terms, and the numbers ``terms`` and frequencies ``tfs`` of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n, sizes, all_terms, all_tfs = [], [0], [], []
            for text in text_bytes(batch.column(1)):
                found = terms(text)
                n.append(len(found))
                own = np.fromiter((i for w in found if (i := number.get(w)) is not None), np.int32)
                term, tf = np.unique(own, return_counts=True)
                sizes.append(len(term))
                all_terms.append(term)
                all_tfs.append(tf)
            ends = pa.array(np.cumsum(sizes), pa.int32())
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))
                for parts in (all_terms, all_tfs)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def candidates(vectors: DataFrame, asked: Question, place: np.ndarray, most: int = BEST) -> DataFrame:
    """``slot, doc_id, score`` of the best rows that each task finds for each item.

    ``place`` gives each vocabulary number its place in the frequency order.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((asked, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, place = shared.value
        best = [Best(most) for _ in asked.slot]
        ids = None
        look_up = np.zeros(asked.n_terms, np.int64)
        for table in tables_of(batches, BLOCK):
            table = table.combine_chunks()
            # Row numbers follow the ids, so that they settle ties; null ids come last.
            table = table.sort_by("doc_id")
            lists = [c.chunk(0) if c.num_chunks else pa.array([], pa.list_(pa.int32())) for c in (table["terms"], table["tfs"])]
            start = lists[0].offsets.to_numpy().astype(np.int64)
            start = start - start[0]
            term = place[lists[0].flatten().to_numpy()]
            tf = lists[1].flatten().to_numpy()
            owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
            order = np.lexsort((term, owner))
            n = table["n"].to_numpy()
            norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * asked.n_docs) // asked.n_words
            vectors = in_path_order(Vectors(np.arange(len(n)), norm, start, term[order], tf[order]))
            tree = grown(vectors, asked.n_terms)
            gains = gain(vectors.tf, np.repeat(vectors.norm, np.diff(vectors.start)))
            own_ids = table["doc_id"].combine_chunks()
            found = []
            for i, (terms_of, weights) in enumerate(zip(asked.terms, asked.weights)):
                own = Best(most, best[i].least)
                look_up[terms_of] = weights
                searched(tree, vectors, gains, terms_of, weights, look_up, own)
                look_up[terms_of] = 0
                found.append(own)
            ids = own_ids if ids is None else ids
            ids = united(best, ids, found, own_ids)
        if ids is not None:
            rows = np.concatenate([b.row for b in best])
            slots = np.repeat(np.array(asked.slot, np.int64), [len(b.row) for b in best])
            score = np.concatenate([b.score for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(slots), ids.take(pa.array(rows)), pa.array(score)], ["slot", "doc_id", "score"])

    kind = dict(vectors.dtypes)["doc_id"]
    return vectors.where(F.size("terms") > 0).mapInArrow(run, f"slot bigint, doc_id {kind}, score bigint")


def united(best: list[Best], ids: pa.Array, more: list[Best], more_ids: pa.Array) -> pa.Array:
    """Add rows of another block to ``best``; the ids of all rows that ``best`` then numbers, in order."""
    rows = np.concatenate([b.row for b in best])
    new = np.concatenate([b.row for b in more])
    used, used_new = np.unique(rows), np.unique(new)
    every = pa.concat_arrays([ids.take(pa.array(used)), more_ids.take(pa.array(used_new))])
    # Numbers follow the ids, so that they settle ties; null ids come last.
    order = pc.sort_indices(every, null_placement="at_end").to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    for b, m in zip(best, more):
        b.row = number[np.searchsorted(used, b.row)]
        b.add(m.score, number[len(used) + np.searchsorted(used_new, m.row)])
    return every.take(pa.array(order))


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of every item with a score above 0.

    Equal scores come by ascending id, null ids last. Rows of ``docs`` and
    ``items`` stand for themselves even where an id repeats or is null; an item or
    a document without terms (null, empty or marks only) has no part in it. An
    empty table gives no rows. Whole texts count however long they are; columns
    other than the ids and ``text`` are not read.

    Items are asked in passes of a bounded number, each with one scan of the
    documents that keeps the terms asked for, and one search of what was kept.
    """
    spark = docs.sparkSession
    asked = stored(term_counts(items, "item_id"), "items")
    n_items, n_terms = asked.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    passes = max(-(-n_items // ITEMS), -(-n_terms // ITEM_TERMS))
    out = None
    if passes > 1:
        # Dealt out evenly, so that a pass has a bounded number of items.
        dealt = stored(asked.df.repartition(passes).withColumn("pass", F.spark_partition_id()), "items")
        asked.free()
        asked = dealt
    for number in range(passes):
        some = asked.df.where(F.col("pass") == number) if passes > 1 else asked.df
        found = _one_pass(docs, some.select("slot", "terms", "times").collect(), most)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    kinds = f"rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint"
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, {kinds}")
    ids = asked.df.select("slot", F.col("item").alias("item_id"))
    return out.join(ids, "slot").select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, items: list, most: int) -> DataFrame | None:
    """``slot, rank, doc_id, score`` of a bounded number of items; None without terms."""
    vocabulary = sorted({bytes(t) for r in items for t in r["terms"]})
    if not vocabulary:
        return None
    kept = stored(restricted(docs, vocabulary), "vectors")
    vectors = kept.df
    n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        kept.free()
        return None
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        df[r["term"]] = r["df"]
    # Frequent terms first: their paths are shared by most documents.
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    own = [np.array([number[bytes(t)] for t in r["terms"]], np.int64) for r in items]
    weights = [weight[o] * np.array(r["times"], np.int64) for o, r in zip(own, items)]
    question = Question([r["slot"] for r in items], [place[o] for o in own], weights, len(vocabulary), n_docs, n_words)
    found = candidates(vectors, question, place.astype(np.int32), most)
    out = stored(first_ranks(found, ["slot"], [F.desc("score"), F.asc_nulls_last("doc_id")], most), "ranked").df
    kept.free()
    return out
