"""Text quality by nearest-neighbour voting in a latent-semantic space.

Labelled texts become TF-IDF vectors of word shapes and shape pairs, reduced by
a singular value decomposition. These bounded vectors are broadcast; every
document is projected alike, its cosine with every labelled vector is computed
exactly, in blocks, and its nearest ones vote with their similarities.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import WORD, computed, drawn, with_output

SHAPES = 1024
TERMS = 4096
RANK = 48
NEIGHBOURS = 15
# Bound of the labelled sample, in texts.
MAX_LABELLED = 4_000
# Documents whose cosines are computed at once.
BLOCK = 512
REMEMBERED = 200_000
SEED = 3

_RUNS = [(re.compile(p), r) for p, r in ((r"\d+", "0"), (r"[^\W\d_]+", None), (r"(\W|_)\1+", r"\1\1"))]


def _letters(match: re.Match) -> str:
    run = match[0]
    if run.isupper():
        return "A" if len(run) > 1 else "B"
    return "Aa" if run[0].isupper() else "a"


def shape_of(word: str) -> int:
    """Hashed shape: runs of digits and letters are one sign each, repeated marks two."""
    shape = _RUNS[0][0].sub("0", word)
    shape = _RUNS[1][0].sub(_letters, shape)
    shape = _RUNS[2][0].sub(_RUNS[2][1], shape)
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (SHAPES - 32)


def terms(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of a text and their square-rooted relative counts.

    Terms are shapes, neighbouring shapes, how often a word repeats the one
    before it, and the share of distinct words.
    """
    found = WORD.findall(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    known.update((w, shape_of(w)) for w in set(found) if w not in known)
    shapes = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    pairs = SHAPES + (shapes[:-1] * 40_503 + shapes[1:] * 9_973) % (TERMS - SHAPES)
    same = sum(map(str.__eq__, found, found[1:]))
    share = int(8 * len(set(found)) / len(found))
    extra = [SHAPES - 32 + min(7, int(16 * same / len(found))), SHAPES - 16 + share]
    numbers, counts = np.unique(np.concatenate([shapes, pairs, np.repeat(extra, max(1, len(found) // 4))]), return_counts=True)
    return numbers, np.sqrt(counts / len(found))


def _remember(known: dict) -> None:
    if len(known) > REMEMBERED:
        known.clear()


class Space(NamedTuple):
    """Labelled unit vectors, their labels, and the projection of terms."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(_dense(rows) @ self.projection)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for row, (numbers, values) in zip(out, rows):
        row[numbers] = values
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK) -> Space | None:
    if not rows:
        return None
    tf = _dense(rows)
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 0.1
    weighted = _unit(tf * idf)
    # Right singular vectors, from the eigenvectors of the smaller square of the terms in use.
    used = np.flatnonzero((tf > 0).any(axis=0))
    square = weighted[:, used].T @ weighted[:, used]
    _, vectors = np.linalg.eigh(square.astype(np.float64))
    projection = np.zeros((TERMS, min(rank, len(used))), np.float32)
    projection[used] = vectors[:, ::-1][:, :rank]
    projection *= idf[:, None]
    return Space(projection, _unit(tf @ projection), labels.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> Space | None:
    """Space of at most ``max_labelled`` texts of ``docs`` that ``labels`` (``doc_id, quality``) covers; None without any.

    Drawn by the least seeded hash of the id; the largest label of a repeated
    id counts, and rows with a null id or label are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = drawn(known, max_labelled, seed, "doc_id").toDF("chosen", "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "quality")

    def found(block: list[str]) -> dict[str, list]:
        made = [terms(t, {}) for t in block]
        return {"numbers": [n.tolist() for n, _ in made], "values": [v.tolist() for _, v in made]}

    out, name = with_output(texts, found, {"numbers": "array<int>", "values": "array<double>"})
    # Repeated ids may bring more rows than ids were drawn.
    rows = out.select("doc_id", "quality", f"{name}.*").orderBy("doc_id", "numbers").limit(max_labelled).collect()
    return fit([(np.array(r.numbers, np.int64), np.array(r.values)) for r in rows], np.array([r.quality for r in rows]))


def vote(space: Space, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of the nearest labelled vectors, weighted by cosine; of all of them for what has no similar one."""
    out = np.empty(len(vectors))
    k = min(neighbours, len(space.labels))
    for at in range(0, len(vectors), BLOCK):
        cosine = vectors[at : at + BLOCK] @ space.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0)
        total = weight.sum(axis=1)
        voted = (weight * space.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        out[at : at + BLOCK] = np.where(total > 1e-6, voted, space.labels.mean())
    return np.clip(out, 0, 1)


def scorer(spark, space: Space | None):
    """Batch function of the field ``score``; 0.5 where nothing was learned."""
    shared = spark.sparkContext.broadcast(space)
    known: dict[str, int] = {}

    def score(texts: list[str]) -> dict[str, list]:
        model, out = shared.value, []
        for at in range(0, len(texts), BLOCK):
            _remember(known)
            rows = [terms(t, known) for t in texts[at : at + BLOCK]]
            out.extend([0.5] * len(rows) if model is None else vote(model, model.project(rows)).round(6).tolist())
        return {"score": out}

    return score


def scored(docs: DataFrame, space: Space | None) -> DataFrame:
    """``doc_id, score`` of every row; null and blank texts get the mean label."""
    return computed(docs, scorer(docs.sparkSession, space), {"score": "double"})
