"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones train logistic classifiers by a risk
estimator that corrects for the share of toxic texts among the unlabelled:
``prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0))``.
Where a batch's second term would turn negative, the classifier overfits the
positives, and only the first term is followed. The bias is the one with the
least risk of wrong decisions, estimated by the same correction.

A text is its set of distinct words; a word counts as itself and as its
prefixes of 4 to 6 letters, so inflected forms share evidence.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import computed, drawn, with_output

BITS = 18
PREFIXES = (4, 5, 6)
# Bounds of the training sample, in texts.
MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
CLASSIFIERS = 3
# Standard errors by which a feature's shares of the toxic and of the unlabelled texts must differ.
LEAST_Z = 7.0
# Words whose weight a task remembers.
REMEMBERED = 200_000
SEED = 11

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    parts = [f"w:{word}", *[f"p:{word[:n]}" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts]


def distinct_words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


class Sample(NamedTuple):
    """Hashed features of texts, one after the other, and where each text starts."""

    ids: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))

    def renamed(self, place: np.ndarray) -> Sample:
        """The same texts with feature ``i`` called ``place[i]``, without those whose place is negative."""
        mask = place[self.ids] >= 0
        sizes = np.bincount(self.rows()[mask], minlength=len(self))
        return Sample(place[self.ids[mask]], np.concatenate([[0], np.cumsum(sizes)]))

    def take(self, chosen: np.ndarray) -> Sample:
        sizes = np.diff(self.starts)[chosen]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[chosen] - starts[:-1], sizes)
        return Sample(self.ids[at], starts)

    def without_near_copies(self) -> Sample:
        """The texts but for those that share most of 16 minimum hashes with an earlier one."""
        if not len(self):
            return self
        rng = np.random.default_rng(0)
        full = np.flatnonzero(np.diff(self.starts))
        least = np.empty((len(full), 16), np.int64)
        for i in range(16):
            mixed = rng.permutation(1 << BITS).astype(np.int32)
            least[:, i] = np.minimum.reduceat(mixed[self.ids], self.starts[full]) if len(full) else 0
        seen: dict[tuple[int, int, int], list[int]] = {}
        kept = []
        for row, values in enumerate(least):
            keys = [(i, int(values[i]), int(values[i + 1])) for i in range(0, 16, 2)]
            others = {o for k in keys for o in seen.get(k, ())}
            if any((least[o] == values).sum() >= 9 for o in others):
                continue
            kept.append(row)
            for k in keys:
                seen.setdefault(k, []).append(row)
        return self.take(full[kept])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.rows(), weights[self.ids], len(self))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score_words(self, words: list[str]) -> list[float]:
        return [float(self.weights[features_of(w)].sum()) for w in words]


def gather(texts: DataFrame, ids: DataFrame, n: int, seed: int = SEED) -> Sample:
    """Features of the texts (``doc_id, text``) of at most ``n`` of ``ids``, those with the least seeded hash.

    Features are found where the texts are; only the drawn ids meet them, as a
    broadcast table. Of rows that repeat an id one counts, and equal sets of
    features count once, so copies weigh no more.
    """

    def features(block: list[str]) -> dict[str, list]:
        return {"ids": [np.array(sorted(f for w in distinct_words(t) for f in features_of(w)), np.int32) for t in block]}

    few = drawn(ids.select(F.col("doc_id").alias("chosen")).where("chosen IS NOT NULL"), n, seed, "chosen")
    picked = texts.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("chosen"), "left_semi")
    out, name = with_output(picked, features, {"ids": "array<int>"})
    one_each = out.groupBy("doc_id").agg(F.min(f"{name}.ids").alias("ids"))
    found = one_each.select("ids").distinct().sort("ids").toArrow().column("ids")
    ids = [np.asarray(c.flatten()) for c in found.chunks]
    sizes = [np.diff(np.asarray(c.offsets)) for c in found.chunks]
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return Sample(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk by the scores of positive and of unlabelled texts.

    The risk is the prior's share of the logistic loss of positives as such,
    and, unless that is negative, the loss of the unlabelled as negatives less
    the prior's share of that of the positives.
    """
    as_negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    of_positive = prior * (sigmoid(positive) - 1) / len(positive)
    if as_negative <= 0:
        return of_positive, np.zeros(len(unlabelled))
    return of_positive - prior * sigmoid(positive) / len(positive), sigmoid(unlabelled) / len(unlabelled)


def fit(positive: Sample, unlabelled: Sample, prior: float, seed: int = SEED, epochs: int = 60) -> Model:
    """One classifier. Without positives it scores everything as the prior."""
    size = 1 << BITS
    prior = min(max(prior, 1e-4), 0.999)
    base = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(size), base)

    def texts_with(sample: Sample) -> np.ndarray:
        # The features of a text are sorted: of equal ones the first counts.
        first = np.diff(sample.ids, prepend=-1) != 0
        first[sample.starts[:-1][np.diff(sample.starts) > 0]] = True
        return np.bincount(sample.ids[first], minlength=size)

    n_pos, n_unl = len(positive), len(unlabelled)
    pos, unl = texts_with(positive), texts_with(unlabelled)
    pooled = (pos + unl + 1) / (n_pos + n_unl + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    used = np.flatnonzero(np.abs(pos / n_pos - unl / n_unl) >= LEAST_Z * error)
    p = (pos[used] + 0.5) / (n_pos + 1)
    n = np.maximum((unl[used] + 0.5) / (n_unl + 1) - prior * p, 0.5 / (n_unl + 1)) / (1 - prior)
    # Features enter scaled by how much they tell, so telling ones learn first.
    scale = np.clip(np.log(p / n), -3, 3)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    positive, unlabelled = positive.renamed(place), unlabelled.renamed(place)
    every, size = np.zeros(size), len(used)

    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(size), base
    m, v, mb, vb, step = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    batches = max(1, min(4, len(unlabelled) // 256))
    for _ in range(epochs):
        p_parts = np.array_split(rng.permutation(len(positive)), batches)
        u_parts = np.array_split(rng.permutation(len(unlabelled)), batches)
        for some_p, some_u in zip(p_parts, u_parts):
            if not len(some_p) or not len(some_u):
                continue
            sp, su = positive.take(some_p), unlabelled.take(some_u)
            zp, zu = sp.scores(weights * scale, bias), su.scores(weights * scale, bias)
            gp, gu = risk_slopes(zp, zu, prior)
            grad = np.bincount(sp.ids, gp[sp.rows()], size) + np.bincount(su.ids, gu[su.rows()], size)
            grad = grad * scale + 1e-5 * weights
            slope = float(gp.sum() + gu.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * slope, 0.99 * vb + 0.01 * slope * slope
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            weights = weights - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            bias = bias - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    every[used] = weights * scale
    score = [sample.scores(weights * scale, 0.0) for sample in (positive, unlabelled)]
    return Model(every, _cut(*score, prior))


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Bias of the least estimated error: the prior's share of missed positives, twice, plus the share of unlabelled kept."""
    levels = np.unique(np.concatenate([positive, unlabelled]))
    cuts = (levels[:-1] + levels[1:]) / 2 if len(levels) > 1 else levels + 1.0
    missed = np.searchsorted(np.sort(positive), cuts) / len(positive)
    found = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = 2 * prior * missed + found
    # Of cuts that are about as good, the one in the widest gap.
    good = np.flatnonzero(risk <= risk.min() + 0.5 / len(unlabelled))
    width = levels[good + 1] - levels[good] if len(levels) > 1 else np.ones(len(good))
    return -float(cuts[good[np.argmax(width)]])


def train(
    positive: DataFrame,
    unlabelled: DataFrame,
    prior: float,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    seed: int = SEED,
) -> Model:
    """Mean of ``CLASSIFIERS`` classifiers from tables with ``doc_id, text``, of which so many texts at most are drawn.

    ``prior`` is the share of toxic texts among the unlabelled.
    """
    return _fitted(gather(positive, positive, max_positive, seed), gather(unlabelled, unlabelled, max_unlabelled, seed), prior, seed)


def _fitted(positive: Sample, unlabelled: Sample, prior: float, seed: int) -> Model:
    samples = positive.without_near_copies(), unlabelled.without_near_copies()
    models = [fit(*samples, prior, seed + i) for i in range(CLASSIFIERS)]
    return Model(sum(m.weights for m in models) / CLASSIFIERS, sum(m.bias for m in models) / CLASSIFIERS)


def train_from_labels(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    seed: int = SEED,
) -> Model:
    """Model from ``labels`` (``doc_id, toxic``) of ``docs``.

    Positives are the texts labelled 1; unlabelled are texts of any label or
    none, and the prior is the share of 1 among the labels. Labels with a null
    id or value are left out, of repeated ids the largest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    positive = gather(docs, known.where("toxic = 1"), max_positive, seed)
    return _fitted(positive, gather(docs, docs, max_unlabelled, seed), prior, seed)


def scorer(spark, model: Model):
    """Batch function of the field ``score``: probability of being toxic, of the bias alone for texts without letters."""
    shared = spark.sparkContext.broadcast(model)
    known: dict[str, float] = {}

    def score(texts: list[str]) -> dict[str, list]:
        if len(known) > REMEMBERED:
            known.clear()
        sums = []
        for text in texts:
            found = distinct_words(text)
            new = [w for w in found if w not in known]
            known.update(zip(new, shared.value.score_words(new)))
            # Summed in sorted order, equal texts have equal scores in every task.
            sums.append(shared.value.bias + sum(sorted(map(known.__getitem__, found))))
        return {"score": sigmoid(np.array(sums)).tolist()}

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; null texts count as empty.

    Texts without letters have the score of the bias alone. Equal texts have
    equal scores, repeated rows stay repeated, and an empty table stays empty;
    whole texts are read however long, and other columns are not.
    """
    return computed(docs, scorer(docs.sparkSession, model), {"score": "double"})


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``, with all their columns.

    Rows with equal texts stay or go together; a score at the threshold goes.
    """
    out, name = with_output(docs, scorer(docs.sparkSession, model), {"score": "double"})
    return out.where(F.col(f"{name}.score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
