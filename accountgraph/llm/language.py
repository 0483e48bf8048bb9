"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes in both directions, gives every position a
distribution over languages, and a document the mean of its positions'. It is
trained by backpropagation through time on windows of labelled documents.

Long texts are read in spans with some bytes of context on either side, so
every byte is labelled once and work is even however long a text is.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import computed, with_output

HIDDEN = 8
# Bytes of a span that are labelled together, and of context before and after them.
SPAN = 256
CONTEXT = 16
# Spans read side by side, fewer with more than so many languages.
LANES = 2048
FULL_LANES = 32
# Bounds of the training sample: documents of a language, of all languages unless
# each has the least number, windows of a document and their bytes.
MAX_DOCUMENTS = 400
SAMPLE = 12_800
LEAST_DOCUMENTS = 20
WINDOWS = 3
WINDOW = 96
BATCH = 256
# Ids are drawn by a hash below HASHES; so many times the share needed may leave the tasks.
HASHES = 1 << 40
SPARE = 4
# Training steps; small samples are gone through more often.
STEPS = 200
SEED = 5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


class Network(NamedTuple):
    """Per direction: input rows by byte, recurrent weights and output weights; then the output bias.

    Columns of the first two are the update gate, the reset gate and the candidate.
    """

    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray
    languages: list[str]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(steps: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """States of all steps (``bytes`` by lane) and what the backward pass needs."""
    n_steps, lanes = steps.shape
    size = u.shape[0]
    h = np.zeros((n_steps + 1, lanes, size), np.float32)
    gates = np.empty((n_steps, lanes, 2 * size), np.float32)
    candidates, inner = np.empty((2, n_steps, lanes, size), np.float32)
    for t in range(n_steps):
        a, b = table[steps[t]], h[t] @ u
        gates[t] = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
        inner[t] = b[:, 2 * size :]
        candidates[t] = np.tanh(a[:, 2 * size :] + gates[t, :, size:] * inner[t])
        h[t + 1] = candidates[t] + gates[t, :, :size] * (h[t] - candidates[t])
    return h, gates, candidates, inner


def _backward(steps, u, made, d_out):
    """Gradients of table and recurrent weights from those of the states."""
    h, gates, candidates, inner = made
    size = u.shape[0]
    d_u, d_h = np.zeros_like(u), np.zeros_like(h[0])
    d_in = np.empty((*steps.shape, 3 * size), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        z, r, n = gates[t, :, :size], gates[t, :, size:], candidates[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h[t] - n) * z * (1 - z)
        d_r = d_n * inner[t] * r * (1 - r)
        d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h[t].T @ d_b
        d_h = d_h * z + d_b @ u.T
    flat, rows = steps.ravel(), d_in.reshape(-1, 3 * size)
    d_table = np.stack([np.bincount(flat, rows[:, j], 256) for j in range(3 * size)], axis=1)
    return d_table.astype(np.float32), d_u


def _reversed(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each lane's first ``lengths`` entries (axis 0 is time) in reverse, what is beyond stays in place."""
    time = np.arange(rows.shape[0])[:, None]
    at = np.where(time < lengths, lengths - 1 - time, time)
    return np.take_along_axis(rows, at if rows.ndim == 2 else at[:, :, None], axis=0)


def fit(windows: list[np.ndarray], targets: np.ndarray, languages: list[str], seed: int = SEED, steps: int = STEPS, hidden: int = HIDDEN) -> Network:
    """Network trained with Adam on the mean cross-entropy of all positions of the windows."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    make = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    weights = [make(256, 3 * hidden, s=0.3) for _ in range(2)] + [make(hidden, 3 * hidden, s=0.4) for _ in range(2)]
    weights += [make(hidden, n_lang, s=0.3) for _ in range(2)] + [np.zeros(n_lang, np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    batches = -(-len(windows) // BATCH)
    epochs = -(-steps // batches)
    total = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            lengths = np.array([len(windows[i]) for i in chosen])
            lanes = np.zeros((lengths.max(), len(chosen)), np.uint8)
            for lane, i in enumerate(chosen):
                lanes[: lengths[lane], lane] = windows[i]
            both = [lanes, _reversed(lanes, lengths)]
            made = [_forward(s, weights[i], weights[2 + i]) for i, s in enumerate(both)]
            states = [made[0][0][1:], _reversed(made[1][0][1:], lengths)]
            logits = states[0] @ weights[4] + states[1] @ weights[5] + weights[6]
            p = np.exp(logits - logits.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(len(chosen)), targets[chosen]] -= 1
            p *= (np.arange(len(lanes))[:, None] < lengths)[:, :, None] / lengths.sum()
            p = p.astype(np.float32)
            d_states = [p @ weights[4].T, _reversed(p @ weights[5].T, lengths)]
            back = [_backward(s, weights[2 + i], made[i], d_states[i]) for i, s in enumerate(both)]
            flat = p.reshape(-1, n_lang)
            grads = [b[0] for b in back] + [b[1] for b in back]
            grads += [s.reshape(-1, hidden).T @ flat for s in states] + [flat.sum(axis=0)]
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for w, g, m, v in zip(weights, grads, first, second):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Network(weights[0:2], weights[2:4], weights[4:6], weights[6], languages)


def cut(text: str, windows: int, window: int) -> list[bytes]:
    """Evenly spread windows of at most ``window`` bytes that begin and end between characters."""
    data = text.encode("utf-8", "replace")
    out = []
    for start in sorted({int(s) for s in np.linspace(0, max(0, len(data) - window), windows)}):
        part = data[start : start + window]
        # Bytes 10xxxxxx go on with a character.
        first = next((i for i, c in enumerate(part) if c & 0xC0 != 0x80), len(part))
        out.append(part[first:].decode("utf-8", "ignore").encode())
    return [part for part in out if part]


def sample(docs: DataFrame, of_each: dict[str, tuple[int, int]], seed: int) -> list[tuple]:
    """``(doc_id, lang)`` of the rows of each language with the least seeded hash of the id.

    ``of_each`` has the number to draw from a language and the number of its
    rows. Only ids whose hash lies below ``SPARE`` times the share to be drawn
    leave their tasks, so the rows collected are bounded by the numbers drawn,
    however many rows a language has.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(HASHES))
    least = F.lit(0)
    for lang, (n, rows) in of_each.items():
        least = F.when(F.col("lang") == lang, F.lit(min(HASHES, SPARE * HASHES * n // rows + SPARE))).otherwise(least)
    found: dict[str, list] = {}
    for r in docs.select("doc_id", "lang", draw.alias("draw")).where(F.col("draw") < least).distinct().collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["doc_id"]))
    return [(doc, lang) for lang, rows in found.items() for _, doc in sorted(rows)[: of_each[lang][0]]]


def train(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    windows: int = WINDOWS,
    window: int = WINDOW,
    seed: int = SEED,
) -> Network | None:
    """Network from ``doc_id, text, lang``; None where no row has a language.

    Learns every language, from at most ``max_documents`` documents of each
    (least seeded hash of the id), in ``windows`` evenly spread windows of
    ``window`` bytes of a document. With many languages each has fewer
    documents, but no less than ``LEAST_DOCUMENTS`` where it has them. Rows
    with a null id, text or language teach nothing; of an id that repeats with
    one language every row does.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return None
    most = min(max_documents, max(LEAST_DOCUMENTS, SAMPLE // len(languages)))
    chosen = sample(known, {lang: (most, n) for lang, n in counts.items()}, seed)
    kind = dict(docs.dtypes)["doc_id"]
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"chosen {kind}, of string"))
    picked = known.join(ids, (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("of")), "left_semi")
    out, name = with_output(picked, lambda texts: {"windows": [cut(t, windows, window) for t in texts]}, {"windows": "array<binary>"})
    # Equal windows of one document, as of repeated rows, count once.
    rows = out.select("doc_id", "lang", F.posexplode(f"{name}.windows").alias("nth", "part")).distinct().collect()
    rows = sorted((r["lang"], r["doc_id"], r["nth"], bytes(r["part"])) for r in rows)
    number = {lang: i for i, lang in enumerate(languages)}
    parts = [np.frombuffer(part, np.uint8) for *_, part in rows]
    return fit(parts, np.array([number[lang] for lang, *_ in rows], int), languages, seed) if parts else None


def _logits(steps: np.ndarray, table: np.ndarray, u: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Output of one direction at every step. Gate columns of the weights come halved, for ``tanh`` as the sigmoid."""
    size = u.shape[0]
    h = np.zeros((steps.shape[1], size), np.float32)
    made = np.empty((*steps.shape, out.shape[1]), np.float32)
    a, b = np.empty((2, steps.shape[1], 3 * size), np.float32)
    gate = np.empty((steps.shape[1], 2 * size), np.float32)
    n = np.empty((steps.shape[1], size), np.float32)
    for t in range(len(steps)):
        np.take(table, steps[t], axis=0, out=a, mode="clip")
        np.matmul(h, u, out=b)
        np.add(a[:, : 2 * size], b[:, : 2 * size], out=gate)
        np.tanh(gate, out=gate)
        gate += 1.0
        gate *= 0.5
        np.multiply(gate[:, size:], b[:, 2 * size :], out=n)
        n += a[:, 2 * size :]
        np.tanh(n, out=n)
        h -= n
        h *= gate[:, :size]
        h += n
        np.matmul(h, out, out=made[t])
    return made


def _halved(weights: np.ndarray) -> np.ndarray:
    size = weights.shape[1] // 3
    return np.concatenate([weights[:, : 2 * size] * 0.5, weights[:, 2 * size :]], axis=1).astype(np.float32)


def position_sums(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its positions' distributions, and the number of positions."""
    tables, recurrent = [_halved(w) for w in network.tables], [_halved(w) for w in network.recurrent]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    spans = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), spans)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    low, high = nth * SPAN, np.minimum((nth + 1) * SPAN, sizes[owner])
    start, end = np.maximum(low - CONTEXT, 0), np.minimum(high + CONTEXT, sizes[owner])
    sums = np.zeros((len(texts), len(network.languages)))
    order = np.argsort(end - start, kind="stable")
    lanes = max(1, LANES * FULL_LANES // max(FULL_LANES, len(network.languages)))
    for at in range(0, len(order), lanes):
        lane = order[at : at + lanes]
        lengths = (end - start)[lane]
        time = np.arange(lengths.max())[:, None]
        where = np.minimum((begins[owner] + start)[lane] + np.minimum(time, lengths - 1), len(data) - 1)
        steps = data[where]
        both = [steps, _reversed(steps, lengths)]
        ahead, back = [_logits(s, tables[i], recurrent[i], network.out[i]) for i, s in enumerate(both)]
        p = ahead + _reversed(back, lengths) + network.bias
        np.exp(np.clip(p, -40, 40, out=p), out=p)
        p /= p.sum(axis=2, keepdims=True)
        p *= ((time >= (low - start)[lane]) & (time < (high - start)[lane]))[:, :, None]
        np.add.at(sums, owner[lane], p.sum(axis=0, dtype=np.float64))
    return sums, sizes


def predictor(spark, network: Network | None):
    """Batch function of ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(network)

    def predict(texts: list[str]) -> dict[str, list]:
        model = shared.value
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        read = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
        if read:
            sums, sizes = position_sums(model, [texts[i].encode("utf-8", "replace") for i in read])
            p = sums / sizes[:, None]
            for i, best, row in zip(read, p.argmax(axis=1), p):
                lang[i], score[i] = model.languages[best], min(1.0, round(float(row[best]), 6))
        return {"lang_pred": lang, "score": score}

    return predict


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    ``und`` with score 0 for null texts, texts without a letter, and where
    nothing was learned. Of languages with equal shares the first by name is
    taken. Equal texts have equal rows, repeated rows stay repeated, and an empty
    table stays empty; whole texts are read however long, and other columns
    are not.
    """
    return computed(docs, predictor(docs.sparkSession, network), {"lang_pred": "string", "score": "double"})
