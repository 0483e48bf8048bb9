"""Encoding and decoding with a SentencePiece vocabulary by unigram Viterbi.

Pieces with log scores sit in a double-array trie. The best segmentation of a
text is the one with the highest sum of scores. Characters that no piece covers
fall back to the pieces of their UTF-8 bytes. A space becomes the white-space
marker, one marker goes in front of the text, and decoding takes both back, so
every text survives the round trip.

No piece continues across the start of a run of markers, so the best
segmentation of a text is that of its units (a run of spaces with the word after
it) one after another. Distinct units are segmented side by side in numpy.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import fresh, with_output

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARKER = "▁"
# The marker as one byte that UTF-8 never uses.
_MARK = b"\xff"
# How much less than the least piece an uncovered character scores.
UNCOVERED = 10.0
REMEMBERED = 200_000
# Units segmented side by side, and the bytes of the longest times their number.
LANES = 20_000
CELLS = 4_000_000
# Bytes from which on a unit is segmented alone, with the scores of the last few positions only.
LONG = 1_024


class Vocabulary(NamedTuple):
    """Trie arrays, by piece the log score, and by id the bytes a piece stands for."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    contents: list[bytes]
    byte_ids: np.ndarray
    longest: int
    newline_alone: bool


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie of ``keys``: a child of state ``s`` by byte ``c`` is ``base[s] + c`` where ``check`` of that is ``s``.

    ``piece`` has the number of the key that ends in a state, or -1. State 0 is
    the root.
    """
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for number, key in enumerate(keys):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = number
    size = 16 * len(children) + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    # No base is negative. Lone children fill the holes from below; families are put near the top, where room is found soon.
    state, queue, free, top = {0: 0}, [0], 256, 256
    for node in queue:
        if node in ends:
            piece[state[node]] = ends[node]
        below = sorted(children[node])
        if not below:
            continue
        while used[free]:
            free += 1
        first = below[0]
        at = free if len(below) == 1 else max(free, top - 32)
        while used[at] or any(used[at - first + c] for c in below):
            at += 1
        base[state[node]] = at - first
        for c in below:
            child = children[node][c]
            state[child] = at - first + c
            used[state[child]] = 1
            top = max(top, state[child])
            check[state[child]] = state[node]
            queue.append(child)
    return base[: top + 1], check[: top + 1], piece[: top + 1]


def log_scores(scores: Sequence[float]) -> np.ndarray:
    """Scores of a unigram model as they are; whole numbers are merge ranks and become the log of Zipf's law over them."""
    scores = np.asarray(scores, float)
    if len(scores) and (scores == np.round(scores)).all():
        _, rank = np.unique(-scores, return_inverse=True)
        harmonic = (1.0 / np.arange(1, rank.max() + 2)).sum()
        return -np.log(1.0 + rank) - np.log(harmonic)
    return scores


def load(path: str = f"{TOKENIZERS}/{MODEL}") -> Vocabulary:
    """Vocabulary of a SentencePiece model file with byte pieces, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    ids = range(model.get_piece_size())
    byte_ids = np.full(256, -1, np.int32)
    contents = [b""] * len(ids)
    plain, raw = [], []
    for i in ids:
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            contents[i] = bytes([int(text[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append(i)
            raw.append(model.get_score(i))
            contents[i] = text.encode().replace(MARKER.encode(), b" ")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    names = [model.id_to_piece(i) for i in plain]
    if any(MARKER in name.lstrip(MARKER) for name in names):
        raise ValueError("a piece has a marker after other characters")
    keys = [name.encode().replace(MARKER.encode(), _MARK) for name in names]
    base, check, number = double_array(keys)
    piece = np.where(number >= 0, np.array(plain, np.int32)[number], -1).astype(np.int32)
    scores = np.zeros(len(ids))
    scores[plain] = log_scores(raw)
    return Vocabulary(base, check, piece, scores, contents, byte_ids, max(map(len, keys)), not any("\n" in n for n in names))


def segment(vocabulary: Vocabulary, units: list[bytes]) -> list[bytes]:
    """Ids of the best segmentation of each unit, as the bytes of 32-bit integers.

    Of segmentations with equal scores, the one with the longer last piece wins,
    at every position.
    """
    out: list[bytes] = [b""] * len(units)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    some = []
    while order and len(units[order[-1]]) >= LONG:
        some.append(order.pop())
    if some:
        for i, ids in zip(some, _segment_alone(vocabulary, [units[i] for i in some])):
            out[i] = ids
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < LANES and (end - at + 1) * len(units[order[end]]) <= CELLS:
            end += 1
        lane = order[at:end]
        for i, ids in zip(lane, _segment_lanes(vocabulary, [units[i] for i in lane])):
            out[i] = ids
        at = end
    return out


def _segment_alone(v: Vocabulary, units: list[bytes]) -> Iterator[bytes]:
    """The same as ``_segment_lanes``, one unit at a time, in four bytes for each byte of the unit."""
    base, check, piece, scores = v.base.tolist(), v.check.tolist(), v.piece.tolist(), v.scores.tolist()
    least, limit, longest = float(v.scores.min() - UNCOVERED), len(check), v.longest
    ring, never = max(longest, 4) + 1, float("-inf")
    for data in units:
        size = len(data)
        best = [never] * ring
        best[0] = 0.0
        # The id of the last piece up to each position, or how many bytes an uncovered character has, negated.
        used = array("i", bytes(4 * (size + 1)))
        for start in range(size):
            so_far = best[start % ring]
            if so_far == never:
                continue
            best[start % ring] = never
            lead = data[start]
            alone = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF8 else 1
            end = min(start + alone, size)
            if so_far + least > best[end % ring]:
                best[end % ring], used[end] = so_far + least, start - end
            state = 0
            for end in range(start + 1, min(size, start + longest) + 1):
                following = base[state] + data[end - 1]
                if following >= limit or following == 0 or check[following] != state:
                    break
                state = following
                if piece[state] >= 0 and so_far + scores[piece[state]] > best[end % ring]:
                    best[end % ring], used[end] = so_far + scores[piece[state]], piece[state]
        ids, end = array("i"), size
        while end:
            last = used[end]
            if last >= 0:
                ids.append(last)
                end -= len(v.contents[last])
            else:
                ids.extend(v.byte_ids[list(data[end + last : end][::-1])].tolist())
                end += last
        ids.reverse()
        yield np.array(ids, "<i4").tobytes()


def _segment_lanes(v: Vocabulary, units: list[bytes]) -> list[bytes]:
    lengths = np.array([len(u) for u in units])
    width, n = int(lengths.max()), len(units)
    data = np.zeros((width + 5, n), np.uint8)
    filled = np.frombuffer(b"".join(units), np.uint8)
    data[np.concatenate([np.arange(k) for k in lengths]), np.repeat(np.arange(n), lengths)] = filled
    least = v.scores.min() - UNCOVERED
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0.0
    came = np.zeros((width + 1, n), np.int32)
    used = np.full((width + 1, n), -1, np.int32)
    lead = data[:width]
    span = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 1))))
    limit = len(v.check)

    def offer(start: int, end: np.ndarray, lanes: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score > best[end, lanes]
        end, lanes = end[better], lanes[better]
        best[end, lanes], came[end, lanes], used[end, lanes] = score[better], start, ids[better]

    for start in range(width):
        lanes = np.flatnonzero((lengths > start) & (best[start] > -np.inf))
        if not len(lanes):
            continue
        so_far = best[start, lanes]
        alone = start + span[start, lanes]
        offer(start, np.minimum(alone, lengths[lanes]), lanes, so_far + least, np.full(len(lanes), -1, np.int32))
        state = np.zeros(len(lanes), np.int32)
        for end in range(start + 1, min(width, start + v.longest) + 1):
            following = v.base[state] + data[end - 1, lanes]
            following = np.where(following < limit, following, 0)
            alive = (v.check[following] == state) & (lengths[lanes] >= end) & (following > 0)
            lanes, state, so_far = lanes[alive], following[alive], so_far[alive]
            if not len(lanes):
                break
            ids = v.piece[state]
            there = ids >= 0
            if there.any():
                offer(start, np.full(there.sum(), end), lanes[there], so_far[there] + v.scores[ids[there]], ids[there])

    # Walk all lanes back at once; bytes of uncovered characters stand for themselves.
    at = lengths.copy()
    lanes = np.flatnonzero(at > 0)
    found_lane, found_at, found_id = [], [], []
    while len(lanes):
        end = at[lanes]
        start, ids = came[end, lanes], used[end, lanes]
        plain = ids >= 0
        found_lane.append(lanes[plain]), found_at.append(start[plain]), found_id.append(ids[plain])
        for back in range(1, 5):
            some = ~plain & (end - start >= back)
            where = end[some] - back
            found_lane.append(lanes[some]), found_at.append(where), found_id.append(v.byte_ids[data[where, lanes[some]]])
        at[lanes] = start
        lanes = lanes[start > 0]
    lane, place, ids = map(np.concatenate, (found_lane, found_at, found_id)) if found_lane else (np.zeros(0, int),) * 3
    sort = np.lexsort((place, lane))
    flat = ids[sort].astype("<i4").tobytes()
    ends = 4 * np.cumsum(np.bincount(lane, minlength=n))
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encodes and decodes texts, remembering the ids of units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.unit = re.compile(r"\n| +[^ \n]*|[^ \n]+" if vocabulary.newline_alone else r" +[^ ]*|[^ ]+")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; none for the empty text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        units = [self.unit.findall(f" {t}") if t else [] for t in texts]
        new = list({u for some in units for u in some}.difference(self.known))
        self.known.update(zip(new, segment(self.vocabulary, [u.encode().replace(b" ", _MARK) for u in new])))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, some)), "<i4") for some in units]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids, without the marker put in front; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.vocabulary.contents.__getitem__, np.asarray(ids).tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, str]:
    """``docs`` with a struct column, and its name: ``n_tokens``, ``n_bytes`` of them byte pieces, ``ids``, ``decoded``.

    Null and empty texts have no ids and decode to the empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    state: dict[str, Codec] = {}

    def encode(texts: list[str]) -> dict[str, Sequence]:
        if not state:
            state["codec"] = Codec(shared.value)
        codec = state["codec"]
        ids = codec.encode(texts)
        is_byte = np.zeros(len(codec.vocabulary.contents), bool)
        is_byte[codec.vocabulary.byte_ids] = True
        sizes = np.array([len(i) for i in ids], np.int32)
        flat = np.concatenate(ids).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return {
            "n_tokens": sizes,
            "n_bytes": [int(is_byte[i].sum()) for i in ids],
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            "decoded": [codec.decode(i) for i in ids],
        }

    return with_output(docs, encode, {"n_tokens": "int", "n_bytes": "int", "ids": "array<int>", "decoded": "string"})


def tokenized(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``, and as ``text`` what the ids decode to; a null text stays null.

    The two new columns get a leading underscore where ``docs`` has such names.
    """
    out, name = encoded(docs, vocabulary)
    text = F.when(F.col("text").isNotNull(), F.col(f"{name}.decoded")).alias("text")
    kept = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    new = [F.col(f"{name}.{c}").alias(fresh(docs.columns, c)) for c in ("ids", "n_tokens")]
    return out.select(*kept, *new)
