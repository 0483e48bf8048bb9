"""Byte-pair encoding by merge rounds over many words at once, and decoding.

Texts are cut into words as the vocabulary file says: special tokens first, then
canonical composition, lower case and a pattern. The symbols of many distinct
words lie in one flat array. In a round every pair of neighbours is looked up by
binary search in the sorted keys of all merges, each word merges its pair of
lowest rank, and words without a pair left are done.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from itertools import groupby
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accountgraph.llm.common import with_output

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"
# Words that a worker remembers, and symbols that one array holds.
REMEMBERED = 400_000
LANE_SYMBOLS = 1_000_000
# The white space of the vocabulary's patterns (fixed values).
SPACES = "\t\n\v\f\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NONE = np.iinfo(np.int64).max


class Vocabulary(NamedTuple):
    """What a vocabulary file and its library say, as plain values."""

    tokens: list[str]
    merges: list[tuple[str, str]]
    suffix: str
    special: dict[str, int]
    letters: str
    numbers: str
    lower: dict[int, str]


def _ranges(members: Sequence[int]) -> str:
    """Body of a character class with these code points."""
    out = []
    for _, run in groupby(enumerate(members), lambda p: p[1] - p[0]):
        points = [p for _, p in run]
        out.append(f"{re.escape(chr(points[0]))}-{re.escape(chr(points[-1]))}")
    return "".join(out)


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary at ``path``, with the character classes and the lower case that the library uses.

    The library's Unicode tables may be older than Python's, so its classes
    are asked from it, once, over all characters.
    """
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    data = json.loads((Path(TOKENIZERS) / VOCABULARY if path is None else Path(path)).read_text(encoding="utf-8"))
    model = data["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("only plain byte-pair vocabularies with word ends are supported")
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    if any(t[flag] for t in data["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special tokens must match as they are")
    tokens = [""] * (max([*model["vocab"].values(), *special.values()]) + 1)
    for token, i in [*model["vocab"].items(), *special.items()]:
        tokens[i] = token
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    every = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    text = "".join(every)
    classes = [
        _ranges(sorted({ord(c) for part, _ in Split(Regex(rf"[{name}]+"), "removed", invert=True).pre_tokenize_str(text) for c in part}))
        for name in (r"\p{L}", r"\p{N}")
    ]
    # A space between the characters makes each stand alone.
    lowered = Lowercase().normalize_str("\n".join(c for c in every if c != "\n")).split("\n")
    lower = {ord(c): low for c, low in zip((c for c in every if c != "\n"), lowered, strict=True) if low != c.lower()}
    # Python's lower case of capital sigma depends on its place in a word.
    return Vocabulary(tokens, merges, model.get("end_of_word_suffix") or "", special, *classes, lower | {0x3A3: "\u03c3"})


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.normalizers import NFC

        v = self.vocabulary = vocabulary
        ids = {t: i for i, t in enumerate(v.tokens)}
        shown = byte_characters()
        self.inner = np.array([ids[c] for c in shown], np.int64)
        self.final = np.array([ids[c + v.suffix] for c in shown], np.int64)
        left = np.array([ids[a] for a, _ in v.merges], np.int64)
        right = np.array([ids[b] for _, b in v.merges], np.int64)
        made = np.array([ids[a + b] for a, b in v.merges], np.int64)
        rank = np.arange(len(made))
        # A repeated pair counts with its last rank, as in a table filled in order.
        keys = (left << 32) | right
        _, last = np.unique(keys[::-1], return_index=True)
        order = len(keys) - 1 - last
        self.keys, self.ranks, self.made = keys[order], rank[order], made[order]
        # Where the token that a merge makes takes part in an earlier merge, merging
        # one place can change what comes next: such merges go one place at a time.
        first_use = np.full(len(v.tokens), _NONE)
        np.minimum.at(first_use, left[order], self.ranks)
        np.minimum.at(first_use, right[order], self.ranks)
        self.at_once = first_use[self.made] > self.ranks
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        # The pattern of the vocabulary file with its classes spelled out, letters first (fixed pattern).
        self.pattern = re.compile(
            rf"[{v.letters}]+|[{v.numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACES}{v.letters}{v.numbers}]+"
        )
        # The same for ASCII texts.
        self.plain = re.compile(r"[a-zA-Z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t\n\v\f\r a-zA-Z0-9]+")
        self.odd_lower = re.compile(f"[{_ranges(sorted(v.lower))}]")
        self.compose = NFC().normalize_str
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Words of a piece of text without special tokens."""
        if text.isascii():
            return self.plain.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = self.compose(text)
        if self.odd_lower.search(text):
            text = text.translate(self.vocabulary.lower)
        return self.pattern.findall(text.lower())

    def parts(self, text: str) -> list[str]:
        """Words of a text and the special tokens in it, which no word equals."""
        if self.special is None or not self.special.search(text):
            return self.words(text)
        out: list[str] = []
        at = 0
        for found in self.special.finditer(text):
            out += self.words(text[at : found.start()])
            out.append(found[0])
            at = found.end()
        return out + self.words(text[at:])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, and its place among the sorted keys; no merge has the largest integer."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE) if len(self.keys) else np.full(len(keys), _NONE), at

    def merged(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of each word, none of them empty.

        Every round merges, in every word, the places of its lowest rank from
        left to right; places that overlap and merges that could be overtaken
        by what they make wait for the next round.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        # ``rank`` and ``at`` belong to the pair of a symbol and the next one; a word's last symbol has no pair.
        rank, at = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], at[:-1] = self.look_up(symbols[:-1], symbols[1:])
        rank[ends - 1] = _NONE
        out: list = [None] * len(words)
        active = np.arange(len(words))
        while len(active):
            starts = ends - sizes
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[active[i]] = symbols[starts[i] : ends[i]].copy()
                keep = np.repeat(~done, sizes)
                symbols, rank, at = symbols[keep], rank[keep], at[keep]
                active, sizes, least = active[~done], sizes[~done], least[~done]
                ends = np.cumsum(sizes)
                starts = ends - sizes
                if not len(active):
                    break
            places = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = np.searchsorted(ends, places, side="right")
            # In a run of overlapping places every second one merges.
            fresh = np.concatenate([[True], np.diff(places) > 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            chosen = (np.arange(len(places)) - run_start) % 2 == 0
            first = np.concatenate([[True], np.diff(owner) > 0])
            chosen &= self.at_once[at[places]] | first
            places, owner = places[chosen], owner[chosen]
            symbols[places] = self.made[at[places]]
            gone = np.zeros(len(symbols), bool)
            gone[places + 1] = True
            shift = np.cumsum(gone)
            symbols, rank, at = symbols[~gone], rank[~gone], at[~gone]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            ends = np.cumsum(sizes)
            places = places - shift[places]
            # Only pairs with a new symbol have a new rank.
            touched = np.zeros(len(symbols), bool)
            touched[places] = True
            touched[places[places > 0] - 1] = True
            changed = np.flatnonzero(touched)
            inside = np.ones(len(symbols), bool)
            inside[ends - 1] = False
            rank[changed[~inside[changed]]] = _NONE
            changed = changed[inside[changed]]
            rank[changed], at[changed] = self.look_up(symbols[changed], symbols[changed + 1])
        return out

    def learn(self, words: set[str]) -> None:
        """Make the packed ids of all ``words`` known."""
        if not self.known or len(self.known) > REMEMBERED:
            self.known = {t: int(i).to_bytes(4, "little") for t, i in self.vocabulary.special.items()}
        new = [w for w in words if w not in self.known]
        spelled = [w.encode("utf-8", "surrogatepass") for w in new]
        start = size = 0
        for i, word in enumerate([*spelled, None]):
            if word is None or (i > start and size + len(word) > LANE_SYMBOLS):
                if i > start:
                    found = self.merged(spelled[start:i])
                    self.known.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(new[start:i], found))
                start, size = i, 0
            size += len(word or b"")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, parts)) for parts in cut]

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by spaces, word ends and byte characters as they are: the file names no decoder."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``n_tokens``, ``ids``, ``packed`` and ``decoded``, and that column's name.

    ``packed`` holds the ids as little-endian unsigned 32-bit integers.
    Null and empty texts and texts of white space have no tokens; their decoded
    text is empty. Rows are encoded one by one, so equal texts have equal ids,
    repeated rows stay repeated and an empty table stays empty; whole texts are
    encoded however long they are, and extra columns of any name are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    state: dict[str, Codec] = {}

    def run(texts: list[str]) -> dict[str, Sequence]:
        if not state:
            state["codec"] = Codec(shared.value)
        codec = state["codec"]
        packed = codec.encode(texts)
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
        each = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
        return {
            "n_tokens": np.diff(ends),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            "packed": packed,
            "decoded": [codec.decode(e) for e in each],
        }

    return with_output(docs, run, {"n_tokens": "bigint", "ids": "array<int>", "packed": "binary", "decoded": "string"})
