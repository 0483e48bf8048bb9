"""Text quality rules on how public vocabularies cut a text into tokens.

Every word is encoded, with the space before it, by a byte-level BPE vocabulary
and by one of pieces with byte fallback. A text is rejected when its characters
per token, its share of byte pieces or the entropy of its tokens leaves the band
of its language or script. The bands are robust quantiles over all texts of about
its length that pass the plain rules on word count and repetition.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountgraph.llm.common import WORD, with_output
from accountgraph.storage import stored

TOKENIZERS = "/opt/tokenizers"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
# How the byte-level vocabulary cuts text before merging (fixed pattern).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000

# Base rules: fewest words, largest percentage of words in repeated windows of
# so many words; and the marks that count as symbols (fixed values).
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"


class Band(NamedTuple):
    """What a text of a script may have: characters per token, share of byte pieces, bits of token entropy."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


# Measures that have a band. A fitted band reaches so many robust deviations, each at
# least so much of the median; a group of texts has so many rows at least, and one
# of so many parts of all rows. All texts of two to the power of LONGEST words and more are of one length.
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
REACH = 4.0
LEAST_SPREAD = 0.015
LEAST_GROUP = 100
MOST_GROUPS = 10_000
LONGEST = 16

# Where too few texts are alike: by the script of most letters; "other" holds for all scripts not named and for texts without letters.
BANDS = {
    "latin": Band(2.0, 8.0, 0.10, 5.0),
    "cyrillic": Band(0.8, 6.0, 0.10, 4.0),
    "greek": Band(0.5, 4.0, 0.30, 4.0),
    "cjk": Band(0.3, 2.5, 0.60, 4.0),
    "other": Band(0.2, 8.0, 0.90, 3.0),
}
_SCRIPTS = [
    ("latin", re.compile(r"[A-Za-zª-ɏḀ-ỿ]+")),
    ("cyrillic", re.compile(r"[Ѐ-ԯ]+")),
    ("greek", re.compile(r"[Ͱ-Ͽἀ-῿]+")),
    ("cjk", re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]+")),
]


def script_of(text: str) -> str:
    """Script with the most letters; ``other`` without any of the known ones."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    counts = [(sum(map(len, pattern.findall(text))), name) for name, pattern in _SCRIPTS]
    most = max(n for n, _ in counts)
    return next(name for n, name in counts if n == most) if most else "other"


class Files(NamedTuple):
    """Contents of the two vocabulary files."""

    byte_ranks: bytes
    piece_model: bytes


def load(folder: str = TOKENIZERS) -> Files:
    return Files((Path(folder) / BYTE_VOCABULARY).read_bytes(), (Path(folder) / PIECE_VOCABULARY).read_bytes())


class Meter:
    """Encodes words and remembers what it found."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, files.byte_ranks.splitlines())}
        self.bytes = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.piece_model)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[str, tuple[int, int, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        """Measures of words: pieces, byte pieces among them, and tokens of the byte-level vocabulary as 32-bit integers."""
        new = list(words.difference(self.known))
        if not new:
            return
        pieces = self.pieces.encode(new, num_threads=1)
        flat = np.fromiter((i for p in pieces for i in p), np.int64, sum(map(len, pieces)))
        ends = np.cumsum([len(p) for p in pieces])
        total = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        in_bytes = np.diff(total[np.concatenate([[0], ends])])
        tokens = [array("i", self.bytes.encode_ordinary(f" {w}")).tobytes() for w in new]
        self.known.update(zip(new, zip([len(p) for p in pieces], in_bytes.tolist(), tokens)))

    def measure(self, words: list[str]) -> tuple[float, float, float]:
        """Characters per token over both vocabularies, share of byte pieces, bits of entropy of the tokens."""
        counts = Counter(words)
        n_pieces, n_bytes, parts = zip(*map(self.known.__getitem__, counts))
        times = np.array(list(counts.values()))
        n_pieces, n_bytes = int(np.dot(n_pieces, times)), int(np.dot(n_bytes, times))
        sizes = np.array(list(map(len, parts))) // 4
        tokens = np.frombuffer(b"".join(parts), np.int32)
        _, which = np.unique(tokens, return_inverse=True)
        each = np.bincount(which, np.repeat(times, sizes))
        n_tokens = each.sum()
        share = each / n_tokens
        chars = sum(map(len, words)) + len(words)
        return 2 * chars / (n_tokens + n_pieces), n_bytes / n_pieces, float(-(share * np.log2(share)).sum())


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[:n].copy()
    for i in range(1, window):
        # Renumbered after each word, the products stay below the square of the text's length.
        key = np.unique(key * len(number) + ids[i : i + n], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= again
    return int(covered.sum())


FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "script": "string",
}


def measured(texts: list[str], meter: Meter) -> dict[str, list]:
    """``FIELDS`` of each text; the token measures are null without words."""
    if len(meter.known) > REMEMBERED:
        meter.known.clear()
    rows = []
    found = [WORD.findall(text) for text in texts]
    meter.learn(set().union(*found))
    for text, words in zip(texts, found):
        lines = [line for line in text.split("\n") if WORD.search(line)]
        facts = meter.measure(words) if words else (None, None, None)
        counts = (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))
        rows.append((*counts, *[None if f is None else round(f, 6) for f in facts], script_of(text)))
    return dict(zip(FIELDS, map(list, zip(*rows))))


def fitted(measures: DataFrame, reach: float = REACH) -> DataFrame:
    """``group, length, bands``: bands by group and power of two of the words, and by group alone (``length`` null).

    A band reaches ``reach`` robust deviations (the middle half's width over
    1.349) from the median. Rows of equal measures count once, so copies of one
    text set no band, and a deviation is no less than ``LEAST_SPREAD`` of the
    median. Groups need ``LEAST_GROUP`` rows and 1 / ``MOST_GROUPS`` of all, so
    few enough exist to be broadcast.
    """
    each = measures.select("group", "length", *MEASURES).distinct()
    total = each.agg(F.count(F.lit(1))).scalar()
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1_000).alias(m) for m in MEASURES]
    grouped = each.rollup("group", "length").agg(F.count(F.lit(1)).alias("n"), *quartiles).where("group IS NOT NULL")
    enough = grouped.where((F.col("n") >= LEAST_GROUP) & (F.col("n") * MOST_GROUPS >= total))

    def reached(m: str, sign: int) -> Column:
        spread = F.greatest((F.col(m)[2] - F.col(m)[0]) / 1.349, F.col(m)[1] * LEAST_SPREAD)
        return F.col(m)[1] + F.lit(sign * reach) * spread

    edges = {
        "least_chars": reached("chars_per_token", -1),
        "most_chars": reached("chars_per_token", 1),
        "most_bytes": reached("byte_share", 1),
        "least_entropy": reached("token_entropy", -1),
    }
    return enough.select("group", "length", F.struct(*[edges[f].alias(f) for f in Band._fields]).alias("band"))


def judged(docs: DataFrame, files: Files, bands: dict[str, Band] = BANDS, reach: float = REACH) -> DataFrame:
    """``doc_id``, ``FIELDS``, ``base_failed`` and ``kept`` of every row.

    ``kept`` tells that the base rules hold and that characters per token and
    token entropy lie within the band of the text's language (``lang``, where
    there is such a column and it is not null) or script, at its length; and
    that the share of byte pieces does not exceed both that band's and the
    script's. The bands come from all rows that pass the base rules; where too few
    texts are alike, ``bands`` of the script hold instead.

    Null, empty and blank texts have no words and fail the base rules. Equal
    texts of one language are judged alike, repeated rows stay repeated, and
    an empty table stays empty. Whole texts are measured however long they are;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    state: dict[str, Meter] = {}

    def run(texts: list[str]) -> dict[str, list]:
        if not state:
            state["meter"] = Meter(shared.value)
        return measured(texts, state["meter"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out, name = with_output(docs.select("doc_id", "text", lang.alias("lang")), run, FIELDS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    length = F.least(F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))), F.lit(LONGEST)).cast("int")
    flat = out.select("doc_id", "lang", f"{name}.*").withColumn("base_failed", failed)
    found = stored(flat.select("*", F.coalesce("lang", "script").alias("group"), length.alias("length")), "fertility").df

    fits = fitted(found.where(~F.col("base_failed")), reach)
    exact = fits.where(F.col("length").isNotNull()).select("group", "length", F.col("band").alias("exact"))
    of_group = fits.where(F.col("length").isNull()).select("group", F.col("band").alias("of_group"))
    judging = found.join(F.broadcast(exact), ["group", "length"], "left").join(F.broadcast(of_group), "group", "left")
    of_script = {f: F.lit(bands["other"][i]) for i, f in enumerate(Band._fields)}
    for script, band in bands.items():
        for i, f in enumerate(Band._fields):
            of_script[f] = F.when(F.col("script") == script, F.lit(band[i])).otherwise(of_script[f])
    edge = {f: F.coalesce(F.col("exact")[f], F.col("of_group")[f], of_script[f]) for f in Band._fields}
    inside = (
        F.col("chars_per_token").between(edge["least_chars"], edge["most_chars"])
        & (F.col("byte_share") <= F.greatest(edge["most_bytes"], of_script["most_bytes"]))
        & (F.col("token_entropy") >= edge["least_entropy"])
    )
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return judging.select("doc_id", *FIELDS, "base_failed", kept.alias("kept"))
