"""Pieces, fertility and licences against brute force, the pipeline, and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from accountgraph.llm import fertility, licences, pieces, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def best_score(v, text):
    """Best sum over all segmentations of a text, character by character."""
    scores = {v.contents[i]: v.scores[i] for i in range(len(v.contents)) if v.contents[i] and i not in set(v.byte_ids.tolist())}
    least = v.scores.min() - pieces.UNCOVERED
    text = f" {text}"
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + least
        for start in range(max(0, end - 30), end):
            score = scores.get(text[start:end].encode())
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def score_of(v, ids):
    """Sum of the pieces' scores, a run of byte pieces as its characters."""
    is_byte = set(v.byte_ids.tolist())
    least, total, run = v.scores.min() - pieces.UNCOVERED, 0.0, b""
    for i in [*ids, None]:
        if i in is_byte:
            run += v.contents[i]
            continue
        total += least * len(run.decode())
        run = b""
        if i is not None:
            total += v.scores[i]
    return total


def test_segmentations_are_the_best(vocabulary, texts):
    codec = pieces.Codec(vocabulary)
    some = [t[:300] for t in list(texts.values())[:25]] + ["  a  b\n\nx\t\u0000é漢字🙂 ", "<s> <0x41>", "aaaa" * 30]
    for text, ids in zip(some, codec.encode(some)):
        assert score_of(vocabulary, ids.tolist()) == pytest.approx(best_score(vocabulary, text))


def test_round_trips(vocabulary, texts):
    codec = pieces.Codec(vocabulary)
    rng = random.Random(9)
    signs = " \n\t▁aé漢🙂\u0000<>0x41"
    some = [*texts.values(), *["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)], "y" * 3000]
    for text, ids in zip(some, codec.encode(some)):
        assert codec.decode(ids) == text
    assert codec.encode([""])[0].tolist() == []


def test_double_array():
    rng = random.Random(1)
    keys = list({bytes(rng.choice(b"abcd\xff\x00\x01") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    base, check, piece = pieces.double_array(keys)

    def find(key):
        state = 0
        for c in key:
            following = base[state] + c
            if following >= len(check) or check[following] != state:
                return -1
            state = following
        return piece[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.choice(b"abcd\xff\x00\x01") for _ in range(rng.randint(1, 7))) for _ in range(400)} - set(keys)
    assert {find(k) for k in others} == {-1}


def test_pieces_query(spark, texts):
    found = queries.op7_pieces(spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == set(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_tokenized_odd_rows(odd, none, vocabulary):
    out = pieces.tokenized(odd, vocabulary)
    assert out.columns == [*odd.columns, "_ids", "_n_tokens"]
    assert Counter((r.doc_id, r.text, r.ids) for r in out.collect()) == Counter((r.doc_id, r.text, r.ids) for r in odd.collect())
    assert pieces.tokenized(none, vocabulary).count() == 0


# -------------------------------------------------------------------- fertility


def repeated(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_fertility_query(spark, texts):
    for r in queries.op8_fertility(spark, SF_DIR).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(words)
        assert r.base_failed == (len(words) < 50 or 100 * repeated(words) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(500):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        assert fertility.repeated_words(words) == repeated(words)


def test_measures_against_whole_encodings():
    meter = fertility.Meter(fertility.load())
    words = "The quick brown fox jumps over the lazy dog 漢字 \u0007 the".split(" ")
    meter.learn(set(words))
    chars, share, entropy = meter.measure(words)
    tokens = [t for w in words for t in meter.bytes.encode_ordinary(f" {w}")]
    parts = [p for w in words for p in meter.pieces.encode(w)]
    assert chars == pytest.approx(2 * (sum(map(len, words)) + len(words)) / (len(tokens) + len(parts)))
    assert share == pytest.approx(sum(meter.pieces.is_byte(p) for p in parts) / len(parts))
    p = np.array(list(Counter(tokens).values())) / len(tokens)
    assert entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_scripts_and_bands(spark):
    assert fertility.script_of("Grüße aus Köln") == "latin"
    assert fertility.script_of("Привет, мир") == "cyrillic"
    assert fertility.script_of("漢字かな") == "cjk"
    assert fertility.script_of("12 34") == fertility.script_of("") == "other"
    rng = random.Random(1)
    syllables = "an er in on th re st al en de".split()
    good = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(200))
    noise = " ".join("".join(chr(rng.randint(0x1F600, 0x1F640)) + "a" for _ in range(3)) for _ in range(200))
    docs = spark.createDataFrame([(1, good), (2, noise), (3, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in fertility.judged(docs, fertility.load()).collect()} == {1: True, 2: False, 3: False}


def bands_by_hand(rows, reach):
    """Bands of (group, length) and (group, None) from (group, length, measures) of rows."""
    each = set(rows)
    groups = defaultdict(list)
    for group, length, measures in each:
        groups[group, length].append(measures)
        groups[group, None].append(measures)
    out = {}
    for key, members in groups.items():
        if len(members) >= fertility.LEAST_GROUP and len(members) * fertility.MOST_GROUPS >= len(each):
            edges = []
            for values in zip(*members):
                low, middle, high = (sorted(values)[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.5, 0.75))
                spread = max((high - low) / 1.349, middle * fertility.LEAST_SPREAD)
                edges.append((middle - reach * spread, middle + reach * spread))
            out[key] = edges
    return out


def test_verdicts_against_quantiles(spark, monkeypatch):
    monkeypatch.setattr(fertility, "LEAST_GROUP", 8)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("lang", F.expr("IF(doc_id % 9 = 0, NULL, lang)"))
    langs = {r.doc_id: r.lang for r in docs.collect()}
    for reach in (4.0, 1.0):
        found = fertility.judged(docs, fertility.load(), reach=reach).collect()
        key = {r.doc_id: (langs[r.doc_id] or r.script, min(r.n_words.bit_length() - 1, fertility.LONGEST)) for r in found}
        rows = {r.doc_id: (r.chars_per_token, r.byte_share, r.token_entropy) for r in found}
        bands = bands_by_hand([(*key[i], rows[i]) for i in rows if not next(r for r in found if r.doc_id == i).base_failed], reach)
        for r in found:
            band = bands.get(key[r.doc_id], bands.get((key[r.doc_id][0], None)))
            own = fertility.BANDS[r.script]
            chars, share, entropy = band or [(own.least_chars, own.most_chars), (0, own.most_bytes), (own.least_entropy, 0)]
            inside = chars[0] <= r.chars_per_token <= chars[1] and r.byte_share <= max(share[1], own.most_bytes) and r.token_entropy >= entropy[0]
            assert r.kept == (not r.base_failed and inside)
        assert bands and sum(not r.kept and not r.base_failed for r in found) > (0 if reach > 1 else 10)


def test_junk_goes_and_clean_short_texts_stay(spark):
    """Marks stuck to words are rejected; of clean texts of any length hardly one is."""
    rng = random.Random(4)
    syllables = "an er in on th re st al en de ou ti es or".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    clean = [(i, " ".join(word() for _ in range(rng.choice([55, 60, 90, 300])))) for i in range(1200)]
    junk = [(5000 + i, " ".join(word() + rng.choice(["%%%", "***", "&&&", "$$$", ""]) for _ in range(rng.choice([60, 300])))) for i in range(40)]
    # A third of all rows are copies of one odd text, which must not set the band.
    copies = [(9000 + i, " ".join(["the"] * 30 + [f"ab{j}" for j in range(40)])) for i in range(600)]
    docs = spark.createDataFrame(clean + junk + copies, "doc_id long, text string").repartition(4)
    kept = {r.doc_id: r.kept for r in fertility.judged(docs, fertility.load()).collect()}
    assert sum(kept[i] for i, _ in clean) >= 0.995 * len(clean)
    assert sum(kept[i] for i, _ in junk) <= 2


def test_fertility_odd_rows(odd, none):
    found = fertility.judged(odd, fertility.load()).collect()
    assert len(found) == odd.count()
    assert {r.kept for r in found if r.n_words == 0} == {False}
    assert fertility.judged(none, fertility.load()).count() == 0


# -------------------------------------------------------------------- licences


def test_matching_statistics_against_all_runs():
    automaton = licences.build()
    numbers = [[automaton.numbers[w] for w in licences.words_of(t)] for _, t in licences.TEMPLATES]
    ends = defaultdict(set)
    for k, line in enumerate(numbers):
        for i in range(len(line)):
            for j in range(i + 1, min(len(line), i + 12) + 1):
                ends[tuple(line[i:j])].add((k, j))
    rng = random.Random(1)
    for _ in range(100):
        text = []
        while len(text) < 30:
            line = rng.choice(numbers)
            at = rng.randrange(len(line))
            text += line[at : at + rng.randint(1, 6)]
        for end, (n, state) in enumerate(licences.matching_statistics(automaton, text)):
            longest = next(k for k in range(12, -1, -1) if k <= end + 1 and (k == 0 or tuple(text[end + 1 - k : end + 1]) in ends))
            assert n == longest or (n > 12 and longest == 12)
            if 0 < n <= 12:
                assert set(automaton.ends[state]) == ends[tuple(text[end + 1 - n : end + 1])]


def longest_common_runs(template, text):
    """All runs of a template in a text that neither side continues, by comparing every pair of words."""
    out = []
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and (i == 0 or j == 0 or text[i - 1] != template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= licences.LEAST_RUN:
                    out.append(licences.Run(i, i + n, j))
    return sorted(out)


def test_runs_and_chains_against_all_chains():
    rng = random.Random(8)
    chained = 0
    for _ in range(150):
        templates = [(f"t{k}", " ".join(rng.choices("abcde", k=rng.randint(8, 16)))) for k in range(3)]
        automaton = licences.build(templates)
        text = []
        while len(text) < 26:
            line = rng.choice(templates)[1].split()
            at = rng.randrange(len(line))
            text += line[at : at + rng.randint(2, 8)] + rng.choices(["z", "a"], k=rng.choice([0, 0, 1, 4, 12]))
        found = licences.runs(automaton, text)
        for k, (_, template) in enumerate(templates):
            own = found.get(k, [])
            assert own == longest_common_runs(template.split(), text)
            if not own or len(own) > 9:
                continue
            best = 0
            for size in range(1, len(own) + 1):
                for chosen in combinations(own, size):
                    cut, total = None, 0
                    for run in chosen:
                        shared = 0 if cut is None else max(0, cut.end - run.start, cut.at + cut.end - cut.start - run.at)
                        if shared >= run.end - run.start or (cut is not None and run.start + shared - cut.end > licences.GAP):
                            break
                        cut = licences.Run(run.start + shared, run.end, run.at + shared)
                        total += cut.end - cut.start
                    else:
                        best = max(best, total)
            parts = [c for cluster in licences.clusters(own) for c in licences.chains(cluster)]
            assert max(covered for covered, _ in parts) == best
            for covered, chain in parts:
                places = [r.at + k for r in chain for k in range(r.end - r.start)]
                assert len(set(places)) == len(places) == covered and places == sorted(places)
                chained += len(chain) > 1
    assert chained > 30


def labels(text):
    return [s.label for s in licences.spans(licences.build(), licences.words_of(text))]


def notice(label):
    return max((t for name, t in licences.TEMPLATES if name == label), key=len)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["cc-by-nc-sa"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["cc-by-nd"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["cc-by"]),
        ("Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License", ["cc-by-nc-nd"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa"]),
        ("It is licensed under the GNU General Public License, version 2.", ["gpl-2"]),
        ("It is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("It is licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl-2.1"]),
        ("This work is licensed under a Creative " * 5, []),
        ("This work is licensed under a Creative Commons Attribution", []),
        ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", []),
        ("licensed under the terms and conditions of the sale to any person", []),
        ("Released under the BSD License.", []),
    ],
)
def test_kin_licences_stay_apart(text, expected):
    assert labels(text) == expected
    assert labels(f"Some words before. {text} And some words after, version 7 of them.") == expected


@pytest.mark.parametrize("label", sorted({label for label, _ in licences.TEMPLATES}))
def test_every_notice_has_its_own_label_only(label):
    assert set(labels(notice(label))) == {label}
    words = notice(label).split()
    keep = {w for w in words for t in licences.words_of(w) if t in licences.KIN | licences.NAMES or t.isdigit()}
    edited = [w if w in keep or i % 15 != 7 else "changed" for i, w in enumerate(words)]
    assert set(labels(" ".join(["intro"] * 5 + edited + ["end"]))) == {label}
    # Two licences one after the other both count, and a notice in two pieces is found again.
    assert set(labels(notice(label) + " something else entirely " + notice("isc"))) == {label, "isc"}


def test_spans_of_edited_licences():
    automaton = licences.build()
    words = licences.words_of(notice("mit"))
    edited = ["intro"] * 5 + words[:40] + ["changed", "here"] + words[42:] + ["end"]
    (span,) = licences.spans(automaton, edited)
    assert span.label == "mit" and (span.start, span.end) == (5, 5 + len(words)) and span.share > 0.9


def test_licence_query(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.op10_licences(spark, SF_DIR).collect():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        words = word.findall(lower)
        places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licences_of_odd_rows(odd, none):
    found = licences.scanned(odd).collect()
    assert len(found) == odd.count() and {r.labels for r in found} == {""}
    assert licences.scanned(none).count() == 0


# -------------------------------------------------------------------- pipeline


def test_pipeline(spark, texts):
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert out and {r.doc_id for r in out} <= set(texts)
    codec = pieces.Codec(pieces.load())
    for r in out[:50]:
        assert codec.decode(r.ids) == r.text and r.n_tokens == len(r.ids)
    assert not any(re.search(r"@mail\d\.example\.com", r.text) for r in out)


def test_stages_keep_columns(spark, odd):
    few = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, few, SF_DIR).columns == few.columns, name
        assert stage(spark, few.where("false"), SF_DIR).count() == 0, name
