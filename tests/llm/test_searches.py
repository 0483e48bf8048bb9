"""Hard negatives, merges and ranked search against SQL, a library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from conftest import SF_DIR

from accountgraph.llm import lexical, merges, negatives, queries


@pytest.fixture(scope="module")
def sql():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", ["op11_negatives", "op13_lexical"])
def test_queries_against_sql(spark, sql, name):
    found = oracle.spark_rows(queries.queries()[name](spark, SF_DIR))
    assert found[1] and found == oracle.sql_rows(sql, queries.oracle_sql()[name])


# ------------------------------------------------------------- hard negatives


def mined_by_hand(rows, every, positives, n):
    """Plain restatement; rows are (id, label, whole numbers), null ids last."""
    key = lambda r: (r[1] is None, r[1] or 0)
    out = []
    for a_id, a_label, a in {(r[0], r[1], tuple(r[2])) for r in rows if r[0] is not None and r[0] % every == 0}:
        scored = [(sum(x * y for x, y in zip(a, q)), i, label) for i, label, q in rows]
        best = sorted((r for r in scored if r[2] == a_label and r[1] != a_id), key=lambda r: (-r[0], *key(r)))[:positives]
        for p_score, p_id, _ in best:
            inside = [r for r in scored if r[2] != a_label and 30 * p_score <= 100 * r[0] <= 90 * p_score]
            for rank, (score, i, _) in enumerate(sorted(inside, key=lambda r: (-r[0], *key(r)))[:n], 1):
                out.append((a_id, p_id, rank, i, p_score, score))
    return Counter(out)


@pytest.mark.parametrize("block, anchors", [(65_536, 4_096), (7, 3)])
def test_mining_against_all_pairs(spark, block, anchors):
    rng = random.Random(block)
    rows = [(i, rng.randrange(3), [rng.randint(-4, 9) for _ in range(12)]) for i in range(120)]
    # Ties, repeated rows, shorter vectors, zeros and rows without an id.
    rows += rows[:8] + [(i + 200, label, q) for i, label, q in rows[:30]]
    rows += [(300, 1, [3, 1]), (310, 2, []), (320, 0, [0] * 12), (None, 1, [5] * 12), (None, 2, [2] * 12), (-10, 1, [1] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").repartition(3)
    found = negatives.mined(table, 10, 5, 4, block=block, most_anchors=anchors).collect()
    assert Counter(tuple(r) for r in found) == mined_by_hand(rows, 10, 5, 4)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 1.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    extra = table.selectExpr("*", "'mine' AS q", "1 AS score", "2 AS `a.b`", "3 AS slot")
    whole = negatives.whole_numbers(extra, extra["label"])
    assert [tuple(r) for r in whole.collect()] == [(0, 1, [128, -1])]
    assert negatives.mined(whole, 100).collect() == []
    assert negatives.mined(whole.where("false"), 100).collect() == []
    with pytest.raises(Exception, match="too large"):
        negatives.whole_numbers(table.selectExpr("vec_id", "array(1e300D) AS embedding", "1 AS label"), table["label"]).collect()


def test_scans_leave_rows_out():
    """Bounds never lose a row, and leave most of them out before the last dimension."""
    rng = np.random.default_rng(5)
    values = rng.integers(-20, 20, (64, 4000)).astype(float)
    columns = negatives.Columns(np.arange(4000), np.zeros(4000, bool), np.zeros(4000), values, values.min(axis=1), values.max(axis=1))
    query = np.round(rng.normal(0, 40, 64)) * np.linspace(0, 1, 64) ** 3 // 1
    sizes = []

    def keep(low, high):
        sizes.append(len(low))
        return high >= negatives.nth_largest(low, 5)

    rows, scores = negatives.scan(columns, query, np.arange(4000), keep)
    exact = query @ values
    order = np.lexsort((np.arange(4000), -exact))[:5]
    assert np.isin(order, rows).all() and (scores == exact[rows]).all()
    assert sizes[-1] < 400


# ---------------------------------------------------------------------- merges


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{merges.TOKENIZERS}/{merges.VOCABULARY}")


@pytest.fixture(scope="module")
def vocabulary():
    return merges.load()


def test_merges_query_against_the_library(spark, library, texts):
    found = {r.doc_id: r for r in queries.op12_merges(spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[doc].n_tokens == len(ids)
        assert found[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[doc].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_texts_against_the_library(library, vocabulary):
    rng = random.Random(12)
    alphabet = [c for c in map(chr, [*range(1, 0x530), *range(0x530, 0xD800, 7), *range(0xE000, 0x1FFFF, 61)])]
    odd = ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(1500)]
    odd += ["".join(rng.choices("abcdeth ingx'sS\n", k=rng.randrange(1, 300))) for _ in range(500)]
    odd += ["a" * n for n in range(1, 70)] + ["", " ", "x" * 50_000, "ΑΣ ΑΣΑ", "İI", "ȩ́", "<|endoftext|>it's<|startoftext|>"]
    odd += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8000))]
    codec = merges.Codec(vocabulary)
    for text, packed in zip(odd, codec.encode(odd)):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, ascii(text[:80])
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged_by_hand(word, merges_of):
    """One merge at a time: the lowest rank, the leftmost place."""
    symbols = list(word)
    while True:
        ranks = [(merges_of[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges_of]
        if not ranks:
            return symbols
        _, i = min(ranks)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_rounds_against_single_merges(vocabulary):
    """Merge tables in any order, also such where a made token is used by an earlier merge."""
    rng = random.Random(3)
    shown = merges.byte_characters()
    overtaken = 0
    for _ in range(40):
        made, pairs = set("abc"), []
        while len(pairs) < 14:
            pair = (rng.choice(sorted(made)), rng.choice(sorted(made)))
            if pair not in pairs and len("".join(pair)) < 7:
                pairs.append(pair)
                made.add("".join(pair))
        rng.shuffle(pairs)
        tokens = sorted({*shown, *made})
        codec = merges.Codec(vocabulary._replace(tokens=tokens, merges=pairs, suffix="", special={}))
        overtaken += int((~codec.at_once).sum())
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(30)]
        ranks = {p: i for i, p in enumerate(pairs)}
        for word, ids in zip(words, codec.merged([w.encode() for w in words])):
            assert [tokens[i] for i in ids] == merged_by_hand(word, ranks)
    assert overtaken > 40


def test_merges_of_odd_rows(odd, none, library, vocabulary):
    docs = odd.withColumnRenamed("mix", "a.b")
    out, name = merges.encoded(docs, vocabulary)
    assert out.columns == [*docs.columns, name] and name != "output"
    for r in out.select("text", name).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r[1].ids == ids and r[1].n_tokens == len(ids) and r[1].packed == np.array(ids, "<u4").tobytes()
    assert merges.encoded(none, vocabulary)[0].count() == 0


def test_memory_is_bounded(monkeypatch, vocabulary):
    monkeypatch.setattr(merges, "REMEMBERED", 10)
    monkeypatch.setattr(merges, "LANE_SYMBOLS", 20)
    codec, whole = merges.Codec(vocabulary), merges.Codec(vocabulary)
    for i in range(5):
        batch = [f"word{j} <|endoftext|> {'long' * j} number {i}" for j in range(9)]
        assert codec.encode(batch) == whole.encode(batch)
        assert len(codec.known) < 80


# --------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked_by_hand(docs, items, most=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_words = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            if c:
                norm = 25 + 75 * c.total() * n_docs // n_words
                asked = TERM.findall((text or "").translate(LOWER))
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * norm))
                    for t in asked
                )
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, s[3], -s[0]) for i, s in enumerate(sorted(s for s in scores if s[0] < 0)[:most], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, leaf, cells, items_each", [(16_384, 48, 8_000_000, 2_000), (40, 1, 8_000_000, 2), (25, 2, 30, 2_000)])
def test_ranks_against_all_documents(spark, monkeypatch, block, leaf, cells, items_each):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", items_each)
    grown = lexical.grown
    monkeypatch.setattr(lexical, "grown", lambda v, n: grown(v, n, leaf, cells))
    rng = random.Random(block)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(i, pick(rng.randrange(1, 60))) for i in range(150)]
    # Copies, repeated ids, null ids, empty texts, one long text, capitals beyond ASCII.
    docs += [(200 + i, docs[3][1]) for i in range(30)] + docs[:5] + [(None, docs[4][1]), (None, None), (7, ""), (8, " .,;")]
    docs += [(900, pick(20_000)), (901, "ÉTÉ Été W1-w2"), (902, "w1 w2 w1")]
    items = [(1, "w1 W2 w3 w1"), (2, "été ÉTÉ"), (3, None), (4, "..."), (5, pick(30)), (5, pick(3)), (None, "w39 w38"), (6, "unknown"), (7, "w0")]
    found = lexical.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS slot", "2 AS `n.x`").repartition(4),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS slot"),
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == ranked_by_hand(docs, items)


def test_ranks_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "the same text")], "item_id long, text string")
    assert lexical.ranked(none, items).count() == 0
    assert lexical.ranked(odd, items.where("false")).count() == 0
    assert lexical.ranked(odd.where("text IS NULL OR doc_id = 3"), items).count() == 0


def test_trees_leave_nodes_out(spark):
    """Searches visit few of the nodes, and every leaf's rows have their bounds."""
    rng = np.random.default_rng(2)
    picks = [np.flatnonzero(rng.random(60) < 1 / (1 + np.arange(60) / 4)) for _ in range(3000)]
    start = np.concatenate([[0], np.cumsum([len(p) for p in picks])])
    vectors = lexical.in_path_order(
        lexical.Vectors(np.arange(3000), rng.integers(25, 400, 3000), start, np.concatenate(picks), rng.integers(1, 9, start[-1]))
    )
    tree = lexical.grown(vectors, 60, leaf=8)
    for low, high, first, last, most, least in zip(*tree):
        part = slice(vectors.start[low], vectors.start[high])
        assert (vectors.tf[part] <= most[vectors.term[part]]).all() and least == vectors.norm[low:high].min()
        if last > first:
            assert tree.low[first] == low and tree.high[last - 1] == high and tree.high[first : last - 1] == tree.low[first + 1 : last]
    gains = lexical.gain(vectors.tf, np.repeat(vectors.norm, np.diff(vectors.start)))
    term, look_up = np.array([30, 45, 59]), np.zeros(60, np.int64)
    look_up[term] = weight = np.array([900, 2000, 4000])
    best = lexical.Best(10)
    visited = lexical.searched(tree, vectors, gains, term, weight, look_up, best)
    whole = np.add.reduceat(np.append(look_up[vectors.term] * gains, 0), vectors.start[:-1]) * (np.diff(vectors.start) > 0)
    order = np.lexsort((vectors.row, -whole))[:10]
    assert best.row.tolist() == vectors.row[order].tolist() and best.score.tolist() == whole[order].tolist()
    assert visited < len(tree.low) / 2
