"""Learned operators: held-out accuracy on planted cases, gradients, and odd rows."""

import math
import random

import numpy as np
import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from accountgraph.llm import common, language, personal, quality, queries, toxicity

NEUTRAL = [f"{a}{v}{b}" for a in "kl mn pr st br dr gl".split() for v in "aeiouy" for b in ("ano", "eri", "ulo", "ita", "osa", "emu", "ilo", "ura")]


def prose(rng, n, extra=()):
    words = [rng.choice(NEUTRAL) for _ in range(n)]
    for word in extra:
        words.insert(rng.randrange(len(words)), word)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(2)
    out = []
    for i in range(900):
        toxic = i % 6 == 0
        out.append((i, prose(rng, 60, [rng.choice(["vilewort", "grobian", "vileworten"]) for _ in range(2)] if toxic else ()), int(toxic)))
    return spark.createDataFrame(out, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark, insults, none):
    learned = F.col("doc_id") % 5 != 0
    model = toxicity.train_from_labels(insults.where(learned), insults.where(learned).select("doc_id", "toxic"))
    found = toxicity.scored(insults.where(~learned), model).join(insults, "doc_id").collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in found]
    assert len(right) == 180 and sum(right) >= 175, sum(right)
    kept = toxicity.clean(insults, model)
    assert kept.columns == insults.columns
    assert kept.where("toxic = 0").count() >= 745 and kept.where("toxic = 1").count() <= 5


def test_toxicity_of_odd_rows(spark, odd, none, insults):
    model = toxicity.train_from_labels(insults, insults.select("doc_id", "toxic"))
    found = rows(toxicity.scored(odd, model).select("score"))
    assert len(found) == odd.count() and all(0 <= s <= 1 for (s,) in found)
    assert toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.scored(none, model).count() == 0
    nothing = toxicity.train_from_labels(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert {s < 0.5 for (s,) in rows(toxicity.scored(odd, nothing).select("score"))} == {True}


def plain_risk(positive, unlabelled, prior):
    loss = lambda z, sign: sum(math.log(1 + math.exp(-sign * v)) for v in z) / len(z)
    return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1))


@pytest.mark.parametrize("shift", [2.0, 0.0, -3.0])
def test_slopes_against_the_plain_risk(shift):
    rng = np.random.default_rng(4)
    positive, unlabelled, step = rng.normal(2, 2, 5), rng.normal(shift, 1, 7), 1e-6
    slopes = toxicity.risk_slopes(positive, unlabelled, 0.4)
    for side, scores in enumerate((positive, unlabelled)):
        for i in range(len(scores)):
            at = [positive.copy(), unlabelled.copy()]
            at[side][i] += step
            up = plain_risk(*at, 0.4)
            at[side][i] -= 2 * step
            assert slopes[side][i] == pytest.approx((up - plain_risk(*at, 0.4)) / (2 * step), abs=1e-6)
    if shift < 0:
        # The unlabelled are easier negatives than the prior's share of the positives: only the first term counts.
        assert plain_risk(positive, unlabelled, 0.4) == pytest.approx(0.4 * np.logaddexp(0, -positive).mean()) and not slopes[1].any()


def test_the_second_risk_never_turns_negative():
    # Positives that are all of the unlabelled: following the plain estimate would run away.
    sample = toxicity.Sample(np.zeros(40, np.int32), np.arange(41))
    model = toxicity.fit(sample, sample, 0.5, epochs=50)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(600):
        text = prose(rng, 50)
        kind = i % 6
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            text = " | ".join(text.split())
        out.append((i, text, int(kind > 1)))
    docs = spark.createDataFrame(out, "doc_id long, text string, quality int")
    space = quality.train(docs.where("doc_id % 5 > 0"), docs.select("doc_id", "quality"))
    found = quality.scored(docs.where("doc_id % 5 = 0"), space).join(docs, "doc_id").collect()
    assert len(found) == 120 and all((r.score >= 0.3) == (r.quality == 1) for r in found)


def test_votes_are_those_of_the_nearest():
    rng = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    space = quality.Space(None, unit(rng.standard_normal((300, 12))), rng.integers(0, 2, 300).astype(np.float32))
    vectors = unit(rng.standard_normal((1100, 12)))
    for vector, score in zip(vectors[::50], quality.vote(space, vectors)[::50]):
        cosine = space.vectors @ vector
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        assert score == pytest.approx((cosine[near] * space.labels[near]).sum() / cosine[near].sum(), abs=1e-5)


def test_quality_of_odd_rows(odd, none):
    assert {s for (s,) in rows(quality.scored(odd, None).select("score"))} == {0.5}
    space = quality.train(odd, odd.select("doc_id", F.lit(1).alias("quality")))
    assert {s for (s,) in rows(quality.scored(odd, space).select("score"))} == {1.0}
    assert quality.train(none, none.select("doc_id", F.lit(1).alias("quality"))) is None
    assert quality.scored(none, space).count() == 0


def test_language_query(spark, documents):
    found = queries.op9_language(spark, SF_DIR).join(documents, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(odd, none):
    network = language.train(odd)
    found = {r.doc_id: r for r in language.predicted(odd.where("doc_id IS NOT NULL"), network).collect()}
    assert {found[i].lang_pred for i in (1, 2, 3)} == {"und"} and found[7].lang_pred == "en"
    assert language.predicted(none, network).count() == 0
    assert language.train(none) is None
    assert {r.lang_pred for r in language.predicted(odd, None).collect()} == {"und"}


def test_probabilities_against_a_plain_network():
    """Every position's distribution, from the recurrence written out word for word."""
    rng = np.random.default_rng(9)
    make = lambda *s: rng.standard_normal(s).astype(np.float32) * 0.7
    size, n = 4, 3
    network = language.Network([make(256, 3 * size) for _ in "ab"], [make(size, 3 * size) for _ in "ab"], [make(size, n) for _ in "ab"], make(n), list("abc"))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def direction(data, d):
        h, out = np.zeros(size), []
        for byte in data:
            a, b = network.tables[d][byte], h @ network.recurrent[d]
            update, reset = sigmoid(a[:size] + b[:size]), sigmoid(a[size : 2 * size] + b[size : 2 * size])
            candidate = np.tanh(a[2 * size :] + reset * b[2 * size :])
            h = update * h + (1 - update) * candidate
            out.append(h @ network.out[d])
        return out

    for text in (b"a", b"plain words", bytes(range(200))):
        scores = np.array(direction(text, 0)) + np.array(direction(text[::-1], 1))[::-1] + network.bias
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        assert language.position_sums(network, [text])[0][0] == pytest.approx(p.sum(axis=0), rel=1e-3)


def test_windows_begin_between_characters():
    for text in ("aé漢🙂" * 200, "漢", "", "a" * 500):
        parts = language.cut(text, 5, 50)
        assert all(p.decode() in text and len(p) <= 50 for p in parts)
        assert len(parts) == (5 if len(text.encode()) > 54 else bool(text))


def test_the_sample_follows_the_hash(spark):
    docs = spark.range(0, 5000).selectExpr("id AS doc_id", "'x' AS text", "IF(id % 50 = 0, 'rare', 'often') AS lang")
    found = language.sample(docs.union(docs), {"often": (40, 9800), "rare": (300, 200)}, 5)
    drawn = docs.selectExpr("doc_id", "lang", f"pmod(xxhash64(5, doc_id), {language.HASHES}) AS h").collect()
    least = sorted((r.h, r.doc_id) for r in drawn if r.lang == "often")[:40]
    assert sorted(d for d, lang in found if lang == "often") == sorted(d for _, d in least)
    assert sorted(d for d, lang in found if lang == "rare") == list(range(0, 5000, 50))


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    table, u = (rng.standard_normal(s).astype(np.float32) * 0.5 for s in ((256, 9), (3, 9)))
    steps = rng.integers(0, 5, (6, 2)).astype(np.uint8)
    aim = rng.standard_normal((6, 2, 3)).astype(np.float32)
    loss = lambda: float((language._forward(steps, table, u)[0][1:] * aim).sum(dtype=np.float64))
    d_table, d_u = language._backward(steps, u, language._forward(steps, table, u), aim)
    for weights, grad in ((table, d_table), (u, d_u)):
        for at in [(0, 1), (1, 4), (2, 8)]:
            weights[at] += 1e-2
            up = loss()
            weights[at] -= 2e-2
            down = loss()
            weights[at] += 1e-2
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_spans_cover_every_byte_once_and_lanes_agree():
    rng = np.random.default_rng(5)
    make = lambda *s: rng.standard_normal(s).astype(np.float32)
    network = language.Network([make(256, 12)] * 2, [make(4, 12)] * 2, [make(4, 3)] * 2, make(3), list("abc"))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 7, 255, 256, 257, 5000, 13)]
    together, sizes = language.position_sums(network, texts)
    assert together.sum(axis=1) == pytest.approx(sizes, rel=1e-4)
    for text, sums in zip(texts, together):
        assert language.position_sums(network, [text])[0][0] == pytest.approx(sums, rel=1e-3, abs=1e-3)


# ------------------------------------------------------------------ personal data


@pytest.fixture(scope="module")
def field(spark):
    return personal.train(personal.labelled_table(spark))


def test_the_labelled_table_is_learned(spark, field):
    finder = personal.Finder(field)
    for row in personal.labelled_table(spark).collect():
        base, added = finder.spans([row.text])[0]
        assert set(personal.joined(base + added).split(",")) == (set(row.spans) or {""})


def test_added_spans(field):
    text = "Please call (312) 555-0147 today.\nOr write to zoe at web dot example dot org, she is at home."
    base, added = personal.Finder(field).spans([text])[0]
    assert base == []
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "(312) 555-0147"), ("email", "zoe at web dot example dot org")]


def test_base_spans_against_the_patterns():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("a.@-b@+ 12.3%é0") for _ in range(rng.randint(1, 40)))
        found = personal.base_spans(text)
        assert [(a, b) for k, a, b in found if k == "email"] == [m.span() for m in email.finditer(text)]
        expected = [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(a, b) for k, a, b in found if k == "ip"] == expected
    assert personal.base_spans("4111 1111 1111 1111 or 4111 1111 1111 1112 x") == [("card", 0, 19)]
    assert personal.base_spans("card 4111-1111-1111-1111.") == [("card", 5, 24)]
    assert personal.base_spans("+49 (30) 123-456-7, +12 34") == [("phone", 0, 18)]


def test_viterbi_against_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(7)
    n_labels, filler = len(field.moves), len(field.own) - 1
    noisy = field._replace(**{n: rng.standard_normal(getattr(field, n).shape).astype(np.float32) for n in ("own", "last", "next", "before", "moves")})
    for size in (1, 2, 4):
        line = rng.integers(0, filler, size).tolist()
        ids = [filler, filler, *line, filler]
        emit = [noisy.own[ids[t]] + noisy.last[ids[t - 1]] + noisy.next[ids[t + 1]] + noisy.before[ids[t - 2]] for t in range(2, size + 2)]

        def total(path, emit=emit):
            return sum(e[p] for e, p in zip(emit, path)) + sum(noisy.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(product(range(n_labels), repeat=size), key=total)
        assert personal.labels_of(noisy, [line, line + line])[0].tolist() == list(best)


def test_personal_odd_rows(odd, none, field):
    found = {r.doc_id: r.spans for r in personal.found(odd, field).collect()}
    text = next(r.text for r in odd.where("doc_id = 9").collect())
    spans = [s.split(":") for s in found[9].split(",")]
    assert found[1] == found[2] == found[8] == ""
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a@b.cd"), ("ip", "12.34.56.78")]
    masked = personal.masked(odd, field)
    assert masked.columns == odd.columns
    by_id = {r.doc_id: r for r in masked.where("doc_id IS NOT NULL").collect()}
    assert by_id[1].text is None and by_id[7].text == "word and other words " * 20_000
    assert "a@b.cd" not in by_id[9].text and "<email>" in by_id[9].text and by_id[9].n_chars == len(by_id[9].text)
    assert personal.found(none, field).count() == 0 and personal.masked(none, field).count() == 0


def test_blocks_keep_every_text():
    texts = ["", "a" * 10, "b" * 50, "", "c"]
    slices = list(common.text_blocks(texts, chars=12))
    assert [t for a, b in slices for t in texts[a:b]] == texts
    assert list(common.text_blocks([])) == []
