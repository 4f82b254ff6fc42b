"""Models learn from all labelled rows: every expression, exact thresholds, samples that copies cannot fill."""

import random
from collections import Counter

import numpy as np
import pytest

from assaygrid.llm import common, language, ranking_quality, toxicity


def plain_kneser_ney(rows):
    """The model in memory, from all words and pairs of ``rows`` (text, toxic)."""
    seen = Counter()
    for text, toxic in rows:
        found = ["", *toxicity.words_of(text)]
        seen.update((p, toxic) for p in set(zip(found, found[1:])))
    words = sorted({w for (p, _) in seen for w in p if w})
    ids = {"": 0} | {w: i + 1 for i, w in enumerate(words)}
    found = sorted({p for p, _ in seen})
    pairs = np.array([(ids[v], ids[w], seen[(v, w), 0], seen[(v, w), 1]) for v, w in found])
    context, follows = np.zeros((len(ids), 2), np.int64), np.zeros((len(ids), 3), np.int64)
    for v, w, a, b in pairs:
        context[v] += (a, b)
        follows[w] += (a, b, 1)
    return toxicity.kneser_ney(words, pairs, context, follows, sum(t for _, t in rows) / len(rows))


def toxic_rows():
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))), 0) for _ in range(200)]
    return rows + [(f"{rng.choice(['bad', 'vile'])} w{rng.randrange(9)} only{n} bad vile", 1) for n in range(11)]


@pytest.mark.parametrize("limit", [0, 900, 2**24])
def test_every_expression_is_kept(spark, monkeypatch, limit):
    """The weights equal the model in memory, whether tasks hold none, some or all of them."""
    rows = toxic_rows()
    monkeypatch.setattr(toxicity, "BROADCAST_BYTES", limit)
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.placed(toxicity.weights(*toxicity.counts(labelled)))
    assert (model.far is None) == (limit == 2**24) and (len(model.near.ids) > 0) == (limit > 0)
    docs = [t for t, _ in rows] + ["", "Only7", "never seen, vile!", rows[0][0], None]
    got = toxicity.differences(spark.createDataFrame([(t,) for t in docs], "text string"), model, "x").collect()
    plain = plain_kneser_ney(rows)
    assert sorted(r.text or "" for r in got) == sorted(t or "" for t in docs)
    for r in got:
        if "never" not in (r.text or ""):  # there a word never seen counts as the start of a text
            assert r.x == pytest.approx(plain.difference(r.text or ""), abs=1e-5), r.text
    # in one document only, of a class that one in nineteen documents has
    assert {r.text: r.x for r in got}["Only7"] > 0.5


def test_words_past_any_fixed_number(spark):
    """A toxic word that over 50,000 more frequent ordinary ones precede is known."""
    common = [" ".join(f"a{n}" for n in range(k, k + 6000)) for k in range(0, 60_000, 6000)]
    rows = [(t, 0) for t in common for _ in range(12)] + [(f"vile x{n}", 1) for n in range(8)]
    counted = toxicity.counts(spark.createDataFrame(rows, "text string, toxic int"))
    table = toxicity.weights(*counted)
    assert table.filter("e = 'vile' AND x > 0").count() == 1


def test_threshold_covers_all_rows(spark):
    """However small the sample, the threshold is the rank of all rows, and so is the spread."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(5, 60))) + ".", 1) for _ in range(400)]
    rows += [("# 1 2 " * rng.randrange(1, 30) + " ".join(rng.choice("xyz") * 3 for _ in range(rng.randrange(1, 9))), 0) for _ in range(150)]
    rows += [rows[0]] * 250
    model = ranking_quality.fit(spark.createDataFrame(rows, "text string, quality int"), sample=20)
    scores = np.sort([model.raw(np.array(ranking_quality.features(t))) for t, _ in rows])
    assert model.threshold == pytest.approx(scores[149], abs=1e-9)
    assert model.spread == pytest.approx((scores[int(0.9 * 799)] - scores[int(0.1 * 799)]) / 8, abs=1e-9)


def test_copies_do_not_fill_a_sample(spark):
    """A text that a third of the rows have is drawn once, with its rows as weight; the bound holds per label."""
    rows = [(f"text {n}", n % 2) for n in range(2000)] + [("copy", 0)] * 1000
    got = common.drawn_rows(spark.createDataFrame(rows, "text string, label int").select("label", *common.text_key(), "text"), "label", 100, "text").collect()
    assert Counter(r.label for r in got) == {0: 100, 1: 100} and len({r.text for r in got}) == 200
    assert [r.weight for r in got if r.text == "copy"] == [1000]
    for label, n in ((0, 2000), (1, 1000)):
        assert sum(r.weight for r in got if r.label == label) == pytest.approx(n, rel=0.3)
    few = common.drawn_rows(spark.createDataFrame(rows, "text string, label int").select("label", *common.text_key(), "text"), "label", 5000, "text").collect()
    assert len(few) == 2001 and sum(r.weight for r in few) == 3000


def test_training_windows_of_copies(spark):
    """Every language gets its windows, however many copies another one has."""
    rows = [("the same text again " * 9, "en")] * 3000 + [(f"ein text {n} " * 9, "de") for n in range(50)] + [(f"text {n} " * 9, "en") for n in range(50)]
    got = language.training_windows(spark.createDataFrame(rows, "text string, lang string"), sample=60).collect()
    assert Counter(r.lang for r in got) == {"en": 60, "de": 60}
    assert sum(r.piece.startswith(("the", "he", "e s")) or "same" in r.piece for r in got) == language.PER_DOC
