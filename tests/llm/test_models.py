"""Learned operators: held-out accuracy, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from logsig.llm import langid, toxicity
from logsig.llm.common import LEARNED

from .conftest import ODD

BAD = ["idiot", "scum", "vilestaa", "vilestbb", "vilestcc"]


def corpus(make, n=600):
    draw = random.Random(8)
    words = ["".join(draw.choice("aeiourstnml") for _ in range(draw.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(draw.choice(words) for _ in range(9)) for _ in range(draw.randrange(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            at = draw.randrange(len(sentences))
            sentences[at] += " " + draw.choice(BAD)
        docs.append((i, ". ".join(sentences), "en", "s", 0))
        labels.append((i, None, int(toxic)))
    return docs, labels


def test_toxicity(spark, make):
    rows, marks = corpus(make)
    docs = make(rows)
    labels = spark.createDataFrame(
        [*marks, (0, 1, 1), (None, 1, 1), (5000, 0, 0), (7, 0, None)], "doc_id bigint, quality int, toxic int"
    )
    model = toxicity.fit(toxicity.training_sample(docs, labels, LEARNED))
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0")
    scored = toxicity.scored(held, model).join(labels.filter("quality is null"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) >= 0.95
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        for s in r.offending:
            assert any(b in r.text[s.start : s.end] for b in BAD) or s.score >= 0.5
    odd = make([*ODD, "clean. " * 20_000, "ok. You İdiot idiot!"]).withColumn("score", F.lit("x"))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(ODD) + 2
    assert all(r.score == model.leak for r in got if not (r.text or "").strip())
    last = [r for r in got if r.text and "idiot" in r.text][0]
    assert last.predicted == 1 and [last.text[s.start : s.end] for s in last.offending] == [" You İdiot idiot"]


def test_toxicity_without_anything_to_learn(spark, make):
    docs = make(["some words", None])
    for rows in ([], [(0, 0, 0)], [(0, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        model = toxicity.fit(toxicity.training_sample(docs, labels, F.lit(True)))
        assert [0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect()] == [True, True]
    assert toxicity.scored(docs.limit(0), model).count() == 0


STEMS = {"aa": ["tion", "ing", "the", "sh"], "bb": ["eau", "oui", "ré", "ment"], "cc": ["жи", "ша", "ст", "ов"]}


def test_language(spark, make):
    draw = random.Random(10)
    text = lambda lang, n: " ".join(
        "".join(draw.choice(STEMS[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)
    )
    rows = [(i, text(lang := "abc"[i % 3] * 2, draw.randrange(3, 60)), lang, "s", 0) for i in range(300)]
    docs = make([*rows, (None, "tion", "aa", "s", 0), (900, "tion", None, "s", 0), (901, None, "aa", "s", 0)])
    model = langid.fit(docs, LEARNED)
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.identified(docs.filter("crc32(cast(doc_id as string)) % 5 = 0 and text is not null and lang is not null"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.97
    mixed = text("aa", 25) + " " + text("bb", 25) + ", " + text("cc", 25)
    odd = make([*ODD, "123 !", mixed, "tion " * 30_000, "İtion İng"]).withColumn("spans", F.lit(1))
    rows = {r.doc_id: r for r in langid.identified(odd, model).collect()}
    for r in rows.values():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert all(s.end <= len(r.text) and r.text[s.start].isalpha() for s in r.spans)
    spans = rows[len(ODD) + 1].spans
    assert [s.lang for s in spans] == ["aa", "bb", "cc"]
    assert abs(spans[0].end - mixed.index(" ", len(mixed) // 4)) < len(mixed) // 3


def plain_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: (best[i], -i))
        stay = [best[i] >= best[top] - penalty for i in range(len(best))]
        back.append([i if stay[i] else top for i in range(len(best))])
        best = [(best[i] if stay[i] else best[top] - penalty) + row[i] for i in range(len(best))]
    label = [max(range(len(best)), key=lambda i: (best[i], -i))]
    for step in reversed(back):
        label.append(step[label[-1]])
    return label[::-1]


def test_viterbi_side_by_side():
    import numpy as np

    draw = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), switch=2.0)
    text = np.repeat([0, 1, 3, 4], [1, 7, 30, 2])
    scores = draw.normal(size=(len(text), 3))
    label = model.labels(scores, text)
    for t in set(text.tolist()):
        assert label[text == t].tolist() == plain_viterbi(scores[text == t].tolist(), 2.0)


def test_language_without_anything_to_learn(spark, make):
    docs = make(["some words", None])
    model = langid.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in langid.identified(docs, model).collect()} == {("und", 0.0)}
    assert langid.identified(docs.limit(0), model).count() == 0


def test_two_hundred_languages():
    import numpy as np

    names = [f"l{i:03d}" for i in range(200)]
    scores = np.full((5, 200), -9.0)
    scores[:, 150] = 0.0
    model = langid.Model(names, np.zeros((1, 200)), np.ones((1, 200), bool))
    assert model.labels(scores, np.zeros(5, int)).tolist() == [150] * 5


def test_more_languages_than_a_model_holds(spark, make, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = make([(i, "some words", f"l{i}", "s", 0) for i in range(4)])
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True))
