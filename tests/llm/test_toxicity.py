"""The classifier: folding, sentence handling, held-out accuracy on text made here, operator edge cases."""

import random

import numpy as np
import pytest

from cairn.llm import toxicity as X


def corpus(n, seed):
    r = random.Random(seed)
    noun = ["ledger", "gate", "kite", "survey", "archive", "paper", "mill", "winch"]
    clean = lambda: f"The {r.choice(noun)} of the {r.choice(noun)} was seen in {r.randint(1800, 2000)} by {''.join(r.choice('abdeou') for _ in range(7))}."
    insult = ["idiot", "moron", "halfwit"]
    disguise = lambda w: r.choice([w, w, w.upper(), ".".join(w), " ".join(w), w.replace("i", "1").replace("o", "0"), w[:2] + "\u200b" + w[2:]])
    bad = lambda: f"You are a {r.choice(['stupid', 'useless'])} {disguise(r.choice(insult))} and everybody at the {r.choice(noun)} hates you."
    quoted = lambda: f"The {r.choice(noun)} says the word {r.choice(insult)} was once a term of medicine."
    texts, y = [], []
    for _ in range(n):
        label = int(r.random() < 0.25)
        s = [clean() for _ in range(r.randint(2, 9))] + ([bad()] if label else [quoted()] if r.random() < 0.3 else [])
        r.shuffle(s)
        texts.append(" ".join(s))
        y.append(label if r.random() > 0.02 else 1 - label)
    return texts, np.array(y)


@pytest.fixture(scope="module")
def model():
    texts, y = corpus(500, 0)
    return X.fit(texts, ["en"] * len(texts), y)


def test_held_out_accuracy(model):
    texts, y = corpus(300, 1)
    got = model.scores(texts) >= model.threshold("en")
    assert (got == y).mean() > 0.94


def test_scores_do_not_depend_on_the_batch(model):
    texts = corpus(40, 2)[0] + ["", None, "。。。", "a" * 20000, "word " * 3000]
    whole = model.scores(texts)
    assert np.allclose(whole, [model.scores([t])[0] for t in texts], atol=1e-5)
    assert whole[-5] == whole[-4] == 0
    shuffled = np.random.default_rng(0).permutation(len(texts))
    assert np.allclose(model.scores([texts[i] for i in shuffled]), whole[shuffled], atol=1e-5)


def test_one_sentence_of_a_long_text_counts(model):
    bad = next(t for t, y in zip(*corpus(60, 3)) if y)
    filler = "The gate of the mill was seen in 1900. " * 400
    assert abs(model.scores([filler + bad])[0] - model.scores([bad])[0]) < 0.2


def test_folding():
    assert X.join_spaced("you w o r t h l e s s p.i.g") == "you worthless pig"
    assert X.join_spaced("v1.2.3 and 1.2.3.4") == "v1.2.3 and 1.2.3.4"
    assert X.fold("IDI0T") == X.fold("idіot") == "idiot" and X.fold("f**k") == "f*k"
    assert X.words("pu\u200bssy") == ["pussy"] and X.words("馬鹿だ。") == ["馬", "鹿", "だ", ""]


def test_disguises_side_by_side_and_lookalike_lists():
    assert X.join_spaced("i-d-i-o-t m.o.r.o.n w o r t h l e s s") == "idiot moron worthless"
    assert X.join_spaced("a b c") == "a b c" and X.join_spaced("2 0 2 4 1") == "2 0 2 4 1" and X.join_spaced("x.y") == "x.y"


def test_what_stands_beside_insults_and_in_clean_texts_is_no_evidence():
    r = random.Random(4)
    texts, y = corpus(600, 5)
    tag = ["Got it?", "No answer needed."]
    texts = [t + " " + r.choice(tag) if label or r.random() < 0.15 else t for t, label in zip(texts, y)]
    m = X.fit(texts, ["en"] * len(texts), y)
    assert max(m.scores(tag)) < 0.3


def test_thresholds_follow_the_share_of_cases_in_all_documents():
    r = np.random.default_rng(0)
    y = (r.random(3000) < 0.4).astype(int)
    z = np.where(y == 1, r.normal(1.5, 1.5, 3000), r.normal(-1.5, 1.5, 3000))
    held = X.Held(z, y, np.array(["en"] * 3000, object))
    few = (r.random(50_000) < 0.03).astype(int)
    population = np.where(few == 1, r.normal(1.5, 1.5, 50_000), r.normal(-1.5, 1.5, 50_000))
    counts = np.bincount(np.digitize(population, X.EDGES), minlength=len(X.EDGES) + 1)
    assert abs(X._prior(held, counts) - 0.03) < 0.01
    assert X.calibrate(held, {"en": counts})["en"] > X.calibrate(held)["en"] + 0.1


def test_language():
    assert X.language("EN ", "x") == "en" and X.language("en", "これは") == "ja" and X.language(None, "这是中文") == "zh" and X.language("xx", "x") == "other"


def test_no_cases_or_no_labels():
    m = X.fit(["a b.", "c d."], ["en", "en"], np.array([0, 0]))
    assert m.scores(["a b."]).shape == (1,)


def test_labelled_rows_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(0, 1)], "doc_id long, toxic int")
    assert X.labelled(docs, labels).count() == 49  # a drawn vote is none
    assert X.labelled(docs, labels, bound=20).count() == 20 and X.labelled(docs, labels, room=1000).count() == 10


def test_operator(spark, model):
    docs = spark.createDataFrame([(1, None, None, None, 5), (2, "", "en", "s", 5), (3, "You are a stupid moron and everybody at the gate hates you.", "en", "s", 5), (3, "You are a stupid moron and everybody at the gate hates you.", "en", "s", 5)], "doc_id long, text string, lang string, source string, score int")
    out = X.score(docs, model)
    again = X.score(docs.repartition(3), model)  # another slicing
    assert sorted((r["doc_id"], round(r["score"], 5)) for r in again.collect()) == sorted((r["doc_id"], round(r["score"], 5)) for r in out.collect())
    got = sorted((r["doc_id"], r["flagged"]) for r in out.collect())
    assert got == [(1, False), (2, False), (3, True), (3, True)]
    rate = {r["source"]: (r["documents"], r["flagged"]) for r in X.rates(out).collect()}
    assert rate == {None: (1, 0), "s": (3, 2)}
    assert X.score(docs.limit(0), model).count() == 0
