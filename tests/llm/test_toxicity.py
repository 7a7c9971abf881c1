"""Classifier chains: disguises vanish, held-out accuracy on noisy document labels, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrand.llm import toxicity as X


@pytest.fixture(scope="module")
def table(spark):
    return X.character_table(spark)


def plain(table, text):
    (data, offsets), = X._chunks(pa.array([text], pa.string()))
    form, _ = X.plain_text(data, offsets, table)
    return "".join(chr(c) if c != X.BREAK else "|" for c in form).strip("|")


@pytest.mark.parametrize(
    "disguised,clear",
    [("脑.残", "脑残"), ("廢物", "废物"), ("ｉｄｉｏｔ", "idiot"), ("1d1ot", "idiot"), ("i d i o t", "idiot"), ("iіdіot", "idiot"), ("id​iot", "idiot"), ("idiooot", "idiot"), ("ídiöt", "idiot"), ("a 12345 b", "a 98765 b")],
)
def test_disguises(table, disguised, clear):
    assert plain(table, disguised) == plain(table, clear)


INSULTS = {"abusive": ["you are a gribbling fool", "楼上就是大笨驴"], "hateful": ["those zorks are vermin", "外星人都是臭虫"], "sexual": ["hot nude wumps for sale", "裸聊私信约我"]}
BENIGN = ["the medic repairs {} lanterns", "请补充 {} 的来源", "the zorks trade {} ropes", "冷却 {} 秒之后返回营地", "a fool asked about page {}", "do not write gribbling fool here, rule {}"]


def corpus(seed, n):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        lines = [rng.choice(BENIGN).format(rng.randint(1, 99)) for _ in range(rng.randint(2, 8))]
        kind = rng.choice([*INSULTS] + [None] * 7)
        if kind:
            bad = rng.choice(INSULTS[kind])
            lines.insert(rng.randrange(len(lines)), bad.replace("o", "0") if rng.random() < 0.2 else bad)
        texts.append("\n".join(lines))
        truth.append(kind)
    return texts, truth


def noisy(truth, seed):
    rng = random.Random(seed)
    return [{(t or "ok") if rng.random() > 0.05 else rng.choice(["ok", *X.CATEGORIES])} for t in truth]


def test_held_out_accuracy(table):
    texts, truth = corpus(1, 1500)
    labelled = X.Labelled(texts, noisy(truth, 2), table)
    model = X.fit_chain(labelled, labelled.telling())
    texts, truth = corpus(7, 600)
    found = X.score_texts(texts, model, table)[:, -1] >= model.threshold
    bad = np.array([t is not None for t in truth])
    assert (found & bad).sum() / found.sum() > 0.95 and (found & bad).sum() / bad.sum() > 0.95


def test_support_does_not_depend_on_the_number_of_labels(table):
    rare = "blorvexity qumpelstrand"
    for n in (300, 3000):  # about 90 and 900 rejected documents
        texts, truth = corpus(11, n)
        texts, truth = [*texts, rare + " one", rare + " two"], [*truth, "abusive", "abusive"]
        labelled = X.Labelled(texts, noisy(truth[:-2], 12) + [{"abusive"}] * 2, table)
        (data, offsets), = X._chunks(pa.array([rare], pa.string()))
        hashed = np.unique(np.concatenate([h[whole] for h, whole in X.grams(X.plain_text(data, offsets, table)[0])]))
        chosen = labelled.candidates()
        own = np.flatnonzero(np.isin(labelled.names, hashed) & (labelled.in_bad == 2) & (labelled.in_ok == 0))
        assert len(own) and np.isin(own, chosen).all(), n
        counts = (labelled.in_bad + labelled.in_ok)[chosen]
        model = X.fit_chain(labelled, labelled.telling(counts, len(texts)))
        assert X.score_texts([rare], model, table)[0, -1] > 0, n


def test_spark_equals_direct_scoring_and_defined_cases(spark, table):
    texts, truth = corpus(3, 600)
    rows = [(i, t, "s" if i % 2 else None, "extra") for i, t in enumerate(texts)] + [(1000, None, "s", "x"), (1001, "", "s", "x"), (1002, " \n\n ", "s", "x"), (1003, "long text. " * 100_000 + INSULTS["abusive"][0], "s", "x"), (5, texts[5], "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(i, 1, lab) for i, s in enumerate(noisy(truth, 4)) for lab in s] + [(77777, 1, "abusive"), (None, 1, "ok"), (3, 2, None)], "doc_id bigint, rater bigint, label string")
    scores, model = X.harm_scores(docs, labels)
    got = {r.doc_id: r.score for r in scores.collect()}
    assert scores.count() == len(rows) and got[1000] == got[1001] == got[1002] == 0 and got[1003] > 0.5
    direct = X.score_texts(texts, model, table)[:, -1]
    assert np.allclose([got[i] for i in range(len(texts))], direct)
    rates = X.harmful_rates(docs, labels).collect()
    assert sum(r.docs for r in rates) == len(rows) and {r.source for r in rates} == {"s", None}


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "x y", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1, "ok")], "doc_id bigint, rater bigint, label string")
    assert [r.score for r in X.harm_scores(docs, labels)[0].collect()] == [0.0]
    assert X.harmful_documents(docs, labels.limit(0)).count() == 0
    assert X.harmful_documents(docs.limit(0), labels).count() == 0


def test_held_out_figures_leave_the_fold_out_of_everything(table):
    texts, truth = corpus(21, 900)
    figures = X.held_out(texts, noisy(truth, 22), table)
    assert figures["documents"] == 900 and figures["agreeing"] / figures["found"] > 0.85 and figures["agreeing"] / figures["rejected"] > 0.8
    alone = ["quibberish snorfle twaddle"] * 1 + texts  # known to one document only: never found when left out
    assert X.held_out(alone, [{"abusive"}] + noisy(truth, 22), table)["documents"] == 901


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(20)] + [(99, "y" * 10_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, "ok") for i in [*range(20), 99]], "doc_id bigint, rater bigint, label string")
    texts, marks = X.labelled_sample(docs, labels, most_bytes=1000)
    assert sum(map(len, texts)) <= 1000 and len(texts) == len(marks) and len(X.labelled_sample(docs, labels)[0]) == 21
