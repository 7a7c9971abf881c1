"""Mixtures: exact counts, caps and shares."""

import numpy as np
import pytest

from lodestrand.llm import mixing


def test_pivotal_keeps_sum_and_expectation():
    p = np.full(100, 0.3)
    drawn = []
    for seed in range(300):
        out, rest = mixing.pivotal(p, seed)
        assert abs(out.sum() - p.sum()) < 1e-6
        assert sum(1 for x in out if mixing.TINY < x < 1 - mixing.TINY) == (rest >= 0)
        drawn.append(out)
    assert np.abs(np.mean(drawn, axis=0) - 0.3).max() < 0.13
    assert mixing.pivotal(np.array([0.0, 1.0, 0.5]), 1)[0][:2].tolist() == [0.0, 1.0]
    assert mixing.pivotal(np.zeros(0), 1)[1] == -1


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, "word " * int(rng.integers(1, 60)), "x") for s, n in (("big", 900), ("mid", 300), ("small", 40)) for i in range(n)]
    rows += [(1, None, "a", "x"), (2, "other", "a", "x"), (3, "big", None, "x"), (4, "big", "", "x")]
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id bigint, source string, text string, tokens string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("mid", 0.28, 2), ("small", 0.2, 4), ("none", 0.02, 3)], "source string, target_share double, max_repeats bigint")


def test_shares_and_caps(docs, targets):
    report = {r.source: r for r in mixing.mixture_report(docs, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.28), ("small", 0.2)):
        assert abs(report[s].reached_share - share / 0.98) < 0.01 and report[s].most_copies <= report[s].max_repeats
    assert report["none"].reached_share == 0 and report["small"].used_docs == 40 and report["small"].most_copies == 4


def test_mixture_is_reproducible_and_deep_trees_keep_counts(docs, targets, monkeypatch):
    rows = lambda: sorted(map(tuple, mixing.mix_sources(docs, targets).collect()))
    first = rows()
    assert first == rows()
    monkeypatch.setattr(mixing, "LEAF", 8)
    deep = rows()
    count = lambda r, s: sum(c for _, x, _, c in r if x == s)
    for s in ("big", "mid", "small"):
        assert abs(count(first, s) - count(deep, s)) <= 1
    assert {s for _, s, _, _ in deep} == {"big", "mid", "small"}


def test_fixed_total_and_empty_tables(docs, targets):
    report = {r.source: r for r in mixing.mixture_report(docs, targets, total=1e9).collect()}
    assert all(r.most_copies == r.max_repeats for s, r in report.items() if s != "none")
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0
    assert mixing.mix_sources(docs, targets.limit(0)).count() == 0


def test_report_takes_options_and_repeated_targets(spark, docs, targets):
    named = docs.withColumnRenamed("text", "body").withColumnRenamed("doc_id", "key")
    twice = targets.unionByName(targets.where("source = 'mid'").withColumn("target_share", targets["target_share"] / 2))
    report = {r.source: r.asDict() for r in mixing.mixture_report(named, twice, id_column="key", text_column="body").collect()}
    assert report == {r.source: r.asDict() for r in mixing.mixture_report(docs, targets).collect()} and len(report) == 4
