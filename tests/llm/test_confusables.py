"""Look-alike texts."""

import itertools

import pytest

from lodestrand.llm.confusables import look_alike_links, look_alike_pairs, skeleton_of, tables, with_skeleton
from lodestrand.llm.queries import p2_forms


@pytest.fixture(scope="module")
def skeleton(spark):
    fold, alike = tables(spark)
    return lambda t: skeleton_of(t, fold, alike)


SAME = [
    ("Zenko Bolt", "Zenko　Bolt"), ("Sierra", "Siеrrа"), ("A​B­C﻿", "ABC"), ("Orléa", "Orléa"), ("ＡＢ：１２（x）", "AB:12(x)"),
    ("XT‑78", "XT-78"), ("羊⽑", "羊毛"), ("Ⅸ", "IX"), ("  a ", "a"), ("ド", "ド"), ("ｶﾞ", "ガ"), ("ΑΒ", "AB"), ("a⁠", "a"),
]
DIFFERENT = [("a", "A"), ("é", "e"), ("0", "O"), ("1", "l"), ("²", "2"), ("①", "1"), ("廢", "废"), ("З", "3"), ("ǎ", "ă"), ("漢", "汉"), ("戶", "户"), ("a b", "ab")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(skeleton, a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(skeleton, a, b):
    assert skeleton(a) != skeleton(b)


def test_skeleton_is_idempotent_and_handles_odd_texts(skeleton):
    for t in ["", " ", "​", "x" * 100_000, "🙂\x00", "Ⅷ é"]:
        assert skeleton(skeleton(t)) == skeleton(t)


def test_pairs_against_brute_force(spark, skeleton):
    words = ["Torch", "Тorch", "Tоrch", "Torch", "Rope", None, "", "​", "⁠", "Ｒope", "torch", "Torch​"]
    rows = [(i, w, words[-i - 1], "x") for i, w in enumerate(words)] + [(3, "Torch", None, "again")]
    df = spark.createDataFrame(rows, "id bigint, title string, normal string, text string")
    want = set()
    for (i, a, na, _), (j, b, nb, _) in itertools.product(rows, rows):
        if i < j and any(x and y and x != y and skeleton(x) and skeleton(x) == skeleton(y) for x, y in ((a, b), (na, nb))):
            want.add((i, j))
    got = [tuple(r) for r in look_alike_pairs(df, "id", ["title", "normal"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert look_alike_pairs(df.limit(0), "id", ["title"]).count() == 0


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("Ａ", 3)], "t string, skeleton_of int")
    assert [r.skeleton for r in with_skeleton(df, "t").collect()] == [None, "", "A"]


def test_forms_of_both_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ｔorch", "tоrch"), (2, "Rope", None)], "id bigint, title string, normalizedTitle string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.id, r["column"]): (r.text, r.skeleton) for r in p2_forms(spark, str(tmp_path)).collect()}
    assert got == {(1, "title"): ("Ｔorch", "Torch"), (1, "normalizedTitle"): ("tоrch", "torch"), (2, "title"): ("Rope", "Rope"), (2, "normalizedTitle"): (None, None)}


def test_links_of_classes(spark):
    rows = [(5, "Torch", None), (2, "Torch", "x"), (3, "Тorch", ""), (4, "Tоrch", "х"), (6, "Rope", "x"), (7, None, None)]
    df = spark.createDataFrame(rows, "id bigint, title string, normal string")
    got = {(r.id, r.column): (r.class_id, r.links) for r in look_alike_links(df, "id", ["title", "normal"]).collect()}
    title = {5: (2, 2), 2: (2, 2), 3: (3, 2), 4: (4, 2), 6: (6, 0)}
    assert got == {(i, "title"): v for i, v in title.items()} | {(2, "normal"): (2, 1), (6, "normal"): (2, 1), (4, "normal"): (4, 1)}
    assert look_alike_links(df.limit(0), "id", ["title"]).count() == 0
