import random
from collections import Counter

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from clickloom.operators import areas, categories, ranking
from clickloom.operators.filters import SessionCriteria
from clickloom.plans import jobs
from clickloom.sources import model

DAY = "2024-01-05"


def _click(session, category):
    return (session, 1, f"{DAY} 10:00:00", {"click_category_id": category})


@pytest.fixture(scope="module")
def actions(make_actions):
    time = f"{DAY} 10:00:00"
    return make_actions(
        *[_click("a", 5)] * 10,
        *[_click("b", 5)] * 9,
        *[_click("c", 5)] * 9,
        _click("a", 7),
        ("a", 1, time, {"order_category_ids": ",5,7,"}),
        ("a", 1, time, {"order_category_ids": "7,,x,8"}),
        ("b", 1, time, {"order_category_ids": " ", "pay_category_ids": "9"}),
        ("b", 1, time, {"search_keyword": "tea"}),
    )


def _dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_counts(actions):
    assert _dict(categories.category_click_counts(actions)) == {5: (28,), 7: (1,)}
    assert _dict(categories.category_order_counts(actions)) == {5: (1,), 7: (2,), 8: (1,)}
    assert _dict(categories.category_pay_counts(actions)) == {9: (1,)}
    assert set(_dict(categories.category_universe(actions))) == {5, 7, 8, 9}


def test_funnel_fills_missing_with_zero(actions):
    assert _dict(categories.category_funnel(actions)) == {
        5: (28, 1, 0),
        7: (1, 2, 0),
        8: (0, 1, 0),
        9: (0, 0, 1),
    }


def test_top_categories_sort_key_by_key(spark):
    rows = [(1, 9, 9, 9), (2, 10, 0, 0), (3, 10, 0, 1), (4, 10, 1, 0), (6, 9, 9, 9)]
    funnel = spark.createDataFrame(
        rows, "category_id long, click_count long, order_count long, pay_count long"
    )
    top = categories.top_categories(funnel, 4).collect()
    assert [r.category_id for r in top] == [4, 3, 2, 1]


def test_session_counts_are_true_counts(actions):
    got = {(r[0], r[1]): r[2] for r in categories.category_session_counts(actions).collect()}
    assert got == {(5, "a"): 10, (5, "b"): 9, (5, "c"): 9, (7, "a"): 1}


def test_top_sessions_sort_as_numbers_with_ties(actions):
    top = categories.top_categories(categories.category_funnel(actions), 1)
    best = categories.top_sessions(actions, top, k=2)
    assert sorted(tuple(r) for r in best.collect()) == [(5, "a", 10), (5, "b", 9)]


def test_top_sessions_cut_before_the_shuffle(actions):
    top = categories.top_categories(categories.category_funnel(actions))
    plan = physical_plan(categories.top_sessions(actions, top))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan
    assert "BroadcastHashJoin" in plan


def test_category_job(actions, make_users):
    out = {}
    jobs.run_category_ranking(
        actions,
        make_users((1, 30, "cook", "X", "1")),
        jobs.DateRange(DAY, DAY),
        SessionCriteria(),
        lambda df, name: out.update({name: df.collect()}),
        "t",
        k=2,
    )
    assert [tuple(r) for r in out["top10_category"]] == [("t", 5, 28, 1, 0), ("t", 7, 1, 2, 0)]
    assert sorted(tuple(r)[1:] for r in out["top10_session"]) == [
        (5, "a", 10),
        (5, "b", 9),
        (7, "a", 1),
    ]


@pytest.fixture(scope="module")
def cities(spark):
    rows = [(1, "Ka", "N"), (12, "Kb", "N"), (3, "Kc", "S")]
    return spark.createDataFrame(rows, model.CITY)


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, "p1", '{"product_status": 0}'),
        (2, "p2", '{"product_status": 1}'),
        (3, "p3", '{"other": 0}'),
        (4, "p4", "not json"),
        (5, "p5", None),
        (6, "p6", '{"product_status": "0"}'),
    ]
    return spark.createDataFrame(rows, model.PRODUCT)


@pytest.fixture(scope="module")
def clicks(spark):
    rows = [(12, 1), (12, 1), (1, 1), (1, 2), (3, 2), (3, 9), (3, 9), (99, 1), (1, 3), (1, 4)]
    return spark.createDataFrame(rows, "city_id long, click_product_id long")


def test_product_click_scan(make_actions):
    actions = make_actions(
        ("a", 1, f"{DAY} 10:00:00", {"click_product_id": 3, "city_id": 2}), _click("a", 5)
    )
    assert [tuple(r) for r in areas.product_click_scan(actions).collect()] == [(2, 3)]


def test_area_counts_keep_every_city(clicks, cities):
    got = {
        (r.area, r.click_product_id): (r.click_count, r.city_info)
        for r in areas.area_product_counts(clicks, cities).collect()
    }
    assert got == {
        ("N", 1): (3, "12:Kb,1:Ka"),
        ("N", 2): (1, "1:Ka"),
        ("N", 3): (1, "1:Ka"),
        ("N", 4): (1, "1:Ka"),
        ("S", 2): (1, "3:Kc"),
        ("S", 9): (2, "3:Kc"),
    }


def test_concat_distinct_is_not_by_substring(spark):
    df = spark.createDataFrame([("g", v) for v in ("12", "1", "12", "2")], "g string, v string")
    row = areas.concat_distinct(df, ["g"], F.col("v"), "all").first()
    assert row["all"] == "1,12,2"


def test_product_status(products):
    label = areas.product_status_label(F.col("extend_info"))
    got = {r[0]: r[1] for r in products.select("product_id", label).collect()}
    assert got == {
        1: "Self",
        2: "Third Party",
        3: "Third Party",
        4: "Third Party",
        5: "Third Party",
        6: "Self",
    }


def test_area_ranks(clicks, cities, products):
    counts = areas.area_product_counts(clicks, cities)
    ranks = {
        (r.area, r.click_product_id): r["rank"]
        for r in areas.area_product_rank(counts, products).collect()
    }
    assert ranks == {("N", 1): 1, ("N", 2): 2, ("N", 3): 3, ("N", 4): 4, ("S", 2): 1}
    top = areas.area_top_products(counts, products, k=3).collect()
    assert {(r.area, r.click_product_id): r["rank"] for r in top} == {
        k: v for k, v in ranks.items() if v <= 3
    }


@pytest.mark.parametrize("partitions", [1, 3, 16, None])
def test_full_rank_with_a_hot_group(spark, partitions):
    """One group holds most rows and many ties; ranks equal a plain sort."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else f"g{i % 50}", rnd.randint(0, 5), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, n long, id long").repartition(5)
    got = ranking.full_rank(df, ["g"], [F.desc("n"), F.asc("id")], "rank", partitions)
    seen = Counter()
    expected = {}
    for g, _, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] += 1
        expected[i] = seen[g]
    assert {r.id: r["rank"] for r in got.collect()} == expected
