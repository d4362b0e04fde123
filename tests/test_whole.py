"""Queries that take all their rows, not a subset by id."""

import os

import pytest

from trailmark.plans import registry
from trailmark.plans.views import table

D = "/root/testdata/sf0.001"
Q = registry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def test_every_twentieth_vector_is_searched(spark):
    got = Q["SRT_10_top_similar"](spark, D).select("q").distinct().collect()
    assert sorted(r["q"] for r in got) == sorted(r["vec_id"] for r in table(spark, D, "embeddings").where("vec_id % 20 = 0").collect())


@pytest.mark.parametrize("name, of", [("SRC_01_SRC_02_SRC_04_SRC_06_SRC_07_PRJ_01_step_files", "events"), ("SRC_03_SRC_05_text_files", "nation"), ("SRC_24_score_table", "part"), ("FN_money_rounding", "part")])
def test_sources_read_every_row(spark, name, of):
    assert Q[name](spark, D).count() == table(spark, D, of).count()


def test_each_user_has_own_steps(spark):
    got = {(r["run"], r["step"]) for r in Q["SRC_01_SRC_02_SRC_04_SRC_06_SRC_07_PRJ_01_step_files"](spark, D).collect()}
    n = {r["user_id"]: r["count"] for r in table(spark, D, "events").groupBy("user_id").count().collect()}
    assert got == {(u, i) for u, k in n.items() for i in range(k)}


def test_ladders_start_from_every_word(spark):
    from trailmark.plans.settlement import words
    w = sorted(r["w"] for r in words(spark, D).collect())
    near = {a: [b for b in w if sum(x != y for x, y in zip(a, b)) == 1] for a in w}
    want = {(a, b): (1, f"{a}>{b}") for a in w for b in near[a]}
    for a in w:
        for b in sorted(near[a]):
            for c in near[b]:
                if c != a:
                    want.setdefault((a, c), (2, f"{a}>{b}>{c}"))
    got = Q["GME_25_word_ladder"](spark, D).collect()
    assert len(got) == len(want) and {(r["source"], r["target"]): (r["hops"], r["path"]) for r in got} == want
