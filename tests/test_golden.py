"""Golden facts from SURVEY 7.3: popularity ranking at sf0.01."""

from recsmith.plans.ranking_queries import popularity_rank_metrics

from .conftest import SF01


def test_popularity_golden(spark):
    rows = {r["k"]: r for r in popularity_rank_metrics(spark, SF01).collect()}
    assert rows[10]["n"] == 1500
    assert abs(rows[10]["hr"] - 0.006667) < 1e-6 and abs(rows[10]["ndcg"] - 0.002260) < 1e-6
    assert abs(rows[20]["hr"] - 0.015333) < 1e-6 and abs(rows[20]["ndcg"] - 0.004434) < 1e-6
    assert abs(rows[50]["hr"] - 0.031333) < 1e-6 and abs(rows[50]["ndcg"] - 0.007561) < 1e-6
