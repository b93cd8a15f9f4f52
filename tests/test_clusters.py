"""The clusters are searched over the reference's range."""

from quaesitor.operators import stats
from quaesitor.plans import catalogue


def test_k_from_3_to_10(spark, sf, monkeypatch):
    tried = []
    whole = stats.clusters
    monkeypatch.setattr(stats, "clusters", lambda *a, **k: tried.append(out := whole(*a, **k)) or out)
    n = catalogue.queries()["q402_unit_clusters"](spark, sf).select("cluster").distinct().count()
    scores = tried[0][1]
    assert sorted(scores) == list(range(3, 11)) and n == max(scores, key=scores.get)
