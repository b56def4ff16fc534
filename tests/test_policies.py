"""Hand-computed winners of the policies, and errors of objective sets."""

from __future__ import annotations

import pytest

from tidemark.operators.policies import ObjectiveSet, ParetoMaxMinStrategy, ParetoUtopiaPolicy, WeightedSumPolicy
from tidemark.operators.scores import CorrelationFidelity, DiversityReward, WassersteinFidelity


def table(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["combo_id", "label", *names])


def test_weighted_sum(spark):
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "d": (1.0, DiversityReward())})
    scores = table(spark, [("a,b", 0.5, 0.3), ("c,d", 0.1, 0.8), ("e,f", 0.9, 0.1)], ["wasserstein", "diversity"])
    assert WeightedSumPolicy().select_best(scores, objectives).first()["label"] == "c,d"
    with pytest.raises(ValueError):
        WeightedSumPolicy({"unknown": 1.0}).rank_all(scores, objectives)


def test_pareto(spark):
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (1.0, CorrelationFidelity())})
    scores = table(spark, [("a,b", 0.1, 0.9), ("c,d", 0.5, 0.1), ("e,f", 0.9, 0.5), ("g,h", 0.3, 0.3)], ["wasserstein", "correlation"])
    ranked = {r["label"]: r for r in ParetoUtopiaPolicy().rank_all(scores, objectives).collect()}
    assert [k for k, r in sorted(ranked.items()) if r["pareto_mask"]] == ["a,b", "c,d", "g,h"]
    assert ParetoMaxMinStrategy().select_best(scores, objectives).first()["label"] == "g,h"


def test_objective_errors():
    with pytest.raises(ValueError):
        ObjectiveSet({"w": (-1.0, WassersteinFidelity())})
    with pytest.raises(ValueError):
        ObjectiveSet({"a": (1.0, WassersteinFidelity()), "b": (1.0, WassersteinFidelity())})
