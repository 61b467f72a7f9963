"""Verdicts and paired tests on small inputs."""

from pyspark.sql import functions as F

from oddsloom.operators import diagnostics, logit


def model(kind, coef, cuts, loss):
    return logit.LogitModel(kind, ["a", "b"], [0.0, 0.0], [1.0, 1.0], coef, cuts, 100, loss, 1)


def test_proportional_odds():
    by_cut = [model("binary", [0.5, s], [0.0], 0.6) for s in (0.1, -0.1)]
    out = diagnostics.proportional_odds(model("ordinal", [0.5, 0.1], [0.0, 1.0], 1.0), by_cut, model("multinomial", [[0.5, 0.1], [0.4, 0.2]], [0.0, 0.0], 1.0))
    assert out["unstable"] == ["b"] and out["verdict"] == "violated"


def test_granularity_and_stages(spark):
    fine = spark.createDataFrame([(i, i % 2 == 0, 0.5) for i in range(20)], "id int, correct boolean, log_loss double")
    same = diagnostics.granularity_verdict(fine, fine, ["id"]).first()
    assert same.verdict == "no_cost" and same.n == 20
    coarse = fine.withColumn("log_loss", F.col("log_loss") + 0.06)
    assert diagnostics.granularity_verdict(coarse, fine, ["id"]).first().verdict == "costs_accuracy"
    arms = {r.arm: r.score for r in diagnostics.isolated_stages(fine, fine, coarse.where("id < 10"), ["id"]).collect()}
    assert abs(arms["predicted"] - arms["actual"] - 0.06) < 1e-12


def test_compounding(spark):
    scored = spark.createDataFrame([(str(m), i, 0.4) for m in range(12) for i in range(3)], "match_id string, map_index int, residual double")
    pairs = diagnostics.compounding_pairs(scored)
    assert pairs.count() == 12
    assert diagnostics.compounding_test(pairs, 300, 1).first().p_value < 0.05
