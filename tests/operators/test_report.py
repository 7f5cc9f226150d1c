import pytest

from tessera.operators import audit, report
from tessera.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def stored(spark, folder, **tables):
    for k, rows in tables.items():
        report.store(spark.createDataFrame(*rows) if isinstance(rows, tuple) else rows, folder, k)


def test_every_section_is_filled_from_queries(spark, tmp_path):
    q = lambda name: QUERIES[name](spark, DATA)
    gap = audit.validator_verdict(spark.createDataFrame([(0.12, 0.3, False)], "gap double, max_share double, has_suspect boolean"))
    stored(
        spark, str(tmp_path), problem=([("panel_forecasting", "panel_forecasting", "y")], "kind string, subtype string, target string"), horizons=q("horizon_steps"), profile=q("column_profile_customer"), missing=q("overall_missingness"),
        shift=q("ks_two_sample"), folds=q("oof_fold_metrics"), skill=q("baseline_skill"), stability=q("fold_stability"), gap=gap, recursion=q("recursion_choice").withColumnRenamed("t", "step"), predictions=q("submission_stats"), round_trip=q("round_trip_audit"),
        risks=([("val has periods inside train",)], "risk string"),
    )
    text = report.build(spark, str(tmp_path), "Run")
    for s in report.SECTIONS:
        assert (f"## {s.capitalize()}" in text) == (s != "features")  # no part of that section was stored
    assert text.startswith("# Run\n\n**FIX: the submission") and "Not stored: families, adversarial, search, importance, cause, suspects." in text
    skill = q("baseline_skill").first()
    assert f"{skill.mae:,.4f}" in text and "c_mktsegment" in text and "The strict error is 12.0 % above the reported one: WARNING." in text
    per_fold = {str(r.fold_id) for r in q("oof_fold_metrics").collect()}
    lines = text.split("### Folds")[1].split("###")[0].split("## ")[0].splitlines()
    assert {x.split("|")[1].strip() for x in lines if x.startswith("| ") and x.split("|")[1].strip().isdigit()} == per_fold


def test_parts_are_checked_and_few_parts_suffice(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown part"):
        report.store(spark.range(1), str(tmp_path), "other")
    with pytest.raises(ValueError, match="lacks"):
        report.store(spark.range(1), str(tmp_path), "risks")
    text = report.build(spark, str(tmp_path), "Nothing yet")
    assert "## Risks" in text and "## Forecast" not in text and "**SUBMIT**" in text
    stored(spark, str(tmp_path), risks=spark.createDataFrame([], "risk string"), predictions=spark.createDataFrame([], "min double, max double, mean double, std double, n_null long, n_negative long"))
    assert "### Predictions" in report.build(spark, str(tmp_path), "Empty")


@pytest.mark.parametrize(
    ("rows", "word"),
    [
        ({}, "SUBMIT"),
        ({"round_trip": {"passed": False}, "gap": {"verdict": "CRITICAL"}}, "FIX"),
        ({"round_trip": {"passed": True}, "gap": {"verdict": "CRITICAL"}}, "REVIEW"),
        ({"gap": {"verdict": "CRITICAL"}, "cause": {"cause": "CV_SCHEME"}}, "SUBMIT:"),
        ({"gap": {"verdict": "CRITICAL", "leakage_two_signal": "CRITICAL"}, "cause": {"cause": "CV_SCHEME"}}, "REVIEW"),
        ({"gap": {"verdict": "WARNING"}}, "SUBMIT WITH"),
        ({"stability": {"verdict": "CV_RISK"}}, "SUBMIT WITH"),
    ],
)
def test_recommendation(rows, word):
    assert report.recommendation(rows).startswith(word)


def test_validator_verdict(spark):
    df = spark.createDataFrame([(0.3, 0.1, False), (0.2, 0.1, False), (0.1, 0.6, False), (0.1, 0.5, True), (None, None, None)], "gap double, max_share double, has_suspect boolean")
    assert [r.verdict for r in audit.validator_verdict(df).collect()] == ["CRITICAL", "WARNING", "WARNING", "CRITICAL", "PASS"]
    assert [r.verdict for r in audit.validator_verdict(df, classification=True).collect()] == ["PASS", "PASS", "WARNING", "CRITICAL", "PASS"]
