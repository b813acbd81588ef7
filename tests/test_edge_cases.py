"""Hand-made rows for the rules that are easy to get wrong."""

from pyspark.sql import functions as F

from wardstone.functions import (
    class_column, died_between, died_within, encode, hours_between, level_band, night_flag, round_half_away,
)
from wardstone.operators.assemble import attrition, require_unique
from wardstone.operators.assessment import assessment_summary, assessment_times
from wardstone.operators.balance import balance
from wardstone.operators.codesets import code_flags
from wardstone.operators.rules import CodeRule, TextClass
from wardstone.operators.scores import ordinal_scores
from wardstone.operators.sequence import entity_sequence
from wardstone.operators.windowed import windowed_features, within_window
from wardstone.plans import rulebook as rules
from wardstone.plans.cohort import score_inputs


def ntz(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_window_is_closed_on_both_ends(spark, ts):
    anchors = ntz(spark, [(1, ts())], "k long, t0 timestamp_ntz")
    events = ntz(spark, [(1, ts(0, -1), 1), (1, ts(), 2), (1, ts(24), 3), (1, ts(24, 1), 4)], "k long, t timestamp_ntz, n int")
    kept = within_window(events, anchors, "k", "t", "t0", 0, 24)
    assert sorted(r.n for r in kept.collect()) == [2, 3]


def test_open_bounds(spark, ts):
    anchors = ntz(spark, [(1, ts())], "k long, t0 timestamp_ntz")
    events = ntz(spark, [(1, ts(12), 1), (1, ts(12, 1), 2)], "k long, t timestamp_ntz, n int")
    assert [r.n for r in within_window(events, anchors, "k", "t", "t0", 12, None, "(]").collect()] == [2]


CHART = "stay_id long, charttime timestamp_ntz, itemid int, value string"


def assess(spark, ts, rows, **options):
    stays = ntz(spark, [(1, ts())], "stay_id long, intime timestamp_ntz")
    times = assessment_times(
        ntz(spark, rows, CHART), entity="stay_id", item="itemid", time="charttime", text="value",
        gate_items=rules.CAM_GATE_ITEMS, all_items=rules.CAM_ITEMS, classes=rules.CAM_CLASSES,
    )
    return assessment_summary(times, stays, entity="stay_id", time="charttime", anchor_time="intime", **options).collect()


def test_positive_at_the_cut_is_prevalent_not_incident(spark, ts):
    row, = assess(spark, ts, [(1, ts(12), 228300, "Yes")])
    assert (row.prevalent_12h, row.incident_12h, row.ever_positive, row.outcome) == (1, 0, 1, 1)
    row, = assess(spark, ts, [(1, ts(12), 228300, "Yes")], incident_after=24)
    assert (row.ever_positive, row.outcome) == (1, 0)


def test_fanout_counts(spark, ts):
    rows = [(1, ts(1), 228300, "Yes"), (1, ts(2), 228337, "Yes"), (1, ts(3), 228302, "No")]
    faithful, = assess(spark, ts, rows)
    corrected, = assess(spark, ts, rows, fanout="corrected")
    assert (faithful.n_positive, faithful.n_negative, faithful.n_assessments) == (4, 2, 3)
    assert (corrected.n_positive, corrected.n_negative, corrected.n_assessments) == (2, 1, 3)


def test_without_gate_rows_counts_stay(spark, ts):
    row, = assess(spark, ts, [(1, ts(1), 228301, "Yes"), (1, ts(1), 228302, None)])
    assert (row.n_positive, row.n_assessments, row.ever_positive, row.hours_to_first_positive) == (1, 1, 0, None)


def test_text_class_order(spark):
    said = ["Yes (Continue)", "No", "Unable to Assess", "Not done", "Language barrier", "abc"]
    df = spark.createDataFrame([(s,) for s in said], "value string")
    out = [r[0] for r in df.select(class_column("value", rules.CAM_CLASSES, "other", fold_case=True)).collect()]
    assert out == ["positive", "negative", "unable", "negative", "unable", "other"]


def test_equal_times_break_on_the_id(spark, ts):
    df = ntz(spark, [(1, 12, ts()), (1, 11, ts())], "p long, s long, t timestamp_ntz")
    assert {r.s: r.seq for r in entity_sequence(df, "p", "t", ["s"]).collect()} == {11: 1, 12: 2}


def test_single_reading_and_units(spark, ts):
    stays = ntz(spark, [(1, ts()), (2, ts())], "stay_id long, intime timestamp_ntz")
    rows = [(1, ts(1), 220045, 80.0), (1, ts(1), 223762, 37.0), (2, ts(1), 223761, 98.6), (2, ts(30), 228096, -4.0)]
    events = ntz(spark, rows, "stay_id long, charttime timestamp_ntz, itemid int, valuenum double")
    out = {
        r.stay_id: r for r in windowed_features(
            events, stays, rules.CHART_FEATURES, on="stay_id", entity="stay_id", time="charttime",
            anchor_time="intime", item="itemid", value="valuenum",
        ).collect()
    }
    assert (out[1].hr_mean, out[1].hr_sd, out[1].temp_f_mean) == (80.0, None, 98.6)
    assert out[2].temp_f_mean == 98.6
    assert (out[2].rass_min, out[2].rass_ever_unarousable, out[2].rass_assessment_count) == (-4.0, 1, 1)
    assert (out[1].rass_ever_unarousable, out[1].rass_assessment_count) == (0, None)


SCORE_INPUTS = (
    "id int, spo2_max double, fio2_min double, platelets_min double, bilirubin_max double, creatinine_max double, "
    "urine_output_24h double, map_min double, gcs_eye_min double, gcs_verbal_min double, gcs_motor_min double, "
    "score_epinephrine int, score_norepinephrine int, score_dopamine int, score_vasopressor int"
)


def scores(spark, **given):
    names = [part.split()[0] for part in SCORE_INPUTS.split(", ")]
    df = spark.createDataFrame([tuple(given.get(n, 0 if n == "id" else None) for n in names)], SCORE_INPUTS)
    return ordinal_scores(score_inputs(df), rules.SCORES, "sofa_total").first()


def test_missing_inputs_score_zero(spark):
    row = scores(spark)
    assert [row[r.name] for r in rules.SCORES] == [0] * 6 and row.sofa_total == 0


def test_score_edges(spark):
    assert scores(spark, spo2_max=98.0, fio2_min=0.0).sofa_resp == 0
    assert scores(spark, spo2_max=98.0, fio2_min=40.0).sofa_resp == 4
    assert [scores(spark, platelets_min=float(p)).sofa_coag for p in (19, 20, 50, 100, 150)] == [4, 3, 2, 1, 0]
    assert [scores(spark, bilirubin_max=b).sofa_liver for b in (1.1, 1.2, 2.0, 6.0, 12.0)] == [0, 1, 2, 3, 4]
    assert scores(spark, creatinine_max=1.5, urine_output_24h=100.0).sofa_renal == 1
    assert scores(spark, urine_output_24h=100.0).sofa_renal == 3
    assert scores(spark, urine_output_24h=200.0).sofa_renal == 2
    # Parts that are missing count as normal: 4 + 5 + 6 without any, one point less from a single part.
    assert [scores(spark, gcs_motor_min=float(m)).sofa_cns for m in (6, 5, 3, 1)] == [0, 1, 2, 2]
    assert scores(spark, score_dopamine=1, score_vasopressor=1, map_min=60.0).sofa_cardio == 3
    assert scores(spark, map_min=69.9).sofa_cardio == 1


def test_one_sided_balance(spark):
    gains = spark.createDataFrame([(1, 2000.0), (2, 2000.5), (4, None)], "k int, v double")
    losses = spark.createDataFrame([(3, 10.0)], "k int, v double")
    out = {r.k: tuple(r)[1:] for r in balance(gains, losses, entity="k", gain="v", loss="v", threshold=2000).collect()}
    assert out == {1: (2000.0, 0.0, 2000.0, 0), 2: (2000.5, 0.0, 2000.5, 1), 3: (0.0, 10.0, -10.0, 0), 4: (0.0, 0.0, 0.0, 0)}


def test_code_range_and_dots(spark):
    codes = ["140", "2399", "240", "14", "C50", "V10"]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, icd_code string")
    cancer = [r for r in rules.COMORBIDITIES if r.flag == "cm_cancer"]
    out = {r.k: r.cm_cancer for r in code_flags(df, cancer, key="k", code="icd_code", only_matches=False).collect()}
    assert [out[i] for i in range(6)] == [1, 1, 0, 0, 1, 0]
    alcohol = [r for r in rules.COMORBIDITIES if r.flag == "cm_alcohol"]
    plain = spark.createDataFrame([(1, "30500")], "k int, icd_code string")
    assert code_flags(plain, alcohol, key="k", code="icd_code").count() == 0
    assert code_flags(plain, alcohol, key="k", code="icd_code", normalise=True).count() == 1


def test_code_version(spark):
    df = spark.createDataFrame([(1, "E8700", 9), (2, "E876", 10)], "k int, code string, v int")
    rule = [CodeRule("x", ("E87",), version=10)]
    assert code_flags(df, rule, key="k", code="code").count() == 2
    assert [r.k for r in code_flags(df, rule, key="k", code="code", version="v").collect()] == [2]


def test_death_timing(spark, ts):
    df = ntz(spark, [(ts(48), ts(0), ts(48), ts(0))], "death timestamp_ntz, a timestamp_ntz, b timestamp_ntz, disch timestamp_ntz")
    assert df.select(died_between(F.col("death"), F.col("a"), F.col("b"))).first()[0] == 1
    days = ntz(spark, [(ts(24 * 30).date(), ts()), (ts(24 * 31).date(), ts()), (None, ts())], "dod date, disch timestamp_ntz")
    assert [r[0] for r in days.select(died_within(F.col("dod"), F.col("disch"), days=30)).collect()] == [1, 0, 0]


def test_night_hours_and_bands(spark, ts):
    df = ntz(spark, [(ts(5 + 59 / 60),), (ts(6),), (ts(19 + 59 / 60),), (ts(20),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(night_flag(F.col("t"))).collect()] == [1, 0, 0, 1]
    ages = spark.createDataFrame([(a,) for a in (64, 65, 74, 75, 84, 85)], "a int")
    assert [r[0] for r in ages.select(level_band(F.col("a"), rules.AGE_CUTS)).collect()] == [0, 1, 1, 2, 2, 3]


def test_lab_counts_for_both_overlapping_stays(spark, ts):
    stays = ntz(spark, [(7, 1, ts()), (7, 2, ts(15))], "hadm_id long, stay_id long, intime timestamp_ntz")
    labs = ntz(spark, [(7, ts(20), 50912, 3.0)], "hadm_id long, charttime timestamp_ntz, itemid int, valuenum double")
    out = windowed_features(
        labs, stays, rules.LAB_FEATURES, on="hadm_id", entity="stay_id", time="charttime", anchor_time="intime",
        item="itemid", value="valuenum",
    )
    assert {r.stay_id: r.creatinine_max for r in out.collect()} == {1: 3.0, 2: 3.0}


def test_half_is_rounded_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (-0.25,), (97.64999999999999,), (None,)], "x double")
    assert [r[0] for r in df.select(round_half_away(F.col("x"), 2)).collect()] == [1.01, -0.25, 97.65, None]
    assert [r[0] for r in df.select(round_half_away(F.col("x"), 1)).collect()] == [1.0, -0.3, 97.7, None]


def test_hours_do_not_depend_on_the_session_zone(spark, ts):
    df = ntz(spark, [(ts(0), ts(24 * 120))], "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(hours_between(F.col("a"), F.col("b"))).first()[0] == 24 * 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_attrition_counts_null_as_not_passed(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, x int")
    rows = attrition(df, {"known": F.col("x") > 0, "big": F.col("x") > 6}).collect()
    assert [(r.step, r.n, r.removed) for r in rows] == [("all", 3, 0), ("known", 2, 1), ("big", 1, 1)]


def test_uniqueness_is_checked(spark):
    import pytest

    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        require_unique(df, "k")
    require_unique(df.distinct(), "k")


def test_quotes_and_backslashes_in_rules(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",)], "x string")
    assert [r[0] for r in df.select(encode("x", (TextClass(1, ("it's",)), TextClass(2, ("\\",))), 0)).collect()] == [1, 2]


def test_fused_rules_equal_one_query_per_rule(spark, base):
    from catalogue import clinical
    from catalogue.registry import Tables
    from wardstone.plans import cohort

    tables = clinical.stored(Tables(spark, base), ["icustays", "chartevents"])
    fused = cohort.chart_features(tables).orderBy("stay_id").collect()
    stays = cohort.anchors(tables).drop("hadm_id")
    for rule in (r for r in rules.CHART_FEATURES if r.name in ("hr_sd", "rass_ever_agitated", "temp_f_mean", "pain_max_24h")):
        alone = windowed_features(
            tables["chartevents"], stays, [rule], on="stay_id", entity="stay_id", time="charttime",
            anchor_time="intime", item="itemid", value="valuenum",
        )
        single = {r.stay_id: r[1] for r in alone.collect()}
        for row in fused:
            assert row[rule.name] == single.get(row.stay_id, 0 if rule.agg == "any" else None)


def test_cohort_invariants(spark, base):
    from catalogue import clinical
    from catalogue.registry import Tables
    from wardstone.plans import cohort

    df = cohort.cohort_table(clinical.stored(Tables(spark, base))).cache()
    assert tuple(df.columns) == rules.COLUMNS and len(df.columns) == 166
    assert df.count() == df.select("stay_id").distinct().count() > 0
    assert df.where("is_first_icu_stay <> 1 OR age < 18").count() == 0
    parts = " + ".join(r.name for r in rules.SCORES)
    assert df.where(f"sofa_total <> {parts}").count() == 0
    assert len(cohort.feature_names(df.columns)) == 127
    assert len(cohort.feature_names(df.columns, rules.SPARSE_REVISED)) == 125
    df.unpersist()
