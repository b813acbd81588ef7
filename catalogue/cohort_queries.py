"""The cohort over the derived hospital tables, and SQL that computes it the long way round.

The SQL keeps one statement per feature family, joins assessments in full and takes distinct counts, where the Spark
plan fuses scans and never builds those products.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import clinical
from catalogue.registry import Tables, query
from wardstone.operators.profile import item_report, items_listed
from wardstone.operators.windowed import windowed_features
from wardstone.plans import cohort as plan, profiling, rulebook as rules
from wardstone.plans.cohort import Options

_AGG = {"max": "max", "min": "min", "avg": "avg", "sum": "sum", "stddev": "stddev_samp"}


def rounded(expression: str, digits: int) -> str:
    """Half away from zero on ten decimals."""
    return f"CAST(round(CAST({expression} AS DECIMAL(30, 10)), {digits}) AS DOUBLE)"


def _members(items) -> str:
    return ", ".join(str(i) for i in items)


def _feature(rule, value: str) -> str:
    tests = [f"e.itemid IN ({_members(rule.items)})"] if rule.items else []
    if rule.window:
        tests.append(f"date_diff('microsecond', s.intime, e.at) BETWEEN 0 AND {rule.window[1]} * 3600000000")
    if rule.valid:
        tests.append(f"e.{value} >= {rule.valid[0]} AND e.{value} <= {rule.valid[1]}")
    if isinstance(rule.where, tuple):
        tests.append(f"e.{value} {rule.where[0]} {rule.where[1]}")
    kept = f"FILTER (WHERE {' AND '.join(tests)})" if tests else ""
    if rule.agg == "any":
        return f"CAST(count(*) {kept} > 0 AS INT) AS {rule.name}"
    if rule.agg == "count":
        return f"NULLIF(count(*) {kept}, 0) AS {rule.name}"
    measured = f"e.{value}"
    if rule.convert:
        measured = f"(CASE e.itemid WHEN {rules.CELSIUS} THEN e.{value} * 9.0 / 5.0 + 32 ELSE e.{value} END)"
    out = f"{_AGG[rule.agg]}({measured}) {kept}"
    return f"{rounded(out, rule.digits) if rule.digits else out} AS {rule.name}"


def family(name: str, table: str, time: str, value: str, features, key: str = "stay_id", where: str = "TRUE") -> str:
    columns = ",\n  ".join(_feature(r, value) for r in features)
    return f"""{name} AS (
  SELECT s.stay_id, {columns}
  FROM icustays s JOIN (SELECT *, {time} AS at FROM {table}) e ON e.{key} = s.{key} WHERE {where} GROUP BY s.stay_id)"""


def _code_test(rule) -> str:
    tests = [f"starts_with(icd_code, '{p}')" for p in rule.prefixes]
    tests += [f"icd_code = '{c}'" for c in rule.codes]
    tests += [f"(icd_code >= '{a}' AND icd_code < '{b}')" for a, b in rule.ranges]
    return " OR ".join(tests)


def answer_class(text: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({text}), 'yes') THEN 'positive' WHEN regexp_matches(lower({text}), 'no') THEN 'negative'
      WHEN regexp_matches(lower({text}), 'unable|language|barrier') THEN 'unable' ELSE 'other' END"""


ASSESSMENTS = f"""answers AS (
  SELECT stay_id, charttime, itemid IN ({_members(rules.CAM_GATE_ITEMS)}) AS gate, {answer_class('value')} AS said
  FROM chartevents WHERE value IS NOT NULL AND itemid IN ({_members(rules.CAM_ITEMS)})),
pairs AS (
  SELECT a.stay_id, a.charttime, a.said, g.said = 'positive' AS hit,
         date_diff('microsecond', s.intime, g.charttime) AS after
  FROM answers a JOIN icustays s USING (stay_id) LEFT JOIN (SELECT * FROM answers WHERE gate) g ON g.stay_id = a.stay_id),
cam AS (
  SELECT stay_id, count(DISTINCT charttime) AS cam_total_assessments,
    count(*) FILTER (WHERE said = 'positive') AS cam_positive_count,
    count(*) FILTER (WHERE said = 'negative') AS cam_negative_count,
    count(*) FILTER (WHERE said = 'unable') AS cam_uta_count,
    CAST(count(*) FILTER (WHERE hit) > 0 AS INT) AS cam_positive,
    CAST(count(*) FILTER (WHERE hit AND after <= 43200000000) > 0 AS INT) AS prevalent_cam_12h,
    CAST(count(*) FILTER (WHERE hit AND after <= 86400000000) > 0 AS INT) AS prevalent_cam_24h,
    CAST(count(*) FILTER (WHERE hit AND after > 43200000000) > 0 AS INT) AS outcome_incident_cam_12h,
    CAST(count(*) FILTER (WHERE hit AND after > 86400000000) > 0 AS INT) AS after_24h,
    min(after) FILTER (WHERE hit) / 3.6e9 AS hours_to_first_cam_positive, 1 AS cam_screened
  FROM pairs GROUP BY stay_id)"""

SEQUENCE = """stays AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS icu_stay_seq,
         count(*) OVER (PARTITION BY subject_id) AS stays_per_patient FROM icustays)"""


def _bands(column: str, op: str, pairs) -> str:
    return " ".join(f"WHEN {column} {op} {cut} THEN {points}" for cut, points in pairs)


def _coded(column: str, classes, default) -> str:
    cases = []
    for c in classes:
        tests = [f"contains({column}, '{p}')" for p in c.contains] + [f"{column} = '{e}'" for e in c.equals]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {c.value}")
    return f"CASE {' '.join(cases)} ELSE {default} END"


def _filled(names, prefix: str) -> str:
    return ", ".join(f"coalesce({prefix}.{n}, 0) AS {n}" for n in names)


FEATURES = ",\n".join([
    SEQUENCE, ASSESSMENTS,
    family("charted", "chartevents", "charttime", "valuenum", rules.CHART_FEATURES),
    family("labs", "labevents", "charttime", "valuenum", rules.LAB_FEATURES, key="hadm_id"),
    family("drugs", "inputevents", "starttime", "amount", rules.MEDICATION_FEATURES),
    family("score_drugs", "inputevents", "starttime", "amount", rules.SCORE_DRUG_FEATURES),
    """volumes_in AS (
  SELECT s.stay_id, coalesce(sum(amount), 0) AS ml FROM inputevents JOIN icustays s USING (stay_id)
  WHERE lower(amountuom) = 'ml' AND starttime >= intime AND starttime <= intime + INTERVAL 24 HOUR GROUP BY s.stay_id)""",
    """volumes_out AS (
  SELECT s.stay_id, coalesce(sum(value), 0) AS ml FROM outputevents JOIN icustays s USING (stay_id)
  WHERE charttime >= intime AND charttime <= intime + INTERVAL 24 HOUR GROUP BY s.stay_id)""",
    f"""urine AS (
  SELECT s.stay_id, sum(value) AS urine_output_24h FROM outputevents JOIN icustays s USING (stay_id)
  WHERE itemid IN ({_members(rules.URINE)}) AND charttime >= intime AND charttime <= intime + INTERVAL 24 HOUR
  GROUP BY s.stay_id)""",
    """fluid AS (
  SELECT coalesce(i.stay_id, o.stay_id) AS stay_id, coalesce(i.ml, 0) AS fluid_input_24h,
         coalesce(o.ml, 0) AS fluid_output_24h, coalesce(i.ml, 0) - coalesce(o.ml, 0) AS fluid_balance_24h
  FROM volumes_in i FULL JOIN volumes_out o ON i.stay_id = o.stay_id)""",
    """first_gcs AS (
  SELECT stay_id, valuenum AS gcs_first FROM (
    SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY charttime, valuenum) AS nth
    FROM chartevents WHERE itemid = 223901 AND valuenum BETWEEN 3 AND 15) WHERE nth = 1)""",
    f"vents AS (SELECT DISTINCT stay_id, 1 AS mechanical_vent FROM procedureevents WHERE itemid IN ({_members(rules.VENTILATION)}))",
    "codes AS (SELECT s.stay_id, "
    + ", ".join(f"CAST(bool_or({_code_test(r)}) AS INT) AS {r.flag}" for r in rules.CODE_FLAGS)
    + " FROM diagnoses_icd d JOIN icustays s USING (hadm_id) GROUP BY s.stay_id)",
])

_LOW, _HIGH = ((67, 4), (142, 3), (221, 2), (302, 1)), ((12, 4), (6, 3), (2, 2), (1.2, 1))
_STEPS = """
    CASE {resp} ELSE 0 END AS sofa_resp, CASE {coag} ELSE 0 END AS sofa_coag, CASE {liver} ELSE 0 END AS sofa_liver,
    CASE WHEN score_epinephrine + score_norepinephrine > 0 THEN 4 WHEN score_dopamine > 0 THEN 3
         WHEN map_min < 70 THEN 1 ELSE 0 END AS sofa_cardio,
    CASE {cns} ELSE 0 END AS sofa_cns, CASE {renal} {urine} ELSE 0 END AS sofa_renal""".format(
    resp=_bands("spo2_max / NULLIF(fio2_min, 0)", "<", _LOW),
    coag=_bands("platelets_min", "<", ((20, 4), (50, 3), (100, 2), (150, 1))),
    liver=_bands("bilirubin_max", ">=", _HIGH),
    cns=_bands(
        "(CASE WHEN gcs_eye_min IS NULL AND gcs_verbal_min IS NULL AND gcs_motor_min IS NULL THEN NULL ELSE "
        "coalesce(gcs_eye_min, 4) + coalesce(gcs_verbal_min, 5) + coalesce(gcs_motor_min, 6) END)",
        "<", ((6, 4), (10, 3), (13, 2), (15, 1)),
    ),
    renal=_bands("creatinine_max", ">=", ((5, 4), (3.5, 3), (2, 2), (1.2, 1))),
    urine=_bands("urine_output_24h", "<", ((200, 3), (500, 2))),
)


def _threshold(rule) -> str:
    tests = " OR ".join(f"coalesce({c} {op} {cut}, FALSE)" for c, op, cut in rule.tests)
    return f"CAST({tests} AS INT) AS {rule.flag}"


_SIGN = "CASE WHEN {} = 1 THEN '+' ELSE '-' END"
_CAM = [
    "cam_positive", "prevalent_cam_12h", "prevalent_cam_24h", "outcome_incident_cam_12h", "cam_screened",
    "cam_total_assessments", "cam_positive_count", "cam_negative_count", "cam_uta_count",
]
_RASS_FLAGS = ["rass_ever_unarousable", "rass_ever_deeply_sedated", "rass_ever_agitated"]
_OTHER_CHART = [r.name for r in rules.CHART_FEATURES if r.name not in _RASS_FLAGS]
BASE = f"""base AS (
  SELECT s.*, p.anchor_year_group, year(s.intime) AS admission_year,
    CAST(s.icu_stay_seq = 1 AS INT) AS is_first_icu_stay, CAST(s.icu_stay_seq > 1 AS INT) AS prior_icu_stay,
    CAST(coalesce(a.deathtime >= s.intime AND a.deathtime <= s.outtime, FALSE) AS INT) AS mortality_icu,
    CAST(a.deathtime IS NOT NULL AS INT) AS mortality_inhospital,
    CAST(coalesce(p.dod <= a.dischtime + INTERVAL 30 DAY, FALSE) AS INT) AS mortality_30day,
    CAST(coalesce(p.dod <= a.dischtime + INTERVAL 90 DAY, FALSE) AS INT) AS mortality_90day,
    CAST(coalesce(p.dod <= a.dischtime + INTERVAL 1 YEAR, FALSE) AS INT) AS mortality_1year,
    s.los AS icu_los_days, date_diff('microsecond', a.admittime, a.dischtime) / 8.64e10 AS hospital_los_days,
    p.anchor_age + year(s.intime) - p.anchor_year AS age, CAST(p.gender = 'F' AS INT) AS female,
    {_coded('a.race', *rules.RACE)} AS race_coded, {_coded('a.insurance', *rules.INSURANCE)} AS insurance_coded,
    {_coded('a.marital_status', *rules.MARITAL)} AS marital_coded,
    {_coded('a.language', *rules.ENGLISH)} AS english_speaker, {_coded('s.first_careunit', *rules.UNIT_TYPE)} AS icu_type,
    {_coded('a.admission_type', *rules.URGENCY)} AS admission_urgency,
    CAST(hour(s.intime) NOT BETWEEN 6 AND 19 AS INT) AS nighttime_admission
  FROM stays s JOIN patients p USING (subject_id) JOIN admissions a USING (hadm_id))"""
WIDE = f"""wide AS (
  SELECT base.*, {_filled(_CAM, 'cam')}, coalesce(cam.after_24h, 0) AS after_24h, cam.hours_to_first_cam_positive,
    {_filled(_RASS_FLAGS, 'charted')}, {', '.join(f'charted.{n}' for n in _OTHER_CHART)},
    {', '.join(f'labs.{r.name}' for r in rules.LAB_FEATURES)}, {_filled([r.name for r in rules.MEDICATION_FEATURES], 'drugs')},
    {', '.join(f'score_drugs.{r.name}' for r in rules.SCORE_DRUG_FEATURES)}, urine.urine_output_24h,
    fluid.fluid_input_24h, fluid.fluid_output_24h, fluid.fluid_balance_24h, first_gcs.gcs_first,
    coalesce(vents.mechanical_vent, 0) AS mechanical_vent, {_filled([r.flag for r in rules.CODE_FLAGS], 'codes')}
  FROM base LEFT JOIN cam USING (stay_id) LEFT JOIN charted USING (stay_id) LEFT JOIN labs USING (stay_id)
    LEFT JOIN drugs USING (stay_id) LEFT JOIN score_drugs USING (stay_id) LEFT JOIN urine USING (stay_id)
    LEFT JOIN fluid USING (stay_id) LEFT JOIN first_gcs USING (stay_id) LEFT JOIN vents USING (stay_id)
    LEFT JOIN codes USING (stay_id))"""
SCORED = f"""scored AS (
  SELECT *, sofa_resp + sofa_coag + sofa_liver + sofa_cardio + sofa_cns + sofa_renal AS sofa_total
  FROM (SELECT *, {_STEPS} FROM wide)),
final AS (
  SELECT *, cam_positive AS outcome_incident_cam_24h, cam_positive AS outcome_incident_any_24h,
    greatest(delirium_icd, cam_positive) AS delirium_any,
    'ICD' || {_SIGN.format('delirium_icd')} || '/CAM' || {_SIGN.format('cam_positive')} AS concordance_icd_cam,
    'ICD' || {_SIGN.format('delirium_icd')} || '/CAM' || {_SIGN.format('cam_positive')} || '/Dem'
      || {_SIGN.format('dementia_icd')} AS group_2x2x2,
    CASE dementia_icd * 2 + greatest(delirium_icd, cam_positive) WHEN 3 THEN 'Both' WHEN 2 THEN 'Dementia Only'
      WHEN 1 THEN 'Delirium Only' ELSE 'Neither' END AS exposure_group,
    CAST(age >= 65 AS INT) + CAST(age >= 75 AS INT) + CAST(age >= 85 AS INT) AS age_group,
    CASE WHEN gcs_first IS NOT NULL THEN CAST(gcs_first <= 8 AS INT) END AS gcs_severe_admission,
    {', '.join(_threshold(r) for r in rules.THRESHOLDS)},
    CAST(coalesce(fluid_balance_24h > 2000, FALSE) AS INT) AS positive_fluid_balance,
    {', '.join(f"greatest({', '.join(parts)}) AS {name}" for name, parts in rules.COMPOSITES.items())},
    {', '.join(f"{' + '.join(parts)} AS {name}" for name, parts in rules.BURDENS.items())}
  FROM scored)"""

SOURCES = ("patients", "admissions", "icustays", "chartevents", "labevents", "inputevents", "outputevents",
           "procedureevents", "diagnoses_icd")
ALL = f"WITH {clinical.with_clause(*SOURCES)},\n{FEATURES},\n{BASE},\n{WIDE},\n{SCORED}\n"
COHORT_SQL = f"{ALL}SELECT {', '.join(rules.COLUMNS)} FROM final WHERE is_first_icu_stay = 1 AND age >= 18"


@query("cohort_table", COHORT_SQL)
def _cohort(t: Tables):
    return plan.cohort_table(clinical.Derived(t))


DESCRIBED = Options(incident_after=24, fanout="corrected", screened_only=True, drop_prevalent=True)
_KEPT = "stay_id, subject_id, outcome_incident_cam_24h, cam_total_assessments, cam_positive_count, cam_negative_count, cam_uta_count, sofa_total, age"


@query(
    "cohort_as_described",
    ALL + """, answered AS (
  SELECT stay_id, count(*) FILTER (WHERE said = 'positive') AS p, count(*) FILTER (WHERE said = 'negative') AS n,
         count(*) FILTER (WHERE said = 'unable') AS u FROM answers GROUP BY stay_id)
SELECT stay_id, subject_id, after_24h AS outcome_incident_cam_24h, cam_total_assessments, p AS cam_positive_count,
       n AS cam_negative_count, u AS cam_uta_count, sofa_total, age
FROM final JOIN answered USING (stay_id)
WHERE is_first_icu_stay = 1 AND age >= 18 AND cam_screened = 1 AND prevalent_cam_24h = 0""",
)
def _cohort_described(t: Tables):
    return plan.cohort_table(clinical.Derived(t), DESCRIBED).select(*_KEPT.split(", "))


@query(
    "cohort_attrition",
    ALL + """, kept AS (
  SELECT count(*) AS a, count(*) FILTER (WHERE cam_screened = 1) AS b,
    count(*) FILTER (WHERE cam_screened = 1 AND prevalent_cam_24h = 0) AS c,
    count(*) FILTER (WHERE cam_screened = 1 AND prevalent_cam_24h = 0 AND icu_stay_seq = 1) AS d,
    count(*) FILTER (WHERE cam_screened = 1 AND prevalent_cam_24h = 0 AND icu_stay_seq = 1 AND age >= 18) AS e
  FROM final)
SELECT 0 AS step_no, 'all stays' AS step, a AS n, 0 AS removed FROM kept
UNION ALL SELECT 1, 'screened', b, a - b FROM kept
UNION ALL SELECT 2, 'not prevalent in 24h', c, b - c FROM kept
UNION ALL SELECT 3, 'first stay', d, c - d FROM kept
UNION ALL SELECT 4, 'adult', e, d - e FROM kept""",
)
def _attrition(t: Tables):
    return plan.cohort_attrition(clinical.Derived(t))


def family_query(name: str, sql: str, build):
    """A feature family on its own."""
    query(name, sql)(lambda t: build(clinical.Derived(t)))


def _with(*names: str) -> str:
    return f"WITH {clinical.with_clause(*names)},\n"


family_query(
    "chart_features",
    _with("icustays", "chartevents")
    + family(
        "charted", "chartevents", "charttime", "valuenum", rules.CHART_FEATURES,
        where=f"e.valuenum IS NOT NULL AND (e.itemid = 228096 OR (e.itemid IN ({_members(sorted({i for r in rules.CHART_FEATURES if r.window for i in r.items}))}) "
        "AND e.at >= s.intime AND e.at <= s.intime + INTERVAL 24 HOUR))",
    )
    + " SELECT * FROM charted",
    plan.chart_features,
)
family_query(
    "lab_features",
    _with("icustays", "labevents")
    + family(
        "labs", "labevents", "charttime", "valuenum", rules.LAB_FEATURES, key="hadm_id",
        where="e.valuenum IS NOT NULL AND e.itemid <> 51000 AND e.at >= s.intime AND e.at <= s.intime + INTERVAL 24 HOUR",
    )
    + " SELECT * FROM labs",
    plan.lab_features,
)
family_query(
    "assessment_features",
    _with("icustays", "chartevents") + ASSESSMENTS + """
SELECT stay_id, cam_positive AS outcome_incident_cam_24h, outcome_incident_cam_12h, cam_positive AS outcome_incident_any_24h,
  cam_positive, prevalent_cam_12h, prevalent_cam_24h, hours_to_first_cam_positive, cam_screened, cam_total_assessments,
  cam_positive_count, cam_negative_count, cam_uta_count FROM cam""",
    lambda d: plan.assessment_features(d).where("cam_screened = 1").drop("gcs_first", "gcs_severe_admission"),
)
family_query(
    "diagnosis_flags",
    _with("icustays", "diagnoses_icd") + "flagged AS (SELECT s.stay_id, "
    + ", ".join(f"CAST(bool_or({_code_test(r)}) AS INT) AS {r.flag}" for r in rules.CODE_FLAGS)
    + " FROM diagnoses_icd d JOIN icustays s USING (hadm_id) GROUP BY s.stay_id) SELECT * FROM flagged WHERE "
    + " + ".join(r.flag for r in rules.CODE_FLAGS) + " > 0",
    plan.diagnosis_features,
)
family_query(
    "medication_flags",
    _with("icustays", "inputevents")
    + family("drugs", "inputevents", "starttime", "amount", rules.MEDICATION_FEATURES,
             where=f"e.itemid IN ({_members(sorted({i for r in rules.MEDICATION_FEATURES for i in r.items}))}) "
                   "AND e.at >= s.intime AND e.at <= s.intime + INTERVAL 24 HOUR")
    + " SELECT * FROM drugs",
    lambda d: windowed_features(
        d["inputevents"], plan.anchors(d).drop("hadm_id"), rules.MEDICATION_FEATURES, on="stay_id", entity="stay_id",
        time="starttime", anchor_time="intime", item="itemid",
    ),
)
family_query(
    "fluid_balance",
    _with("icustays", "inputevents", "outputevents") + """
gone AS (SELECT s.stay_id, CAST(NULL AS DOUBLE) AS i, value AS o FROM outputevents JOIN icustays s USING (stay_id)
         WHERE charttime BETWEEN intime AND intime + INTERVAL 24 HOUR),
come AS (SELECT s.stay_id, amount AS i, CAST(NULL AS DOUBLE) AS o FROM inputevents JOIN icustays s USING (stay_id)
         WHERE amountuom IN ('ml', 'mL') AND starttime BETWEEN intime AND intime + INTERVAL 24 HOUR),
ins AS (SELECT stay_id, sum(i) AS total FROM come GROUP BY stay_id), outs AS (SELECT stay_id, sum(o) AS total FROM gone GROUP BY stay_id)
SELECT coalesce(ins.stay_id, outs.stay_id) AS stay_id, coalesce(ins.total, 0) AS fluid_input_24h,
  coalesce(outs.total, 0) AS fluid_output_24h, coalesce(ins.total, 0) - coalesce(outs.total, 0) AS fluid_balance_24h,
  CAST(coalesce(ins.total, 0) - coalesce(outs.total, 0) > 2000 AS INT) AS positive_fluid_balance
FROM ins FULL JOIN outs ON ins.stay_id = outs.stay_id""",
    lambda d: plan.fluid_balance(d),
)
family_query(
    "organ_failure_scores",
    ALL + "SELECT stay_id, sofa_resp, sofa_coag, sofa_liver, sofa_cardio, sofa_cns, sofa_renal, sofa_total FROM final",
    lambda d: plan.organ_failure_scores(d),
)
family_query(
    "pain_scores",
    _with("icustays", "chartevents") + """
inside AS (SELECT s.stay_id, valuenum FROM chartevents JOIN icustays s USING (stay_id)
  WHERE itemid = 223791 AND valuenum IS NOT NULL AND charttime BETWEEN intime AND intime + INTERVAL 24 HOUR)
SELECT stay_id, max(valuenum) AS pain_max_24h, avg(valuenum) AS pain_mean_24h, CAST(max(valuenum) >= 7 AS INT) AS severe_pain
FROM inside GROUP BY stay_id""",
    lambda d: plan.pain_scores(d),
)
family_query(
    "item_discovery",
    _with("chartevents", "d_items") + """
SELECT i.itemid, i.label, count(*) AS n FROM chartevents c JOIN d_items i ON i.itemid = c.itemid
WHERE lower(i.label) LIKE '%pain%' AND c.valuenum IS NOT NULL GROUP BY ALL ORDER BY n DESC, i.itemid LIMIT 10""",
    lambda d: item_report(
        d["chartevents"], d["d_items"], item="itemid", label="label", pattern="%pain%", where=F.col("valuenum").isNotNull()
    ),
)
family_query(
    "item_labels",
    _with("d_items") + """
SELECT itemid, label FROM d_items WHERE label ILIKE '%rass%' OR label ILIKE '%richmond%' OR itemid IN (220739, 223900, 223901)""",
    lambda d: items_listed(
        d["d_items"], item="itemid", label="label", items=(220739, 223900, 223901), patterns=("%rass%", "%richmond%")
    ),
)
family_query(
    "family_row_counts",
    ALL + f"""
SELECT 'stays' AS tbl, count(*) AS n FROM icustays
UNION ALL SELECT 'assessments', count(*) FROM (SELECT stay_id FROM cam UNION SELECT stay_id FROM first_gcs)
UNION ALL SELECT 'chart', count(DISTINCT stay_id) FROM chartevents JOIN icustays USING (stay_id)
  WHERE valuenum IS NOT NULL AND (itemid = 228096 OR (itemid IN ({_members(sorted({i for r in rules.CHART_FEATURES if r.window for i in r.items}))})
  AND charttime BETWEEN intime AND intime + INTERVAL 24 HOUR))
UNION ALL SELECT 'labs', count(DISTINCT stay_id) FROM labevents JOIN icustays USING (hadm_id)
  WHERE valuenum IS NOT NULL AND itemid <> 51000 AND charttime BETWEEN intime AND intime + INTERVAL 24 HOUR
UNION ALL SELECT 'inputs', count(DISTINCT stay_id) FROM inputevents JOIN icustays USING (stay_id)
  WHERE itemid IN ({_members(rules.NOREPINEPHRINE + rules.DOPAMINE + rules.EPINEPHRINE)})
     OR starttime BETWEEN intime AND intime + INTERVAL 24 HOUR
UNION ALL SELECT 'outputs', count(DISTINCT stay_id) FROM outputevents JOIN icustays USING (stay_id)
  WHERE charttime BETWEEN intime AND intime + INTERVAL 24 HOUR
UNION ALL SELECT 'procedures', count(*) FROM vents
UNION ALL SELECT 'diagnoses', count(*) FROM codes WHERE {' + '.join(r.flag for r in rules.CODE_FLAGS)} > 0""",
    lambda d: plan.sanity_counts(d),
)
_DAY = "BETWEEN intime AND intime + INTERVAL 24 HOUR"
family_query(
    "study_table_counts",
    ALL + f"""
SELECT 'icu_seq' AS tbl, count(*) AS n FROM icustays
UNION ALL SELECT 'cam_assessments', count(*) FROM cam
UNION ALL SELECT 'sofa_components', count(DISTINCT stay_id) FROM icustays
UNION ALL SELECT 'vitals_24h', count(DISTINCT stay_id) FROM chartevents JOIN icustays USING (stay_id)
  WHERE itemid IN ({_members(rules.VITAL_ITEMS)}) AND valuenum IS NOT NULL AND charttime {_DAY}
UNION ALL SELECT 'labs_24h', count(DISTINCT stay_id) FROM labevents JOIN icustays USING (hadm_id) WHERE valuenum IS NOT NULL AND charttime {_DAY}
UNION ALL SELECT 'medications_24h', count(DISTINCT stay_id) FROM inputevents JOIN icustays USING (stay_id) WHERE starttime {_DAY}
UNION ALL SELECT 'fluid_balance_24h', count(*) FROM (
  SELECT stay_id FROM inputevents JOIN icustays USING (stay_id) WHERE amountuom IN ('ml', 'mL') AND starttime {_DAY}
  UNION SELECT stay_id FROM outputevents JOIN icustays USING (stay_id) WHERE charttime {_DAY})
UNION ALL SELECT 'pain_scores_24h', count(DISTINCT stay_id) FROM chartevents JOIN icustays USING (stay_id)
  WHERE itemid = 223791 AND valuenum IS NOT NULL AND charttime {_DAY}""",
    lambda d: plan.study_table_counts(d),
)
family_query(
    "cohort_profile",
    ALL + """, kept AS (SELECT * FROM final WHERE is_first_icu_stay = 1 AND age >= 18)
SELECT 'race_coded' AS column_name, CAST(race_coded AS VARCHAR) AS value, count(*) AS n FROM kept GROUP BY 2""",
    lambda d: profiling.report(plan.cohort_table(d))["race_values"],
)
