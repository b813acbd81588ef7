"""The clinical rule tables of the delirium cohort. Data only; the operators give it meaning.

FIXED VALUES: item ids, codes, cut points, text patterns and output names below are part of the result's definition.
"""

from __future__ import annotations

from wardstone.operators.rules import CodeRule, FeatureRule, OrdinalRule, TextClass, ThresholdRule

DAY_ONE = (0, 24)

# --- fixed values: bedside delirium assessment ------------------------------------------------------------------------
CAM_GATE_ITEMS = (228300, 228337, 229326)
CAM_ITEMS = (228300, 228301, 228302, 228303, 228334, 228335, 228336, 228337, 229324, 229325, 229326)
CAM_CLASSES = (
    TextClass("positive", contains=("yes",)),
    TextClass("negative", contains=("no",)),
    TextClass("unable", contains=("unable", "language", "barrier")),
)

# --- fixed values: chart items ----------------------------------------------------------------------------------------
RASS, GCS_FIRST, PAIN, FIO2 = (228096,), (223901,), (223791,), (223835,)
GCS_RANGE = (3, 15)
HEART_RATE, SYSTOLIC, MEAN_PRESSURE = (220045,), (220050, 220179), (220052, 220181, 225312)
SPO2, RESP_RATE, TEMPERATURE, CELSIUS = (220277,), (220210,), (223761, 223762), 223762
GCS_PARTS = (("gcs_eye_min", (220739,), 4), ("gcs_verbal_min", (223900,), 5), ("gcs_motor_min", (223901,), 6))


TO_FAHRENHEIT = "{v} * 9.0D / 5.0D + 32"


_RASS = {"items": RASS, "valid": (-5, 4)}
_DAY = {"window": DAY_ONE}
CHART_FEATURES = (
    FeatureRule("rass_mean", "avg", digits=2, **_RASS),
    FeatureRule("rass_min", "min", **_RASS),
    FeatureRule("rass_max", "max", **_RASS),
    FeatureRule("rass_ever_unarousable", "any", where=("<=", -4), **_RASS),
    FeatureRule("rass_ever_deeply_sedated", "any", where=("<=", -3), **_RASS),
    FeatureRule("rass_ever_agitated", "any", where=(">=", 1), **_RASS),
    FeatureRule("rass_assessment_count", "count", none_if_empty=True, **_RASS),
    FeatureRule("hr_mean", "avg", HEART_RATE, digits=1, **_DAY),
    FeatureRule("hr_max", "max", HEART_RATE, **_DAY),
    FeatureRule("hr_min", "min", HEART_RATE, **_DAY),
    FeatureRule("hr_sd", "stddev", HEART_RATE, digits=2, **_DAY),
    FeatureRule("sbp_mean", "avg", SYSTOLIC, digits=1, **_DAY),
    FeatureRule("sbp_min", "min", SYSTOLIC, **_DAY),
    FeatureRule("sbp_max", "max", SYSTOLIC, **_DAY),
    FeatureRule("map_mean", "avg", MEAN_PRESSURE, digits=1, **_DAY),
    FeatureRule("map_min", "min", MEAN_PRESSURE, **_DAY),
    FeatureRule("spo2_mean", "avg", SPO2, digits=1, **_DAY),
    FeatureRule("spo2_min", "min", SPO2, **_DAY),
    FeatureRule("spo2_max", "max", SPO2, **_DAY),
    FeatureRule("rr_mean", "avg", RESP_RATE, digits=1, **_DAY),
    FeatureRule("rr_max", "max", RESP_RATE, **_DAY),
    FeatureRule("temp_f_mean", "avg", TEMPERATURE, digits=1, convert={CELSIUS: TO_FAHRENHEIT}, **_DAY),
    FeatureRule("temp_f_max", "max", TEMPERATURE, convert={CELSIUS: TO_FAHRENHEIT}, **_DAY),
    FeatureRule("fio2_min", "min", FIO2, **_DAY),
    *[FeatureRule(name, "min", items, **_DAY) for name, items, _ in GCS_PARTS],
    FeatureRule("pain_max_24h", "max", PAIN, **_DAY),
    FeatureRule("pain_mean_24h", "avg", PAIN, **_DAY),
)

# --- fixed values: laboratory items (feature, item, aggregate) --------------------------------------------------------
LAB_FEATURES = tuple(
    FeatureRule(f"{name}_{agg}", agg, (item,), **_DAY)
    for name, item, aggs in (
        ("creatinine", 50912, ("max",)),
        ("bun", 51006, ("max",)),
        ("sodium", 50983, ("min", "max")),
        ("potassium", 50971, ("min", "max")),
        ("chloride", 50902, ("min",)),
        ("calcium", 50893, ("min", "max")),
        ("glucose", 50931, ("min", "max")),
        ("wbc", 51301, ("max",)),
        ("hemoglobin", 51222, ("min",)),
        ("platelets", 51265, ("min",)),
        ("hematocrit", 51221, ("min",)),
        ("bilirubin", 50885, ("max",)),
        ("alt", 50861, ("max",)),
        ("ast", 50878, ("max",)),
        ("albumin", 50862, ("min",)),
        ("inr", 51237, ("max",)),
        ("lactate", 50813, ("max",)),
    )
    for agg in aggs
)

# --- fixed values: infusions, outputs, procedures ---------------------------------------------------------------------
NOREPINEPHRINE, DOPAMINE, EPINEPHRINE = (221906, 229617), (221662,), (221289,)
VASOPRESSIN, PHENYLEPHRINE = (222315,), (221749,)
SEDATIVES = {
    "midazolam": 221668, "lorazepam": 225972, "propofol": 222168, "dexmedetomidine": 225942, "fentanyl": 221744,
    "hydromorphone": 221833, "morphine": 225154,
}
ANTIPSYCHOTICS = {"haloperidol": 225829, "quetiapine": 225146}
MEDICATION_FEATURES = (
    FeatureRule("norepinephrine", "any", NOREPINEPHRINE, **_DAY),
    FeatureRule("dopamine", "any", DOPAMINE, **_DAY),
    FeatureRule("epinephrine", "any", EPINEPHRINE, **_DAY),
    FeatureRule("vasopressin", "any", VASOPRESSIN, **_DAY),
    FeatureRule("phenylephrine", "any", PHENYLEPHRINE, **_DAY),
    FeatureRule(
        "vasopressor_any", "any", NOREPINEPHRINE + DOPAMINE + EPINEPHRINE + VASOPRESSIN + PHENYLEPHRINE, **_DAY
    ),
    *[FeatureRule(name, "any", (item,), **_DAY) for name, item in SEDATIVES.items()],
    FeatureRule("sedative_any", "any", tuple(SEDATIVES.values()), **_DAY),
    *[FeatureRule(name, "any", (item,), **_DAY) for name, item in ANTIPSYCHOTICS.items()],
)
SCORE_DRUG_FEATURES = (
    FeatureRule("score_epinephrine", "any", EPINEPHRINE),
    FeatureRule("score_norepinephrine", "any", NOREPINEPHRINE),
    FeatureRule("score_dopamine", "any", DOPAMINE),
    FeatureRule("score_vasopressor", "any", NOREPINEPHRINE + DOPAMINE + EPINEPHRINE),
)
VOLUME_UNITS = ("ml", "mL")
URINE = (226559, 226560, 226561, 226584, 226563, 226564, 226565)
VENTILATION = (225792, 225794)
HIGH_BALANCE_ML = 2000

# --- fixed values: diagnosis code sets --------------------------------------------------------------------------------
DELIRIUM = CodeRule(
    "delirium_icd",
    prefixes=("F05",),
    codes=(
        "F10121", "F10221", "F10231", "F10131", "F10921",
        "F11121", "F11221", "F11921",
        "F12121", "F12221", "F12921",
        "F13121", "F13221", "F13231", "F13131", "F13921",
        "F14121", "F14221", "F14921",
        "F15121", "F15221", "F15921",
        "F16121", "F16221", "F16921",
        "F18121", "F18221", "F18921",
        "F19121", "F19221", "F19231", "F19131", "F19921",
        "F10931", "F13931", "F19931",
        "2930", "2931", "29381", "29389", "29390",
        "2910", "29011", "29012", "29013",
        "29200", "29211", "29212", "29281", "29282",
    ),
)
DEMENTIA = (
    CodeRule(
        "dementia_icd",
        prefixes=("F00", "F01", "F02", "F03", "G30", "G31"),
        codes=(
            "2900", "29010", "29011", "29012", "29013", "29020", "29021", "2903",
            "29040", "29041", "29042", "29043", "2941", "3310", "3311", "3312",
        ),
    ),
    CodeRule("dementia_alzheimers", prefixes=("G30", "F00"), codes=("3310",)),
    CodeRule("dementia_vascular", prefixes=("F01",), codes=("29040", "29041", "29042", "29043")),
)
COMORBIDITIES = (
    CodeRule("cm_chf", ("I50", "428")),
    CodeRule("cm_afib", ("I48", "4273")),
    CodeRule("cm_hypertension", ("I10", "I11", "401", "402")),
    CodeRule("cm_diabetes", ("E10", "E11", "250")),
    CodeRule("cm_ckd", ("N18", "585")),
    CodeRule("cm_copd", ("J44", "496", "491", "492")),
    CodeRule("cm_liver", ("K70", "K74", "571")),
    CodeRule("cm_alcohol", ("F10", "303", "305.0")),
    CodeRule("cm_depression", ("F32", "F33", "296", "311")),
    CodeRule("cm_stroke", ("I63", "I64", "434", "436")),
    CodeRule("cm_sepsis", ("A41", "R65", "995.91", "995.92")),
    CodeRule("cm_cancer", ("C",), ranges=(("140", "240"),)),
    CodeRule("cm_epilepsy", ("G40", "345")),
    CodeRule("cm_parkinsons", ("G20", "332")),
    CodeRule("cm_schizophrenia", ("F20", "295")),
    CodeRule("cm_cad", ("I25", "414")),
    CodeRule("cm_bipolar", ("F31",)),
    CodeRule("cm_anxiety", ("F41", "300")),
    CodeRule("cm_electrolyte_disorder", ("E87", "276")),
    CodeRule("cm_anemia", ("D50", "D64", "280", "285")),
    CodeRule("cm_malnutrition", ("E40", "E41", "E42", "E43", "E44", "263", "264", "265")),
)
CODE_FLAGS = (DELIRIUM, *DEMENTIA, *COMORBIDITIES)

# --- fixed values: organ failure score --------------------------------------------------------------------------------
def _steps(column, op, *cut_points):
    return tuple((column, op, cut, points) for cut, points in cut_points)


SCORES = (
    OrdinalRule("sofa_resp", _steps("oxygen_ratio", "<", (67, 4), (142, 3), (221, 2), (302, 1))),
    OrdinalRule("sofa_coag", _steps("platelets_min", "<", (20, 4), (50, 3), (100, 2), (150, 1))),
    OrdinalRule("sofa_liver", _steps("bilirubin_max", ">=", (12, 4), (6, 3), (2, 2), (1.2, 1))),
    OrdinalRule(
        "sofa_cardio",
        (
            ("score_epinephrine", "=", 1, 4), ("score_norepinephrine", "=", 1, 4), ("score_dopamine", "=", 1, 3),
            ("score_vasopressor", "=", 1, 2),  # never reached: the three drugs above are all there are
            ("map_min", "<", 70, 1),
        ),
    ),
    OrdinalRule("sofa_cns", _steps("gcs_min", "<", (6, 4), (10, 3), (13, 2), (15, 1))),
    OrdinalRule(
        "sofa_renal",
        _steps("creatinine_max", ">=", (5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1))
        + _steps("urine_output_24h", "<", (200, 3), (500, 2)),
    ),
)

# --- fixed values: threshold flags ------------------------------------------------------------------------------------
THRESHOLDS = (
    ThresholdRule("sofa_severe", (("sofa_total", ">=", 8),)),
    ThresholdRule("tachycardia", (("hr_max", ">", 100),)),
    ThresholdRule("bradycardia", (("hr_min", "<", 60),)),
    ThresholdRule("hypotension", (("sbp_min", "<", 90),)),
    ThresholdRule("fever", (("temp_f_max", ">", 100.4),)),
    ThresholdRule("hypoxia", (("spo2_min", "<", 90),)),
    ThresholdRule("aki_flag", (("creatinine_max", ">", 1.5),)),
    ThresholdRule("dysnatremia", (("sodium_min", "<", 135), ("sodium_max", ">", 145))),
    ThresholdRule("dyskalemia", (("potassium_min", "<", 3.5), ("potassium_max", ">", 5.0))),
    ThresholdRule("hyperglycemia", (("glucose_max", ">", 200),)),
    ThresholdRule("hypoglycemia", (("glucose_min", "<", 70),)),
    ThresholdRule("leukocytosis", (("wbc_max", ">", 12),)),
    ThresholdRule("severe_anemia", (("hemoglobin_min", "<", 7),)),
    ThresholdRule("thrombocytopenia", (("platelets_min", "<", 100),)),
    ThresholdRule("hypoalbuminemia", (("albumin_min", "<", 2.5),)),
    ThresholdRule("coagulopathy", (("inr_max", ">", 1.5),)),
    ThresholdRule("hyperlactatemia", (("lactate_max", ">", 2.0),)),
    ThresholdRule("severe_pain", (("pain_max_24h", ">=", 7),)),
)
GCS_SEVERE = 8

# --- fixed values: text encoders --------------------------------------------------------------------------------------
RACE = (
    (TextClass(1, ("WHITE",)), TextClass(2, ("BLACK",)), TextClass(3, ("HISPANIC",)), TextClass(4, ("ASIAN",))), 5,
)
INSURANCE = ((TextClass(1, ("Medicare",)), TextClass(2, ("Medicaid",)), TextClass(3, equals=("Other",))), 4)
MARITAL = (
    tuple(TextClass(i, equals=(word,)) for i, word in enumerate(("MARRIED", "SINGLE", "DIVORCED", "WIDOWED"), 1)), 5,
)
ENGLISH = ((TextClass(1, equals=("ENGLISH",)),), 0)
FEMALE = ((TextClass(1, equals=("F",)),), 0)
UNIT_TYPE = (
    (
        TextClass(1, ("MICU",)), TextClass(2, ("SICU", "Surg")), TextClass(3, ("CVICU", "CCU", "Coronary")),
        TextClass(4, ("Neuro",)),
    ),
    5,
)
URGENCY = ((TextClass(1, ("EMERGENCY", "URGENT")), TextClass(2, ("ELECTIVE",))), 3)

# --- fixed values: composites and cohort ------------------------------------------------------------------------------
AGE_CUTS = (65, 75, 85)
ADULT_AGE = 18
COMPOSITES = {
    "antipsychotic_any": ("haloperidol", "quetiapine"),
    "benzodiazepine_any": ("midazolam", "lorazepam"),
    "opioid_any": ("fentanyl", "hydromorphone", "morphine"),
}
BURDENS = {
    "comorbidity_count": tuple(r.flag for r in COMORBIDITIES),
    "psychiatric_burden": ("cm_depression", "cm_bipolar", "cm_anxiety", "cm_schizophrenia", "cm_alcohol"),
    "neurologic_burden": ("cm_stroke", "cm_epilepsy", "cm_parkinsons", "dementia_icd"),
}

# --- fixed values: the columns of the analytic table, by family -------------------------------------------------------
COLUMN_FAMILIES = {
    "identifiers": """subject_id hadm_id stay_id icu_stay_seq is_first_icu_stay admission_year stays_per_patient""",
    "outcomes": """outcome_incident_cam_24h outcome_incident_cam_12h outcome_incident_any_24h""",
    "status": """delirium_any delirium_icd cam_positive concordance_icd_cam group_2x2x2 exposure_group
        hours_to_first_cam_positive prevalent_cam_12h prevalent_cam_24h""",
    "mortality": """mortality_icu mortality_inhospital mortality_30day mortality_90day mortality_1year icu_los_days
        hospital_los_days""",
    "demographics": """age age_group female race_coded insurance_coded marital_coded english_speaker""",
    "admission": """icu_type admission_urgency prior_icu_stay""",
    "severity": """sofa_total sofa_resp sofa_coag sofa_liver sofa_cardio sofa_cns sofa_renal sofa_severe""",
    "first_gcs": """gcs_first gcs_severe_admission""",
    "vitals": """hr_mean hr_max hr_min hr_sd sbp_mean sbp_min sbp_max map_mean map_min spo2_mean spo2_min rr_mean
        rr_max temp_f_mean temp_f_max tachycardia bradycardia hypotension fever hypoxia""",
    "labs": """creatinine_max bun_max aki_flag sodium_min sodium_max potassium_min potassium_max chloride_min
        calcium_max calcium_min dysnatremia dyskalemia glucose_min glucose_max hyperglycemia hypoglycemia wbc_max
        hemoglobin_min platelets_min hematocrit_min leukocytosis severe_anemia thrombocytopenia bilirubin_max alt_max
        ast_max albumin_min hypoalbuminemia inr_max coagulopathy lactate_max hyperlactatemia""",
    "sedation": """rass_mean rass_min rass_max rass_ever_unarousable rass_ever_deeply_sedated rass_ever_agitated
        rass_assessment_count""",
    "treatment": """mechanical_vent vasopressor_any norepinephrine dopamine epinephrine vasopressin phenylephrine
        sedative_any propofol dexmedetomidine fentanyl midazolam lorazepam hydromorphone morphine haloperidol
        quetiapine antipsychotic_any benzodiazepine_any opioid_any""",
    "dementia": """dementia_icd dementia_alzheimers dementia_vascular""",
    "comorbidity": " ".join(BURDENS["comorbidity_count"]) + " comorbidity_count psychiatric_burden neurologic_burden",
    "assessment": """cam_screened cam_total_assessments cam_positive_count cam_negative_count cam_uta_count""",
    "first_day": """nighttime_admission fluid_input_24h fluid_output_24h fluid_balance_24h positive_fluid_balance
        pain_max_24h pain_mean_24h severe_pain""",
    "period": "anchor_year_group",
}
COLUMNS = tuple(name for names in COLUMN_FAMILIES.values() for name in names.split())

# --- fixed values: what is not a feature ------------------------------------------------------------------------------
TARGET = "outcome_incident_cam_24h"
NOT_FEATURES = tuple(
    name for family in ("identifiers", "outcomes", "status", "mortality", "assessment")
    for name in COLUMN_FAMILIES[family].split()
)
LEAKAGE = ("rass_assessment_count", "antipsychotic_any", "haloperidol", "quetiapine")
SPARSE = ("albumin_min", "bilirubin_max", "alt_max")
SPARSE_REVISED = SPARSE + ("ast_max", "lactate_max")
NON_NUMERIC = ("anchor_year_group",)
MIN_SUBGROUP_EVENTS = 10
LAST_TRAIN_YEAR = 2018

# --- fixed values: digits of published results ------------------------------------------------------------------------
PUBLISHED_DIGITS = {
    "auroc": 3, "pr_auc": 3, "cv_auroc_mean": 3, "cv_auroc_sd": 3, "ci_95_lo": 3, "ci_95_hi": 3, "brier": 4,
    "boosted_auroc": 3, "boosted_ap": 3, "lr_auroc": 3, "lr_ap": 3, "prevalence_pct": 1, "pct_missing": 1,
}

# Items that make a stay part of the vitals table: fixed values.
VITAL_ITEMS = (220045, 220050, 220179, 220052, 220181, 225312, 220277, 220210, 223761, 223762)
