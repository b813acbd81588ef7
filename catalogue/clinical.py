"""Hospital-shaped tables derived from all rows of the given tables.

One SQL text per table serves Spark and the comparison engine, so that both start from the same rows. Orders become
stays and admissions, customers patients, line items the events. Times are a function of the order key alone, values
are multiples of small powers of two, so sums and means come out the same in any order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from catalogue.registry import Tables
from wardstone.plans import rulebook as rules
from wardstone.session import scratch_path
from wardstone.sources import materialise

START = "2110-01-01 00:00:00"


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which the two engines differ."""

    start: str
    explode: str
    index: str

    def pick(self, number: str, choices) -> str:
        """Choose by ``number`` modulo the number of choices."""
        def quoted(c):
            return "NULL" if c is None else f"'{c}'" if isinstance(c, str) else str(c)

        return self.index.format(items=", ".join(map(quoted, choices)), at=f"CAST(({number}) % {len(choices)} AS INT)")

    def copies(self, n: int) -> str:
        return self.explode.format(n=n, last=n - 1)

    def stay_start(self, key: str) -> str:
        return f"({self.start} + INTERVAL '1' MINUTE * (({key} % 3000) * 1440 + ({key} * 7) % 1440))"

    def event_time(self) -> str:
        return f"{self.stay_start('l_orderkey')} + INTERVAL '1' MINUTE * ((h * 37) % 4320 - 240)"

    def value(self, items) -> str:
        """A plausible value of the picked item, missing in every 13th row."""
        lows, steps = zip(*[_ITEM_RANGES.get(i, (0, 1)) for i in items])
        low, step = (self.pick("h", [_Number(x) for x in xs]) for xs in (lows, steps))
        return f"CASE WHEN (h + l_suppkey) % 13 = 0 THEN NULL ELSE {low} + {step} * CAST(n AS DOUBLE) END"

    def lines(self, copies: int, salt: int) -> str:
        """Each line item as ``copies`` rows with a mixing number ``h`` and a value number ``n``."""
        return f"""
            SELECT *, (h * 7919 + l_suppkey * 31) % 40 AS n FROM (
                SELECT *, l_partkey * {copies} + k + l_linenumber * {131 + salt} + l_orderkey * 17 AS h FROM (
                    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, {self.copies(copies)} AS k
                    FROM lineitem) AS copied) AS mixed"""


class _Number(float):
    """A number spelled as a double in both engines."""

    def __str__(self):
        return f"CAST({float(self)} AS DOUBLE)"


SPARK = Dialect(f"TIMESTAMP_NTZ'{START}'", "explode(sequence(0, {last}))", "array({items})[{at}]")
OTHER = Dialect(f"TIMESTAMP '{START}'", "unnest(range({n}))", "([{items}])[{at} + 1]")

CHART_ITEMS = (
    *rules.CAM_ITEMS, *rules.CAM_GATE_ITEMS, *rules.RASS, *rules.HEART_RATE, *rules.HEART_RATE, *rules.SYSTOLIC,
    *rules.MEAN_PRESSURE, *rules.SPO2, *rules.RESP_RATE, *rules.TEMPERATURE, *rules.FIO2,
    220739, 223900, 223901, *rules.PAIN, 220001, 220002,
)
ANSWERS = ("Yes", "No", "Unable to Assess", "Not done", "YES (Continue)", "Language barrier", "abc", None)
LAB_ITEMS = (*dict.fromkeys(i for r in rules.LAB_FEATURES for i in r.items), 51000)
INPUT_ITEMS = (
    *dict.fromkeys(i for r in rules.MEDICATION_FEATURES for i in r.items), 220949, 225158, 225828, 220862, 225168,
)
OUTPUT_ITEMS = (*rules.URINE, 226588, 226573)
YEAR_GROUPS = ("2008 - 2010", "2011 - 2013", "2014 - 2016", "2017 - 2019", "2020 - 2022")
RACES = ("WHITE", "BLACK/AFRICAN", "HISPANIC/LATINO", "ASIAN - INDIAN", "OTHER", "WHITE - EU", None)
INSURANCES = ("Medicare", "Medicaid", "Other", "Private", "medicare", None)
MARITAL_STATES = ("MARRIED", "SINGLE", "DIVORCED", "WIDOWED", None)
LANGUAGES = ("ENGLISH", "ENGLISH", "SPANISH", None)
ADMISSION_TYPES = ("EW EMERGENCY", "URGENT", "ELECTIVE", "OBSERVATION", "DIRECT EMERGENCY")
UNITS = (
    "Medical (MICU)", "Surgical (SICU)", "Trauma Surgical", "Cardiac (CVICU)", "Coronary Unit", "Neuro Intermediate",
    "Medical/Surgical", "Other", "CCU",
)
AMOUNT_UNITS = ("ml", "mL", "mg", "ml", "units")
ITEM_WORDS = ("CAM-ICU answer", "Richmond-RAS Scale", "Pain Level", "Heart Rate", "cam gate", "RASS goal", "Cuff Pressure")
PROCEDURE_ITEMS = (*rules.VENTILATION, *range(225440, 225452))
CODES = (
    "I501", "4280", "I4891", "42731", "I10", "4019", "E119", "25000", "N186", "5859", "J449", "496", "K7030", "5712",
    "F1020", "30390", "30500", "F329", "2962", "I639", "43491", "A419", "R6520", "99591", "C509", "140", "2399", "240",
    "14", "V1005", "G409", "34590", "G20", "3320", "F209", "29570", "I2510", "41401", "F319", "F419", "30000", "E876",
    "2761", "D509", "2859", "E440", "2639", "F05", "F0500", "F10231", "2930", "29281", "G309", "3310", "F0150", "29040",
    "F0280", "G310", "2941", "Z7902", "Y92230", "V5861", "K219", "53081", "Z87891", "3051", "E785", "2724", "J189",
)

_ITEM_RANGES = {  # lowest value and step per item; anything else is 0, 1, 2 ...
    228096: (-6, 0.25), 220045: (40, 2.5), 220050: (60, 3), 220179: (60, 3), 220052: (45, 2), 220181: (45, 2),
    225312: (45, 2), 220277: (82, 0.5), 220210: (6, 1), 223761: (94, 0.25), 223762: (34, 0.125), 223835: (0, 2.5),
    220739: (1, 0.125), 223900: (1, 0.125), 223901: (1, 0.375), 223791: (0, 0.25), 50912: (0.25, 0.125),
    51006: (5, 2), 50983: (120, 1), 50971: (2, 0.125), 50902: (85, 1), 50893: (6, 0.125), 50931: (40, 8),
    51301: (1, 0.75), 51222: (5, 0.25), 51265: (10, 8), 51221: (15, 1), 50885: (0.25, 0.375), 50861: (5, 8),
    50878: (5, 8), 50862: (1, 0.125), 51237: (0.75, 0.125), 50813: (0.5, 0.125),
}


_STAY_OF_LINE = "l_orderkey * 10 + CASE WHEN l_orderkey % 7 = 0 AND h % 3 = 0 THEN 2 ELSE 1 END"


def texts(d: Dialect) -> dict[str, str]:
    return {
        "patients": f"""
            SELECT c_custkey AS subject_id, {d.pick('c_custkey', ('F', 'M'))} AS gender,
                   CAST(10 + c_custkey % 80 AS INT) AS anchor_age, CAST(2108 + c_custkey % 5 AS INT) AS anchor_year,
                   {d.pick('c_custkey', YEAR_GROUPS)} AS anchor_year_group,
                   CASE WHEN c_custkey % 3 = 0
                        THEN CAST({d.start} + INTERVAL '1' DAY * ((c_custkey * 13) % 4000) AS DATE) END AS dod
            FROM customer""",
        "admissions": f"""
            SELECT hadm_id, admittime, dischtime,
                   CASE WHEN hadm_id % 11 = 0 THEN dischtime - INTERVAL '1' HOUR * ((hadm_id * 3) % 90) END AS deathtime,
                   {d.pick('hadm_id', RACES)} AS race, {d.pick('hadm_id', INSURANCES)} AS insurance,
                   {d.pick('hadm_id', MARITAL_STATES)} AS marital_status, {d.pick('hadm_id', LANGUAGES)} AS language,
                   {d.pick('hadm_id', ADMISSION_TYPES)} AS admission_type
            FROM (
                SELECT hadm_id, admittime,
                       admittime + INTERVAL '1' MINUTE * ((2 + hadm_id % 20) * 1440 + hadm_id % 1000) AS dischtime
                FROM (SELECT o_orderkey AS hadm_id,
                             {d.stay_start('o_orderkey')} - INTERVAL '1' HOUR * (3 + o_orderkey % 48) AS admittime
                      FROM orders) AS entered) AS timed""",
        "icustays": f"""
            SELECT subject_id, hadm_id, stay_id, intime,
                   intime + INTERVAL '1' HOUR * ((1 + hadm_id % 10) * 12) AS outtime,
                   CAST((1 + hadm_id % 10) * 0.5 AS DOUBLE) AS los, {d.pick('stay_id', UNITS)} AS first_careunit
            FROM (
                SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey * 10 + 1 AS stay_id,
                       {d.stay_start('o_orderkey')} AS intime FROM orders
                UNION ALL
                SELECT o_custkey, o_orderkey, o_orderkey * 10 + 2, {d.stay_start('o_orderkey')} + INTERVAL '15' HOUR
                FROM orders WHERE o_orderkey % 7 = 0) AS both_stays""",
        "chartevents": f"""
            SELECT {_STAY_OF_LINE} AS stay_id, {d.event_time()} AS charttime, CAST({d.pick('h', CHART_ITEMS)} AS INT) AS itemid,
                   {d.pick('h * 5 + l_suppkey', ANSWERS)} AS value, {d.value(CHART_ITEMS)} AS valuenum
            FROM ({d.lines(8, 0)}) AS numbered""",
        "labevents": f"""
            SELECT l_orderkey AS hadm_id, {d.event_time()} AS charttime, CAST({d.pick('h', LAB_ITEMS)} AS INT) AS itemid,
                   {d.value(LAB_ITEMS)} AS valuenum
            FROM ({d.lines(4, 2)}) AS numbered""",
        "inputevents": f"""
            SELECT {_STAY_OF_LINE} AS stay_id, {d.event_time()} AS starttime, CAST({d.pick('h', INPUT_ITEMS)} AS INT) AS itemid,
                   CAST(l_quantity * 20 + n AS DOUBLE) AS amount, {d.pick('h * 3 + l_suppkey', AMOUNT_UNITS)} AS amountuom
            FROM ({d.lines(2, 4)}) AS numbered""",
        "outputevents": f"""
            SELECT {_STAY_OF_LINE} AS stay_id, {d.event_time()} AS charttime, CAST({d.pick('h', OUTPUT_ITEMS)} AS INT) AS itemid,
                   CASE WHEN h % 17 = 0 THEN NULL ELSE CAST(l_quantity * 8 + n AS DOUBLE) END AS value
            FROM ({d.lines(2, 6)}) AS numbered""",
        "procedureevents": f"""
            SELECT l_orderkey * 10 + 1 AS stay_id,
                   CAST({d.pick('l_partkey + l_linenumber', PROCEDURE_ITEMS)} AS INT) AS itemid FROM lineitem""",
        "diagnoses_icd": f"""
            SELECT l_orderkey AS hadm_id, {d.pick('l_partkey * 3 + l_linenumber + l_suppkey', CODES)} AS icd_code
            FROM lineitem""",
        "d_items": f"""
            SELECT itemid, concat({d.pick('itemid', ITEM_WORDS)}, ' ', CAST(itemid AS VARCHAR(20))) AS label
            FROM (SELECT DISTINCT CAST({d.pick('p_partkey', CHART_ITEMS)} AS INT) AS itemid FROM part) AS known""",
    }


GIVEN = ("customer", "orders", "lineitem", "part")
NAMES = tuple(texts(SPARK))
STORED = ("diagnoses_icd",)


def derived(tables: Tables, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    text = texts(SPARK)[name]
    for source in GIVEN:
        if f"FROM {source}" in text:
            tables(source).createOrReplaceTempView(f"_given_{source}")
            text = text.replace(f"FROM {source}", f"FROM _given_{source}")
    return tables.spark.sql(text)


class Derived(Mapping):
    """The derived tables as plans over the given ones: a query derives those it asks for, and only the columns and rows
    it reads. Event tables are not written: these copies are many times larger than the given tables. ``STORED`` ones are:
    each code is compared with hundreds of others, which would spell it out as often."""

    def __init__(self, tables: Tables):
        self.tables, self.made = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name not in NAMES:
                raise KeyError(name)
            self.made[name] = stored(self.tables, [name])[name] if name in STORED else derived(self.tables, name)
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)


_written: dict[tuple, DataFrame] = {}


def stored(tables: Tables, names=NAMES) -> dict[str, DataFrame]:
    """The derived tables, written to the shared folder the first time a session asks for them.

    Hospital tables are stored tables: their scans prune columns and push filters, and their sizes are known. For tests
    of that; queries over the given tables use ``Derived``.
    """
    session = tables.spark.sparkContext.applicationId
    for name in names:
        key = (session, tables.base, name)
        if key not in _written:
            _written[key] = materialise(derived(tables, name), scratch_path(tables.spark, name))
    return {name: _written[(session, tables.base, name)] for name in names}


def with_clause(*names: str) -> str:
    """The derived tables as common table expressions of the comparison engine."""
    said = texts(OTHER)
    return ",\n".join(f"{name} AS MATERIALIZED ({said[name]})" for name in names)
