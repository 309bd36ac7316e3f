"""Inputs that queries and oracles derive from the supplied tables by the same projection.

A fixture is SQL that both engines read: double literals are written with an exponent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

CLINICAL = """SELECT c_custkey AS id, (18 + c_custkey % 28) * 1e0 AS age, (45 + (c_custkey * 7) % 76) * 1e0 AS weight,
  1.5e0 + ((c_custkey * 3) % 41) / 100e0 AS height, (90 + (c_custkey * 11) % 91) * 1e0 AS systolic,
  (60 + (c_custkey * 5) % 61) * 1e0 AS diastolic, (70 + (c_custkey * 13) % 111) * 1e0 AS glucose,
  (10 + c_custkey % 33) * 1e0 AS gestational_age, 8e0 + (c_custkey % 15) / 2e0 AS hemoglobin,
  (c_custkey % 6) * 1e0 AS pregnancies, (c_custkey % 4) * 1e0 AS risk_factors FROM customer"""

_GAP = "(l_partkey * 7 + l_linenumber) % 11 = 0"
TAB_NULLS = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN {_GAP} THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN {_GAP} THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN {_GAP} THEN NULL ELSE l_discount + 0e0 END AS discount FROM lineitem"""

SERIES = """SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events"""
SERIES_NULLS = """SELECT user_id AS series_id, event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events"""
SCORES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey % 101) / 100e0 END AS tabular,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey * 7 % 101) / 100e0 END AS temporal,
  CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE (c_custkey * 13 % 101) / 100e0 END AS image,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey * 29 % 101) / 100e0 END AS text FROM customer"""

#: The sum is one of floats, as in the SQL, also over vectors of doubles: a sum of doubles (which an integer literal gives, too) rounds some pixels down.
#: Spark's floor gives a long, which NaN, infinities and values beyond it don't fit: those, whole as they are, stay.
_LEVELS = "transform(embedding, e -> CAST(CAST(e AS float) + CAST(1 AS float) AS double) * 127.5e0)"
GRIDS_SPARK = f"SELECT vec_id AS image_id, 1 AS channels, 8 AS height, 8 AS width, transform({_LEVELS}, v -> CASE WHEN abs(v) < 9e15 THEN CAST(floor(v) AS double) ELSE v END) AS pixels FROM embeddings"
GRIDS_DUCK = "SELECT vec_id AS image_id, list_transform(embedding, lambda e: floor((e::FLOAT + 1::FLOAT)::DOUBLE * 127.5e0)::DOUBLE) AS pixels FROM embeddings"

NOTES = (
    (0, "BP 150/95, HR 88. Taking labetalol; headache and swelling noted."),
    (1, "Hx of UTI, now taking rx amoxicillin. No pain."),
    (2, "Preeclampsia ruled out; nausea + vomiting since Monday (n/v)."),
    (3, "FHR 140 bpm, GA 32 wks; bleeding, bleeding again."),
    (4, "blood 118/76 measured at home"),
    (5, "Gestational_diabetes follow-up: glucose > 126 mg/dl"),
    (6, "é à q"),
    (7, ""),
    (8, "medication"),
)
NOTES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in NOTES) + ") AS n(note_id, text)"

_TABLES = ("customer", "lineitem", "events", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a fixture's SQL over the tables in ``sf_dir``; views have names of their own for each folder."""
    for name in _TABLES:
        if f" FROM {name}" in sql or f"\nFROM {name}" in sql:
            return spark.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=table(spark, sf_dir, name))
    return spark.sql(sql)


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTES), "note_id int, text string")
