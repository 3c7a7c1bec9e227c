"""A frames view over the ``events`` table, the same in Spark and in DuckDB.

The supplied tables hold no bus traffic; the view derives message time, id,
payload, label, scenario and trace from each event, so every operator can be
checked against SQL over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = """
SELECT event_id AS idx_src, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) AS ts_us, user_id AS can_id,
       CAST(event_id % 9 AS INT) AS dlc,
       upper(substr(md5(CAST(event_id AS STRING)), 1, CAST(2 * (event_id % 9) AS INT))) AS data_hex,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_type AS scenario,
       date_format(ts, 'yyyy-MM-dd') AS source_file, value AS signal1
FROM {events}
"""

#: The same rows as a DuckDB common table expression named ``f``.
DUCK = """f AS (
SELECT event_id AS idx_src, epoch_us(ts) AS ts_us, user_id AS can_id, CAST(event_id % 9 AS INT) AS dlc,
       upper(substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(2 * (event_id % 9) AS INT))) AS data_hex,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_type AS scenario,
       strftime(ts, '%Y-%m-%d') AS source_file, value AS signal1
FROM events)"""

TRAIN_BEFORE = "2024-01-16"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def attack_types(df: DataFrame) -> DataFrame:
    """Two attack types: error and purchase messages are attacks, all others benign."""
    return df.selectExpr("*", "CASE WHEN scenario IN ('error', 'purchase') THEN 1 ELSE 0 END AS attack", "CASE WHEN scenario IN ('error', 'purchase') THEN scenario END AS attack_type")


DUCK_TYPES = DUCK + """, a AS (SELECT *, CASE WHEN scenario IN ('error', 'purchase') THEN 1 ELSE 0 END AS attack,
  CASE WHEN scenario IN ('error', 'purchase') THEN scenario END AS attack_type FROM f)"""
