"""The test tables as tables of the domain: SQL that both Spark and DuckDB run.

`{name}` stands for a table. Times are exact multiples of a millisecond, kept as integers until the end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Conversations as files: a turn is a segment of length(text) / 14 seconds, with gaps between 0 and 1.6 s.
SEGMENTS = """
SELECT file_id, pos, speaker, text, (end_ms - len_ms) / 1000.0D AS start, end_ms / 1000.0D AS "end"
FROM (SELECT conv_id AS file_id, turn AS pos, role AS speaker, text, CAST(floor(length(text) * 1000 / 14) AS BIGINT) AS len_ms,
        sum(CAST(floor(length(text) * 1000 / 14) AS BIGINT) + (turn * 7 % 5) * 400) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms
      FROM {conversations}) s
"""

#: Events as words of a file per user: place by time, seconds since the first of January 2024, a score and a label.
WORDS = """
SELECT user_id AS file_id, event_type AS label, value AS score, event_id % 7 = 0 AS unclear, CAST(event_id % 100 AS DOUBLE) / 100 AS prob,
  concat(event_type, CASE WHEN event_id % 9 = 0 THEN '.' ELSE '' END) AS text, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, {seconds} AS start
FROM {events}
"""

#: Line items as graded items: many records for every slice and system.
RECORDS = """
SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_returnflag AS slice, l_linestatus AS system, CASE WHEN l_orderkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
  l_orderkey % 11 = 0 AS empty_ref, CASE WHEN l_orderkey % 29 = 0 THEN 'language' END AS skipped, CASE WHEN l_orderkey % 31 = 0 THEN 'failed' END AS error,
  l_linenumber % 4 AS sub, l_partkey % 3 AS del, l_suppkey % 5 AS ins, CAST(l_quantity AS BIGINT) + 10 AS words, l_partkey % 17 AS char_errors,
  CAST(l_quantity AS BIGINT) * 5 AS chars, l_partkey % 4 AS entities, l_partkey % 2 AS missed, CAST(CAST(l_quantity AS BIGINT) * 2 AS DOUBLE) AS duration,
  CAST(l_linenumber AS DOUBLE) AS seconds, l_extendedprice AS rss
FROM {lineitem}
"""

#: One record for each part of a system: pairs of systems on shared ids.
PAIRED = """
SELECT concat(l_partkey, '-', l_returnflag) AS id, l_returnflag AS slice, l_linestatus AS system, CAST(sum(l_linenumber) AS DOUBLE) / sum(CAST(l_quantity AS BIGINT)) AS wer
FROM {lineitem} GROUP BY 1, 2, 3
"""

#: Documents as items of a corpus.
ITEMS = """
SELECT concat('item-', doc_id) AS id, source AS slice, lang, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split, CAST(floor(length(text) / 14) AS BIGINT) AS duration, text AS reference
FROM {documents}
"""

SPARK = {"seconds": "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) div 1000 - 1704067200000) / 1000.0D", '"end"': "`end`"}
DUCK = {"seconds": "(epoch_us(ts) // 1000 - 1704067200000) / 1000.0::DOUBLE"}
TABLES = re.compile(r"\{(\w+)\}")


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for k, v in SPARK.items():
        sql = sql.replace(k if k.startswith('"') else "{" + k + "}", v)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLES.findall(sql))})


def duck_table(sql: str) -> str:
    """The same as a subquery for DuckDB."""
    for k, v in DUCK.items():
        sql = sql.replace("{" + k + "}", v)
    return f"({TABLES.sub(r'\1', sql.replace('1000.0D', '1000.0::DOUBLE')).strip()})"
