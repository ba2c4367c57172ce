"""Domain tables from the star-schema tables, in SQL that Spark and DuckDB both run (integer arithmetic only)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

MUTATIONS = """
SELECT l_orderkey * 10 + l_linenumber AS mut_id, CONCAT('S', CAST(MIN(l_suppkey) % 8 AS STRING)) AS sample,
  CAST(MIN(l_partkey) % 22 + 1 AS STRING) AS chr, (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 + 1 AS pos,
  SUBSTRING('ACGT', CAST(MIN(l_partkey) % 4 AS INT) + 1, 1) AS ref,
  CASE WHEN MIN(l_partkey) % 9 = 0 THEN 'GG' ELSE SUBSTRING('ACGT', CAST((MIN(l_partkey) % 4 + 1 + MIN(l_suppkey) % 3) % 4 AS INT) + 1, 1) END AS alt,
  CAST(SUM(l_quantity) AS INT) % 60 AS alt_counts, CAST(MIN(l_partkey) % 60 AS INT) + 1 AS ref_counts
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

SEGMENTS = """
SELECT CONCAT('S', CAST(a.n_nationkey AS STRING)) AS sample, CAST(b.n_nationkey + 1 AS STRING) AS chr,
  CAST(c.n_nationkey * 50000 + 1 AS BIGINT) AS startpos, CAST((c.n_nationkey + 1) * 50000 AS BIGINT) AS endpos,
  (a.n_nationkey * 31 + b.n_nationkey * 17 + c.n_nationkey * 13) % 5 AS nMajor,
  LEAST((a.n_nationkey * 31 + b.n_nationkey * 17 + c.n_nationkey * 13) % 5, (a.n_nationkey + b.n_nationkey + c.n_nationkey) % 3) AS nMinor,
  CAST((a.n_nationkey * 31 + b.n_nationkey * 17 + c.n_nationkey * 13) % 16 * 25 AS DOUBLE) / 100 AS nAraw,
  CAST((a.n_nationkey * 13 + b.n_nationkey * 29 + c.n_nationkey * 7) % 11 * 20 AS DOUBLE) / 100 AS nBraw,
  CAST(5 + a.n_nationkey % 5 AS DOUBLE) / 10 AS purity, CAST(20 + a.n_nationkey % 4 * 9 AS DOUBLE) / 10 AS ploidy,
  CASE WHEN a.n_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender
FROM {nation} a CROSS JOIN {nation} b CROSS JOIN {nation} c
WHERE a.n_nationkey < 8 AND b.n_nationkey < 22 AND c.n_nationkey < 20 AND (a.n_nationkey * 7 + b.n_nationkey * 3 + c.n_nationkey * 5) % 11 <> 0"""

CYTOBANDS = """
SELECT CONCAT('chr', CAST(n_nationkey + 1 AS STRING)) AS chr, CAST(v.s AS BIGINT) AS start, CAST(v.e AS BIGINT) AS "end", v.name AS name, v.stain AS "gieStain"
FROM {nation} CROSS JOIN (VALUES ('p12', 1, 250000, 'gneg'), ('p11.2', 250001, 400000, 'gpos50'), ('p11.1', 400001, 450000, 'acen'),
  ('q11.1', 450001, 500000, 'acen'), ('q11.2', 500001, 750000, 'gpos25'), ('q12', 750001, 1000000, 'gneg')) AS v(name, s, e, stain)
WHERE n_nationkey < 22"""

LISTS = """
SELECT CAST(l_partkey AS STRING) AS item, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) - SUM(l_quantity) * 0.25E0 AS v1,
  SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) - SUM(l_quantity) * 0.25E0 AS v2
FROM {lineitem} GROUP BY l_partkey"""

EXPRESSION = """
SELECT CAST(l_partkey AS STRING) AS gene, CONCAT('S', CAST(l_suppkey % 10 AS STRING)) AS sample, SUM(l_quantity) AS value
FROM {lineitem} GROUP BY l_partkey, l_suppkey % 10"""

DENSE_EXPRESSION = """
SELECT g.gene, s.sample, COALESCE(v.value, 0E0) AS value
FROM (SELECT CAST(s_suppkey AS STRING) AS gene FROM {supplier}) g CROSS JOIN (SELECT DISTINCT CONCAT('L', CAST(l_linenumber AS STRING)) AS sample FROM {lineitem}) s
LEFT JOIN (SELECT CAST(l_suppkey AS STRING) AS gene, CONCAT('L', CAST(l_linenumber AS STRING)) AS sample, SUM(l_quantity) AS value FROM {lineitem} GROUP BY l_suppkey, l_linenumber) v
  ON v.gene = g.gene AND v.sample = s.sample"""

CELL_TYPES = """
SELECT g.gene, c.cell_type, COALESCE(v.value, 0E0) AS value
FROM (SELECT CAST(s_suppkey AS STRING) AS gene FROM {supplier}) g CROSS JOIN (SELECT DISTINCT CONCAT('c', l_returnflag, l_linestatus) AS cell_type FROM {lineitem}) c
LEFT JOIN (SELECT CAST(l_suppkey AS STRING) AS gene, CONCAT('c', l_returnflag, l_linestatus) AS cell_type, SUM(l_extendedprice) AS value FROM {lineitem} GROUP BY l_suppkey, l_returnflag, l_linestatus) v
  ON v.gene = g.gene AND v.cell_type = c.cell_type"""

GENE_SETS = "SELECT p_brand AS set, CAST(p_partkey AS STRING) AS item FROM {part}"

SEQUENCES = """
SELECT CAST(doc_id AS STRING) AS chr, TRANSLATE(REGEXP_REPLACE(LOWER(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq
FROM {documents} WHERE text IS NOT NULL"""

SNVS = """
SELECT CONCAT('S', CAST(LENGTH(q.chr) % 4 AS STRING)) AS sample, q.chr AS chr, CAST((LENGTH(q.seq) * 31 + k.k * 104729) % LENGTH(q.seq) + 1 AS BIGINT) AS pos,
  SUBSTRING(q.seq, CAST((LENGTH(q.seq) * 31 + k.k * 104729) % LENGTH(q.seq) + 1 AS INT), 1) AS ref,
  CASE WHEN k.k % 5 = 0 THEN 'T' WHEN k.k % 5 = 1 THEN 'G' WHEN k.k % 5 = 2 THEN 'A' ELSE 'C' END AS alt
FROM (""" + SEQUENCES + """) q CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS k(k) WHERE LENGTH(q.seq) > 0"""

REGIONS = """
SELECT q.chr AS chr, CAST(k.k * 104729 % LENGTH(q.seq) + 1 AS BIGINT) AS start,
  CAST(LEAST(k.k * 104729 % LENGTH(q.seq) + 1 + LENGTH(q.seq) % 97 + k.k * 40, LENGTH(q.seq)) AS BIGINT) AS "end"
FROM (""" + SEQUENCES + """) q CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(k) WHERE LENGTH(q.seq) > 0"""

SIGNATURES = """
SELECT CAST(c_nationkey AS STRING) AS signature, o_orderpriority AS context, CAST(COUNT(*) AS DOUBLE) AS weight
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority"""

TARGETS = """
SELECT c_mktsegment AS target, o_orderpriority AS context, CAST(COUNT(*) AS DOUBLE) AS weight
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority"""

HDP_COUNTS = "SELECT CAST(user_id AS STRING) AS sample, event_type AS category, COUNT(*) AS n FROM {events} GROUP BY user_id, event_type"

HDP_EXPOSURES = """
SELECT CAST(user_id AS STRING) AS sample, CAST(event_id % 4 AS STRING) AS signature, CAST(COUNT(*) AS DOUBLE) / 16 AS value
FROM {events} GROUP BY user_id, event_id % 4"""

HDP_SIGNATURES = "SELECT CAST(event_id % 4 AS STRING) AS signature, event_type AS category, CAST(COUNT(*) AS DOUBLE) / 1024 AS value FROM {events} GROUP BY event_id % 4, event_type"

BASES = """
SELECT CAST(l_suppkey % 6 AS STRING) AS study, CAST(2 + l_linenumber % 3 AS INT) AS rank_idx, CAST(l_quantity AS INT) % (2 + l_linenumber % 3) AS factor_idx,
  CONCAT('g', CAST(l_partkey % 60 AS STRING)) AS gene, SUM(l_quantity) + l_partkey % 60 / 128E0 AS coef
FROM {lineitem} GROUP BY l_suppkey % 6, 2 + l_linenumber % 3, CAST(l_quantity AS INT) % (2 + l_linenumber % 3), l_partkey % 60"""

TURNS = "SELECT conv_id * 100 + turn AS turn_no, role, CAST(LENGTH(text) AS INT) AS size, text AS peptide, CAST(conv_id AS STRING) AS source FROM {conversations}"


def duck(sql: str) -> str:
    """``sql`` for DuckDB: plain table names."""
    sql = sql.replace("{g}", ", 'g'")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` for Spark over the parquet tables of ``sf_dir``."""
    sql = sql.replace("{g}", "")
    sql = re.sub(r'"(\w+)"', r"`\1`", sql)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)
