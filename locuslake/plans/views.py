"""Genomic views of the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_frag": """SELECT concat('chr', l_linenumber) AS chrom, l_partkey * 100 + l_suppkey * 7 AS st,
  CAST(floor(l_partkey * 100 + l_suppkey * 7 + l_quantity * 5) AS BIGINT) AS en, l_suppkey AS cell, l_returnflag AS sample FROM {lineitem}""",
    "v_ins": """SELECT cell, chrom, pos, count(*) AS n FROM (SELECT cell, chrom, st AS pos FROM {v_frag} UNION ALL SELECT cell, chrom, en - 1 AS pos FROM {v_frag}) x GROUP BY cell, chrom, pos""",
    "v_cov": """SELECT chrom, CAST(floor(pos / 100) AS BIGINT) AS bin, cell AS row_id, CAST(sum(n) AS BIGINT) AS value FROM {v_ins} GROUP BY chrom, CAST(floor(pos / 100) AS BIGINT), cell""",
    "v_peak": """SELECT concat('chr', p_partkey % 7 + 1) AS chrom, p_partkey * 100 AS st, CAST(p_partkey * 100 + p_size * 20 AS BIGINT) AS en, p_partkey AS pid, concat('p', p_partkey) AS name FROM {part}""",
    "v_gene": """SELECT *, CASE WHEN size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM (SELECT concat('chr', p_partkey % 7 + 1) AS chrom, p_partkey * 100 AS st,
  CAST(p_partkey * 100 + p_size * 20 AS BIGINT) AS en, p_size AS size, concat('g', p_partkey, '.', p_size % 3) AS gene_id, p_name AS gene_name, p_partkey AS pk FROM {part}) x""",
    "v_chrom": """SELECT concat('chr', k.x) AS chrom, m.s AS size FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) AS k(x), (SELECT (max(p_partkey) + 1) * 100 + 10000 AS s FROM {part}) m""",
    "v_black": """SELECT concat('chr', p_partkey % 7 + 1) AS chrom, p_partkey * 100 + 30 AS st, p_partkey * 100 + 130 AS en FROM {part} WHERE p_partkey % 11 = 3""",
    "v_members": """SELECT DISTINCT s_suppkey AS row_id, concat('g', s_suppkey % 10) AS pid FROM {supplier}""",
    "v_multi": """SELECT row_id, pid FROM {v_members} UNION ALL SELECT row_id, concat('g', (row_id + 1) % 10) AS pid FROM {v_members}""",
    "v_cells": """SELECT c_custkey AS cell, c_mktsegment AS grp, n_name AS subclass, r_name AS class, c_acctbal AS bal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_counts": """SELECT l_suppkey AS cell, l_partkey AS feature, CAST(sum(l_quantity) AS BIGINT) AS n FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "v_eval": """SELECT l_partkey AS peak, concat('g', l_suppkey % 10) AS pid, CAST(sum(l_quantity) AS DOUBLE) AS ytrue, round(sum(l_extendedprice), 2) / 2000 AS ypred FROM {lineitem} GROUP BY l_partkey, concat('g', l_suppkey % 10)""",
    "v_qtl": """SELECT concat(l_orderkey, '_', l_linenumber, '_', p_partkey, '_', l_suppkey) AS qtl_id, concat('chr', l_linenumber) AS chrom, p_partkey * 100 AS st, CAST(p_partkey * 100 + p_size * 20 AS BIGINT) AS en,
  l_partkey * 100 + l_suppkey * 7 AS pos, substr('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1) AS ref, substr('ACGT', CAST((l_orderkey + 1 + l_suppkey % 3) % 4 + 1 AS INT), 1) AS alt, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, l_quantity AS q
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey AND l_linenumber = p_partkey % 7 + 1 WHERE l_suppkey * 7 < p_size * 20""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in _sources(name)}
    return spark.sql(VIEWS[name], **parts)


def with_views(sql: str) -> str:
    """The SQL with the views it names defined in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _sources(name):
                need(n)
            order.append(name)

    for n in re.findall(r"\bv_\w+", sql):
        need(n)
    defs = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    body = sql.strip()
    if not defs:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(defs)}, {body[15:]}"
    return f"WITH {', '.join(defs)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(defs)} {body}"
