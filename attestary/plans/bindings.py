"""Input tables of the jobs, derived from the given tables. Each is one SELECT that Spark and DuckDB both run, so the
twins of the queries start from the same rows; {name} stands for a given table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Payment types in the order of their numbers, and tiers.
TYPES = ("grant", "prize", "contract", "hiring", "company", "investor_thesis", "none_stated")
TIERS = ("A", "B", "C", "D", "E")

_TYPE = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
_TIER = "CASE {} % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TIERS)) + " END"
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"

BINDINGS: dict[str, str] = {
    # two snapshots of fetched items
    "snapshot_1": """
        SELECT concat('https://', source, '.example.com/d/', doc_id) AS url, source AS source_id, lang AS title, text,
               doc_id % 13 = 0 AS finished, doc_id FROM {documents} WHERE doc_id % 5 <> 0""",
    "snapshot_2": """
        SELECT concat('https://', source, '.example.com/d/', doc_id, '/') AS url, source AS source_id, lang AS title,
               CASE WHEN doc_id % 7 = 0 THEN concat(text, ' v2') ELSE text END AS text,
               doc_id % 13 = 0 OR doc_id % 17 = 0 AS finished, doc_id FROM {documents} WHERE doc_id % 11 <> 0""",
    "problem_sources": f"""
        SELECT concat('prob-', l_orderkey) AS problem_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS pos,
               concat(CASE l_suppkey % 4 WHEN 0 THEN 'grants-gov-' WHEN 1 THEN 'aria-' WHEN 2 THEN 'greenhouse-' ELSE 'rss-' END, l_suppkey) AS source_id,
               {_TIER.format("l_suppkey")} AS tier, {_TYPE} AS ptype,
               CASE WHEN l_partkey % 7 = 6 THEN ''
                    WHEN l_linenumber % 4 = 0 THEN concat('$', CAST(floor(l_extendedprice / 1000) AS BIGINT), 'k')
                    WHEN l_linenumber % 4 = 1 THEN concat('£', CAST(l_quantity AS BIGINT), 'm')
                    WHEN l_linenumber % 4 = 2 THEN concat('Award ceiling: ', CAST(l_quantity AS BIGINT), ',000')
                    ELSE 'a large prize' END AS stated,
               CASE l_linenumber WHEN 7 THEN 'rolling' WHEN 6 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS deadline,
               l_linenumber, l_quantity, l_extendedprice, l_suppkey
        FROM {{lineitem}}""",
    "problems": """
        SELECT concat('prob-', o_orderkey) AS problem_id, o_orderkey % 3 + 1 AS revision, concat('statement ', o_custkey) AS statement FROM {orders}""",
    "novelty": """
        SELECT concat('prob-', o_orderkey) AS problem_id, o_orderkey % 4 + 1 AS revision,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'unsolved' WHEN '2' THEN 'partially_solved' WHEN '3' THEN 'solved'
                    WHEN '4' THEN 'unclear' ELSE 'malformed' END AS status, o_orderkey % 5 + 1 AS searches
        FROM {orders} WHERE o_orderkey % 2 = 0""",
    "assessments": """
        SELECT concat('prob-', o_orderkey) AS problem_id, o_orderkey % 2 + 1 AS revision,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS low,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 2 * o_totalprice END AS high, o_orderkey % 4 AS n_warnings
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "fits": """
        SELECT concat('prob-', o_orderkey) AS problem_id, o_orderkey % 2 + 1 AS revision, o_orderkey % 11 AS score,
               o_orderkey % 2 + 1 AS problem_revision, concat('digest-', o_orderkey % 7 % 2) AS profile_digest
        FROM {orders} WHERE o_orderkey % 4 <> 3""",
    "opportunities": """
        SELECT concat('prob-', o_orderkey) AS problem_id, concat('OPP-', o_orderkey) AS opportunity_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'investigate' WHEN 1 THEN 'contact' ELSE 'ignore' END AS recommendation,
               o_orderkey % 5 + 1 AS in_problem, o_orderkey % 2 + 1 AS in_fit, o_orderkey % 11 AS in_fit_score,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 + 1 END AS in_novelty,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 + 1 END AS in_value
        FROM {orders} WHERE o_orderkey % 8 = 0""",
    "board": """
        SELECT l_partkey AS challenge_id, row_number() OVER (PARTITION BY l_partkey ORDER BY
                 CASE WHEN l_partkey % 7 = 0 THEN l_orderkey % 97 ELSE 0 END,
                 CASE WHEN l_partkey % 3 = 0 THEN -l_extendedprice ELSE l_extendedprice END, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS pos,
               concat('team-', l_suppkey) AS team, l_extendedprice / 120000 AS score, l_returnflag = 'R' AS is_baseline,
               CASE l_partkey % 6 WHEN 0 THEN 'Accuracy' WHEN 1 THEN 'Log Loss' WHEN 2 THEN 'RMSE' WHEN 3 THEN 'Score'
                    WHEN 4 THEN 'Mean Average Precision' ELSE 'F1' END AS metric
        FROM {lineitem}""",
    "scan_log": """
        SELECT concat('src-', user_id) AS source_id, event_id AS seq, ts,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'new' WHEN 'click' THEN 'changed'
                    WHEN 'purchase' THEN 'candidate' ELSE 'unchanged' END AS outcome, event_id % 7 AS n_items, user_id, value FROM {events}""",
    # candidates extracted from items: one for each customer
    "candidates": f"""
        SELECT concat('cand-', c_custkey, '-r', c_custkey % 3 + 1, '-0') AS candidate_id, c_custkey AS doc_id, c_custkey % 3 + 1 AS revision,
               concat('src', c_nationkey) AS source_id, {_TIER.format("c_nationkey")} AS tier, c_mktsegment AS category,
               concat(c_name, ' in ', c_mktsegment) AS statement, CAST(floor(abs(c_acctbal)) AS BIGINT) % 3000 AS output_tokens,
               c_custkey % 28 AS day, concat('call of ', c_mktsegment) AS title,
               CASE c_custkey % 4 WHEN 0 THEN 'rolling' WHEN 1 THEN NULL WHEN 2 THEN concat('1995-12-', 10 + c_custkey % 20)
                    ELSE concat('1996-01-', 10 + c_custkey % 20) END AS deadline
        FROM {{customer}}""",
    "item_state": """
        SELECT doc_id, doc_id % 2 + 1 AS revision, doc_id % 13 = 0 AS finished FROM {documents} WHERE doc_id % 10 <> 9""",
    "processed": """
        SELECT concat('cand-', c_custkey, '-r', c_custkey % 3 + 1, '-0') AS candidate_id,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('prob-', c_custkey % 50) END AS problem_id,
               CASE c_custkey % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'new' ELSE 'merged' END AS decision
        FROM {customer} WHERE c_custkey % 3 <> 0""",
    "sessions": """
        SELECT conv_id AS session_id, turn AS line_no, role, text,
               CASE turn % 3 WHEN 0 THEN 'WebSearch' WHEN 1 THEN 'WebFetch' ELSE 'StructuredOutput' END AS tool FROM {conversations}""",
    "triage": """
        SELECT concat('prob-', o_orderkey) AS problem_id, CASE WHEN o_orderkey % 6 < 3 THEN 'shortlist' ELSE 'reject' END AS mark
        FROM {orders} WHERE o_orderkey % 3 = 1""",
    "estimates": """
        SELECT concat('prob-', l_orderkey) AS problem_id, l_linenumber AS pos,
               CASE l_linenumber % 4 WHEN 0 THEN 'affected_units' WHEN 1 THEN 'frequency_per_year' WHEN 2 THEN 'cost_per_occurrence'
                    ELSE 'addressable_share' END AS quantity,
               CASE WHEN l_linenumber % 4 = 3 THEN l_discount ELSE l_quantity END AS low,
               CASE WHEN l_linenumber % 4 = 3 THEN l_discount + l_tax ELSE l_quantity + l_linenumber END AS high,
               CASE l_linenumber % 4 WHEN 0 THEN 'sites' WHEN 1 THEN 'per year' WHEN 2 THEN CASE l_suppkey % 3 WHEN 0 THEN 'USD' ELSE 'USD/incident' END
                    ELSE 'share' END AS unit, l_returnflag = 'R' AS cited
        FROM {lineitem} WHERE l_linenumber <= 7""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = BINDINGS[name]
    return spark.sql(sql, **{t: given(spark, sf_dir, t) for t in tables_of(sql)})


def twin(*names: str) -> str:
    """The same tables as common table expressions of DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', BINDINGS[n])})" for n in names)
