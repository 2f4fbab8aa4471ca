"""Registered queries and the SQL that states the same result, with the model's projections as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

T0 = "TIMESTAMP '1992-01-01'"
_ENTITY = f"{T0} AS created_at, {T0} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to"
SERIAL = "l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey||':'||strftime(l_shipdate,'%Y%m%d')"

CTES = {
    "entities": f"""entities AS (
 SELECT 'R:'||r_regionkey AS id, r_name AS name, 'Region' AS entity_type, {_ENTITY} FROM region
 UNION ALL SELECT 'N:'||n_nationkey, n_name, 'Nation', {_ENTITY} FROM nation
 UNION ALL SELECT 'C:'||c_custkey, c_name, 'Customer', {_ENTITY} FROM customer
 UNION ALL SELECT 'S:'||s_suppkey, s_name, 'Supplier', {_ENTITY} FROM supplier
 UNION ALL SELECT 'P:'||p_partkey, p_name, 'Part', {_ENTITY} FROM part)""",
    "episodes": f"""episodes AS (
 SELECT 'D:'||doc_id AS id, 'doc '||doc_id AS name, 'document' AS episode_type, text AS content, source, {T0} AS valid_from FROM documents
 UNION ALL SELECT 'M:'||conv_id||':'||turn, 'conversation '||conv_id, 'message', text, role, {T0} + to_minutes(turn) FROM conversations
 UNION ALL SELECT 'O:'||o_orderkey, 'order '||o_orderkey, 'event', o_orderpriority||' '||o_orderstatus, 'orders', o_orderdate FROM orders)""",
    "edges": f"""edges AS (
 SELECT 'IN_REGION:N:'||n_nationkey AS id, 'N:'||n_nationkey AS source_id, 'R:'||n_regionkey AS target_id, 'IN_REGION' AS relationship, CAST(1 AS DOUBLE) AS weight, '{{}}' AS properties, {T0} AS created_at, {T0} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM nation
 UNION ALL SELECT 'IN_NATION:C:'||c_custkey, 'C:'||c_custkey, 'N:'||c_nationkey, 'IN_NATION', 1, '{{}}', {T0}, {T0}, NULL FROM customer
 UNION ALL SELECT 'IN_NATION:S:'||s_suppkey, 'S:'||s_suppkey, 'N:'||s_nationkey, 'IN_NATION', 1, '{{}}', {T0}, {T0}, NULL FROM supplier
 UNION ALL SELECT 'ORDERED:'||{SERIAL}, 'C:'||o_custkey, 'P:'||l_partkey, 'ORDERED', l_quantity, '{{"flag":"'||l_returnflag||'"}}', o_orderdate, o_orderdate, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'SUPPLIED_BY:'||{SERIAL}, 'P:'||l_partkey, 'S:'||l_suppkey, 'SUPPLIED_BY', l_quantity, '{{"flag":"'||l_returnflag||'"}}', l_shipdate, l_shipdate, CASE WHEN l_linestatus <> 'O' THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END FROM lineitem)""",
}


def query(name: str, sql: str | None = None, needs: str = "", recursive: bool = False):
    """Register a function of (spark, sf_dir); needs: names of the CTES that the SQL reads."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [CTES[n] for n in needs.split()]
            body = sql.strip()
            if parts:
                lead = "WITH RECURSIVE " if recursive else "WITH "
                if body.upper().startswith("WITH "):
                    body = body[5:]
                    body = body[len("RECURSIVE ") :] if body.upper().startswith("RECURSIVE ") else body
                    body = lead + ",\n".join(parts) + ",\n" + body
                else:
                    body = lead + ",\n".join(parts) + "\n" + body
            ORACLE_SQL[name] = body
        return f

    return register
