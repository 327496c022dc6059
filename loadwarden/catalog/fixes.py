"""Remediations, proposed from the events and applied to the loads they concern."""
from __future__ import annotations

from pyspark.sql import functions as F

from loadwarden.catalog.given import CUSTOMER_COLUMNS, CUSTOMERS, Given, ORDER_COLUMNS, ORDERS
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import DETECT, values
from loadwarden.operators import contracts, remediate
from loadwarden.operators.rename import last_profiles
from loadwarden.operators.staging import latest_per_key, mapped, model_columns
from loadwarden.session import write_through


def _columns(column_map):
    return model_columns(column_map, "stg_orders")


@query("document_columns", f"""WITH {DETECT}
SELECT column_after AS column_name, lower(type_after) AS data_type,
       'Added by producer in load ' || load_id || '; not yet consumed' AS description FROM events WHERE drift_class = 'additive'""")
def document_columns(g: Given):
    return remediate.document_columns(g.contract, g.structural_events).select("column_name", "data_type", "description")


@query("widen_contract", f"""WITH {DETECT}
SELECT load_id, 'stg_orders' AS model, lower(column_before) AS alias, lower(type_before) AS old_type, lower(type_after) AS new_type
FROM events WHERE drift_class = 'type_widening'""")
def widen_contract(g: Given):
    return remediate.widen_map_types(g.column_map, g.structural_events)


_ALL_LOADS = """SELECT order_id, cust_id, amount, status, _load_id FROM bronze
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _loaded_at DESC, _load_id DESC) = 1"""


@query("remap_staging", f"""WITH {DETECT}, s AS ({_ALL_LOADS})
SELECT order_id, cust_id, CAST(amount AS DOUBLE) AS amount, status, _load_id FROM s""")
def remap_staging(g: Given):
    """Staging with the renamed load in it: earlier loads read the old map, the new one the remapped map."""
    load = "L2001.rename"
    fixed = remediate.remap_sources(g.column_map, g.structural_events, load)
    rows = mapped(g.baseline, _columns(g.column_map)).unionByName(mapped(g.variants[load], _columns(fixed)))
    return latest_per_key(rows, "order_id").select(
        F.col("order_id").cast("bigint").alias("order_id"), F.col("cust_id").cast("bigint").alias("cust_id"),
        F.col("amount").cast("double").alias("amount"), "status", F.substring_index("_load_id", ".", 1).alias("_load_id"))


_PAIRS = """old_ranked AS (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY share DESC, v) AS rank
                FROM base_shares WHERE _load_id = 'L2000'),
flags AS (SELECT CASE WHEN status = 'C' THEN 'true' ELSE 'false' END AS v, count(*) AS n FROM new GROUP BY 1),
codes AS (SELECT substr(channel, 1, 1) AS v, count(*) AS n FROM new GROUP BY 1),
pairs AS (
  SELECT 'L2001.breaking' AS load_id, 'STATUS' AS column_before, 'SETTLED' AS column_after, o.rank, n.v AS new_value, o.v AS old_value
  FROM old_ranked o JOIN (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rank FROM flags) n USING (rank)
  WHERE o.column_name = 'STATUS'
  UNION ALL SELECT 'L2001.replaced', 'CHANNEL', 'CHANNEL_CODE', o.rank, n.v, o.v
  FROM old_ranked o JOIN (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rank FROM codes) n USING (rank)
  WHERE o.column_name = 'CHANNEL')"""


def _pairs(g: Given):
    return remediate.recode_pairs(g.code_events, last_profiles(g.code_lists, g.structure[0]), g.code_lists)


@query("recode_pairs", f"WITH {DETECT}, {_PAIRS} SELECT * FROM pairs")
def recode_pairs(g: Given):
    return _pairs(g).drop("table_fqn", "type_after")


@query("recode_apply", f"""WITH {DETECT}, {_PAIRS}
SELECT order_id, p.old_value AS status FROM new
JOIN pairs p ON p.load_id = 'L2001.breaking' AND p.new_value = CASE WHEN status = 'C' THEN 'true' ELSE 'false' END""")
def recode_apply(g: Given):
    """The load that lost its status, with the status derived from its replacement by the proposed recoding."""
    load = "L2001.breaking"
    expressions = remediate.recode_expressions(_pairs(g).where(F.col("load_id") == load))
    fixed = remediate.with_expressions(g.column_map, remediate.recoded_aliases(g.column_map, expressions))
    return mapped(g.variants[load], _columns(fixed)).select(F.col("order_id").cast("bigint").alias("order_id"), "status")


@query("normalise_unit", f"""WITH {DETECT},
s AS (SELECT order_id, CAST(amount AS DOUBLE) AS amount, _loaded_at, _load_id FROM base
      UNION ALL SELECT order_id, ((cents * 2 + 84) // 168) * 84 / 100.0, _loaded_at, _load_id FROM new)
SELECT order_id, amount FROM s QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _loaded_at DESC, _load_id DESC) = 1""")
def normalise_unit(g: Given):
    """Staging with the rescaled load led back to the contract unit, after the producer's confirmation."""
    load = "L2001.semantic"
    fixes = remediate.normalise_units(g.column_map, g.rescaled_events.where(F.col("load_id") == load), confirmed=True)
    columns = _columns(remediate.with_expressions(g.column_map, fixes))
    rows = mapped(g.baseline.unionByName(g.variants[load]), columns)
    return latest_per_key(rows, "order_id").select(F.col("order_id").cast("bigint").alias("order_id"),
                                                   F.col("amount").cast("double").alias("amount"))


_VERSIONS = f"""promised(table_fqn, column_name, data_type) AS ({values([(t, c["source"].upper(), c["type"]) for t, cs in ((ORDERS, ORDER_COLUMNS), (CUSTOMERS, CUSTOMER_COLUMNS)) for c in cs])}),
facts AS (
  SELECT table_fqn, column_name, '' AS since, data_type FROM promised
  UNION ALL SELECT '{ORDERS}', column_after, load_id, lower(type_after) FROM events WHERE drift_class IN ('additive', 'rename', 'type_widening')
  UNION ALL SELECT '{ORDERS}', column_before, load_id, NULL FROM events WHERE drift_class = 'rename' OR subtype = 'column_dropped'),
turns AS (SELECT table_fqn, column_name, since, max(data_type) AS data_type FROM facts GROUP BY 1, 2, 3),
arrived AS (SELECT DISTINCT '{ORDERS}' AS table_fqn, _load_id AS load_id FROM base UNION ALL SELECT '{ORDERS}', 'L2001.' || kind FROM kinds
            UNION ALL SELECT DISTINCT '{CUSTOMERS}', 'C1994' FROM customer)"""


@query("contract_as_of", f"""WITH {DETECT}, {_VERSIONS}
SELECT table_fqn, load_id, column_name, data_type, since FROM (
  SELECT a.table_fqn, a.load_id, t.column_name, t.data_type, t.since FROM arrived a JOIN turns t ON t.table_fqn = a.table_fqn AND t.since <= a.load_id
  QUALIFY row_number() OVER (PARTITION BY a.table_fqn, a.load_id, t.column_name ORDER BY t.since DESC) = 1) WHERE data_type IS NOT NULL""")
def contract_as_of(g: Given):
    """What was promised at each load, the new ones taken as if they had come one after another and had all been accepted."""
    versions = write_through(contracts.contract_versions(g.contract, g.structural_events), "contract-versions")
    loads = g.gate.where(F.col("status") == "PASSED").select("table_fqn", "load_id").unionByName(g.candidates)
    return contracts.contract_as_of(loads, versions)


@query("contract_rewrite", f"""WITH {DETECT}, {_VERSIONS}
SELECT table_fqn, column_name, data_type, CASE WHEN since <> '' AND (table_fqn, column_name) NOT IN (SELECT table_fqn, column_name FROM promised)
  THEN 'Since load ' || since END AS description
FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY table_fqn, column_name ORDER BY since DESC) = 1) WHERE data_type IS NOT NULL""")
def contract_rewrite(g: Given):
    """The source contract after all of them: new columns in, renamed ones replaced, lost ones out, wider types."""
    versions = write_through(contracts.contract_versions(g.contract, g.structural_events), "contract-versions")
    return contracts.rewritten_contract(g.contract, versions).drop("meta")


@query("contract_gaps", f"""WITH {DETECT}
SELECT load_id, coalesce(column_after, column_before) AS column_name, coalesce(lower(type_before), 'absent') AS expected, coalesce(lower(type_after), 'absent') AS found
FROM events WHERE drift_class = 'type_widening' OR subtype IN ('column_added', 'column_dropped')
UNION ALL SELECT load_id, column_before, lower(type_before), 'absent' FROM events WHERE drift_class = 'rename'
UNION ALL SELECT load_id, column_after, 'absent', lower(type_after) FROM events WHERE drift_class = 'rename'""")
def contract_gaps(g: Given):
    """Where the schema of a load is not what was promised when none of the changes had been accepted."""
    promised = contracts.contract_as_of(g.snapshots.select("table_fqn", F.col("snapshot_id").alias("load_id")), contracts.contract_versions(g.contract))
    return contracts.contract_gaps(g.snapshots, promised).drop("table_fqn")
