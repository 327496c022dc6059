"""SQL building blocks shared by the check queries (DuckDB)."""

BRONZE = """
bronze AS (
  SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderdate AS order_ts,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CASE WHEN sent > year(o_orderdate) THEN 'C' WHEN o_orderstatus = 'P' THEN 'A' ELSE 'C' END AS status,
         o_orderpriority AS channel, 'L' || sent AS _load_id, make_timestamp(sent + 1, 1, 1, 0, 0, 0.0) AS _loaded_at
  FROM (SELECT *, unnest(CASE WHEN month(o_orderdate) = 12 THEN [year(o_orderdate), year(o_orderdate) + 1]
                              ELSE [year(o_orderdate)] END) AS sent FROM orders)
)"""

CUSTOMERS = """
bronze_customers AS (
  SELECT c_custkey AS cust_id, c_mktsegment AS segment, 'NATION_' || c_nationkey AS city,
         CAST(DATE '1995-01-01' - CAST(floor(abs(c_acctbal) / 12) AS INTEGER) AS DATE) AS signup_date,
         'C1994' AS _load_id, TIMESTAMP '1995-01-01' AS _loaded_at
  FROM customer
)"""

STAGING = BRONZE + "," + CUSTOMERS + """,
stg_orders AS (
  SELECT * FROM bronze WHERE _load_id < 'L2001'
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _loaded_at DESC, _load_id DESC) = 1
),
stg_customers AS (SELECT * FROM bronze_customers),
fct AS (
  SELECT o.order_id, o.cust_id, c.segment, c.city, o.order_ts, CAST(o.order_ts AS DATE) AS order_date,
         o.amount, o.status, o.channel
  FROM stg_orders o LEFT JOIN stg_customers c USING (cust_id)
)"""


def values(rows) -> str:
    """Rows as a SQL VALUES list."""
    def cell(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


KINDS = ["additive", "breaking", "clean", "codes", "rename", "replaced", "semantic", "widening"]

# Statistics of the baseline and of every variant of the new load, and the tests on them.
DETECT = BRONZE + f""",
base AS (SELECT * FROM bronze WHERE _load_id < 'L2001'),
new AS (SELECT *, CAST(amount * 100 AS BIGINT) AS cents FROM bronze WHERE _load_id = 'L2001'),
kinds(kind) AS ({values([(k,) for k in KINDS])}),
base_medians AS (
  SELECT _load_id, 'CUST_ID' AS column_name, median(CAST(cust_id AS DOUBLE)) AS m FROM base GROUP BY 1
  UNION ALL SELECT _load_id, 'AMOUNT', median(CAST(amount AS DOUBLE)) FROM base GROUP BY 1),
new_medians AS (
  SELECT kind, 'CUST_ID' AS column_name, median(CAST(cust_id AS DOUBLE)) AS m FROM new, kinds
  WHERE kind NOT IN ('rename', 'replaced') GROUP BY 1
  UNION ALL SELECT kind, 'AMOUNT', median(CASE WHEN kind = 'semantic' THEN ((cents * 2 + 84) // 168) / 100.0
                                               ELSE CAST(amount AS DOUBLE) END) FROM new, kinds
  WHERE kind <> 'widening' GROUP BY 1),
base_stats AS (
  SELECT column_name, b.med, median(abs(m - b.med)) AS mad FROM base_medians
  JOIN (SELECT column_name, median(m) AS med FROM base_medians WHERE m <> 0 GROUP BY 1) b USING (column_name)
  WHERE m <> 0 GROUP BY ALL),
numeric_tests AS (
  SELECT *, factor >= 3.0 AND z >= 6.0 AS flagged,
         CASE WHEN factor >= 3.0 AND z >= 6.0 THEN
           CASE WHEN abs(ratio - 84) / 84 <= 0.1 THEN 'down' WHEN abs(1 / ratio - 84) / 84 <= 0.1 THEN 'up' END END AS direction
  FROM (SELECT 'L2001.' || kind AS load_id, n.column_name, med, n.m, med / n.m AS ratio,
               greatest(med / n.m, n.m / med) AS factor,
               abs(n.m - med) / (1.4826 * coalesce(nullif(mad, 0), nullif(abs(med) * 0.01, 0), 1e-9)) AS z
        FROM new_medians n JOIN base_stats USING (column_name))),
base_values AS (SELECT _load_id, 'STATUS' AS column_name, status AS v FROM base
                UNION ALL SELECT _load_id, 'CHANNEL', channel FROM base),
new_values AS (SELECT kind, 'STATUS' AS column_name,
                      CASE WHEN kind <> 'codes' THEN status WHEN status = 'A' THEN 'C' ELSE 'A' END AS v
               FROM new, kinds WHERE kind <> 'breaking'
               UNION ALL SELECT kind, 'CHANNEL', channel FROM new, kinds WHERE kind <> 'replaced'),
base_counts AS (SELECT _load_id, column_name, v, count(*) AS n FROM base_values GROUP BY 1, 2, 3),
new_counts AS (SELECT kind, column_name, v, count(*) AS n FROM new_values GROUP BY 1, 2, 3),
base_shares AS (SELECT _load_id, column_name, v, n / sum(n) OVER (PARTITION BY _load_id, column_name) AS share FROM base_counts),
shares AS (SELECT kind, column_name, v, n / sum(n) OVER (PARTITION BY kind, column_name) AS share FROM new_counts),
expected AS (SELECT column_name, v, sum(share) / (SELECT count(DISTINCT _load_id) FROM base) AS e
             FROM base_shares GROUP BY 1, 2),
tested AS (SELECT DISTINCT kind, column_name FROM shares),
category_shares AS (
  SELECT 'L2001.' || t.kind AS load_id, t.column_name, coalesce(e.v, s.v) AS value, e.e AS expected, s.share AS actual
  FROM (SELECT t.kind, t.column_name, x.v, x.e FROM tested t JOIN expected x USING (column_name)) e
  FULL JOIN shares s ON s.kind = e.kind AND s.column_name = e.column_name AND s.v = e.v
  JOIN tested t ON t.kind = coalesce(e.kind, s.kind) AND t.column_name = coalesce(e.column_name, s.column_name)),
category_tests AS (
  SELECT *, psi >= 0.25 AS flagged,
         CASE WHEN psi >= 0.25 THEN CASE WHEN overlap >= 0.8 THEN 'code_meaning_change' ELSE 'new_value_domain' END END AS subtype
  FROM (SELECT load_id, column_name,
               sum((greatest(coalesce(actual, 0), 1e-4) - greatest(coalesce(expected, 0), 1e-4))
                   * ln(greatest(coalesce(actual, 0), 1e-4) / greatest(coalesce(expected, 0), 1e-4))) AS psi,
               count(*) FILTER (expected IS NOT NULL AND actual IS NOT NULL) / count(*) AS overlap
        FROM category_shares GROUP BY ALL)),
containment AS (
  SELECT count(*) FILTER (c IN (SELECT cust_id FROM base)) / count(*) AS c, count(*) AS n_new,
         (SELECT count(DISTINCT cust_id) FROM base WHERE _load_id = 'L2000') AS n_old
  FROM (SELECT DISTINCT cust_id AS c FROM new)),
ratio AS (SELECT c, least(n_new, n_old) / greatest(n_new, n_old) AS r FROM containment),
fingerprint AS (SELECT round(c, 4) AS c, round(r, 4) AS r, round(0.6 * c + 0.2 + 0.2 * r, 4) AS score,
                       round(0.2 + 0.2 * r, 4) AS no_overlap FROM ratio),
rejected AS (
  SELECT 'L2001.breaking' AS load_id, 'STATUS' AS column_before, 'SETTLED' AS column_after,
         'type family VARCHAR vs BOOLEAN' AS reason
  UNION ALL SELECT 'L2001.replaced', 'CUST_ID', 'ACCOUNT_NO', 'score ' || no_overlap || ' < 0.9' FROM fingerprint
  UNION ALL SELECT 'L2001.replaced', 'CUST_ID', 'CHANNEL_CODE', 'type family NUMBER(19,0) vs VARCHAR'
  UNION ALL SELECT 'L2001.replaced', 'CHANNEL', 'ACCOUNT_NO', 'type family VARCHAR vs NUMBER(19,0)'
  UNION ALL SELECT 'L2001.replaced', 'CHANNEL', 'CHANNEL_CODE', 'distinct values below 50; too small to fingerprint'),
restated AS (
  SELECT 'L2001.' || kind AS load_id, count(*) AS matched_rows, median(r) AS ratio_median, stddev_samp(r) / avg(r) AS ratio_cv
  FROM (SELECT kind, CAST(o.amount AS DOUBLE)
                     / (CASE WHEN kind = 'semantic' THEN ((n.cents * 2 + 84) // 168) / 100.0 ELSE CAST(n.amount AS DOUBLE) END) AS r
        FROM new n JOIN (SELECT order_id, amount FROM base QUALIFY row_number() OVER (
               PARTITION BY order_id ORDER BY _loaded_at DESC, _load_id DESC) = 1) o USING (order_id), kinds) GROUP BY 1),
found AS (
  {values([("L2001.additive", "additive", "column_added", None, "ORDER_MONTH", None, "VARCHAR", 1.0),
           ("L2001.breaking", "breaking", "column_dropped", "STATUS", None, "VARCHAR", None, 1.0),
           ("L2001.breaking", "additive", "column_added", None, "SETTLED", None, "BOOLEAN", 1.0),
           ("L2001.replaced", "breaking", "column_dropped", "CUST_ID", None, "NUMBER(19,0)", None, 1.0),
           ("L2001.replaced", "breaking", "column_dropped", "CHANNEL", None, "VARCHAR", None, 1.0),
           ("L2001.replaced", "additive", "column_added", None, "ACCOUNT_NO", None, "NUMBER(19,0)", 1.0),
           ("L2001.replaced", "additive", "column_added", None, "CHANNEL_CODE", None, "VARCHAR", 1.0),
           ("L2001.widening", "type_widening", "lossless_widening", "AMOUNT", "AMOUNT", "NUMBER(12,2)", "NUMBER(18,2)", 1.0)])}
),
events AS (
  SELECT 'DE-' || substr(sha256('["lake.raw.orders","' || load_id || '","' || drift_class || '","' || subtype || '",'
           || coalesce('"' || column_before || '"', 'null') || ',' || coalesce('"' || column_after || '"', 'null') || ']'), 1, 12)
         AS event_id, *
  FROM (
    SELECT * FROM found t(load_id, drift_class, subtype, column_before, column_after, type_before, type_after, confidence)
    UNION ALL SELECT 'L2001.rename', 'rename', 'column_renamed', 'CUST_ID', 'CUSTOMER_KEY', 'NUMBER(19,0)', 'NUMBER(19,0)', score
    FROM fingerprint WHERE score >= 0.9
    UNION ALL SELECT load_id, 'semantic', CASE WHEN direction IS NULL THEN 'scale_shift' ELSE 'unit_change' END, column_name,
      column_name, t, t, round(least(0.99, 0.7 + CASE WHEN direction IS NULL THEN 0 ELSE 0.15 END
        + CASE WHEN coalesce(matched_rows, 0) >= 30 AND coalesce(ratio_cv, 1) < 0.05 THEN 0.14 ELSE 0 END), 2)
    FROM (SELECT *, CASE column_name WHEN 'AMOUNT' THEN 'NUMBER(12,2)' ELSE 'NUMBER(19,0)' END AS t FROM numeric_tests)
    LEFT JOIN restated r USING (load_id) WHERE flagged
    UNION ALL SELECT load_id, 'semantic', subtype, column_name, column_name, 'VARCHAR', 'VARCHAR',
      CASE subtype WHEN 'code_meaning_change' THEN 0.8 ELSE 0.75 END FROM category_tests WHERE flagged)
)"""
