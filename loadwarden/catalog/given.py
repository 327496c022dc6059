"""The given tables seen as bronze loads, and what the checks need around them.

orders: one load per order year. Each December is sent again with the next year's load, its orders completed
(the restated rows). The load of the last year is new; all earlier ones have passed the gate.
"""
from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwarden.operators import classify
from loadwarden.operators.profile import changed_profiles, column_medians, listed_values, load_counts, top_lists
from loadwarden.plans.detect import Detection, Inputs, decide, detect, scored_changes, structure
from loadwarden.operators.rename import exact_containment
from loadwarden.operators.semantic import checked_columns, numeric_checks, restatement
from loadwarden.policy import Policy
from loadwarden.session import write_through
from loadwarden.sources import bronze
from loadwarden.sources.lineage import lineage_tables
from loadwarden.sources.registry import column_map, source_contract, watch_registry

ORDERS, CUSTOMERS = "lake.raw.orders", "lake.raw.customers"
NEW_LOAD = "L2001"
PROJECT = "shop"
OWNERS = {ORDERS: "orders-team@shop.example", CUSTOMERS: "crm-team@shop.example"}

ORDER_COLUMNS = [
    {"alias": "order_id", "source": "order_id", "type": "number(19,0)", "tests": ["not_null", "unique"]},
    {"alias": "cust_id", "source": "cust_id", "type": "number(19,0)", "tests": ["not_null"]},
    {"alias": "order_ts", "source": "order_ts", "type": "timestamp_ntz", "tests": ["not_null"]},
    {"alias": "amount", "source": "amount", "type": "number(12,2)", "tests": ["not_null"]},
    {"alias": "status", "source": "status", "type": "varchar", "tests": ["not_null"]},
    {"alias": "channel", "source": "channel", "type": "varchar", "tests": []},
]
CUSTOMER_COLUMNS = [
    {"alias": "cust_id", "source": "cust_id", "type": "number(19,0)", "tests": ["not_null", "unique"]},
    {"alias": "segment", "source": "segment", "type": "varchar", "tests": []},
    {"alias": "city", "source": "city", "type": "varchar", "tests": []},
    {"alias": "signup_date", "source": "signup_date", "type": "date", "tests": []},
]
#: Models and readers downstream of the given tables, (from, to).
_FLOWS = {
    "source:raw.orders": ["stg_orders"], "source:raw.customers": ["stg_customers"], "source:raw.lineitem": ["order_lines"],
    "source:raw.supplier": ["supplier_scorecard"], "stg_orders": ["order_lines", "nation_customers"], "stg_customers": ["nation_customers"],
    "order_lines": ["part_demand", "supplier_scorecard"], "supplier_scorecard": ["vendor_review", "region_balance"],
    "nation_customers": ["region_balance", "mailing_lists"], "part_demand": ["restocking_planner"], "region_balance": ["regional_board", "tax_filing"],
}
#: name, title, kind, owner, tier, audience
_READERS = [
    ("restocking_planner", "Restocking planner", "application", "Warehouse Planning", 2, "Warehouses"),
    ("vendor_review", "Yearly vendor review", "notebook", "Procurement", 3, "Buyers"),
    ("regional_board", "Regional board pack", "dashboard", "Regional Offices", 1, "Directors"),
    ("tax_filing", "Quarterly tax filing", "application", "Tax", 1, "Authorities"),
    ("mailing_lists", "Mailing lists", "ml", "Customer Letters", 4, "Print shop"),
]


def _node_id(name: str) -> str:
    kind, _, rest = name.rpartition(":")
    return f"{kind or ('exposure' if name in {r[0] for r in _READERS} else 'model')}.{PROJECT}.{rest}"


EDGES = [(_node_id(a), _node_id(b)) for a, to in _FLOWS.items() for b in to]
NODES = [(i, "model", i.split(".")[2], None, None, None, None, None) for i in sorted({x for e in EDGES for x in e}) if i.startswith("model.")] + [
    (_node_id(r[0]), "exposure", *r) for r in _READERS]


class Given:
    """Lazy views of one data folder; nothing is kept from one query to the next."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.policy = Policy()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ bronze
    @cached_property
    def orders(self) -> DataFrame:
        year = F.year("o_orderdate")
        sent = F.when(F.month("o_orderdate") == 12, F.array(year, year + 1)).otherwise(F.array(year))
        rows = self.table("orders").select("*", year.alias("_y"), F.explode(sent).alias("_sent"))
        first = F.when(F.col("o_orderstatus") == "P", "A").otherwise("C")
        return bronze.tag_load(
            rows.select(
                F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"),
                F.col("o_orderdate").alias("order_ts"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
                F.when(F.col("_sent") > F.col("_y"), "C").otherwise(first).alias("status"),
                F.col("o_orderpriority").alias("channel"), "_sent"),
            F.concat(F.lit("L"), F.col("_sent").cast("string")),
            F.make_timestamp_ntz(F.col("_sent") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).drop("_sent")

    @cached_property
    def customers(self) -> DataFrame:
        rows = self.table("customer").select(
            F.col("c_custkey").alias("cust_id"), F.col("c_mktsegment").alias("segment"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("city"),
            F.date_sub(F.lit("1995-01-01").cast("date"), F.floor(F.abs("c_acctbal") / 12).cast("int")).alias("signup_date"))
        # over a column, not a literal: the gate's semi join on a constant would be a nested loop
        return bronze.tag_load(rows, F.when(F.col("cust_id").isNotNull(), "C1994"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))

    @cached_property
    def baseline(self) -> DataFrame:
        return self.orders.where(F.col("_load_id") < NEW_LOAD)

    @cached_property
    def new_load(self) -> DataFrame:
        """The new load as a stored table: every variant is made from it, and each step reads all of them."""
        return write_through(self.orders.where(F.col("_load_id") == NEW_LOAD), "new-load")

    @cached_property
    def variants(self) -> dict[str, DataFrame]:
        """The new load as it came, and as it would have come with each kind of drift."""
        new = self.new_load
        made = {
            "additive": bronze.with_added_column(new, "order_month", F.date_format("order_ts", "yyyy-MM")),
            "breaking": bronze.with_replaced_column(new, "status", "settled", F.col("status") == "C"),
            "clean": new,
            "codes": bronze.with_swapped_codes(new, "status", "A", "C"),
            "rename": bronze.with_renamed_column(new, "cust_id", "customer_key"),
            "replaced": new.withColumns({"account_no": F.col("cust_id") + 1_000_000_000,
                                         "channel_code": F.substring("channel", 1, 1)}).drop("cust_id", "channel"),
            "semantic": bronze.with_scaled_column(new, "amount", 84.0),
            "widening": bronze.with_widened_column(new, "amount", "decimal(18,2)"),
        }
        return {f"{NEW_LOAD}.{k}": df.withColumn("_load_id", F.lit(f"{NEW_LOAD}.{k}")) for k, df in made.items()}

    # ------------------------------------------------------------------ control plane
    @cached_property
    def observed(self) -> DataFrame:
        return bronze.observed_loads(self.orders, ORDERS).unionByName(bronze.observed_loads(self.customers, CUSTOMERS))

    @cached_property
    def gate(self) -> DataFrame:
        """Gate rows as a stored table, for the steps that read it many times."""
        return write_through(self.live_gate, "gate")

    @cached_property
    def live_gate(self) -> DataFrame:
        """Latest gate rows: all loads have passed but the new one."""
        status = F.when((F.col("table_fqn") == ORDERS) & (F.col("load_id") >= NEW_LOAD), "PENDING").otherwise("PASSED")
        return self.observed.select("table_fqn", "load_id", "row_count", status.alias("status"))

    @cached_property
    def candidates(self) -> DataFrame:
        return self.spark.createDataFrame([(ORDERS, k) for k in self.variants], "table_fqn string, load_id string")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Schema rows: what the baseline loads carry, and what each variant carries."""
        variants = bronze.schema_snapshots(self.spark, {(ORDERS, k): df.schema for k, df in self.variants.items()})
        columns = bronze.schema_snapshots(self.spark, {(ORDERS, ""): self.orders.schema}).drop("snapshot_id")
        loads = self.gate.where((F.col("table_fqn") == ORDERS) & (F.col("status") == "PASSED")).select(
            "table_fqn", F.col("load_id").alias("snapshot_id"))
        held = loads.join(columns, "table_fqn").select(*variants.columns)
        return write_through(held.unionByName(variants), "schema-snapshots")

    @cached_property
    def compared(self) -> DataFrame:
        """What each candidate is compared with, as one name for all its baseline loads together: candidates with the same loads share it."""
        return write_through(self.structure[0].groupBy("table_fqn", "load_id").agg(
            F.array_join(F.array_sort(F.collect_list("base_load_id")), ",").alias("loads"), F.max("base_load_id").alias("newest"))
            .withColumn("base_load_id", F.concat(F.lit("all of "), "loads")), "compared")

    @cached_property
    def changed_counts(self) -> DataFrame:
        """Value counts of the dropped columns in the baseline and of the added ones in the loads that added them: all that fingerprints need.

        Containment asks whether any baseline load had a value, so these are counted as one load of the name in `compared`, and a value that many
        loads hold moves once; by itself only the newest of them is counted, whose distinct values a fingerprint compares.
        """
        changed = self.structure[1].where(F.col("change").isin("added", "dropped")).select("load_id", "column_before", "column_after").collect()
        dropped = {r.column_before.upper() for r in changed if r.column_before}
        held = self.compared.select("base_load_id", "loads", "newest").distinct().collect()  # one row per set of baseline loads
        wanted = [(self.baseline.where(F.col("_load_id").isin(name.loads.split(","))).withColumn("_load_id", F.lit(name.base_load_id)), dropped) for name in held]
        wanted += [(self.baseline.where(F.col("_load_id").isin(sorted({name.newest for name in held}))), dropped)]
        wanted += [(df, {r.column_after.upper() for r in changed if r.column_after and r.load_id == k}) for k, df in self.variants.items()]
        return write_through(reduce(DataFrame.unionByName, [
            load_counts(df, ORDERS, columns=names) for df, names in wanted if names]), "value-counts")

    @cached_property
    def changed(self) -> DataFrame:
        """Null rates and distinct counts of the columns that came or went: what their fingerprints need besides containment."""
        return write_through(changed_profiles(self.changed_counts), "changed-profiles")

    @cached_property
    def medians(self) -> DataFrame:
        """Medians of the numeric columns that some candidate kept, in the baseline and in the candidates that kept them."""
        checked = checked_columns(self.structure[1], ("numeric",), self.key_columns).select("load_id", "column_name").collect()
        wanted = [(self.baseline, ORDERS, frozenset(r.column_name for r in checked))]
        wanted += [(df, ORDERS, frozenset(r.column_name for r in checked if r.load_id == k)) for k, df in self.variants.items()]
        return write_through(column_medians(wanted), "medians")

    @cached_property
    def top_lists(self) -> DataFrame:
        return write_through(top_lists([(df, ORDERS) for df in (self.baseline, *self.variants.values())]), "top-lists")

    @cached_property
    def profiles(self) -> DataFrame:
        """What the checks of meaning read: a column is numeric and has a median, or holds codes and has top values."""
        return self.medians.unionByName(self.top_lists, allowMissingColumns=True)

    @cached_property
    def key_columns(self) -> DataFrame:
        return self.spark.createDataFrame([(ORDERS, "order_id"), (CUSTOMERS, "cust_id")],
                                          "table_fqn string, key_column string")

    def restated_in(self, loads: list[str]) -> DataFrame:
        """Restatement evidence of the given variants."""
        new = reduce(DataFrame.unionByName, [self.variants[k].select("order_id", "amount", "_load_id", "_loaded_at") for k in loads])
        return restatement(new, self.baseline, ORDERS, "order_id", "amount")

    @cached_property
    def restated(self) -> DataFrame:
        return self.restated_in(list(self.variants))

    @cached_property
    def structure(self) -> tuple[DataFrame, DataFrame]:
        """(baseline loads, schema differences)"""
        return structure(self.candidates, self.gate, self.snapshots, self.policy)

    @cached_property
    def scored(self) -> DataFrame:
        """Dropped beside added columns; needs their values alone, no profile of any other column."""
        contained = exact_containment(self.structure[1], self.compared, self.changed_counts)
        x = Inputs(self.candidates, self.gate, self.snapshots, None, containment=contained, changed=self.changed)
        return scored_changes(x, self.policy, self.structure)

    @cached_property
    def structural_events(self) -> DataFrame:
        """The events that schemas and renames give, for queries that read no others."""
        return write_through(classify.structural_events(self.structure[1], self.scored), "structural-events")

    @cached_property
    def code_changes(self) -> DataFrame:
        """Schema differences of the text and boolean columns that came or went: all that a recoding rests on.

        A rename never crosses families, so whether one of these columns was renamed is settled among themselves; keys and amounts have no part in it.
        """
        return self.structure[1].where(F.col("change").isin("added", "dropped") & F.col("family").isin("text", "boolean"))

    @cached_property
    def code_counts(self) -> DataFrame:
        """Value counts of these columns: each baseline load is read once, and the loads that added one; containment and top values both come from them."""
        changed = self.code_changes.select("load_id", "column_before", "column_after").collect()
        held = [r.base_load_id for r in self.structure[0].select("base_load_id").distinct().collect()]
        wanted = [(self.baseline.where(F.col("_load_id").isin(held)), {r.column_before.upper() for r in changed if r.column_before})]
        wanted += [(df, {r.column_after.upper() for r in changed if r.column_after and r.load_id == k}) for k, df in self.variants.items()]
        return write_through(reduce(DataFrame.unionByName, [
            load_counts(df, ORDERS, columns=names) for df, names in wanted if names]), "code-counts")

    @cached_property
    def code_lists(self) -> DataFrame:
        return write_through(listed_values(self.code_counts), "code-lists")

    @cached_property
    def code_events(self) -> DataFrame:
        """The events of `structural_events` on these columns; a dropped one names only those among them as possible replacements."""
        x = Inputs(self.candidates, self.gate, self.snapshots, changed_profiles(self.code_counts), counts=self.code_counts)
        scored = scored_changes(x, self.policy, (self.structure[0], self.code_changes))
        return write_through(classify.structural_events(self.code_changes, scored), "code-events")

    @cached_property
    def rescaled_events(self) -> DataFrame:
        """The events that medians give, for queries that read no others."""
        base, diff = self.structure
        return write_through(classify.rescaled_events(numeric_checks(diff, self.medians, base, self.policy.thresholds, self.key_columns)), "rescaled-events")

    @cached_property
    def detection(self) -> Detection:
        """All events; whether rows were re-sent is not yet part of their evidence."""
        x = Inputs(self.candidates, self.gate, self.snapshots, self.profiles, key_columns=self.key_columns)
        found = detect(x, self.policy, self.structure, self.scored)
        return replace(found, events=write_through(found.events, "found-events"))

    @cached_property
    def events(self) -> DataFrame:
        """All events. As in a scan, re-sent rows are looked for in the loads whose amount was rescaled: no other event has such evidence."""
        events = self.detection.events
        loads = [r.load_id for r in events.where(classify.RESCALED).where("column_before = 'AMOUNT'").select("load_id").distinct().collect()]
        return write_through(classify.with_restatement(events, self.restated_in(loads)), "drift-events") if loads else events

    @cached_property
    def lineage(self) -> tuple[DataFrame, DataFrame]:
        return lineage_tables(self.spark, EDGES, NODES)

    @cached_property
    def column_map(self) -> DataFrame:
        return (column_map(self.spark, "stg_orders", ORDERS, "order_id", ORDER_COLUMNS)
                .unionByName(column_map(self.spark, "stg_customers", CUSTOMERS, "cust_id", CUSTOMER_COLUMNS)))

    @cached_property
    def contract(self) -> DataFrame:
        rows = [(t, c["source"].upper(), c["type"], None, None) for t, cols in
                ((ORDERS, ORDER_COLUMNS), (CUSTOMERS, CUSTOMER_COLUMNS)) for c in cols]
        return source_contract(self.spark, rows)

    @cached_property
    def registry(self) -> DataFrame:
        return watch_registry(self.spark, [(ORDERS, True, "order_id", OWNERS[ORDERS]),
                                           (CUSTOMERS, True, "cust_id", OWNERS[CUSTOMERS])])

    def decided(self, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.lineage
        return decide(self.candidates, self.events if events is None else events, self.column_map, nodes, edges, PROJECT, self.policy)
