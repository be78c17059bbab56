"""The engine's entities as views of the star-schema test tables: DataFrames, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that "today" means over the test tables, whose orders end in 2001.
DAY = dt.date(2001, 9, 1)


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _code(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.hex(c.cast("bigint")))


def _cents(c: Column, kind: str = "decimal(18,2)") -> Column:
    return c.cast(kind)


class Adapters:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.read = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.read[name]

    @cached_property
    def places(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their signed amount in cents: returns are negative."""
        amount = _cents(F.col("l_extendedprice")) * (1 - _cents(F.col("l_discount"), "decimal(4,2)")) * (1 + _cents(F.col("l_tax"), "decimal(4,2)"))
        return self.table("lineitem").withColumn("amount", _cents(F.round(F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount), 2)))

    @cached_property
    def customers(self) -> DataFrame:
        first = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("registration_date"))
        x = self.table("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        return x.select(_id("CUS-", "c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("total_spend"), "registration_date", F.col("n_name").alias("country"), F.col("r_name").alias("region"))

    @cached_property
    def transactions(self) -> DataFrame:
        x = self.lines.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return x.select(
            _code("TXN-", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            _id("CUS-", "o_custkey").alias("customer_id"),
            _id("PRD-", "l_partkey").alias("product_id"),
            F.col("o_orderdate").cast("date").alias("transaction_date"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("amount").alias("total_amount"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("l_discount").alias("discount_percent"),
            F.col("l_tax").alias("tax_rate"),
        )

    @cached_property
    def products(self) -> DataFrame:
        maker = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("supp"))
        x = self.table("part").join(maker, F.col("p_partkey") == F.col("l_partkey"), "left")
        return x.select(
            _id("PRD-", "p_partkey").alias("product_id"),
            _id("VND-", "supp").alias("vendor_id"),
            F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            _cents(F.col("p_retailprice")).alias("price"),
            _cents(F.round(_cents(F.col("p_retailprice")) * F.lit("0.60").cast("decimal(3,2)"), 2)).alias("cost"),
            F.col("p_size").alias("stock_quantity"),
            (F.col("p_size") % 50 / 10.0).alias("rating"),
        )

    @cached_property
    def vendors(self) -> DataFrame:
        x = self.table("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("s_acctbal") + 1000) / 110))
        return x.select(_id("VND-", "s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), score.alias("reliability_score"), F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"))

    @cached_property
    def invoices(self) -> DataFrame:
        of = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.max("l_shipdate").cast("date").alias("shipped"))
        x = self.table("orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
        return x.select(
            _code("INV-", F.col("o_orderkey")).alias("invoice_id"),
            _id("VND-", "supp").alias("vendor_id"),
            day.alias("invoice_date"),
            F.date_add(day, 30).alias("due_date"),
            F.when(status == "F", F.col("shipped")).alias("payment_date"),
            _cents(F.col("o_totalprice")).alias("total_amount"),
            F.when(status == "F", "paid").when(status == "O", "pending").otherwise("partial").alias("payment_status"),
            F.lit("NET30").alias("payment_terms"),
        )

    @cached_property
    def invoice_line_items(self) -> DataFrame:
        unit = _cents(F.col("l_extendedprice"))
        return self.lines.select(_code("INV-", F.col("l_orderkey")).alias("invoice_id"), F.col("l_linenumber").cast("bigint").alias("line_number"), _id("PRD-", "l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), unit.alias("unit_cost"), F.abs("amount").alias("line_total"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    @cached_property
    def reviews(self) -> DataFrame:
        x = self.events.filter("event_type = 'purchase'")
        return x.select(_id("REV-", "event_id").alias("review_id"), _id("PRD-", "k").alias("product_id"), _id("CUS-", "user_id").alias("customer_id"), (1 + F.col("k") % 5).alias("rating"), F.when(F.col("k") % 5 < 2, "negative").otherwise("positive").alias("sentiment"), (F.col("k") % 2 == 0).alias("verified_purchase"))

    @cached_property
    def support_tickets(self) -> DataFrame:
        x = self.events.filter("event_type = 'error'")
        return x.select(_id("TKT-", "event_id").alias("ticket_id"), _id("CUS-", "user_id").alias("customer_id"), _id("PRD-", "k").alias("product_id"), F.concat(F.lit("AGT-"), (F.col("event_id") % 7).cast("string")).alias("agent_id"), F.lit("open").alias("status"), F.lit("high").alias("priority"), (1 + F.col("k") % 5).alias("satisfaction_score"))

    @cached_property
    def call_transcripts(self) -> DataFrame:
        x = self.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
        name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Name "), F.col("conv_id").cast("string")))
        return x.select(_id("CALL-", "conv_id").alias("call_id"), _id("TKT-", "conv_id").alias("ticket_id"), F.concat(F.lit("AGT-"), (F.col("conv_id") % 9).cast("string")).alias("agent_id"), name.alias("agent_name"), (F.col("turns") * 10).alias("duration_seconds"))

    @cached_property
    def silver(self) -> dict[str, DataFrame]:
        names = ("vendors", "customers", "products", "transactions", "invoices", "invoice_line_items", "reviews", "support_tickets", "call_transcripts")
        return {n: getattr(self, n) for n in names}


_AMOUNT = "CAST(ROUND((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))"
_EVENTS = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"

VIEWS = {
    "lines": f"SELECT *, {_AMOUNT} AS amount FROM lineitem",
    "customers": """SELECT 'CUS-' || c_custkey AS customer_id, c_name AS full_name, c_mktsegment AS segment, c_acctbal AS total_spend, registration_date, n_name AS country, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS registration_date FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "transactions": """SELECT 'TXN-' || printf('%X', l_orderkey * 10 + l_linenumber) AS transaction_id, 'CUS-' || o_custkey AS customer_id, 'PRD-' || l_partkey AS product_id, CAST(o_orderdate AS DATE) AS transaction_date,
        CAST(l_quantity AS BIGINT) AS quantity, amount AS total_amount, o_orderstatus AS order_status, l_discount AS discount_percent, l_tax AS tax_rate
        FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "products": """SELECT 'PRD-' || p_partkey AS product_id, 'VND-' || supp AS vendor_id, p_brand || '-' || p_partkey AS sku, p_name AS product_name, p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
        CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.60 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cost, p_size AS stock_quantity, CAST(p_size % 50 AS DOUBLE) / 10.0 AS rating
        FROM part LEFT JOIN (SELECT l_partkey, MIN(l_suppkey) AS supp FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "vendors": """SELECT 'VND-' || s_suppkey AS vendor_id, s_name AS vendor_name, n_name AS country, r_name AS region, LEAST(100.0, GREATEST(0.0, (s_acctbal + 1000) / 110)) AS reliability_score,
        CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "invoices": """SELECT 'INV-' || printf('%X', o_orderkey) AS invoice_id, 'VND-' || supp AS vendor_id, CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date,
        CASE WHEN o_orderstatus = 'F' THEN shipped END AS payment_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'partial' END AS payment_status, 'NET30' AS payment_terms
        FROM orders LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS supp, CAST(MAX(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "invoice_line_items": """SELECT 'INV-' || printf('%X', l_orderkey) AS invoice_id, CAST(l_linenumber AS BIGINT) AS line_number, 'PRD-' || l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_cost, ABS(amount) AS line_total FROM lines""",
    "reviews": f"""SELECT 'REV-' || event_id AS review_id, 'PRD-' || k AS product_id, 'CUS-' || user_id AS customer_id, 1 + k % 5 AS rating,
        CASE WHEN k % 5 < 2 THEN 'negative' ELSE 'positive' END AS sentiment, k % 2 = 0 AS verified_purchase FROM {_EVENTS} WHERE event_type = 'purchase'""",
    "support_tickets": f"""SELECT 'TKT-' || event_id AS ticket_id, 'CUS-' || user_id AS customer_id, 'PRD-' || k AS product_id, 'AGT-' || (event_id % 7) AS agent_id, 'open' AS status, 'high' AS priority, 1 + k % 5 AS satisfaction_score
        FROM {_EVENTS} WHERE event_type = 'error'""",
    "call_transcripts": """SELECT 'CALL-' || conv_id AS call_id, 'TKT-' || conv_id AS ticket_id, 'AGT-' || (conv_id % 9) AS agent_id, CASE WHEN conv_id % 3 = 0 THEN 'Name ' || conv_id END AS agent_name, COUNT(*) * 10 AS duration_seconds
        FROM conversations GROUP BY conv_id""",
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` behind the views, and further ones, that it names, directly or through another."""
    views = VIEWS | (more or {})
    need, queue = [], [body]
    while queue:
        text = queue.pop()
        for name in views:
            if name not in need and f" {name}" in f" {text}".replace("(", " ").replace("\n", " "):
                need.append(name)
                queue.append(views[name])
    made = ",\n".join(f"{n} AS ({views[n]})" for n in views if n in need)
    return f"WITH {made}\n{body}" if made else body
