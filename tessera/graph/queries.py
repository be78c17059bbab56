"""The named graph queries.

A query whose result lists the paths of few starting nodes collects them in arrays
of structs; one that lists the paths of every node has a row for each path, so that
no row grows with the data. Starting nodes are limited before any hop, by id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import with_place
from ..sources.sinks import scratch
from .loader import Graph
from .traverse import Traversal


@dataclass(frozen=True)
class GraphQuery:
    description: str
    run: Callable[[Graph], DataFrame]


def first_nodes(graph: Graph, table: str, n: int) -> DataFrame:
    """The n smallest ids: a top-n that no task sees more of than n rows from each other task."""
    return graph.nodes[table].orderBy("id").limit(n)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted, with the place of each row. The sorted table is written, and its files tell the places, so no task sees all rows."""
    path = scratch(df.sparkSession)
    df.orderBy(*order).write.parquet(path)
    return with_place(df.sparkSession.read.schema(df.schema).parquet(path), "place").orderBy("place")


def _lists(base: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """``base`` (with id) and a list for each name; starts without paths have an empty list."""
    for name, found in lists.items():
        base = base.join(found.withColumnRenamed("start", "_start"), F.col("id") == F.col("_start"), "left").drop("_start")
        kind = found.schema[name].dataType.simpleString()
        base = base.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return base


def reliable_vendor_products(g: Graph, above: float = 90) -> DataFrame:
    """A row for each product of a vendor above the score, and one without a product for a vendor that has none.

    ``place`` numbers the rows by descending score, then by ids.
    """
    vendors = g.nodes["vendor"].filter(F.col("reliability_score") > above).select("id", "vendor_name", "reliability_score")
    products = Traversal(g, "vendor", vendors).out("supplies").pick(product_name="product_name", price="price", category="category", rating="rating").rows()
    found = vendors.join(products.withColumnRenamed("at", "product_id"), F.col("id") == F.col("start"), "left").drop("start")
    return in_order(found, F.desc("reliability_score"), "id", "product_id")


def customer_purchase_history(g: Graph, limit: int = 10) -> DataFrame:
    customers = first_nodes(g, "customer", limit)
    bought = Traversal(g, "customer", customers).out("purchased").pick(product_name="product_name", price="price", category="category")
    sellers = Traversal(g, "product", bought.paths.select(F.col("at").alias("id")).distinct()).in_("supplies").pick(vendor="vendor_name")
    vendor = sellers.aggregate(F.array_join(F.array_sort(F.collect_list("vendor")), ",").alias("vendor")).withColumnRenamed("start", "_product")
    paths = bought.paths.join(vendor, F.col("at") == F.col("_product"), "left")
    found = Traversal(g, "product", paths=paths).collect("purchases", "product_name", "price", "category", "vendor")
    return _lists(customers.select("id", "full_name"), {"purchases": found})


def _also_bought(g: Graph, products: DataFrame) -> Traversal:
    return Traversal(g, "product", products).in_("purchased").out("purchased").pick(name="product_name")


def related_products(g: Graph, limit: int = 5) -> DataFrame:
    """A row for each path from a product to one of its category, of its vendor, or bought by the same customers.

    ``relation`` tells which; a product is reached from itself too, and once for each path.
    """
    products = first_nodes(g, "product", limit)
    start = lambda: Traversal(g, "product", products)
    paths = {
        "same_category": start().out("belongs_to").in_("belongs_to"),
        "same_vendor": start().in_("supplies").out("supplies"),
        "co_purchased": start().in_("purchased").out("purchased"),
    }
    found = reduce(DataFrame.unionByName, [t.pick(related_name="product_name").rows().withColumn("relation", F.lit(name)) for name, t in paths.items()])
    x = products.select(F.col("id").alias("source_product"), "product_name").join(found.withColumnRenamed("at", "related_product"), F.col("source_product") == F.col("start"))
    return x.drop("start")


def co_purchased_products(g: Graph, limit: int = 5) -> DataFrame:
    products = first_nodes(g, "product", limit)
    found = _also_bought(g, products).aggregate(F.array_sort(F.collect_list("name")).alias("also_bought"))
    return _lists(products.select("id", "product_name"), {"also_bought": found}).withColumnRenamed("id", "source_product")


def top_customers_by_vendor(g: Graph) -> DataFrame:
    """A row for each path from vendor over product to customer."""
    paths = Traversal(g, "vendor").pick(vendor_name="vendor_name").out("supplies").in_("purchased").pick(full_name="full_name", total_spend="total_spend").rows()
    return paths.select(F.col("start").alias("id"), "vendor_name", F.col("at").alias("customer_id"), "full_name", "total_spend")


def vendor_influence(g: Graph) -> DataFrame:
    """customer_reach counts paths, distinct_customers the customers on them."""
    reach = Traversal(g, "vendor").out("supplies").in_("purchased").aggregate(F.count("*").alias("customer_reach"), F.countDistinct("at").alias("distinct_customers"))
    products = Traversal(g, "vendor").out("supplies").aggregate(F.count("*").alias("product_count"))
    base = g.nodes["vendor"].select("id", "vendor_name")
    for x in (reach, products):
        base = base.join(x.withColumnRenamed("start", "_start"), F.col("id") == F.col("_start"), "left").drop("_start")
    return base.select("id", "vendor_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customer_reach", "distinct_customers", "product_count")])


def invoice_reconciliation(g: Graph, limit: int = 10) -> DataFrame:
    invoices = first_nodes(g, "invoice", limit)
    items = Traversal(g, "invoice", invoices).out("invoice_item", {"quantity": "quantity", "line_total": "line_total"})
    lines = items.pick(product="product_name").collect("line_items", "product", "quantity", "line_total")
    total = items.aggregate(F.sum("line_total").alias("calculated_total")).withColumnRenamed("start", "_s")
    base = invoices.select("id", F.col("total_amount").alias("invoice_total")).join(total, F.col("id") == F.col("_s"), "left").drop("_s")
    return _lists(base.withColumn("calculated_total", F.coalesce("calculated_total", F.lit(0.0))), {"line_items": lines})


def overdue_vendors(g: Graph) -> DataFrame:
    """A row for each path from a vendor with an invoice that isn't paid to such an invoice or to a product it supplies.

    ``kind`` says which; the other's values are null. Beside the path: how many
    invoices, their sum, and how many products and how much stock.
    """
    values = {c: c for c in ("invoice_date", "due_date", "payment_date", "payment_terms")}
    unpaid = Traversal(g, "vendor").out("billed").pick(status="payment_status", amount="total_amount", **values).where(~F.col("status").eqNullSafe("paid"))
    owed = unpaid.aggregate(F.count("*").alias("overdue_invoices"), F.sum("amount").alias("overdue_amount"))
    supplied = Traversal(g, "vendor").out("supplies").pick(product_name="product_name", stock="stock_quantity")
    stock = supplied.aggregate(F.count("*").alias("supplied_products"), F.sum("stock").alias("supplied_stock"))
    x = g.nodes["vendor"].select("id", "vendor_name").join(owed, F.col("id") == F.col("start")).drop("start")
    x = x.join(stock, F.col("id") == F.col("start"), "left").drop("start")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("supplied_products", "supplied_stock")})
    invoices = unpaid.rows().select("start", F.lit("invoice").alias("kind"), F.col("at").alias("path_id"), F.col("status").alias("payment_status"), F.col("amount").alias("total_amount"), *values)
    products = supplied.rows().select("start", F.lit("product").alias("kind"), F.col("at").alias("path_id"), "product_name", F.col("stock").alias("stock_quantity"))
    return x.join(invoices.unionByName(products, allowMissingColumns=True), F.col("id") == F.col("start")).drop("start")


def vendor_payment_vs_sales(g: Graph) -> DataFrame:
    """Each side is aggregated by itself before the join; sums of nothing are 0 and means of nothing null."""
    billed = Traversal(g, "vendor").out("billed").pick(status="payment_status", amount="total_amount")
    paid = F.when(F.col("status") == "paid", F.col("amount"))
    cost = billed.aggregate(F.sum("amount").alias("total_invoiced"), (F.sum(paid) / F.nullif(F.count(paid), F.lit(0))).alias("avg_paid_invoice"))
    sales = Traversal(g, "vendor").out("supplies").in_("purchased", {"total_amount": "amount"})
    income = sales.aggregate(F.sum("amount").alias("total_revenue"), (F.sum("amount") / F.nullif(F.count("amount"), F.lit(0))).alias("avg_sale_amount"))
    x = g.nodes["vendor"].select("id", "vendor_name").join(cost, F.col("id") == F.col("start"), "left").drop("start")
    x = x.join(income, F.col("id") == F.col("start"), "left").drop("start")
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("total_invoiced", "total_revenue")]
    return x.select("id", "vendor_name", *zero, F.col("avg_paid_invoice").cast("double"), F.col("avg_sale_amount").cast("double"))


GRAPH_QUERIES = {
    "reliable_vendor_products": GraphQuery("Products of vendors with a reliability above 90", reliable_vendor_products),
    "customer_purchase_history": GraphQuery("Purchases of customers, with the vendor of each product", customer_purchase_history),
    "related_products": GraphQuery("Products of the same category, of the same vendor, or bought by the same customers", related_products),
    "co_purchased_products": GraphQuery("Products bought by the customers of a product", co_purchased_products),
    "top_customers_by_vendor": GraphQuery("Customers of each vendor's products, with what they spend", top_customers_by_vendor),
    "vendor_influence": GraphQuery("How many customers each vendor reaches", vendor_influence),
    "invoice_reconciliation": GraphQuery("Invoice totals beside the sums of their lines", invoice_reconciliation),
    "overdue_vendors": GraphQuery("Vendors with unpaid invoices, and what they supply", overdue_vendors),
    "vendor_payment_vs_sales": GraphQuery("What each vendor bills beside what its products sell", vendor_payment_vs_sales),
}


def get_query(name: str) -> GraphQuery:
    """The query of this name; KeyError with the known names if there is none."""
    if name not in GRAPH_QUERIES:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(GRAPH_QUERIES)}")
    return GRAPH_QUERIES[name]


def list_queries() -> list[str]:
    return list(GRAPH_QUERIES)
