"""Gold features: aggregate each side by its key, then join, so that no join fans out.

Amounts are summed as they come: exact where the column is a decimal. Averages are
the sum over the count. Shares that the feature rounds go through DECIMAL(18,3).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_between, months_between_starts, rounded_int


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _date(c: str) -> Column:
    return F.col(c).try_cast("date")


def _or_zero(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0))


def _rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(18,3)"), digits).cast("double")


def _mean(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 0, _double(F.sum(c)) / n)


def _steps(c: Column, steps: list[tuple[float, int]], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for most, score in reversed(steps):
        out = F.when(c <= most, score).otherwise(out)
    return out


# The steps of the scores and the weights of their mean; the tiers of prices.
RECENCY, FREQUENCY, MONETARY = [(30, 5), (90, 4), (180, 3), (365, 2)], [(2, 2), (5, 3), (10, 4)], [(100, 2), (500, 3), (1000, 4)]
WEIGHTS = (0.35, 0.35, 0.30)
#: Into how many parts the customers of a product are dealt, so that one task need not see all of them.
SHARES = 4
TIERS = [(50, "Low"), (200, "Medium"), (500, "High")]


def recency_score(days: Column) -> Column:
    return F.when(days.isNull(), 1).otherwise(_steps(days, RECENCY, 1))


def frequency_score(orders: Column) -> Column:
    return F.when(orders == 0, 1).otherwise(_steps(orders, FREQUENCY, 5))


def monetary_score(revenue: Column) -> Column:
    return F.when(revenue == 0, 1).otherwise(_steps(revenue, MONETARY, 5))


def price_tier(price: Column) -> Column:
    out = F.lit("Premium")
    for below, tier in reversed(TIERS):
        out = F.when(price < below, tier).otherwise(out)
    return out


def customer_stats(transactions: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    back = _or_zero(amount) < 0
    return transactions.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"),
        F.count_if(back).alias("return_count"),
        _double(F.sum(amount)).alias("total_revenue"),
        _double(F.sum(F.when(~back, amount).otherwise(0))).alias("gross_revenue"),
        _double(F.sum(F.when(back, amount).otherwise(0))).alias("return_amount"),
        _mean("total_amount").alias("avg_order_value"),
        F.min("transaction_date").alias("first_purchase"),
        F.max("transaction_date").alias("last_purchase"),
    )


def product_stats(transactions: DataFrame) -> DataFrame:
    # Rows are dealt as they come, narrower than sums begun before, by product and share of its customers. A share's sums and distinct customers need no further shuffle, and a product has few shares to add up.
    share = F.pmod(F.xxhash64("customer_id"), F.lit(SHARES))
    x = transactions.select("product_id", "customer_id", "total_amount", "quantity", "transaction_date").repartition("product_id", share)
    shares = x.groupBy("product_id", share.alias("_share")).agg(
        F.count("*").alias("times_sold"),
        F.count_if(_or_zero("total_amount") < 0).alias("return_count"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("total_amount").alias("total_revenue"),
        F.sum(F.when(_or_zero("total_amount") >= 0, F.col("total_amount")).otherwise(0)).alias("gross_revenue"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.min("transaction_date").alias("first_sale"),
        F.max("transaction_date").alias("last_sale"),
    )
    total = lambda c: F.sum(c).alias(c)
    return shares.groupBy("product_id").agg(
        total("times_sold"),
        total("return_count"),
        F.sum("total_quantity_sold").cast("bigint").alias("total_quantity_sold"),
        *[_double(F.sum(c)).alias(c) for c in ("total_revenue", "gross_revenue")],
        total("unique_customers"),
        F.min("first_sale").alias("first_sale"),
        F.max("last_sale").alias("last_sale"),
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    x = reviews.select("product_id", _double(F.col("rating")).alias("rating"))
    return x.groupBy("product_id").agg(F.count("*").alias("review_count"), _mean("rating").alias("avg_rating"))


def vendor_product_stats(products: DataFrame) -> DataFrame:
    return products.groupBy("vendor_id").agg(F.count("*").alias("total_products_supplied"), _mean("price").alias("avg_product_price"), _mean("rating").alias("product_quality_score"))


def vendor_invoice_stats(invoices: DataFrame) -> DataFrame:
    paid, due = _date("payment_date"), _date("due_date")
    on_time = (F.col("payment_status") == "paid") & (paid <= due)
    owed = F.when(F.col("payment_status") != "paid", _or_zero("total_amount")).otherwise(0)
    return invoices.groupBy("vendor_id").agg(
        F.count("*").alias("total_invoices"),
        _double(F.sum("total_amount")).alias("total_invoice_amount"),
        _mean("total_amount").alias("average_invoice_value"),
        F.count_if(on_time).alias("paid_on_time_invoices"),
        _double(F.sum(owed)).alias("total_outstanding_balance"),
    )


def vendor_revenue(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue by vendor; transactions are summed by product before the join."""
    sold = transactions.groupBy("product_id").agg(F.sum("total_amount").alias("amount"))
    return sold.join(products.select("product_id", "vendor_id"), "product_id").groupBy("vendor_id").agg(_double(F.sum("amount")).alias("revenue_generated"))


def line_item_stats(items: DataFrame) -> DataFrame:
    # Dealt by invoice, the distinct products, the sums and the join with invoices need no further shuffle. An invoice's items come out of one cell, so none has too many for a task.
    return items.select("invoice_id", "product_id", "line_total").repartition("invoice_id").groupBy("invoice_id").agg(F.countDistinct("product_id").alias("unique_products"), _double(F.sum("line_total")).alias("line_items_total"))


def line_item_stats_fallback(invoices: DataFrame, transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Without line items: the distinct products sold and the cost of all sales of the invoice's vendor."""
    sold = transactions.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    cost = sold.join(products.select("product_id", "vendor_id", "cost"), "product_id").groupBy("vendor_id")
    cost = cost.agg(F.countDistinct("product_id").alias("n"), _double(F.sum(F.col("cost") * F.col("quantity"))).alias("amount"))
    x = invoices.select("invoice_id", "vendor_id").join(cost, "vendor_id", "left")
    return x.select("invoice_id", _or_zero("n").alias("unique_products"), _or_zero("amount").alias("line_items_total"))


def customer_features(customers: DataFrame, transactions: DataFrame, reference_date: dt.date) -> DataFrame:
    day = F.lit(reference_date)
    x = customers.select("customer_id", "full_name", "segment", "total_spend", "registration_date").join(customer_stats(transactions), "customer_id", "left")
    tenure = months_between_starts(_date("registration_date"), day)
    x = x.select(
        "customer_id",
        "full_name",
        "segment",
        _or_zero("total_spend").alias("total_spend"),
        *[_or_zero(c).alias(c) for c in ("total_orders", "return_count", "total_revenue", "gross_revenue", "return_amount")],
        _or_zero("avg_order_value").alias("average_order_value"),
        "first_purchase",
        "last_purchase",
        days_between(_date("last_purchase"), day).alias("days_since_last_purchase"),
        tenure.alias("customer_tenure_months"),
        F.when(tenure > 0, _double(F.col("total_orders")) / tenure).otherwise(_double(_or_zero("total_orders"))).alias("purchase_frequency"),
    )
    months = F.col("customer_tenure_months")
    x = x.withColumn("customer_lifetime_value", F.when(months > 0, F.col("total_revenue") / months * 12).otherwise(F.col("total_revenue")))
    x = x.withColumns({"recency_score": recency_score(F.col("days_since_last_purchase")), "frequency_score": frequency_score(F.col("total_orders")), "monetary_score": monetary_score(F.col("total_revenue"))})
    mean = sum((F.col(f"{name}_score").cast("decimal(4,0)") * F.lit(str(w)).cast("decimal(4,2)") for name, w in zip(("frequency", "monetary"), WEIGHTS[1:], strict=True)), F.col("recency_score").cast("decimal(4,0)") * F.lit(str(WEIGHTS[0])).cast("decimal(4,2)"))
    return x.select(*[c for c in x.columns if not c.endswith("_score")], _rounded(mean, 2).alias("customer_segment_score"), "recency_score", "frequency_score", "monetary_score")


def product_features(products: DataFrame, transactions: DataFrame, reviews: DataFrame, vendors: DataFrame) -> DataFrame:
    x = products.select("product_id", "product_name", "category", "vendor_id", _double(F.col("price")).alias("price"), _double(F.col("cost")).alias("cost"), rounded_int(F.col("stock_quantity")).alias("stock_quantity"))
    x = x.join(product_stats(transactions), "product_id", "left").join(review_stats(reviews), "product_id", "left")
    x = x.join(vendors.select("vendor_id", _double(F.col("reliability_score")).alias("reliability")), "vendor_id", "left")
    price, stock, months = F.col("price"), F.col("stock_quantity"), months_between_starts(_date("first_sale"), _date("last_sale"))
    sold = _double(_or_zero("times_sold"))
    weighted = F.when(F.col("reliability").isNotNull() & F.col("avg_rating").isNotNull(), _rounded(F.col("avg_rating") * F.col("reliability") / 100, 2))
    return x.select(
        "product_id",
        "product_name",
        "category",
        "vendor_id",
        "price",
        "cost",
        "stock_quantity",
        _or_zero("times_sold").alias("times_sold"),
        _or_zero("total_quantity_sold").alias("total_quantity_sold"),
        _or_zero("total_revenue").alias("revenue_contribution"),
        _or_zero("unique_customers").alias("unique_customers"),
        _or_zero("review_count").alias("review_count"),
        _or_zero("avg_rating").alias("avg_rating"),
        F.when(price > 0, (price - _or_zero("cost")) / price).otherwise(0.0).alias("profit_margin"),
        price_tier(price).alias("price_tier"),
        F.when(months > 0, sold / months).otherwise(sold).alias("velocity_score"),
        F.when(stock > 0, _double(_or_zero("total_quantity_sold")) / stock).otherwise(0.0).alias("stock_turnover_rate"),
        F.coalesce(weighted, _or_zero("avg_rating")).alias("vendor_reliability_weighted_score"),
    )


def vendor_features(vendors: DataFrame, products: DataFrame, invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    x = vendors.select("vendor_id", "vendor_name", "country", "region", _double(F.col("reliability_score")).alias("reliability_score"), "status")
    for stats in (vendor_product_stats(products), vendor_invoice_stats(invoices), vendor_revenue(transactions, products)):
        x = x.join(stats, "vendor_id", "left")
    n, supplied = _or_zero("total_invoices"), _or_zero("total_products_supplied")
    zero = ("total_products_supplied", "avg_product_price", "product_quality_score", "total_invoices", "total_invoice_amount", "average_invoice_value", "revenue_generated", "total_outstanding_balance")
    return x.select(
        "vendor_id",
        "vendor_name",
        "country",
        "region",
        "reliability_score",
        "status",
        *[_or_zero(c).alias(c) for c in zero],
        F.when(n > 0, _rounded(_double(F.col("paid_on_time_invoices")) / n, 3)).otherwise(0.0).alias("invoice_payment_rate"),
        F.when(supplied > 0, _or_zero("revenue_generated") / supplied).otherwise(0.0).alias("revenue_per_product"),
    )


def reconciliation_flag(total: Column, lines: Column) -> Column:
    off = F.abs(total - lines) / F.greatest(F.abs(total), F.lit(0.01)) > 0.1
    return F.when(lines.isNotNull() & off, "MISMATCH").when(lines.isNull(), "NO_REFERENCE").otherwise("OK")


def invoice_features(invoices: DataFrame, stats: DataFrame, reference_date: dt.date) -> DataFrame:
    """``stats``: of ``line_item_stats`` or its fallback. Terms like NET30 give the days where the dates don't."""
    day, due, sent = F.lit(reference_date), _date("due_date"), _date("invoice_date")
    x = invoices.select("invoice_id", "vendor_id", "invoice_date", "due_date", "payment_date", _double(F.col("total_amount")).alias("total_amount"), "payment_status", "payment_terms")
    x = x.join(stats, "invoice_id", "left")
    terms = F.regexp_extract("payment_terms", r"(\d+)", 1).try_cast("bigint")
    taken = days_between(sent, _date("payment_date"))
    late = (F.col("payment_status") != "paid") & (due < day)
    return x.select(
        *invoices.select("invoice_id", "vendor_id", "invoice_date", "due_date", "payment_date").columns,
        "total_amount",
        "payment_status",
        "payment_terms",
        F.coalesce(days_between(sent, due), terms).alias("payment_terms_days"),
        taken.alias("days_to_payment"),
        F.when(late, days_between(due, day)).otherwise(F.lit(0).cast("bigint")).alias("days_overdue"),
        F.coalesce(late, F.lit(False)).alias("is_overdue"),
        _or_zero("unique_products").alias("line_item_diversity"),
        F.when(taken.isNotNull() & (terms > 0), _rounded(1.0 - _double(taken) / _double(terms), 3)).alias("discount_rate_achieved"),
        reconciliation_flag(F.col("total_amount"), F.col("line_items_total")).alias("reconciliation_flag"),
    )
