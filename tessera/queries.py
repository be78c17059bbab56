"""One query for each operator over the test tables, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import DAY, Adapters, with_views
from .functions import scalars as S
from .graph.loader import build, sizes
from .graph.queries import GRAPH_QUERIES
from .graph.schema import EDGES, NODES
from .operators.integrity import judge, judge_line_items, keep_first, line_items, orphans, quarantined, valid
from .operators.validation import histogram, validate
from .plans import features as G
from .sources.reader import flatten, with_lineage
from .sources.sinks import scratch, write_table
from .specs import ENTITIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_DAY = f"DATE '{DAY}'"


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as ``yyyy-MM-dd``, which both engines print alike."""
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


def query(sql: str | None, more: dict[str, str] | None = None, name: str | None = None):
    """Register a function of Adapters under its name, with its SQL over the views."""

    def put(f: Callable[[Adapters], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: _dates_as_text(f(Adapters(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[key] = with_views(sql, more)
        return f

    return put


# --- scans ---------------------------------------------------------------------


@query("SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS props_k FROM events")
def scan_json_flatten_events(a):
    return flatten(a.table("events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props")))


@query("SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS missing, 'part.parquet' AS _source_file, '2001-09-01T00:00:00' AS _loaded_at FROM part")
def lineage_projection(a):
    return with_lineage(a.table("part").select("p_partkey", "p_name", F.lit(None).cast("string").alias("missing")), "part.parquet", "2001-09-01T00:00:00")


# --- cleaning ------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_brand || p_name) AS low, upper(p_name) AS up, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(p_type || ' oN ' || p_name, ' ')], ' ') AS title FROM part")
def clean_case(a):
    return a.table("part").select("p_partkey", S.lowercase(F.concat("p_brand", "p_name")).alias("low"), S.uppercase(F.col("p_name")).alias("up"), S.titlecase(F.concat_ws(" oN ", "p_type", "p_name")).alias("title"))


@query("SELECT c_custkey, '555' || c_custkey || c_nationkey || CASE WHEN c_custkey % 7 = 0 THEN 'UNLISTED' ELSE '' END AS phone FROM customer")
def clean_phone(a):
    raw = F.concat(F.lit("+(555) "), F.col("c_custkey").cast("string"), F.lit(" - "), F.col("c_nationkey").cast("string"), F.lit(".\t"), F.when(F.col("c_custkey") % 7 == 0, "UNLISTED").otherwise(""))
    return a.table("customer").select("c_custkey", S.phone(raw).alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 2, 4) THEN 'true' WHEN c_custkey % 6 IN (1, 5) THEN 'false' END AS flag FROM customer")
def clean_boolean(a):
    words = F.array(*map(F.lit, ("Yes", "no", "1", "maybe", "TRUE", "N")))
    return a.table("customer").select("c_custkey", S.boolean(words[(F.col("c_custkey") % 6).cast("int")]).cast("string").alias("flag"))


@query("SELECT p_partkey, p_name || ' x y' AS trimmed, ' ' || p_name || ' x y ' AS collapsed, p_name || chr(9) || '  x  y' AS stripped FROM part")
def clean_whitespace(a):
    raw = F.concat(F.lit(" \n"), F.col("p_name"), F.lit("\t  x  y "))
    return a.table("part").select("p_partkey", S.trim_all(raw).alias("trimmed"), S.collapse(raw).alias("collapsed"), S.strip(raw).alias("stripped"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def clean_date_mixed(a):
    day = F.col("o_orderdate").cast("date")
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'09:30:00'Z'")]
    raw = F.when(F.col("o_orderkey") % 7 == 6, "soon").when(F.col("o_orderkey") % 7 == 5, F.unix_timestamp(day.cast("timestamp")).cast("string"))
    for k, form in enumerate(forms):
        raw = raw.when(F.col("o_orderkey") % 7 == k, form)
    return a.table("orders").select("o_orderkey", S.date_iso(raw, DAY).alias("day"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.7 END AS f, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS BIGINT) END AS cut,
    CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS near, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) END AS lax, p_partkey % 4 = 2 AS b, CASE WHEN p_partkey % 4 < 3 THEN CASE p_partkey % 4 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size || '.7' ELSE 'yes' END END AS s FROM part""")
def safe_casts(a):
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    x = a.table("part").select("p_partkey", F.when(m == 0, F.concat(size, F.lit(".0"))).when(m == 1, F.concat(size, F.lit(".7"))).when(m == 2, " yes ").otherwise("null").alias("r"))
    r = F.col("r")
    return x.select("p_partkey", S.safe_float(r).alias("f"), S.safe_int(r).alias("cut"), S.rounded_int(r).alias("near"), S.lax_int(r).alias("lax"), S.safe_bool(F.trim(r)).alias("b"), S.safe_str(r).alias("s"))


@query("SELECT p_partkey, p_name || 'x' AS id, replace(replace(p_name, ' ', '_'), '&', 'and') || '_and_b' AS slug FROM part")
def sanitize_ids(a):
    return a.table("part").select("p_partkey", S.sanitize_id(F.concat(F.lit(" `"), F.col("p_name"), F.lit("\u0007x` "))).alias("id"), S.slug(F.concat("p_name", F.lit(" & b"))).alias("slug"))


# --- validation ----------------------------------------------------------------


def _products_raw(a):
    """Products as strings, with one fault by key: a rating too high, a price below zero, no name, a bad id, a bad number."""
    x = a.products
    n = F.substring("product_id", 5, 20).cast("bigint")
    return x.select(
        F.when(n % 11 == 4, F.concat(F.lit("P-"), n.cast("string"))).otherwise(F.col("product_id")).alias("product_id"),
        "vendor_id",
        "sku",
        F.when(n % 11 != 3, F.col("product_name")).alias("product_name"),
        F.when(n % 11 == 2, -F.col("price")).otherwise(F.col("price")).cast("string").alias("price"),
        F.when(n % 11 == 1, "9.5").otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(n % 11 == 5, "3.5").otherwise(F.col("stock_quantity").cast("string")).alias("stock_quantity"),
        n.alias("_row_id"),
    )


_KIND = "CASE CAST(substr(product_id, 5) AS BIGINT) % 11 WHEN 1 THEN 'less_than_equal' WHEN 2 THEN 'greater_than_equal' WHEN 3 THEN 'missing' WHEN 4 THEN 'string_pattern_mismatch' WHEN 5 THEN 'int_parsing' END"
_FIELD = "CASE CAST(substr(product_id, 5) AS BIGINT) % 11 WHEN 1 THEN 'rating' WHEN 2 THEN 'price' WHEN 3 THEN 'product_name' WHEN 4 THEN 'product_id' WHEN 5 THEN 'stock_quantity' END"


def _failed(a, kind):
    x = validate(_products_raw(a), ENTITIES["product"], DAY).select("_row_id", F.explode("_errors").alias("e"))
    return x.filter(F.col("e.type") == kind).select(F.col("_row_id").alias("n"), F.col("e.field").alias("field"))


@query("SELECT CAST(substr(product_id, 5) AS BIGINT) AS n, 'rating' AS field FROM products WHERE CAST(substr(product_id, 5) AS BIGINT) % 11 = 1")
def validate_range(a):
    return _failed(a, "less_than_equal")


@query("SELECT CAST(substr(product_id, 5) AS BIGINT) AS n, 'product_id' AS field FROM products WHERE CAST(substr(product_id, 5) AS BIGINT) % 11 = 4")
def validate_pattern(a):
    return _failed(a, "string_pattern_mismatch")


@query("SELECT CAST(substr(product_id, 5) AS BIGINT) AS n, 'product_name' AS field FROM products WHERE CAST(substr(product_id, 5) AS BIGINT) % 11 = 3")
def validate_required(a):
    return _failed(a, "missing")


@query("SELECT CAST(substr(product_id, 5) AS BIGINT) AS n, 'stock_quantity' AS field FROM products WHERE CAST(substr(product_id, 5) AS BIGINT) % 11 = 5")
def validate_integer(a):
    return _failed(a, "int_parsing")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey || '@example.com' END AS email FROM customer")
def email_nullify(a):
    n = F.col("c_custkey")
    raw = F.when(n % 5 == 0, F.concat(F.lit("c"), n.cast("string"), F.lit("@example.com"))).when(n % 5 == 1, "N/A").when(n % 5 == 2, "user@").when(n % 5 == 3, "not an@email.com")
    return a.table("customer").select("c_custkey", S.email_or_null(raw).alias("email"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1999-06-15' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def future_date_nullify(a):
    import datetime as dt

    return a.table("orders").select("o_orderkey", S.not_future(F.date_format("o_orderdate", "yyyy-MM-dd"), dt.date(1999, 6, 15)).alias("day"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax * (l_linenumber * 10 - 10) BETWEEN 0 AND 1 THEN l_tax * (l_linenumber * 10 - 10) END AS rate FROM lineitem")
def tax_rate_nullify(a):
    return a.table("lineitem").select("l_orderkey", "l_linenumber", S.unit_interval(F.col("l_tax") * (F.col("l_linenumber") * 10 - 10)).alias("rate"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'credit_card' WHEN 1 THEN lower(replace(o_orderpriority, ' ', '_')) END AS method FROM orders")
def payment_method_normalize(a):
    m = F.col("o_orderkey") % 3
    return a.table("orders").select("o_orderkey", S.snake(F.when(m == 0, " Credit Card ").when(m == 1, F.col("o_orderpriority")).otherwise("  ")).alias("method"))


@query(f"SELECT {_KIND} AS type, COUNT(*) AS n FROM products WHERE {_KIND} IS NOT NULL GROUP BY 1")
def error_histogram(a):
    return histogram(validate(_products_raw(a), ENTITIES["product"], DAY))


@query(f"SELECT 'products' AS source, COUNT(*) AS total, COUNT(*) - COUNT({_KIND}) AS valid, (COUNT(*) - COUNT({_KIND})) / CAST(COUNT(*) AS DOUBLE) AS pass_rate FROM products")
def pass_rate_by_source(a):
    x = validate(_products_raw(a), ENTITIES["product"], DAY)
    good = F.count_if(F.size("_errors") == 0)
    return x.agg(F.count("*").alias("total"), good.alias("valid"), (good / F.count("*")).alias("pass_rate")).select(F.lit("products").alias("source"), "*")


@query(f"SELECT CAST(substr(product_id, 5) AS BIGINT) AS row_index, {_FIELD} AS field, {_KIND} AS type FROM products WHERE {_KIND} IS NOT NULL")
def quarantine_split(a):
    x = quarantined(judge(_products_raw(a), ENTITIES["product"], {}, DAY))
    return x.select("row_index", F.explode("errors").alias("e")).select("row_index", "e.field", "e.type")


@query(f"SELECT product_id, vendor_id, product_name, CAST(price AS DOUBLE) AS price, CAST(stock_quantity AS BIGINT) AS stock_quantity, CAST(NULL AS VARCHAR) AS tags FROM products WHERE {_KIND} IS NULL")
def model_projection(a):
    return valid(judge(_products_raw(a), ENTITIES["product"], {}, DAY)).select("product_id", "vendor_id", "product_name", "price", "stock_quantity", "tags")


# --- dedup and references --------------------------------------------------------

_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(_LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)}) = 1")
def dedup_keep_first(a):
    return keep_first(a.table("lineitem"), ["l_orderkey", "l_linenumber"], _LINE)


@query("SELECT COUNT(*) AS total, COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicates_removed FROM lineitem")
def duplicates_removed(a):
    per_key = a.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("total"), (F.sum("n") - F.count("*")).alias("duplicates_removed"))


def _known_products(a):
    return a.products.filter(F.substring("product_id", 5, 20).cast("bigint") % 50 != 0)


_KNOWN = {"known": "SELECT * FROM products WHERE CAST(substr(product_id, 5) AS BIGINT) % 50 <> 0"}


@query("SELECT transaction_id, product_id, total_amount FROM transactions WHERE product_id NOT IN (SELECT product_id FROM known)", _KNOWN)
def fk_orphans_anti(a):
    return orphans(a.transactions, {"product_id": _known_products(a).select("product_id")}).filter(F.size("_orphan") > 0).select("transaction_id", "product_id", "total_amount")


@query("SELECT transaction_id, product_id FROM transactions WHERE product_id IN (SELECT product_id FROM known)", _KNOWN)
def fk_valid_semi(a):
    return a.transactions.join(_known_products(a).select("product_id").distinct(), "product_id", "left_semi").select("transaction_id", "product_id")


_CASCADE = {
    "good": f"SELECT product_id FROM products WHERE {_KIND} IS NULL",
    "judged": "SELECT review_id, product_id IN (SELECT product_id FROM good) AS p, customer_id IN (SELECT customer_id FROM customers) AS c FROM reviews",
}


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE p AND c) AS valid, COUNT(*) FILTER (WHERE NOT (p AND c)) AS orphaned, COUNT(*) FILTER (WHERE NOT p AND NOT c) AS twice FROM judged", _CASCADE)
def fk_cascade(a):
    products = valid(judge(_products_raw(a), ENTITIES["product"], {}, DAY)).select("product_id")
    x = judge(a.reviews, ENTITIES["review"], {"product": products, "customer": a.customers.select("customer_id")}, DAY)
    lost = F.size(F.filter("_errors", lambda e: e["type"] == "referential_integrity"))
    return x.agg(F.count("*").alias("total"), F.count_if(lost == 0).alias("valid"), F.count_if(lost > 0).alias("orphaned"), F.count_if(lost == 2).alias("twice"))


def _with_json(a):
    item = F.struct(F.col("line_number").cast("string").alias("line_number"), "product_id", F.col("quantity").cast("string").alias("quantity"), F.col("line_total").cast("string").alias("line_total"))
    # Dealt as they come: a list for each part of an invoice would be wider than its rows.
    items = a.invoice_line_items.select("invoice_id", "line_number", "product_id", "quantity", "line_total").repartition("invoice_id")
    # Texts sort as their fields do, as a quote comes before all characters in them, and cost far less than structs.
    return items.groupBy("invoice_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.to_json(item))), ","), F.lit("]")).alias("line_items_json"))


_PAID = {"paid": "SELECT invoice_id FROM invoices WHERE payment_status = 'paid'"}


@query("SELECT invoice_id, CAST(line_number AS VARCHAR) AS line_number, product_id, CAST(quantity AS VARCHAR) AS quantity, CAST(line_total AS DOUBLE) AS line_total FROM invoice_line_items WHERE invoice_id IN (SELECT invoice_id FROM paid)", _PAID)
def line_items_explode(a):
    x = line_items(_with_json(a), a.invoices.filter("payment_status = 'paid'"))
    return x.select("invoice_id", "line_number", "product_id", "quantity", F.col("line_total").cast("double").alias("line_total"))


@query("SELECT product_id IN (SELECT product_id FROM known) AS ok, COUNT(*) AS n FROM invoice_line_items GROUP BY 1", _KNOWN)
def line_items_fk(a):
    x = judge_line_items(line_items(_with_json(a)), _known_products(a).select("product_id"), DAY)
    return x.groupBy((F.size("_errors") == 0).alias("ok")).agg(F.count("*").alias("n"))


# --- aggregates and features -----------------------------------------------------

_BACK = "COALESCE(total_amount, 0) < 0"
_STATS = {
    "cstats": f"""SELECT customer_id, COUNT(*) AS total_orders, COUNT(*) FILTER (WHERE {_BACK}) AS return_count, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
        CAST(SUM(CASE WHEN {_BACK} THEN 0 ELSE total_amount END) AS DOUBLE) AS gross_revenue, CAST(SUM(CASE WHEN {_BACK} THEN total_amount ELSE 0 END) AS DOUBLE) AS return_amount,
        CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value, MIN(transaction_date) AS first_purchase, MAX(transaction_date) AS last_purchase FROM transactions GROUP BY customer_id""",
    "pstats": f"""SELECT product_id, COUNT(*) AS times_sold, COUNT(*) FILTER (WHERE {_BACK}) AS return_count, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
        CAST(SUM(CASE WHEN {_BACK} THEN 0 ELSE total_amount END) AS DOUBLE) AS gross_revenue, COUNT(DISTINCT customer_id) AS unique_customers, MIN(transaction_date) AS first_sale, MAX(transaction_date) AS last_sale
        FROM transactions GROUP BY product_id""",
    "rstats": "SELECT product_id, COUNT(*) AS review_count, CAST(SUM(rating) AS DOUBLE) / COUNT(rating) AS avg_rating FROM reviews GROUP BY product_id",
    "vpstats": "SELECT vendor_id, COUNT(*) AS total_products_supplied, CAST(SUM(price) AS DOUBLE) / COUNT(price) AS avg_product_price, CAST(SUM(CAST(rating AS DECIMAL(9,1))) AS DOUBLE) / COUNT(rating) AS product_quality_score FROM products GROUP BY vendor_id",
    "vistats": """SELECT vendor_id, COUNT(*) AS total_invoices, CAST(SUM(total_amount) AS DOUBLE) AS total_invoice_amount, CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS average_invoice_value,
        COUNT(*) FILTER (WHERE payment_status = 'paid' AND payment_date <= due_date) AS paid_on_time_invoices, CAST(SUM(CASE WHEN payment_status <> 'paid' THEN total_amount ELSE 0 END) AS DOUBLE) AS total_outstanding_balance
        FROM invoices GROUP BY vendor_id""",
    "vrev": "SELECT vendor_id, CAST(SUM(total_amount) AS DOUBLE) AS revenue_generated FROM transactions JOIN products USING (product_id) GROUP BY vendor_id",
    "lstats": "SELECT invoice_id, COUNT(DISTINCT product_id) AS unique_products, CAST(SUM(line_total) AS DOUBLE) AS line_items_total FROM invoice_line_items GROUP BY invoice_id",
    "fstats": """SELECT invoice_id, COALESCE(n, 0) AS unique_products, COALESCE(amount, 0) AS line_items_total FROM invoices LEFT JOIN
        (SELECT vendor_id, COUNT(DISTINCT t.product_id) AS n, CAST(SUM(cost * quantity) AS DOUBLE) AS amount FROM transactions t JOIN products p ON t.product_id = p.product_id GROUP BY vendor_id) s USING (vendor_id)""",
}


def _exact_rating(products):
    return products.withColumn("rating", F.col("rating").cast("decimal(9,1)"))


@query("SELECT * REPLACE (CAST(first_purchase AS VARCHAR) AS first_purchase, CAST(last_purchase AS VARCHAR) AS last_purchase) FROM cstats", _STATS)
def txn_stats_customer(a):
    return G.customer_stats(a.transactions)


@query("SELECT * REPLACE (CAST(first_sale AS VARCHAR) AS first_sale, CAST(last_sale AS VARCHAR) AS last_sale) FROM pstats", _STATS)
def txn_stats_product(a):
    return G.product_stats(a.transactions)


@query("SELECT * FROM rstats", _STATS)
def review_stats(a):
    return G.review_stats(a.reviews)


@query("SELECT * FROM vpstats", _STATS)
def vendor_product_stats(a):
    return G.vendor_product_stats(_exact_rating(a.products))


@query("SELECT * FROM vistats", _STATS)
def vendor_invoice_stats(a):
    return G.vendor_invoice_stats(a.invoices)


@query("SELECT * FROM vrev", _STATS)
def vendor_revenue(a):
    return G.vendor_revenue(a.transactions, a.products)


@query("SELECT * FROM lstats", _STATS)
def line_item_stats(a):
    return G.line_item_stats(a.invoice_line_items)


@query("SELECT * FROM fstats", _STATS)
def line_item_stats_fallback(a):
    return G.line_item_stats_fallback(a.invoices, a.transactions, a.products)


_CUSTOMER = _STATS | {
    "raw_": f"""SELECT customer_id, full_name, segment, COALESCE(total_spend, 0) AS total_spend, COALESCE(total_orders, 0) AS total_orders, COALESCE(return_count, 0) AS return_count, COALESCE(total_revenue, 0) AS total_revenue,
        COALESCE(gross_revenue, 0) AS gross_revenue, COALESCE(return_amount, 0) AS return_amount, COALESCE(avg_order_value, 0) AS average_order_value, first_purchase, last_purchase,
        date_diff('day', last_purchase, {_DAY}) AS days_since_last_purchase, date_diff('month', registration_date, {_DAY}) AS customer_tenure_months,
        CASE WHEN date_diff('month', registration_date, {_DAY}) > 0 THEN CAST(total_orders AS DOUBLE) / date_diff('month', registration_date, {_DAY}) ELSE CAST(COALESCE(total_orders, 0) AS DOUBLE) END AS purchase_frequency
        FROM customers LEFT JOIN cstats USING (customer_id)""",
    "scored": """SELECT *, CASE WHEN days_since_last_purchase IS NULL THEN 1 WHEN days_since_last_purchase <= 30 THEN 5 WHEN days_since_last_purchase <= 90 THEN 4 WHEN days_since_last_purchase <= 180 THEN 3 WHEN days_since_last_purchase <= 365 THEN 2 ELSE 1 END AS recency_score,
        CASE WHEN total_orders = 0 THEN 1 WHEN total_orders <= 2 THEN 2 WHEN total_orders <= 5 THEN 3 WHEN total_orders <= 10 THEN 4 ELSE 5 END AS frequency_score,
        CASE WHEN total_revenue = 0 THEN 1 WHEN total_revenue <= 100 THEN 2 WHEN total_revenue <= 500 THEN 3 WHEN total_revenue <= 1000 THEN 4 ELSE 5 END AS monetary_score FROM raw_""",
}
_SEGMENT = "CAST(ROUND(CAST(recency_score * 0.35 + frequency_score * 0.35 + monetary_score * 0.30 AS DECIMAL(18,3)), 2) AS DOUBLE) AS customer_segment_score"


@query(f"SELECT * REPLACE (CAST(first_purchase AS VARCHAR) AS first_purchase, CAST(last_purchase AS VARCHAR) AS last_purchase), CASE WHEN customer_tenure_months > 0 THEN total_revenue / customer_tenure_months * 12 ELSE total_revenue END AS customer_lifetime_value, {_SEGMENT} FROM scored", _CUSTOMER)
def customer_features(a):
    return G.customer_features(a.customers, a.transactions, DAY)


@query(f"SELECT customer_id, recency_score, frequency_score, monetary_score, {_SEGMENT} FROM scored", _CUSTOMER)
def rfm_scores(a):
    return G.customer_features(a.customers, a.transactions, DAY).select("customer_id", "recency_score", "frequency_score", "monetary_score", "customer_segment_score")


_TIER = "CASE WHEN price < 50 THEN 'Low' WHEN price < 200 THEN 'Medium' WHEN price < 500 THEN 'High' ELSE 'Premium' END AS price_tier"


@query(
    f"""SELECT product_id, product_name, category, vendor_id, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, stock_quantity, COALESCE(times_sold, 0) AS times_sold, COALESCE(total_quantity_sold, 0) AS total_quantity_sold,
    COALESCE(total_revenue, 0) AS revenue_contribution, COALESCE(unique_customers, 0) AS unique_customers, COALESCE(review_count, 0) AS review_count, COALESCE(avg_rating, 0) AS avg_rating,
    CASE WHEN price > 0 THEN (CAST(price AS DOUBLE) - COALESCE(CAST(cost AS DOUBLE), 0)) / CAST(price AS DOUBLE) ELSE 0 END AS profit_margin, {_TIER},
    CASE WHEN date_diff('month', first_sale, last_sale) > 0 THEN CAST(COALESCE(times_sold, 0) AS DOUBLE) / date_diff('month', first_sale, last_sale) ELSE CAST(COALESCE(times_sold, 0) AS DOUBLE) END AS velocity_score,
    CASE WHEN stock_quantity > 0 THEN CAST(COALESCE(total_quantity_sold, 0) AS DOUBLE) / stock_quantity ELSE 0 END AS stock_turnover_rate,
    CASE WHEN reliability_score IS NOT NULL AND avg_rating IS NOT NULL THEN CAST(ROUND(CAST(avg_rating * reliability_score / 100 AS DECIMAL(18,3)), 2) AS DOUBLE) ELSE COALESCE(avg_rating, 0) END AS vendor_reliability_weighted_score
    FROM products LEFT JOIN pstats USING (product_id) LEFT JOIN rstats USING (product_id) LEFT JOIN (SELECT vendor_id, reliability_score FROM vendors) USING (vendor_id)""",
    _STATS,
)
def product_features(a):
    return G.product_features(a.products, a.transactions, a.reviews, a.vendors)


@query(f"SELECT price_tier, COUNT(*) AS n FROM (SELECT {_TIER} FROM (SELECT CASE WHEN CAST(substr(product_id, 5) AS BIGINT) % 9 = 0 THEN NULL ELSE CAST(price AS DOUBLE) / (1 + CAST(substr(product_id, 5) AS BIGINT) % 40) END AS price FROM products)) GROUP BY 1")
def price_tiers(a):
    n = F.substring("product_id", 5, 20).cast("bigint")
    return a.products.select(G.price_tier(F.when(n % 9 != 0, F.col("price").cast("double") / (1 + n % 40))).alias("price_tier")).groupBy("price_tier").agg(F.count("*").alias("n"))


@query(
    """SELECT vendor_id, vendor_name, country, region, reliability_score, status, COALESCE(total_products_supplied, 0) AS total_products_supplied, COALESCE(avg_product_price, 0) AS avg_product_price, COALESCE(product_quality_score, 0) AS product_quality_score,
    COALESCE(total_invoices, 0) AS total_invoices, COALESCE(total_invoice_amount, 0) AS total_invoice_amount, COALESCE(average_invoice_value, 0) AS average_invoice_value, COALESCE(revenue_generated, 0) AS revenue_generated,
    COALESCE(total_outstanding_balance, 0) AS total_outstanding_balance,
    CASE WHEN COALESCE(total_invoices, 0) > 0 THEN CAST(ROUND(CAST(CAST(paid_on_time_invoices AS DOUBLE) / total_invoices AS DECIMAL(18,3)), 3) AS DOUBLE) ELSE 0 END AS invoice_payment_rate,
    CASE WHEN COALESCE(total_products_supplied, 0) > 0 THEN COALESCE(revenue_generated, 0) / total_products_supplied ELSE 0 END AS revenue_per_product
    FROM vendors LEFT JOIN vpstats USING (vendor_id) LEFT JOIN vistats USING (vendor_id) LEFT JOIN vrev USING (vendor_id)""",
    _STATS,
)
def vendor_features(a):
    return G.vendor_features(a.vendors, _exact_rating(a.products), a.invoices, a.transactions)


_FLAG = "CASE WHEN line_items_total IS NOT NULL AND ABS(CAST(total_amount AS DOUBLE) - line_items_total) / GREATEST(ABS(CAST(total_amount AS DOUBLE)), 0.01) > 0.1 THEN 'MISMATCH' WHEN line_items_total IS NULL THEN 'NO_REFERENCE' ELSE 'OK' END AS reconciliation_flag"
_INVOICE = f"""SELECT invoice_id, vendor_id, CAST(i.invoice_date AS VARCHAR) AS invoice_date, CAST(i.due_date AS VARCHAR) AS due_date, CAST(i.payment_date AS VARCHAR) AS payment_date, CAST(total_amount AS DOUBLE) AS total_amount, payment_status, payment_terms,
    COALESCE(date_diff('day', i.invoice_date, i.due_date), 30) AS payment_terms_days, date_diff('day', i.invoice_date, i.payment_date) AS days_to_payment,
    CASE WHEN payment_status <> 'paid' AND i.due_date < {_DAY} THEN date_diff('day', i.due_date, {_DAY}) ELSE 0 END AS days_overdue, payment_status <> 'paid' AND i.due_date < {_DAY} AS is_overdue,
    COALESCE(unique_products, 0) AS line_item_diversity,
    CASE WHEN i.payment_date IS NOT NULL THEN CAST(ROUND(CAST(1.0 - CAST(date_diff('day', i.invoice_date, i.payment_date) AS DOUBLE) / 30 AS DECIMAL(18,3)), 3) AS DOUBLE) END AS discount_rate_achieved, {_FLAG}
    FROM invoices i LEFT JOIN STATS USING (invoice_id)"""


@query(_INVOICE.replace("STATS", "lstats"), _STATS)
def invoice_features(a):
    return G.invoice_features(a.invoices, G.line_item_stats(a.invoice_line_items), DAY)


@query(_INVOICE.replace("STATS", "fstats"), _STATS)
def invoice_features_fallback(a):
    return G.invoice_features(a.invoices, G.line_item_stats_fallback(a.invoices, a.transactions, a.products), DAY)


@query(f"SELECT reconciliation_flag, COUNT(*) AS n FROM (SELECT {_FLAG} FROM invoices LEFT JOIN lstats USING (invoice_id)) GROUP BY 1", _STATS)
def reconciliation(a):
    x = a.invoices.select("invoice_id", "total_amount").join(G.line_item_stats(a.invoice_line_items), "invoice_id", "left")
    return x.groupBy(G.reconciliation_flag(F.col("total_amount").cast("double"), F.col("line_items_total")).alias("reconciliation_flag")).agg(F.count("*").alias("n"))


# --- graph -----------------------------------------------------------------------

_SLUG = "replace(replace({0}, ' ', '_'), '&', 'and')"
_CATEGORY, _REGION = _SLUG.format("category"), _SLUG.format("region")
_NODE_SQL = {
    "vendor": "SELECT vendor_id AS id, vendor_name, country, region, reliability_score, status FROM vendors",
    "customer": "SELECT customer_id AS id, full_name, segment, total_spend, CAST(registration_date AS VARCHAR) AS registration_date FROM customers",
    "product": "SELECT product_id AS id, product_name, sku, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, CAST(stock_quantity AS BIGINT) AS stock_quantity, rating FROM products",
    "invoice": "SELECT invoice_id AS id, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(due_date AS VARCHAR) AS due_date, CAST(payment_date AS VARCHAR) AS payment_date, CAST(total_amount AS DOUBLE) AS total_amount, payment_status, payment_terms FROM invoices",
    "support_ticket": "SELECT ticket_id AS id, status, priority, CAST(satisfaction_score AS BIGINT) AS satisfaction_score FROM support_tickets",
    "call_transcript": "SELECT call_id AS id, CAST(duration_seconds AS BIGINT) AS duration_seconds FROM call_transcripts",
    "category": f"SELECT {_CATEGORY} AS id, MIN(category) AS name FROM products WHERE category IS NOT NULL GROUP BY 1",
    "region": f"SELECT {_REGION} AS id, MIN(region) AS name FROM vendors WHERE region IS NOT NULL GROUP BY 1",
    "agent": """SELECT agent_id AS id, COALESCE(arg_max(agent_name, call_id) FILTER (WHERE agent_name IS NOT NULL), 'Agent ' || agent_id) AS name
        FROM (SELECT agent_id, NULL AS agent_name, '' AS call_id FROM support_tickets UNION ALL SELECT agent_id, agent_name, call_id FROM call_transcripts) GROUP BY agent_id""",
}
_EDGE_SQL = {
    "supplies": "SELECT DISTINCT vendor_id AS src, product_id AS dst FROM products WHERE vendor_id IS NOT NULL",
    "belongs_to": f"SELECT DISTINCT product_id AS src, {_CATEGORY} AS dst FROM products WHERE category IS NOT NULL",
    "based_in": f"SELECT DISTINCT vendor_id AS src, {_REGION} AS dst FROM vendors WHERE region IS NOT NULL",
    "located_in": f"SELECT DISTINCT customer_id AS src, {_SLUG.format('COALESCE(m.r, c.region)')} AS dst FROM customers c LEFT JOIN (SELECT country, arg_max(region, vendor_id) AS r FROM vendors GROUP BY country) m ON c.country = m.country",
    "purchased": "SELECT customer_id AS src, product_id AS dst, transaction_id, quantity, CAST(total_amount AS DOUBLE) AS total_amount, CAST(transaction_date AS VARCHAR) AS transaction_date, order_status, discount_percent, tax_rate FROM transactions",
    "billed": "SELECT DISTINCT vendor_id AS src, invoice_id AS dst FROM invoices WHERE vendor_id IS NOT NULL",
    "invoice_item": "SELECT invoice_id AS src, product_id AS dst, line_number, quantity, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(line_total AS DOUBLE) AS line_total FROM invoice_line_items",
    "reviewed": "SELECT customer_id AS src, product_id AS dst, review_id, CAST(rating AS BIGINT) AS rating, sentiment, verified_purchase FROM reviews",
    "similar_to": """SELECT DISTINCT a.product_id AS src, b.product_id AS dst FROM ranked a JOIN ranked b ON a.category = b.category
        WHERE a.product_id <> b.product_id AND (b.i - a.i + a.n) % a.n BETWEEN 1 AND LEAST(3, a.n - 1)""",
    "raised": "SELECT customer_id AS src, ticket_id AS dst FROM support_tickets",
    "about": "SELECT ticket_id AS src, product_id AS dst FROM support_tickets",
    "handled_by": "SELECT ticket_id AS src, agent_id AS dst FROM support_tickets",
    "includes_transcript": "SELECT ticket_id AS src, call_id AS dst FROM call_transcripts",
    "conducted_by": "SELECT call_id AS src, agent_id AS dst FROM call_transcripts",
}
_RANKED = {"ranked": "SELECT product_id, category, row_number() OVER (PARTITION BY category ORDER BY product_id) - 1 AS i, COUNT(*) OVER (PARTITION BY category) AS n FROM products"}


def _graph(a):
    return build(a.silver)


def _register_graph() -> None:
    def cols(sql: str) -> list[str]:
        import re

        head = re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", sql.split("FROM")[0].replace("SELECT", "").replace("DISTINCT", "")))
        return [c.split(" AS ")[-1].split()[-1].split(".")[-1] for c in head.split(",")]

    for name in NODES:
        names = {"agent": ["id", "name"], "category": ["id", "name"], "region": ["id", "name"]}.get(name) or cols(_NODE_SQL[name])
        query(_NODE_SQL[name], name=f"nodes_{name}")(lambda a, n=name, c=names: _graph(a).nodes[n].select(*c))
    for name in EDGES:
        names = ["src", "dst"] if name in ("similar_to", "located_in", "belongs_to", "based_in") else cols(_EDGE_SQL[name])
        query(_EDGE_SQL[name], _RANKED, name=f"edges_{name}")(lambda a, n=name, c=names: _graph(a).edges[n].select(*c))


_register_graph()


@query(
    " UNION ALL ".join([f"SELECT 'node' AS kind, '{n}' AS tbl, COUNT(*) AS records FROM (SELECT * FROM node_{n} )" for n in NODES] + [f"SELECT 'edge' AS kind, '{e}' AS tbl, COUNT(*) AS records FROM (SELECT * FROM edge_{e} )" for e in EDGES]),
    _RANKED | {f"node_{n}": s for n, s in _NODE_SQL.items()} | {f"edge_{e}": s for e, s in _EDGE_SQL.items()},
)
def graph_degree_summary(a):
    return sizes(a.silver)


def _joined(c, *parts: str):
    """An array of structs as one sorted string."""
    text = F.transform(c, lambda s: F.concat_ws("|", *[F.coalesce(s[p].cast("string"), F.lit("")) for p in parts]))
    found = F.array_join(F.array_sort(text), ",")
    return found.alias(c) if isinstance(c, str) else found


def _graph_query(name: str, sql: str, post: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    query(sql, _RANKED, name=f"q_{name}")(lambda a: post(GRAPH_QUERIES[name].run(_graph(a))))


_list = lambda x: f"COALESCE(string_agg({x}, ',' ORDER BY {x}), '')"
_graph_query(
    "reliable_vendor_products",
    """SELECT *, row_number() OVER (ORDER BY reliability_score DESC, id, product_id NULLS FIRST) - 1 AS place
    FROM (SELECT v.vendor_id AS id, vendor_name, reliability_score, p.product_id, product_name, CAST(price AS DOUBLE) AS price, category, rating FROM vendors v LEFT JOIN products p ON v.vendor_id = p.vendor_id WHERE reliability_score > 90)""",
)
_graph_query(
    "customer_purchase_history",
    f"""SELECT c.customer_id AS id, full_name, {_list("(product_name || '|' || category || '|' || COALESCE(vendor_name, ''))")} AS purchases
    FROM (SELECT * FROM customers ORDER BY customer_id LIMIT 10) c LEFT JOIN transactions t ON t.customer_id = c.customer_id LEFT JOIN products p ON p.product_id = t.product_id LEFT JOIN vendors v ON v.vendor_id = p.vendor_id GROUP BY ALL""",
    lambda x: x.select("id", "full_name", _joined("purchases", "product_name", "category", "vendor")),
)
_FIVE = "(SELECT * FROM products ORDER BY product_id LIMIT 5)"
_ALSO = f"SELECT f.product_id, {_list('q.product_name')} AS l FROM {_FIVE} f JOIN transactions t ON t.product_id = f.product_id JOIN transactions u ON u.customer_id = t.customer_id JOIN products q ON q.product_id = u.product_id GROUP BY f.product_id"
_text_list = lambda c: F.array_join(c, ",").alias(c)
_graph_query(
    "related_products",
    f"""SELECT f.product_id AS source_product, f.product_name, 'same_category' AS relation, q.product_id AS related_product, q.product_name AS related_name FROM {_FIVE} f JOIN products q ON q.category = f.category
    UNION ALL SELECT f.product_id, f.product_name, 'same_vendor', q.product_id, q.product_name FROM {_FIVE} f JOIN products q ON q.vendor_id = f.vendor_id
    UNION ALL SELECT f.product_id, f.product_name, 'co_purchased', q.product_id, q.product_name FROM {_FIVE} f JOIN transactions t ON t.product_id = f.product_id JOIN transactions u ON u.customer_id = t.customer_id JOIN products q ON q.product_id = u.product_id""",
)
_graph_query("co_purchased_products", f"SELECT f.product_id AS source_product, f.product_name, COALESCE(b.l, '') AS also_bought FROM {_FIVE} f LEFT JOIN ({_ALSO}) b ON b.product_id = f.product_id", lambda x: x.select("source_product", "product_name", _text_list("also_bought")))
_graph_query(
    "top_customers_by_vendor",
    "SELECT v.vendor_id AS id, vendor_name, c.customer_id, full_name, total_spend FROM vendors v JOIN products p ON p.vendor_id = v.vendor_id JOIN transactions t ON t.product_id = p.product_id JOIN customers c ON c.customer_id = t.customer_id",
)
_graph_query(
    "vendor_influence",
    """SELECT v.vendor_id AS id, vendor_name, COALESCE(n, 0) AS customer_reach, COALESCE(d, 0) AS distinct_customers, COALESCE(k, 0) AS product_count FROM vendors v
    LEFT JOIN (SELECT vendor_id, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS d FROM products JOIN transactions USING (product_id) GROUP BY vendor_id) r ON r.vendor_id = v.vendor_id
    LEFT JOIN (SELECT vendor_id, COUNT(*) AS k FROM products GROUP BY vendor_id) s ON s.vendor_id = v.vendor_id""",
)
_graph_query(
    "invoice_reconciliation",
    f"""SELECT i.invoice_id AS id, CAST(i.total_amount AS DOUBLE) AS invoice_total, COUNT(l.product_id) AS n_items, {_list("(product_name || '|' || CAST(quantity AS BIGINT) || '|' || CAST(line_total AS DECIMAL(18,2)))")} AS line_items, CAST(COALESCE(SUM(l.line_total), 0) AS DECIMAL(18,2)) AS calculated_total
    FROM (SELECT * FROM invoices ORDER BY invoice_id LIMIT 10) i LEFT JOIN invoice_line_items l ON l.invoice_id = i.invoice_id LEFT JOIN products p ON p.product_id = l.product_id GROUP BY ALL""",
    lambda x: x.select("id", "invoice_total", F.size("line_items").cast("bigint").alias("n_items"), _joined(F.transform("line_items", lambda i: i.withField("line_total", i["line_total"].cast("decimal(18,2)"))), "product", "quantity", "line_total").alias("line_items"), F.col("calculated_total").cast("decimal(18,2)").alias("calculated_total")),
)
_graph_query(
    "overdue_vendors",
    """SELECT v.vendor_id AS id, vendor_name, n AS overdue_invoices, CAST(amount AS DECIMAL(18,2)) AS overdue_amount, COALESCE(k, 0) AS supplied_products, COALESCE(stock, 0) AS supplied_stock,
    kind, path_id, payment_status, total_amount, invoice_date, due_date, payment_date, payment_terms, product_name, stock_quantity FROM vendors v
    JOIN (SELECT vendor_id, COUNT(*) AS n, SUM(total_amount) AS amount FROM invoices WHERE payment_status IS DISTINCT FROM 'paid' GROUP BY vendor_id) o ON o.vendor_id = v.vendor_id
    LEFT JOIN (SELECT vendor_id, COUNT(*) AS k, CAST(SUM(stock_quantity) AS BIGINT) AS stock FROM products GROUP BY vendor_id) s ON s.vendor_id = v.vendor_id
    JOIN (SELECT vendor_id, 'invoice' AS kind, invoice_id AS path_id, payment_status, CAST(total_amount AS DOUBLE) AS total_amount, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(due_date AS VARCHAR) AS due_date,
    CAST(payment_date AS VARCHAR) AS payment_date, payment_terms, CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS BIGINT) AS stock_quantity FROM invoices WHERE payment_status IS DISTINCT FROM 'paid'
    UNION ALL SELECT vendor_id, 'product', product_id, NULL, NULL, NULL, NULL, NULL, NULL, product_name, CAST(stock_quantity AS BIGINT) FROM products) q ON q.vendor_id = v.vendor_id""",
    lambda x: x.withColumn("overdue_amount", F.col("overdue_amount").cast("decimal(18,2)")),
)
_money = lambda c: F.round(F.col(c).cast("decimal(28,4)"), 2).cast("decimal(18,2)").alias(c)
_graph_query(
    "vendor_payment_vs_sales",
    """SELECT v.vendor_id AS id, vendor_name, CAST(COALESCE(b, 0) AS DECIMAL(18,2)) AS total_invoiced, CAST(COALESCE(r, 0) AS DECIMAL(18,2)) AS total_revenue, m IS NULL AS no_paid, s IS NULL AS no_sales, ROUND(CAST(m / mn AS DECIMAL(28,4)), 2)::DECIMAL(18,2) AS avg_paid_invoice, ROUND(CAST(r / s AS DECIMAL(28,4)), 2)::DECIMAL(18,2) AS avg_sale_amount FROM vendors v
    LEFT JOIN (SELECT vendor_id, SUM(total_amount) AS b, SUM(total_amount) FILTER (WHERE payment_status = 'paid') AS m, COUNT(total_amount) FILTER (WHERE payment_status = 'paid') AS mn FROM invoices GROUP BY vendor_id) x ON x.vendor_id = v.vendor_id
    LEFT JOIN (SELECT vendor_id, SUM(total_amount) AS r, COUNT(*) AS s FROM products JOIN transactions USING (product_id) GROUP BY vendor_id) y ON y.vendor_id = v.vendor_id""",
    lambda x: x.select("id", "vendor_name", _money("total_invoiced"), _money("total_revenue"), F.col("avg_paid_invoice").isNull().alias("no_paid"), F.col("avg_sale_amount").isNull().alias("no_sales"), _money("avg_paid_invoice"), _money("avg_sale_amount")),
)


# --- report ----------------------------------------------------------------------


@query(f"""SELECT 'products' AS source, COUNT(*) AS total, COUNT(*) - COUNT({_KIND}) AS valid, COUNT({_KIND}) AS quarantined, CAST(0 AS BIGINT) AS orphaned FROM products
    UNION ALL SELECT 'reviews', COUNT(*), COUNT(*) FILTER (WHERE p AND c), COUNT(*) FILTER (WHERE NOT (p AND c)), COUNT(*) FILTER (WHERE NOT (p AND c)) FROM judged""", _CASCADE)
def quality_summary(a):
    def figures(name, x):
        lost = F.exists("_errors", lambda e: e["type"] == "referential_integrity")
        return x.agg(F.count("*").alias("total"), F.count_if(F.size("_errors") == 0).alias("valid"), F.count_if(F.size("_errors") > 0).alias("quarantined"), F.count_if(lost).alias("orphaned")).select(F.lit(name).alias("source"), "*")

    products = judge(_products_raw(a), ENTITIES["product"], {}, DAY)
    keys = {"product": valid(products).select("product_id"), "customer": a.customers.select("customer_id")}
    return figures("products", products).unionByName(figures("reviews", judge(a.reviews, ENTITIES["review"], keys, DAY)))
