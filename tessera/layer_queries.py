"""Queries over files: the test tables are written as sources, go through scans, sinks and layers, and come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapters import DAY
from .config import DataConfig, FeatureConfig, LayerConfig, PipelineConfig, entities_of
from .functions.scalars import boolean, phone, slug, strip, trim_all
from .graph.loader import GraphLoader, build
from .operators.integrity import judge, keep_first, quarantined
from .operators.validation import validate
from .plans.bronze import BronzeIngester
from .plans.gold import GoldProcessor
from .plans.pipeline import run_pipeline, summary
from .plans.silver import SilverProcessor
from .queries import _FIELD, _KIND, ORACLE_SQL, _products_raw, _with_json, query
from .report import overall_pass_rate, quality_report
from .sizes import measured_joins
from .sources.reader import read_csv, read_json, read_json_lines, read_parquet
from .sources.sinks import export_csv, scratch, write_json_array, write_table
from .specs import ENTITIES, SourceSpec


# --- scans and sinks ---------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS name, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def scan_csv(a):
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type")
    export_csv(a.table("part").select("p_partkey", name.alias("name"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size")), path := scratch(a.spark))
    return read_csv(a.spark, path).drop("_row_id")


@query("SELECT event_id, event_type, CAST(user_id AS BIGINT) AS user_id FROM events")
def scan_json_lines(a):
    a.table("events").select("event_id", "event_type", "user_id").write.json(path := scratch(a.spark))
    return read_json_lines(a.spark, path).drop("_row_id")


def _document(a, lists: dict[str, tuple[DataFrame, str]]) -> str:
    """An object with a count and a list of the rows of each table, in the order of the column named beside it, as one JSON document."""
    line = lambda part, value: a.spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(value).alias("value"))
    lines = line(0, '{"count": 7')
    for k, (key, (df, order)) in enumerate(lists.items()):
        least = df.agg(F.min(order)).first()[0]
        text = F.concat(F.when(F.col(order) != least, ",").otherwise(""), F.to_json(F.struct("*")))
        rows = df.select(F.lit(3 * k + 2).alias("part"), F.col(order).cast("long").alias("at"), text.alias("value"))
        lines = lines.unionByName(line(3 * k + 1, f', "{key}": [')).unionByName(rows).unionByName(line(3 * k + 3, "]"))
    lines = lines.unionByName(line(1 << 20, "}"))
    lines.repartition(1).sortWithinPartitions("part", "at").select("value").write.text(path := scratch(a.spark))
    return path


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_json_envelope(a):
    return read_json(a.spark, _document(a, {"nations": (a.table("nation"), "n_nationkey")}), "nations").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def scan_json_list(a):
    write_json_array(a.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path := scratch(a.spark), "o_orderkey")
    return read_json(a.spark, path).select("o_orderkey", "o_custkey", "o_orderpriority", F.col("_row_id").alias("place"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier")
def scan_json_first_list(a):
    """The first list is the last by name."""
    path = _document(a, {"zones": (a.table("supplier"), "s_suppkey"), "areas": (a.table("region"), "r_regionkey")})
    return read_json(a.spark, path).select("s_suppkey", "s_name", F.col("_row_id").alias("place"))


@query("SELECT COUNT(*) FILTER (WHERE r_regionkey < 0) AS rows_of_empty_list, COUNT(*) FILTER (WHERE r_regionkey IS NULL) AS rows_of_missing_key, COUNT(*) AS rows_of_other_list FROM region")
def scan_json_empty(a):
    region = a.table("region")
    path = _document(a, {"rows": (region.filter("r_regionkey < 0"), "r_regionkey"), "others": (region, "r_regionkey")})
    counts = [read_json(a.spark, path, key).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for key, name in (("rows", "rows_of_empty_list"), ("none", "rows_of_missing_key"), ("others", "rows_of_other_list"))]
    found = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return found.groupBy().pivot("name", ["rows_of_empty_list", "rows_of_missing_key", "rows_of_other_list"]).agg(F.first("n"))


@query("""SELECT event_id AS id, CASE WHEN m = 0 THEN event_type END AS r_by, CASE WHEN m = 0 THEN CAST(user_id AS BIGINT) END AS r_n, CASE m WHEN 2 THEN 'plain ' || event_type WHEN 3 THEN '{"by":[' || user_id || ']}' END AS r
    FROM (SELECT *, event_id % 5 AS m FROM events)""")
def flatten_by_record(a):
    """An object of plain values, null, a plain value, a nested object, or nothing, by record."""
    by, n, m = F.col("event_type"), F.col("user_id"), F.col("event_id") % 5
    shapes = (F.to_json(F.struct(by.alias("by"), n.alias("n"))), F.lit("null"), F.concat(F.lit('"plain '), by, F.lit('"')), F.to_json(F.struct(F.array(n).alias("by"))))
    value = F.when(m == 4, F.lit(""))
    for k, shape in enumerate(shapes):
        value = value.when(m == k, F.concat(F.lit(', "r": '), shape))
    a.table("events").select(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), value, F.lit("}")).alias("value")).write.text(path := scratch(a.spark))
    return read_json_lines(a.spark, path).select("id", "r_by", "r_n", "r")


# --- places over files of uneven size ------------------------------------------------

_FILE = "CAST(floor(sqrt(o_orderkey % 100)) AS INT)"


def _filed(a, form: str, **options) -> str:
    """Orders in ten files, of which each is larger than the one before, in the order of their keys."""
    note = F.concat("o_orderpriority", F.lit('"\n,'), "o_orderstatus")
    x = a.table("orders").select("o_orderkey", "o_custkey", note.alias("note"), F.expr(_FILE).alias("f"))
    x.repartition("f").sortWithinPartitions("f", "o_orderkey").write.partitionBy("f").options(**options).format(form).save(path := scratch(a.spark))
    return path


_PLACES = f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority || '\"' || chr(10) || ',' || o_orderstatus AS note, row_number() OVER (ORDER BY {_FILE}, o_orderkey) - 1 AS place FROM orders"


def _placed(df):
    return df.select(F.col("o_orderkey").cast("long"), "note", F.col("_row_id").alias("place"))


@query(_PLACES)
def place_csv(a):
    return _placed(read_csv(a.spark, _filed(a, "csv", header=True, quote='"', escape='"')))


@query(_PLACES)
def place_json_lines(a):
    return _placed(read_json_lines(a.spark, _filed(a, "json")))


@query(_PLACES)
def place_parquet(a):
    return _placed(read_parquet(a.spark, _filed(a, "parquet")))


@query(f"SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_FILE}, o_orderkey) = 1")
def first_row_over_files(a):
    x = keep_first(read_csv(a.spark, _filed(a, "csv", header=True, quote='"', escape='"')), ["o_custkey"], ["_row_id"])
    return x.select(F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_parquet(a):
    x = write_table(a.table("supplier"), path := scratch(a.spark))
    return read_parquet(x.sparkSession, path).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT vendor_id, vendor_name, status, CASE WHEN vendor_name IS NULL THEN 1 ELSE 0 END AS lost FROM vendors")
def sink_csv_round_trip(a):
    export_csv(a.vendors.select("vendor_id", "vendor_name", "status"), path := scratch(a.spark))
    return read_csv(a.spark, path).select("vendor_id", "vendor_name", "status", F.when(F.col("vendor_name").isNull(), 1).otherwise(0).alias("lost"))


# --- layers ------------------------------------------------------------------------

_SOURCES = (
    SourceSpec("vendors", "vendors", "jsonl", "vendor"),
    SourceSpec("products", "products", "csv", "product", multiline=False),
    SourceSpec("notes", "notes", "parquet", "none"),
    SourceSpec("lost", "lost", "csv", "review"),
    SourceSpec("odd", "notes", "xml", "none"),
)
_N = "CAST(substr(product_id, 5) AS BIGINT)"
_VENDOR = "CAST(substr(vendor_id, 5) AS BIGINT)"
_SILVER = {
    "shop": "SELECT vendor_id, vendor_name, country, region, reliability_score, status FROM vendors WHERE CAST(substr(vendor_id, 5) AS BIGINT) % 5 <> 0",
    "judged_products": f"SELECT product_id, {_N} AS n, {_KIND} AS kind, {_FIELD} AS field, {_VENDOR} % 5 = 0 AS orphan FROM products",
}


def _bronze(a) -> tuple[str, dict[str, dict]]:
    """Vendors without every fifth, products with faults and every tenth twice, and nations as they are."""
    top = scratch(a.spark)
    a.vendors.filter(F.substring("vendor_id", 5, 20).cast("bigint") % 5 != 0).write.json(f"{top}/in/vendors")
    products = _products_raw(a)
    again = products.filter(F.col("_row_id") % 10 == 0)
    export_csv(products.unionByName(again).drop("_row_id"), f"{top}/in/products")
    a.table("nation").write.parquet(f"{top}/in/notes")
    return top, BronzeIngester(a.spark, f"{top}/in", f"{top}/bronze", _SOURCES).ingest_all()


def _silver(a):
    top, bronze = _bronze(a)
    return top, bronze, SilverProcessor(a.spark, f"{top}/bronze", f"{top}/silver", f"{top}/quarantine", _SOURCES, DAY).process_all()


@query(
    f"""SELECT 'vendors' AS source, true AS success, COUNT(*) AS n, 'jsonl' AS format, CAST(6 + 2 AS BIGINT) AS n_columns FROM shop
    UNION ALL SELECT 'products', true, COUNT(*) + COUNT(*) FILTER (WHERE {_N} % 10 = 0), 'csv', 7 + 2 FROM products
    UNION ALL SELECT 'notes', true, COUNT(*), 'parquet', 3 + 2 FROM nation
    UNION ALL SELECT 'lost', false, NULL, 'csv', NULL UNION ALL SELECT 'odd', false, NULL, 'xml', NULL""",
    _SILVER,
)
def bronze_ingest(a):
    rows = [(name, r["success"], r.get("row_count"), r["format"], len(r["columns"]) if r["success"] else None) for name, r in _bronze(a)[1].items()]
    return a.spark.createDataFrame(rows, "source string, success boolean, n long, format string, n_columns long")


@query(
    f"""SELECT 'vendors' AS source, COUNT(*) AS total, COUNT(*) AS valid, 0 AS quarantined, 0 AS duplicates, 0 AS orphaned FROM shop
    UNION ALL SELECT 'products', COUNT(*) + COUNT(*) FILTER (WHERE n % 10 = 0), COUNT(*) FILTER (WHERE kind IS NULL AND NOT orphan), COUNT(*) FILTER (WHERE kind IS NOT NULL OR orphan),
    COUNT(*) FILTER (WHERE n % 10 = 0), COUNT(*) FILTER (WHERE orphan) FROM judged_products
    UNION ALL SELECT 'notes', COUNT(*), COUNT(*), 0, 0, 0 FROM nation
    UNION ALL SELECT 'lost', 0, 0, 0, 0, 0 UNION ALL SELECT 'odd', 0, 0, 0, 0, 0""",
    _SILVER,
)
def silver_figures(a):
    rows = [(r.source, r.total, r.valid, r.quarantined, r.duplicates_removed, r.orphaned) for r in _silver(a)[2].values()]
    return a.spark.createDataFrame(rows, "source string, total long, valid long, quarantined long, duplicates long, orphaned long")


@query("SELECT product_id, vendor_id, sku, product_name, CAST(price AS DOUBLE) AS price, stock_quantity, rating FROM products WHERE product_id IN (SELECT product_id FROM judged_products WHERE kind IS NULL AND NOT orphan)", _SILVER)
def silver_products(a):
    return a.spark.read.parquet(f"{_silver(a)[0]}/silver/products").select("product_id", "vendor_id", "sku", "product_name", "price", "stock_quantity", "rating")


@query("SELECT CASE WHEN n % 11 = 4 THEN 'P-' || n ELSE product_id END AS product_id, CASE WHEN orphan THEN 'vendor_id' ELSE field END AS field, CASE WHEN orphan THEN 'referential_integrity' ELSE kind END AS type FROM judged_products WHERE kind IS NOT NULL OR orphan", _SILVER)
def quarantine_json(a):
    x = a.spark.read.json(f"{_silver(a)[0]}/quarantine/products").select("record.product_id", F.explode("errors").alias("e"))
    return x.select("product_id", "e.field", "e.type")


@query(
    f"""SELECT CAST(rows_read AS BIGINT) AS rows_read, valid, valid / CAST(rows_read AS DOUBLE) AS rate FROM (SELECT s + p + d + m AS rows_read, s + v + m AS valid FROM (SELECT COUNT(*) AS s FROM shop),
    (SELECT COUNT(*) AS p, COUNT(*) FILTER (WHERE n % 10 = 0) AS d, COUNT(*) FILTER (WHERE kind IS NULL AND NOT orphan) AS v FROM judged_products), (SELECT COUNT(*) AS m FROM nation))""",
    _SILVER,
)
def overall_rate(a):
    _, bronze, silver = _silver(a)
    read, good = sum(b.get("row_count", 0) for b in bronze.values()), sum(s.valid for s in silver.values())
    return a.spark.createDataFrame([(read, good, overall_pass_rate(bronze, silver))], "rows_read long, valid long, rate double")


@query("SELECT 'customer_features' AS feature_table, COUNT(*) AS n, 20 AS n_columns FROM customers UNION ALL SELECT 'product_features', COUNT(*), 18 FROM products UNION ALL SELECT 'vendor_features', COUNT(*), 16 FROM vendors UNION ALL SELECT 'invoice_features', COUNT(*), 15 FROM invoices")
def gold_tables(a):
    top = scratch(a.spark)
    for name, df in a.silver.items():
        write_table(df, f"{top}/silver/{name}")
    found = GoldProcessor(a.spark, f"{top}/silver", f"{top}/gold", DAY)
    results = found.process_all()
    found.close()
    rows = [(r.feature_table, a.spark.read.parquet(f"{top}/gold/{r.feature_table}").count(), len(r.columns)) for r in results.values()]
    return a.spark.createDataFrame(rows, "feature_table string, n long, n_columns int")


_CARDS = """
schemas:
  buyer:
    primary_key: c_custkey
    fields:
      c_custkey: {type: integer, required: true}
  card:
    primary_key: o_orderkey
    fields:
      o_orderkey: {type: integer, required: true, min: 1}
      o_custkey: {type: integer, foreign_key: buyer}
      o_orderpriority: {type: string, clean: shout, pattern: '^[^4].*$'}
      o_orderstatus: {type: string, clean: not_there}
      o_totalprice: {type: float, max: 200000}
cleaners:
  shout: {type: case, case: upper}
"""


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, upper(o_orderpriority) AS o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey >= 1 AND o_custkey % 4 <> 0 AND o_totalprice <= 200000 AND o_orderpriority NOT LIKE '4%'")
def silver_from_files(a):
    """Schemas and cleaning rules as a file describes them, over two sources of its own."""
    import yaml

    found, top = yaml.safe_load(_CARDS), scratch(a.spark)
    a.table("customer").filter("c_custkey % 4 <> 0").write.parquet(f"{top}/in/buyers")
    a.table("orders").write.parquet(f"{top}/in/cards")
    sources = (SourceSpec("cards", "cards", "parquet", "card"), SourceSpec("buyers", "buyers", "parquet", "buyer"))
    BronzeIngester(a.spark, f"{top}/in", f"{top}/bronze", sources).ingest_all()
    SilverProcessor(a.spark, f"{top}/bronze", f"{top}/silver", f"{top}/quarantine", sources, DAY, entities=entities_of(found), rules=found).process_all()
    return a.spark.read.parquet(f"{top}/silver/cards").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@query(f"SELECT CAST(substr(product_id, 5) AS BIGINT) AS row_index, {_FIELD} AS field, {_KIND} AS type, row_number() OVER (ORDER BY CAST(substr(product_id, 5) AS BIGINT)) - 1 AS place FROM products WHERE {_KIND} IS NOT NULL")
def quarantine_array(a):
    """Quarantined rows as one JSON array, in the order of their places, read back."""
    write_json_array(quarantined(judge(_products_raw(a), ENTITIES["product"], {}, DAY)), path := scratch(a.spark))
    first = lambda name: F.get_json_object("errors", f"$[0].{name}").alias(name)
    return read_json(a.spark, path).select("row_index", first("field"), first("type"), F.col("_row_id").alias("place"))


@query(
    f"""SELECT 'bronze' AS layer, 'sources' AS what, 5 AS n UNION ALL SELECT 'bronze', 'rows', (SELECT COUNT(*) FROM shop) + (SELECT COUNT(*) + COUNT(*) FILTER (WHERE {_N} % 10 = 0) FROM products) + (SELECT COUNT(*) FROM nation)
    UNION ALL SELECT 'silver', 'valid', (SELECT COUNT(*) FROM shop) + (SELECT COUNT(*) FROM judged_products WHERE kind IS NULL AND NOT orphan) + (SELECT COUNT(*) FROM nation)
    UNION ALL SELECT 'silver', 'quarantined', (SELECT COUNT(*) FROM judged_products WHERE kind IS NOT NULL OR orphan)
    UNION ALL SELECT 'silver', 'duplicates_removed', (SELECT COUNT(*) FROM judged_products WHERE n % 10 = 0) UNION ALL SELECT 'silver', 'orphaned', (SELECT COUNT(*) FROM judged_products WHERE orphan)""",
    _SILVER,
)
def run_totals(a):
    _, bronze, silver = _silver(a)
    rows = [(layer, what, n) for layer, totals in summary({"bronze": bronze, "silver": silver}).items() for what, n in totals.items()]
    return a.spark.createDataFrame(rows, "layer string, what string, n long")


def _gold(a) -> str:
    top = scratch(a.spark)
    for name, df in a.silver.items():
        write_table(df, f"{top}/silver/{name}")
    found = GoldProcessor(a.spark, f"{top}/silver", f"{top}/gold", DAY)
    found.process_all()
    found.close()
    return f"{top}/gold"


@query(None)
def gold_customer_table(a):
    """The feature table as it stands in the Gold folder."""
    return a.spark.read.parquet(f"{_gold(a)}/customer_features")


@query(None)
def gold_invoice_table(a):
    return a.spark.read.parquet(f"{_gold(a)}/invoice_features")


ORACLE_SQL |= {"gold_customer_table": ORACLE_SQL["customer_features"], "gold_invoice_table": ORACLE_SQL["invoice_features"]}


_RUN = (
    SourceSpec("vendors", "vendors", "jsonl", "vendor"),
    SourceSpec("products", "products", "csv", "product"),
    SourceSpec("customers", "customers", "json", "customer"),
    SourceSpec("transactions", "transactions", "parquet", "transaction"),
    SourceSpec("invoices", "invoices", "csv", "invoice"),
    SourceSpec("reviews", "reviews", "jsonl", "review"),
)
_RUN_VIEWS = {
    "sound": "SELECT * FROM products WHERE vendor_id IS NOT NULL",
    "bought": "SELECT DISTINCT transaction_id FROM transactions WHERE product_id IN (SELECT product_id FROM sound)",
    "billed": "SELECT * FROM invoices WHERE vendor_id IS NOT NULL",
    "told": "SELECT * FROM reviews WHERE product_id IN (SELECT product_id FROM sound) AND customer_id IN (SELECT customer_id FROM customers)",
    "items": "SELECT * FROM invoice_line_items WHERE invoice_id IN (SELECT invoice_id FROM billed)",
}


@query(
    """SELECT 'bronze' AS layer, 'sources' AS what, 6 AS n UNION ALL SELECT 'bronze', 'rows', (SELECT COUNT(*) FROM vendors) + (SELECT COUNT(*) FROM products) + (SELECT COUNT(*) FROM customers) + (SELECT COUNT(*) FROM transactions) + (SELECT COUNT(*) FROM invoices) + (SELECT COUNT(*) FROM reviews)
    UNION ALL SELECT 'silver', 'valid', (SELECT COUNT(*) FROM vendors) + (SELECT COUNT(*) FROM sound) + (SELECT COUNT(*) FROM customers) + (SELECT COUNT(*) FROM bought) + (SELECT COUNT(*) FROM billed) + (SELECT COUNT(*) FROM told) + (SELECT COUNT(*) FROM items)
    UNION ALL SELECT 'silver', 'duplicates_removed', (SELECT COUNT(*) - COUNT(DISTINCT transaction_id) FROM transactions)
    UNION ALL SELECT 'gold', 'tables', 4 UNION ALL SELECT 'gold', 'features', 69
    UNION ALL SELECT 'graph', 'nodes', (SELECT COUNT(*) FROM vendors) + (SELECT COUNT(*) FROM sound) + (SELECT COUNT(*) FROM customers) + (SELECT COUNT(*) FROM billed) + (SELECT COUNT(DISTINCT category) FROM sound) + (SELECT COUNT(DISTINCT region) FROM vendors)""",
    _RUN_VIEWS,
)
def whole_run(a):
    """All layers, from source files of four formats to the graph."""
    top = scratch(a.spark)
    text = lambda df: df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})
    with measured_joins(a.spark):
        text(a.vendors).write.json(f"{top}/in/vendors")
        export_csv(text(a.products), f"{top}/in/products")
        number = F.substring("customer_id", 5, 20).cast("bigint")
        write_json_array(text(a.customers).withColumn("row_index", number), f"{top}/in/customers")
        write_table(text(a.transactions), f"{top}/in/transactions")
        export_csv(text(a.invoices.join(_with_json(a), "invoice_id", "left")), f"{top}/in/invoices", "gzip")
        text(a.reviews).write.json(f"{top}/in/reviews")
    config = PipelineConfig(data=DataConfig(f"{top}/in", f"{top}/out"), feature_engineering=FeatureConfig(DAY), layers=LayerConfig(export_csv=False))
    totals = summary(run_pipeline(a.spark, config, sources=_RUN))
    rows = [(layer, what, n) for layer, found in totals.items() for what, n in found.items() if what not in ("quarantined", "orphaned", "edges", "errors")]
    return a.spark.createDataFrame(rows, "layer string, what string, n long")


_ITEM_VIEWS = {
    "judged_items": f"""SELECT i.invoice_id, i.line_number, i.product_id, i.quantity, CAST(i.line_total AS DOUBLE) AS line_total, CAST(substr(i.product_id, 5) AS BIGINT) % 9 = 0 AS lost
        FROM invoice_line_items i WHERE i.invoice_id IN (SELECT invoice_id FROM invoices WHERE vendor_id IS NOT NULL)""",
}


def _item_layers(a) -> str:
    """Silver of invoices with JSON lists and of the products but every ninth, whose line items are lost."""
    top = scratch(a.spark)
    product = F.substring("product_id", 5, 20).cast("bigint")
    a.products.filter(product % 9 != 0).withColumn("vendor_id", F.coalesce("vendor_id", F.lit("VND-0"))).write.parquet(f"{top}/in/products")
    text = lambda df: df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})
    text(a.invoices.join(_with_json(a), "invoice_id", "left")).write.parquet(f"{top}/in/invoices")
    sources = (SourceSpec("products", "products", "parquet", "product"), SourceSpec("invoices", "invoices", "parquet", "invoice"))
    BronzeIngester(a.spark, f"{top}/in", f"{top}/bronze", sources).ingest_all()
    SilverProcessor(a.spark, f"{top}/bronze", f"{top}/silver", f"{top}/quarantine", sources, DAY).process_all()
    return top


@query("SELECT invoice_id, CAST(line_number AS BIGINT) AS line_number, product_id, CAST(quantity AS BIGINT) AS quantity, line_total FROM judged_items WHERE NOT lost", _ITEM_VIEWS)
def silver_line_items(a):
    """Items out of the JSON lists of valid invoices, as Silver keeps them."""
    return a.spark.read.parquet(f"{_item_layers(a)}/silver/invoice_line_items").select("invoice_id", "line_number", "product_id", "quantity", "line_total")


@query("SELECT invoice_id, product_id, 'product_id' AS field, 'referential_integrity' AS type, COUNT(*) AS n FROM judged_items WHERE lost GROUP BY 1, 2", _ITEM_VIEWS)
def quarantine_line_items(a):
    x = a.spark.read.json(f"{_item_layers(a)}/quarantine/invoice_line_items").select("record", F.explode("errors").alias("e"))
    return x.groupBy("record.invoice_id", "record.product_id", "e.field", "e.type").agg(F.count("*").alias("n"))


@query(None)
def gold_invoice_fallback_table(a):
    """The feature table of a Silver folder without line items: transactions stand in for them."""
    top = scratch(a.spark)
    for name, df in a.silver.items():
        if name != "invoice_line_items":
            write_table(df, f"{top}/silver/{name}")
    found = GoldProcessor(a.spark, f"{top}/silver", f"{top}/gold", DAY)
    found.process_all()
    found.close()
    return a.spark.read.parquet(f"{top}/gold/invoice_features")


ORACLE_SQL["gold_invoice_fallback_table"] = ORACLE_SQL["invoice_features_fallback"]


@query(
    """SELECT 'vendors' AS source, COUNT(*) AS total, COUNT(*) AS valid, 0 AS quarantined, 0 AS deduped, 0 AS orphaned, '100.0%' AS pass_rate FROM shop
    UNION ALL SELECT 'products', n, v, q, d, o, printf('%.1f%%', 100.0 * v / n) FROM (SELECT COUNT(*) + COUNT(*) FILTER (WHERE n % 10 = 0) AS n, COUNT(*) FILTER (WHERE kind IS NULL AND NOT orphan) AS v, COUNT(*) FILTER (WHERE kind IS NOT NULL OR orphan) AS q,
        COUNT(*) FILTER (WHERE n % 10 = 0) AS d, COUNT(*) FILTER (WHERE orphan) AS o FROM judged_products)
    UNION ALL SELECT 'notes', COUNT(*), COUNT(*), 0, 0, 0, '100.0%' FROM nation
    UNION ALL SELECT 'lost', 0, 0, 0, 0, 0, '0.0%' UNION ALL SELECT 'odd', 0, 0, 0, 0, 0, '0.0%'""",
    _SILVER,
)
def report_silver_table(a):
    """The Silver table of the report, read from its text."""
    _, bronze, silver = _silver(a)
    section = quality_report(bronze, silver, {}).split("## Silver Layer")[1].split("\n\n")[1]
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in section.splitlines()[2:]]
    rows = [(c[0], *(int(x.replace(",", "")) for x in c[1:6]), c[6]) for c in cells if not c[0].startswith("*")]
    return a.spark.createDataFrame(rows, "source string, total long, valid long, quarantined long, deduped long, orphaned long, pass_rate string")


# --- graph loads ---------------------------------------------------------------------

# Some lines share order and number, so the part tells them apart.
_LINE_NAME, _LINE_PLACE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey", "(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 100000000 + l_partkey"


def _lines(a, **columns: str) -> DataFrame:
    return a.table("lineitem").select(*[F.expr(sql).alias(name) for name, sql in columns.items()], F.expr(f"CAST({_LINE_PLACE} AS BIGINT)").alias("_row_id"))


@query(f"SELECT 'VND-' || l_suppkey AS id, arg_min({_LINE_NAME}, {_LINE_PLACE}) AS vendor_name FROM lineitem GROUP BY l_suppkey")
def nodes_first_row(a):
    """Many rows of each id: the first by place stays."""
    return build({"vendors": _lines(a, vendor_id="'VND-' || l_suppkey", vendor_name=_LINE_NAME, region="CAST(NULL AS STRING)")}).nodes["vendor"].select("id", "vendor_name")


@query(f"SELECT 'A' || l_suppkey AS id, arg_max({_LINE_NAME}, {_LINE_PLACE}) AS name FROM lineitem GROUP BY l_suppkey")
def agents_last_row(a):
    return build({"call_transcripts": _lines(a, call_id="'c'", agent_id="'A' || l_suppkey", agent_name=_LINE_NAME)}).nodes["agent"]


@query(f"SELECT 'c' || arg_min(l_orderkey, {_LINE_PLACE}) AS src, 'p' || arg_min(l_partkey, {_LINE_PLACE}) AS dst, 'R' || l_suppkey AS review_id, CAST(arg_min(l_linenumber, {_LINE_PLACE}) AS BIGINT) AS rating FROM lineitem GROUP BY l_suppkey")
def edges_first_row(a):
    reviews = _lines(a, review_id="'R' || l_suppkey", customer_id="'c' || l_orderkey", product_id="'p' || l_partkey", rating="l_linenumber")
    return build({"reviews": reviews}).edges["reviewed"].select("src", "dst", "review_id", "rating")


def _repeated(a, path: str) -> None:
    """A Silver folder with vendors of which every fifth is there twice and every seventh once more without an id, and their products."""
    n = F.substring("vendor_id", 5, 20).cast("bigint")
    again = a.vendors.filter(n % 5 == 0).withColumn("vendor_name", F.lit("again"))
    lost = a.vendors.filter(n % 7 == 0).withColumn("vendor_id", F.lit(None).cast("string"))
    every = a.vendors.withColumn("_row_id", n).unionByName(again.withColumn("_row_id", n + (1 << 40))).unionByName(lost.withColumn("_row_id", F.lit(1 << 41)))
    write_table(every, f"{path}/vendors")
    write_table(a.products.withColumn("_row_id", F.substring("product_id", 5, 20).cast("bigint")), f"{path}/products")


_LOADED = """SELECT 'vendor' AS tbl, 'node' AS kind, COUNT(*) AS loaded, COUNT(*) FILTER (WHERE n % 5 = 0) + COUNT(*) FILTER (WHERE n % 7 = 0) AS errors FROM numbered
    UNION ALL SELECT 'based_in', 'edge', COUNT(*), COUNT(*) FILTER (WHERE n % 5 = 0) FROM numbered UNION ALL SELECT 'region', 'node', COUNT(DISTINCT region), 0 FROM numbered
    UNION ALL SELECT 'product', 'node', COUNT(*), 0 FROM products UNION ALL SELECT 'category', 'node', COUNT(DISTINCT category), 0 FROM products
    UNION ALL SELECT 'supplies', 'edge', COUNT(vendor_id), 0 FROM products UNION ALL SELECT 'belongs_to', 'edge', COUNT(category), 0 FROM products
    UNION ALL SELECT 'similar_to', 'edge', CAST(SUM(LEAST(3, k - 1) * k) AS BIGINT), 0 FROM (SELECT COUNT(*) AS k FROM products WHERE category IS NOT NULL GROUP BY category)"""
_NUMBERED = {"numbered": "SELECT *, CAST(substr(vendor_id, 5) AS BIGINT) AS n FROM vendors"}


@query(_LOADED, _NUMBERED)
def graph_load_errors(a):
    """What the loader counts while it writes."""
    _repeated(a, f"{(top := scratch(a.spark))}/silver")
    results = GraphLoader(a.spark, f"{top}/silver", f"{top}/graph").load_all()
    return a.spark.createDataFrame([(r.table, r.table_type, r.records_loaded, r.errors) for r in results.values()], "tbl string, kind string, loaded long, errors long")


@query(f"SELECT tbl, CASE WHEN loaded > 0 THEN loaded ELSE 0 END AS records FROM ({_LOADED})", _NUMBERED)
def graph_catalog(a):
    """The schema applied to a database of the catalog, the graph loaded into it, and its tables counted there."""
    _repeated(a, f"{(top := scratch(a.spark))}/silver")
    loader = GraphLoader(a.spark, f"{top}/silver", f"{top}/graph")
    loader.connect(name := f"graph_{top.rpartition('/')[2]}")
    try:
        loader.apply_schema()
        loader.load_all()
        g = loader.load()
        counts = [(t, df.count()) for t, df in (g.nodes | g.edges).items()]
    finally:
        a.spark.sql(f"DROP DATABASE `{name}` CASCADE")
    return a.spark.createDataFrame([c for c in counts if c[1]], "tbl string, records long")


# --- cleaning of cells that vary -----------------------------------------------------


def _chosen(key, options: list[Column]) -> Column:
    """The option whose number is the key's remainder."""
    out = F.when(F.lit(False), options[0])
    for k, option in enumerate(options):
        out = out.when(key % len(options) == k, option)
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 = 5 THEN 'ext' || d[1:3] || '/' || d[4:6] || 'x' || d[7:9] ELSE d END AS phone FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer)")
def clean_phone_varied(a):
    d = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    forms = ["(%s) %s-%s", "%s.%s.%s", "+%s %s %s", "%s\t%s\n%s", "%s%s%s", "ext%s/%sx%s", "%s--%s..%s", " %s ((%s)) %s "]
    raw = _chosen(F.col("c_custkey"), [F.format_string(f, F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3)) for f in forms])
    return a.table("customer").select("c_custkey", phone(raw).alias("phone"))


_WORDS = {"true": True, "True": True, "TRUE": True, "tRuE": True, "yes": True, "YES": True, "1": True, "y": True, "Y": True, "false": False, "FALSE": False, "no": False, "No": False, "0": False, "n": False, "N": False, "maybe": None, "": None, " yes": None, "t": None, "2": None, "on": None, "nein": None}


@query(f"SELECT o_orderkey, ([{', '.join('NULL' if v is None else str(v).lower() for v in _WORDS.values())}])[o_orderkey % {len(_WORDS)} + 1] AS flag FROM orders")
def clean_boolean_varied(a):
    return a.table("orders").select("o_orderkey", boolean(_chosen(F.col("o_orderkey"), [F.lit(w) for w in _WORDS])).alias("flag"))


@query("""SELECT p_partkey, p_name || ([' a b', chr(9) || 'b', chr(10) || chr(10) || ' c', '', '  d'])[p_partkey % 5 + 1] AS stripped, p_name || ([' a b', ' b', ' c', '', ' d'])[p_partkey % 5 + 1] AS trimmed,
    replace(p_name, ' ', '_') || ([ '_and_', '__and__', '&'])[p_partkey % 3 + 1].replace('&', 'and') AS slug FROM part""")
def clean_text_varied(a):
    key = F.col("p_partkey")
    before, after = [F.lit(x) for x in ("", " ", "\t\n", " \r\n ")], [F.lit(x) for x in ("", "\n", "  \t")]
    middle = [F.lit(x) for x in (" a b", "\tb", "\n\n c", "", "  d")]
    raw = F.concat(_chosen(key, before), "p_name", _chosen(key, middle), _chosen(key, after))
    ends = [F.lit(x) for x in (" & ", "  &  ", "&")]
    return a.table("part").select("p_partkey", strip(raw).alias("stripped"), trim_all(raw).alias("trimmed"), slug(F.concat("p_name", _chosen(key, ends))).alias("slug"))


# --- models ------------------------------------------------------------------------


def _model(entity: str, base: str, n: str, every: int, cells: dict[str, tuple[str, dict[int, str | None]]], want: dict[int, str], shown: dict[str, str]) -> None:
    """A query ``model_<entity>``: rows with one fault each by number, their errors as field:type, and validated values.

    ``n``: a row's number, and ``cells``: each column's sound value, both as SQL, and its faulty cells; ``want``: the error of
    each kind of row; ``shown``: columns to show and their SQL.
    """
    kinds = " ".join(f"WHEN {m} THEN '{w}'" for m, w in want.items())
    values = ", ".join(f"{sql} AS {c}" for c, sql in shown.items())
    sql = f"SELECT n, CASE m {kinds} ELSE '' END AS errors, {values} FROM (SELECT *, {n} AS n, ({n}) % {every} AS m FROM {base})"

    def run(a) -> DataFrame:
        m, raw = F.expr(n) % every, []
        for name, (sound, bad) in cells.items():
            c = F.expr(sound).cast("string")
            for k, cell in bad.items():
                c = F.when(m == k, F.lit(cell).cast("string")).otherwise(c)
            raw.append(c.alias(name))
        x = validate(a.table(base).select(*raw, F.expr(n).alias("_n")), ENTITIES[entity], DAY)
        errors = F.array_join(F.transform("_errors", lambda e: F.concat_ws(":", e["field"], e["type"])), ",")
        return x.select(F.col("_n").alias("n"), errors.alias("errors"), *shown)

    query(sql, name=f"model_{entity}")(run)


_model(
    "customer", "customer", "c_custkey", 10,
    {
        "customer_id": ("'CUS-' || c_custkey", {1: "C-1"}), "full_name": ("c_name", {2: None}), "email": ("'a@b.c' || c_custkey", {3: "no address"}), "registration_date": ("'2000-01-02'", {4: "2099-01-01", 5: "junk"}),
        "total_orders": ("'3'", {6: "-1"}), "average_order_value": ("'2.5'", {7: "x"}), "is_active": ("'yes'", {8: "perhaps"}), "age": ("'44.0'", {9: "44.5"}),
    },
    {1: "customer_id:string_pattern_mismatch", 2: "full_name:missing", 5: "registration_date:value_error", 6: "total_orders:greater_than_equal", 7: "average_order_value:float_parsing", 8: "is_active:bool_parsing", 9: "age:int_parsing"},
    {"email": "CASE WHEN m <> 3 THEN 'a@b.c' || c_custkey END", "registration_date": "CASE WHEN m = 5 THEN 'junk' WHEN m <> 4 THEN '2000-01-02' END", "age": "CASE WHEN m <> 9 THEN 44 END", "is_active": "CASE WHEN m <> 8 THEN true END"},
)
_model(
    "transaction", "lineitem", "l_orderkey * 10 + l_linenumber", 8,
    {
        "transaction_id": ("'TXN-' || hex(CAST(l_orderkey AS BIGINT))", {1: "TXN-xyz"}), "quantity": ("CAST(l_quantity AS INT)", {2: "2.5"}), "discount_percent": ("'10'", {3: "150", 4: "-1", 5: "NaN"}),
        "total_amount": ("'-4.5'", {6: "abc"}), "is_gift": ("'off'", {7: "maybe"}),
    },
    {1: "transaction_id:string_pattern_mismatch", 2: "quantity:int_parsing", 3: "discount_percent:less_than_equal", 4: "discount_percent:greater_than_equal", 5: "discount_percent:less_than_equal", 6: "total_amount:float_parsing", 7: "is_gift:bool_parsing"},
    {"quantity": "CASE WHEN m <> 2 THEN CAST(l_quantity AS BIGINT) END", "total_amount": "CASE WHEN m <> 6 THEN CAST(-4.5 AS DOUBLE) END", "is_gift": "CASE WHEN m <> 7 THEN false END"},
)
_model(
    "vendor", "supplier", "s_suppkey", 6,
    {"vendor_id": ("'VND-' || s_suppkey", {1: "VND-"}), "vendor_name": ("s_name", {2: None}), "reliability_score": ("'90'", {3: "101", 4: "-0.5"}), "lead_time_days": ("' 3 '", {5: "soon"})},
    {1: "vendor_id:string_pattern_mismatch", 2: "vendor_name:missing", 3: "reliability_score:less_than_equal", 4: "reliability_score:greater_than_equal", 5: "lead_time_days:int_parsing"},
    {"vendor_name": "CASE WHEN m <> 2 THEN s_name END", "lead_time_days": "CASE WHEN m <> 5 THEN 3 END"},
)
_model(
    "invoice", "orders", "o_orderkey", 6,
    {"invoice_id": ("'INV-' || hex(CAST(o_orderkey AS BIGINT))", {1: "INV-q"}), "vendor_id": ("'any'", {2: None}), "tax_rate": ("'0.25'", {3: "1.5"}), "payment_method": ("' Credit Card '", {4: "  "}), "subtotal": ("'1e2'", {5: "1,5"})},
    {1: "invoice_id:string_pattern_mismatch", 2: "vendor_id:missing", 5: "subtotal:float_parsing"},
    {"tax_rate": "CASE WHEN m <> 3 THEN CAST(0.25 AS DOUBLE) END", "payment_method": "CASE WHEN m <> 4 THEN 'credit_card' END", "subtotal": "CASE WHEN m <> 5 THEN CAST(100 AS DOUBLE) END"},
)
_model(
    "support_ticket", "events", "event_id", 6,
    {"ticket_id": ("'TKT-' || event_id", {1: " "}), "customer_id": ("'any'", {2: None}), "satisfaction_score": ("'4'", {3: "6", 4: "0", 5: "good"}), "status": ("event_type", {})},
    {1: "ticket_id:value_error", 2: "customer_id:missing", 3: "satisfaction_score:less_than_equal", 4: "satisfaction_score:greater_than_equal", 5: "satisfaction_score:int_parsing"},
    {"status": "event_type", "customer_id": "CASE WHEN m <> 2 THEN 'any' END"},
)
_model(
    "call_transcript", "orders", "o_orderkey", 7,
    {"call_id": ("'CALL-' || o_orderkey", {1: None}), "customer_id": ("'any'", {2: None}), "duration_seconds": ("'60'", {3: "-5"}), "quality_score": ("'99.5'", {4: "100.5"}), "resolution_achieved": ("'1'", {5: "perhaps"}), "transfers": ("'2'", {6: "1.5"})},
    {1: "call_id:missing", 2: "customer_id:missing", 3: "duration_seconds:greater_than_equal", 4: "quality_score:less_than_equal", 5: "resolution_achieved:bool_parsing", 6: "transfers:int_parsing"},
    {"transfers": "CASE WHEN m <> 6 THEN 2 END", "resolution_achieved": "CASE WHEN m <> 5 THEN true END"},
)
