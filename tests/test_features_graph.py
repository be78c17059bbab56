"""Features at their bounds, and the graph with its queries, on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.graph.loader import GraphLoader, agents, build, sizes
from tessera.graph.queries import get_query, list_queries
from tessera.graph.schema import EDGE_TABLES, NODE_TABLES, get_schema_statements
from tessera.graph.traverse import Traversal
from tessera.plans import features as G

DAY = dt.date(2026, 2, 1)


@pytest.fixture(scope="module")
def silver(spark):
    make = spark.createDataFrame
    return {
        "customers": make([("CUS-1", "A", "x", 10.0, "2025-01-31", "Italy"), ("CUS-2", "B", "y", None, "2026-02-01", "France"), ("CUS-3", "C", "y", 0.0, None, None)], "customer_id string, full_name string, segment string, total_spend double, registration_date string, address_country string"),
        "vendors": make([("VND-1", "V1", "Italy", "South", 95.0, "active"), ("VND-2", "V2", "Spain", "South & West", 50.0, "active"), ("VND-3", "V3", None, None, None, None)], "vendor_id string, vendor_name string, country string, region string, reliability_score double, status string"),
        "products": make([(f"PRD-{k}", f"VND-{1 + k % 2}", f"S{k}", f"P{k}", "Home & Co" if k < 4 else "Solo", p, 40.0, s, 4.0) for k, (p, s) in enumerate([(49.0, 0), (50.0, 5), (200.0, 2), (500.0, None), (None, 1)])], "product_id string, vendor_id string, sku string, product_name string, category string, price double, cost double, stock_quantity long, rating double"),
        "transactions": make([("TXN-1", "CUS-1", "PRD-0", "2026-01-02", 2, 99.98, "DONE"), ("TXN-2", "CUS-1", "PRD-1", "2025-11-30", 1, -49.99, "DONE"), ("TXN-3", "CUS-2", "PRD-0", "2024-01-01", 4, 200.0, "DONE"), ("TXN-4", "CUS-2", "PRD-0", "2024-02-01", 1, None, "DONE")], "transaction_id string, customer_id string, product_id string, transaction_date string, quantity long, total_amount double, order_status string"),
        "reviews": make([("R1", "PRD-0", "CUS-1", "5"), ("R2", "PRD-0", "CUS-2", "4"), ("R2", "PRD-1", "CUS-2", "1")], "review_id string, product_id string, customer_id string, rating string"),
        "invoices": make([("INV-1", "VND-1", "2025-01-01", "2025-01-31", "2025-01-11", 1000.0, "paid", "NET30"), ("INV-2", "VND-1", "2025-01-01", "2025-01-31", None, 3000.0, "pending", "NET45"), ("INV-3", "VND-2", "2025-01-01", None, "junk", 500.0, "paid", "NET60"), ("INV-4", "VND-2", "2025-01-01", "2026-03-01", None, 7.0, None, None)], "invoice_id string, vendor_id string, invoice_date string, due_date string, payment_date string, total_amount double, payment_status string, payment_terms string"),
        "invoice_line_items": make([("INV-1", 1, "PRD-0", 1, 1.0, 600.0), ("INV-1", 2, "PRD-1", 1, 1.0, 350.0), ("INV-2", 1, "PRD-0", 1, 1.0, 1.0)], "invoice_id string, line_number long, product_id string, quantity long, unit_cost double, line_total double"),
        "support_tickets": make([("T1", "CUS-1", "PRD-0", "AGT-1"), ("T2", "CUS-2", None, None)], "ticket_id string, customer_id string, product_id string, agent_id string"),
        "call_transcripts": make([("C1", "T1", "CUS-1", "AGT-777", " "), ("C2", None, "CUS-1", "AGT-1", "Ann"), ("C3", "T1", "CUS-1", "AGT-1", "Anna")], "call_id string, ticket_id string, customer_id string, agent_id string, agent_name string"),
    }


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_scores_at_their_bounds(spark):
    grid = spark.createDataFrame([(0, 30, 0.0), (2, 90, 100.0), (5, 180, 500.0), (10, 365, 1000.0), (11, 366, 1000.01), (1, None, -5.0)], "o int, d int, r double")
    got = [tuple(r) for r in grid.select(G.frequency_score(F.col("o")), G.recency_score(F.col("d")), G.monetary_score(F.col("r"))).collect()]
    assert got == [(1, 5, 1), (2, 4, 2), (3, 3, 3), (4, 2, 4), (5, 1, 5), (2, 1, 2)]


def test_customer_features(silver):
    x = by(G.customer_features(silver["customers"], silver["transactions"], DAY), "customer_id")
    a, b, c = x["CUS-1"], x["CUS-2"], x["CUS-3"]
    assert (a.return_count, a.gross_revenue, a.return_amount, a.total_orders) == (1, 99.98, -49.99, 2)
    assert (a.customer_tenure_months, a.days_since_last_purchase, a.purchase_frequency) == (13, 30, pytest.approx(2 / 13))
    assert a.customer_lifetime_value == pytest.approx(49.99 / 13 * 12) and a.customer_segment_score == pytest.approx(round(5 * 0.35 + 2 * 0.35 + 2 * 0.3, 2))
    assert (b.customer_tenure_months, b.purchase_frequency, b.average_order_value, b.total_spend) == (0, 2.0, 200.0, 0)
    assert (c.total_orders, c.purchase_frequency, c.recency_score, c.customer_lifetime_value) == (0, 0.0, 1, 0)


def test_product_features(silver):
    x = by(G.product_features(silver["products"], silver["transactions"], silver["reviews"], silver["vendors"]), "product_id")
    assert [x[f"PRD-{k}"].price_tier for k in range(5)] == ["Low", "Medium", "High", "Premium", "Premium"]
    p = x["PRD-0"]
    assert (p.times_sold, p.total_quantity_sold, p.unique_customers, p.review_count, p.avg_rating, p.stock_turnover_rate) == (3, 7, 2, 2, 4.5, 0.0)
    assert p.velocity_score == pytest.approx(3 / 24) and p.vendor_reliability_weighted_score == pytest.approx(4.28, abs=0.006) and p.profit_margin == pytest.approx(9 / 49)
    assert (x["PRD-4"].velocity_score, x["PRD-4"].profit_margin, x["PRD-1"].stock_turnover_rate, x["PRD-2"].vendor_reliability_weighted_score) == (0.0, 0.0, 0.2, 0)


def test_vendor_features(silver):
    x = by(G.vendor_features(silver["vendors"], silver["products"], silver["invoices"], silver["transactions"]), "vendor_id")
    assert (x["VND-1"].total_outstanding_balance, x["VND-1"].invoice_payment_rate) == (3000.0, 0.5)
    assert (x["VND-2"].total_outstanding_balance, x["VND-2"].invoice_payment_rate, x["VND-3"].total_invoices, x["VND-3"].revenue_per_product) == (0.0, 0.0, 0, 0.0)
    assert x["VND-1"].revenue_generated == pytest.approx(299.98) and x["VND-1"].revenue_per_product == pytest.approx(299.98 / 3)


def test_invoice_features(silver):
    x = by(G.invoice_features(silver["invoices"], G.line_item_stats(silver["invoice_line_items"]), DAY), "invoice_id")
    assert (x["INV-1"].days_to_payment, x["INV-1"].discount_rate_achieved, x["INV-1"].reconciliation_flag, x["INV-1"].line_item_diversity) == (10, 0.667, "OK", 2)
    assert (x["INV-2"].days_overdue, x["INV-2"].is_overdue, x["INV-2"].reconciliation_flag) == (366, True, "MISMATCH")
    assert (x["INV-3"].payment_terms_days, x["INV-3"].days_to_payment, x["INV-3"].discount_rate_achieved, x["INV-3"].reconciliation_flag) == (60, None, None, "NO_REFERENCE")
    assert (x["INV-4"].is_overdue, x["INV-4"].days_overdue) == (False, 0)
    fallback = by(G.line_item_stats_fallback(silver["invoices"], silver["transactions"], silver["products"]), "invoice_id")
    assert (fallback["INV-1"].unique_products, fallback["INV-1"].line_items_total) == (1, 280.0) and fallback["INV-3"].unique_products == 1


def test_graph(silver):
    g = build(silver)
    assert list(g.edges) == EDGE_TABLES and set(g.nodes) == set(NODE_TABLES)
    counts = {n: df.count() for n, df in (g.nodes | g.edges).items()}
    assert (counts["product"], counts["category"], counts["region"], counts["agent"], counts["reviewed"], counts["invoice_item"], counts["handled_by"], counts["about"]) == (5, 2, 2, 2, 2, 3, 1, 1)
    assert {r.id: r.name for r in g.nodes["agent"].collect()} == {"AGT-777": "Agent AGT-777", "AGT-1": "Anna"}
    assert {(r.src, r.dst) for r in g.edges["located_in"].collect()} == {("CUS-1", "South")}
    assert {r.id for r in g.nodes["region"].collect()} == {"South", "South_and_West"}
    assert {(r.src, r.dst) for r in g.edges["similar_to"].collect()} == {(f"PRD-{a}", f"PRD-{b}") for a in range(4) for b in range(4) if a != b}
    assert agents(silver["support_tickets"], None).count() == 1
    assert {r.tbl: r.records for r in sizes(silver).collect()} == counts
    assert set(build({"vendors": silver["vendors"]}).edges) == {"based_in"}
    assert len(get_schema_statements()) == 23


def test_ring_of_a_large_category(spark):
    products = spark.createDataFrame([(f"PRD-{k:03d}", f"VND-{k % 3}", "s", "n", "c") for k in range(200)], "product_id string, vendor_id string, sku string, product_name string, category string").repartition(7)
    edges = {(r.src, r.dst) for r in build({"products": products}).edges["similar_to"].collect()}
    assert edges == {(f"PRD-{k:03d}", f"PRD-{(k + j) % 200:03d}") for k in range(200) for j in (1, 2, 3)}


def test_traversals(silver):
    g = build(silver)
    paths = Traversal(g, "vendor").out("supplies").in_("purchased", {"total_amount": "amount"}).where("amount > 0").rows()
    assert sorted((r.start, r.at, r.amount) for r in paths.collect()) == [("VND-1", "CUS-1", 99.98), ("VND-1", "CUS-2", 200.0)]
    with pytest.raises(ValueError, match="start"):
        Traversal(g, "vendor").out("purchased")
    with pytest.raises(ValueError, match="end"):
        Traversal(g, "vendor").in_("supplies")


def test_graph_queries(silver):
    g = build(silver)
    run = lambda name: get_query(name).run(g)
    found = run("reliable_vendor_products").collect()
    assert [(r.place, r.id, r.product_name) for r in found] == [(0, "VND-1", "P0"), (1, "VND-1", "P2"), (2, "VND-1", "P4")]
    found = by(run("customer_purchase_history"), "id")
    assert [(p.product_name, p.vendor) for p in found["CUS-1"].purchases] == [("P0", "V1"), ("P1", "V2")] and found["CUS-3"].purchases == []
    found = run("related_products").collect()
    related = lambda product, relation: sorted(r.related_name for r in found if (r.source_product, r.relation) == (product, relation))
    assert related("PRD-0", "same_category") == ["P0", "P1", "P2", "P3"] and related("PRD-0", "same_vendor") == ["P0", "P2", "P4"]
    assert related("PRD-1", "co_purchased") == ["P0", "P1"] and related("PRD-4", "co_purchased") == []
    assert by(run("co_purchased_products"), "source_product")["PRD-0"].also_bought == ["P0"] * 5 + ["P1"]
    assert sorted((r.id, r.customer_id) for r in run("top_customers_by_vendor").collect()) == [("VND-1", "CUS-1"), ("VND-1", "CUS-2"), ("VND-1", "CUS-2"), ("VND-2", "CUS-1")]
    found = by(run("vendor_influence"), "id")
    assert tuple(found["VND-1"])[2:] == (3, 2, 3) and tuple(found["VND-3"])[2:] == (0, 0, 0)
    found = by(run("invoice_reconciliation"), "id")
    assert (found["INV-1"].calculated_total, len(found["INV-1"].line_items), found["INV-3"].calculated_total, found["INV-3"].line_items) == (950.0, 2, 0.0, [])
    found = by(run("overdue_vendors"), "id")
    assert {k: r.overdue_invoices for k, r in found.items()} == {"VND-1": 1, "VND-2": 1} and found["VND-1"].supplied_products == 3
    found = by(run("vendor_payment_vs_sales"), "id")
    assert (found["VND-1"].total_invoiced, found["VND-1"].avg_paid_invoice, found["VND-1"].avg_sale_amount) == (4000.0, 1000.0, pytest.approx(149.99))
    assert (found["VND-3"].total_revenue, found["VND-3"].avg_sale_amount) == (0.0, None)
    assert len(list_queries()) == 9
    with pytest.raises(KeyError, match="vendor_influence"):
        get_query("none")


def test_overdue_vendors_name_invoices_and_products(silver):
    found = get_query("overdue_vendors").run(build(silver)).filter("id = 'VND-1'").collect()
    products = sorted(r.product_name for r in found if r.kind == "product")
    invoices = [r for r in found if r.kind == "invoice"]
    assert products == ["P0", "P2", "P4"] and len(invoices) == invoices[0].overdue_invoices == 1
    assert invoices[0].path_id.startswith("INV-") and invoices[0].payment_status != "paid" and invoices[0].total_amount == invoices[0].overdue_amount


# --- first and last rows, errors, the catalog ---


def test_first_and_last_rows_by_place(spark):
    """Places, not values, tell which row of an id stays; rows are dealt so that no task sees them in order."""
    vendors = spark.createDataFrame([("VND-1", "Z", "NO", "North", 0), ("VND-1", "A", "NO", "South", 1), ("VND-0", "B", "NO", "West", 2), ("", "none", "SE", "East", 3), (None, "none", "SE", "East", 4)], "vendor_id string, vendor_name string, country string, region string, _row_id long").repartition(3)
    customers = spark.createDataFrame([("CUS-1", "n", "NO", 0)], "customer_id string, full_name string, country string, _row_id long")
    calls = spark.createDataFrame([("C-9", "A-1", "early", 0), ("C-1", "A-1", "late", 5), ("C-5", "A-1", None, 9)], "call_id string, agent_id string, agent_name string, _row_id long").repartition(3)
    reviews = spark.createDataFrame([("R", "c2", "p9", 5, 0), ("R", "c1", "p1", 1, 7), (None, "c1", "p1", 1, 8)], "review_id string, customer_id string, product_id string, rating int, _row_id long").repartition(3)
    g = build({"vendors": vendors, "customers": customers, "call_transcripts": calls, "reviews": reviews})
    assert sorted((r.id, r.vendor_name) for r in g.nodes["vendor"].collect()) == [("VND-0", "B"), ("VND-1", "Z")]
    assert [r.dst for r in g.edges["located_in"].collect()] == ["West"]
    assert [tuple(r) for r in g.nodes["agent"].collect()] == [("A-1", "late")]
    assert [(r.src, r.dst, r.rating) for r in g.edges["reviewed"].collect()] == [("c2", "p9", 5)]


@pytest.fixture
def odd_silver(spark, tmp_path):
    vendors = [("VND-1", "a", "North & West"), ("VND-1", "b", "North and West"), ("VND-2", "c", "South"), (None, "d", None), (" ", "e", None)]
    spark.createDataFrame([(*v, k) for k, v in enumerate(vendors)], "vendor_id string, vendor_name string, region string, _row_id long").write.parquet(f"{tmp_path}/silver/vendors")
    products = [("PRD-1", "VND-1", "s", "p", "c", 0), ("PRD-1", "VND-1", "s", "p", "c", 1), ("PRD-2", None, "s", "p", "c", 2)]
    spark.createDataFrame(products, "product_id string, vendor_id string, sku string, product_name string, category string, _row_id long").write.parquet(f"{tmp_path}/silver/products")
    return f"{tmp_path}/silver"


def test_errors_are_counted_while_loading(spark, odd_silver, tmp_path):
    loader = GraphLoader(spark, odd_silver, f"{tmp_path}/graph")
    found = {n: (r.table_type, r.records_loaded, r.errors) for n, r in loader.load_all().items()}
    assert found["vendor"] == ("node", 2, 3) and found["product"] == ("node", 2, 1)
    assert found["region"] == ("node", 2, 1) and found["category"] == ("node", 1, 0)
    assert found["supplies"] == ("edge", 1, 1) and found["belongs_to"] == ("edge", 2, 1) and found["based_in"][1:] == (2, 1)
    g = loader.load()
    assert {n: df.count() for n, df in (g.nodes | g.edges).items()} == {n: r[1] for n, r in found.items()}


def test_a_database_with_the_schema(spark, odd_silver, tmp_path, caplog):
    loader = GraphLoader(spark, odd_silver, f"{tmp_path}/graph")
    with pytest.raises(ValueError, match="connected"):
        loader.apply_schema()
    loader.connect("shop_graph")
    try:
        assert loader.apply_schema(["CREATE NONSENSE", "CREATE TABLE extra (a int) USING parquet"]) == 1 and "CREATE NONSENSE" in caplog.text
        assert loader.apply_schema() == len(get_schema_statements()) == 23
        results = loader.load_all()
        assert results["vendor"].records_loaded == 2 and results["supplies"].errors == 1
        results = loader.load_all()
        g = loader.load()
        assert g.nodes["vendor"].count() == 2 and dict(g.nodes["product"].dtypes)["stock_quantity"] == "bigint" and g.edges["supplies"].count() == 1
        found = loader.insert("category", spark.createDataFrame([("a", "A"), (None, "B"), ("c", None)], "id string, name string"))
        assert (found.records_loaded, found.errors) == (1, 2) and [tuple(r) for r in spark.table("shop_graph.category").collect()] == [("a", "A")]
        assert [r.id for r in get_query("vendor_influence").run(g).collect()] and spark.catalog.currentDatabase() == "default"
        loader.close()
        assert loader.database is None
    finally:
        spark.sql("DROP DATABASE shop_graph CASCADE")


def test_product_stats_deal_rows_before_sums(spark, tmp_path):
    """Rows are dealt by product and customer as they come, so no sums stand beside them in the first shuffle."""
    from tessera.plans.features import product_stats

    spark.range(100).selectExpr("concat('P', id % 3) as product_id", "concat('C', id % 5) as customer_id", "cast(id as decimal(18,2)) as total_amount", "id as quantity", "date'2024-01-01' as transaction_date").write.parquet(str(tmp_path / "t"))
    got = product_stats(spark.read.parquet(str(tmp_path / "t")))
    rows = {r.product_id: r for r in got.collect()}
    assert [(rows[f"P{k}"].times_sold, rows[f"P{k}"].unique_customers, rows[f"P{k}"].total_quantity_sold) for k in range(3)] == [(len(range(k, 100, 3)), 5, sum(range(k, 100, 3))) for k in range(3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    first = plan[: plan.index("FileScan")].splitlines()
    assert "REPARTITION_BY_COL" in next(line for line in reversed(first) if "Exchange" in line)


def test_product_stats_add_up_shares_of_customers(spark):
    """Every customer of a product counts once, whichever share they fall in, and an empty one not at all."""
    from tessera.plans.features import product_stats

    rows = [(f"P{k % 3}", f"C{k % 41}" if k % 41 else None, float(k % 7 - 1), 1, f"2024-01-{1 + k % 28:02d}") for k in range(600)]
    got = by(product_stats(spark.createDataFrame(rows, "product_id string, customer_id string, total_amount double, quantity long, transaction_date string")), "product_id")
    for p in ("P0", "P1", "P2"):
        own = [r for r in rows if r[0] == p]
        want = (len(own), sum(r[2] < 0 for r in own), len(own), sum(r[2] for r in own), sum(max(r[2], 0) for r in own), len({r[1] for r in own} - {None}), min(r[4] for r in own), max(r[4] for r in own))
        assert tuple(got[p])[1:] == want


def test_items_are_dealt_once(spark, tmp_path):
    """Distinct products and sums of an invoice take one shuffle."""
    items = [(f"INV-{k % 5}", f"P{k % 4}" if k % 4 else None, float(k)) for k in range(40)]
    spark.createDataFrame(items, "invoice_id string, product_id string, line_total double").write.parquet(str(tmp_path / "i"))
    got = G.line_item_stats(spark.read.parquet(str(tmp_path / "i")))
    want = {i: (i, len({p for x, p, _ in items if x == i} - {None}), sum(t for x, _, t in items if x == i)) for i in {i for i, _, _ in items}}
    assert {r.invoice_id: tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().sparkPlan().toString().count("RepartitionBy") + got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
