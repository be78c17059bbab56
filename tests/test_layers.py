"""Sources, cleaning, validation, references, line items, and the whole run on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera import BronzeIngester, GoldProcessor, GraphLoader, SilverCleaner, SilverProcessor
from tessera.config import entities_of, load_config, load_rules, load_schemas, load_sources
from tessera.functions import scalars as S
from tessera.operators.cleaning import clean_column
from tessera.operators.integrity import judge, judge_line_items, keep_first, line_items, orphans, quarantined, valid
from tessera.operators.validation import histogram, validate
from tessera.plans.pipeline import get_logger, run_pipeline, setup_logging
from tessera.report import overall_pass_rate
from tessera.sources.reader import flatten, read_json, read_source
from tessera.sources.sinks import write_json_array
from tessera.specs import ENTITIES, SourceSpec, get_schema, in_order

DAY = dt.date(2026, 2, 1)


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "k").orderBy("k").select("o").collect()]


@pytest.fixture
def raw(tmp_path):
    """A garden shop: a quoted line break, a price below zero, an unknown vendor, no sku, a spend that is no number, a repeat each of a product and a customer."""
    lines = [
        "sku,product_id,product_name,vendor_id,price,stock_quantity,is_active,category,rating,cost",
        'TL-9,PRD-7010,"Spade, 30""\nsteel",VND-31,24.90,12.0,y,Tools,4.25,11',
        "SE-1,PRD-7020,Bean seed,VND-58,2.5,400,FALSE,Seeds,5,1",
        "PT-3,PRD-7030,Pot,VND-31,-8,30,1,Pots,3,2",
        "SE-1b,PRD-7020,Bean seed (old),VND-58,2,1,TRUE,Seeds,5,1",
        "XX,PRD-7040,Lost,VND-900,3,1,1,Pots,2,1",
        ",PRD-7050,Unnamed,VND-31,3,1,1,Pots,2,1",
    ]
    (tmp_path / "products.csv").write_text("\n".join(lines) + "\n")
    ines = {"customer_id": "CUS-80", "full_name": "Ines Holm", "email": "Ines.Holm@Post.EXAMPLE", "phone": "+47 (22) 33-44.55", "total_spend": 31, "is_active": "1", "address": {"city": "Bergen", "country": "Norway"}, "registration_date": "7-Feb-2023"}
    customers = [
        ines,
        {"customer_id": "CUS-81", "full_name": "Ola", "email": "none", "total_spend": 12.5, "is_active": "perhaps", "address": None, "registration_date": "2031-05-01"},
        {"customer_id": "CUS-82", "full_name": "Per", "total_spend": "a lot", "address": {"city": None, "country": "Norway"}},
        ines | {"full_name": "Ines again"},
    ]
    (tmp_path / "customers.json").write_text(json.dumps({"as_of": "today", "customers": customers}))
    vendors = [("VND-31", "Alder", "Norway", "North & West", 97.25, "ACTIVE"), ("VND-58", "Birch", "Denmark", "South", 88.0, "Paused")]
    names = ("vendor_id", "vendor_name", "country", "region", "reliability_score", "status")
    (tmp_path / "vendors.json").write_text(json.dumps({"vendors": [dict(zip(names, v, strict=True)) | {"categories": ["tools", "pots"]} for v in vendors]}))
    return str(tmp_path)


THREE = (SourceSpec("vendors", "vendors.json", "json", "vendor", "vendors"), SourceSpec("products", "products.csv", "csv", "product"), SourceSpec("customers", "customers.json", "json", "customer", "customers"))


# --- sources ---


def test_bronze_reads_flattens_and_isolates_failures(spark, raw, tmp_path):
    sources = (*THREE, SourceSpec("missing", "none.csv", "csv", "review"), SourceSpec("odd", "vendors.json", "xml", "vendor"))
    results = BronzeIngester(spark, raw, f"{tmp_path}/bronze", sources, csv=True).ingest_all()
    assert {k: r.get("row_count") for k, r in results.items()} == {"vendors": 2, "products": 6, "customers": 4, "missing": None, "odd": None}
    assert "none.csv" in results["missing"]["error"] and "xml" in results["odd"]["error"]
    customers = spark.read.parquet(f"{tmp_path}/bronze/customers")
    assert {"address_city", "address_country", "_source_file", "_loaded_at"} <= set(customers.columns) and customers.select("_loaded_at").distinct().count() == 1
    assert spark.read.parquet(f"{tmp_path}/bronze/products").filter("product_id = 'PRD-7010'").first().product_name == 'Spade, 30"\nsteel'
    assert json.loads(spark.read.parquet(f"{tmp_path}/bronze/vendors").first().categories) == ["tools", "pots"]
    with pytest.raises(FileNotFoundError):
        read_source(spark, sources[3], raw)


def test_json_lines_and_plain_csv_are_splittable(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"k": k, "s": {"t": "x\ny"}}) + "\n" for k in range(5)))
    (tmp_path / "a.csv").write_text("k,t\n" + "".join(f'{k},"a ""b"""\n' for k in range(5)))
    read = lambda *spec, **more: read_source(spark, SourceSpec("a", *spec, "none", **more), str(tmp_path)).orderBy("k").collect()
    assert [(r.k, r.s_t) for r in read("a.jsonl", "jsonl")] == [(k, "x\ny") for k in range(5)]
    assert [(r.k, r.t) for r in read("a.csv", "csv", multiline=False)] == [(str(k), 'a "b"') for k in range(5)]
    (tmp_path / "none.jsonl").write_text("")
    assert read_source(spark, SourceSpec("a", "none.jsonl", "jsonl", "none"), str(tmp_path)).count() == 0


def test_json_forms(spark, tmp_path):
    for name, value in {"list": [{"a": 1}, {"a": 2}], "keyed": {"n": 3, "rows": [{"a": 1}]}, "empty": {"rows": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    count = lambda name, key=None: read_json(spark, str(tmp_path / f"{name}.json"), key).count()
    assert (count("list"), count("keyed"), count("keyed", "rows"), count("empty", "rows"), count("keyed", "other")) == (2, 1, 1, 0, 0)


def test_flatten_keeps_columns_of_the_table_and_serialises_nested(spark):
    df = spark.createDataFrame([(1, (2, "x"), ([1, 2], "y"), "own")], "id int, s struct<a:int,b:string>, c struct<l:array<int>,t:string>, s_b string")
    row = flatten(df).first().asDict()
    assert row == {"id": 1, "s_a": 2, "c": '{"l":[1,2],"t":"y"}', "s_b": "own"}


# --- cleaning ---


def test_cleaning_rules(spark):
    assert column(spark, ["Yes", "NO", "1", "0", "y", "n", "maybe", "", None, " yes"], S.boolean) == [True, False, True, False, True, False, None, None, None, None]
    assert column(spark, ["(555) 123-4567", "+1.555", "UNLISTED", None], S.phone) == ["5551234567", "1555", "UNLISTED", None]
    assert column(spark, ["  a \n b\t", None], S.trim_all) == ["a b", None]
    assert column(spark, ["hello world", "ABC"], S.titlecase) == ["Hello World", "Abc"]
    df = spark.createDataFrame([("A", 1)], "s string, n int")
    assert clean_column(df, "s", "nothing")[1] is clean_column(df, "n", "lowercase")[1] is clean_column(df, "x", "lowercase")[1] is False
    assert clean_column(df, "s", "lowercase")[0].first().s == "a"


def test_dates(spark):
    given = ["2024-01-15", "03/25/2024", "25/03/2025", "20-03-2025", "03/04/2025", "15-Jan-2024", "2024-06-01T00:00:00", "2025-03-15T09:23:45Z", " 2025-01-02 ", "1742000000", "20250315", "Mar 5, 2025", "5th of March 2025", "soon", "", None, "2025-03-15x"]
    want = ["2024-01-15", "2024-03-25", "2025-03-25", "2025-03-20", "2025-03-04", "2024-01-15", "2024-06-01", "2025-03-15", "2025-01-02", "2025-03-15", "1970-08-23", "2025-03-05", "2025-03-05", "soon", "", None, "2025-03-15x"]
    assert column(spark, given, lambda c: S.date_iso(c, DAY)) == want


def test_casts_and_identifiers(spark):
    cells = ["3", "3.0", "3.5", " 3 ", "", "x", None, "9007199254740993"]
    assert column(spark, cells, S.lax_int) == [3, 3, None, 3, None, None, None, 9007199254740993]
    assert column(spark, ["3.7", "2.5", "-2.5", "x", "1e30"], S.rounded_int) == [4, 3, -3, None, None]
    assert column(spark, ["100.9", "x", None], S.safe_int) == [100, None, None]
    assert column(spark, ["TRUE", "yes", "no", None], S.safe_bool) == [True, True, False, False]
    assert column(spark, [" a ", "null", "", None], S.safe_str) == ["a", None, None, None]
    assert column(spark, [" `CUS-1`\u0007 "], S.sanitize_id) == ["CUS-1"]
    assert column(spark, ["South & East"], S.slug) == ["South_and_East"]
    assert column(spark, ["user@example.com", "not-an-email", "user@", None, "", "N/A"], S.email_or_null) == ["user@example.com", None, None, None, None, None]
    months = spark.sql("select date'2024-01-31' a, date'2024-02-01' b").select(S.months_between_starts(F.col("a"), F.col("b"))).first()[0]
    assert months == 1


# --- validation and references ---


def errors_of(spark, entity, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cells.items()))
    row = validate(df, ENTITIES[entity], DAY).first()
    return row, {e.field: e.type for e in row._errors}


def test_error_types(spark):
    _, found = errors_of(spark, "product", product_id="PRD-1\n", vendor_id="V", sku=None, product_name=5.0, price="-1", cost="x", stock_quantity="3.5", rating="nan", is_active="perhaps")
    assert found == {"product_id": "string_pattern_mismatch", "vendor_id": "string_pattern_mismatch", "sku": "missing", "product_name": "string_type", "price": "greater_than_equal", "cost": "float_parsing", "stock_quantity": "int_parsing", "rating": "less_than_equal", "is_active": "bool_parsing"}
    assert errors_of(spark, "product", product_id="PRD-1", vendor_id="VND-1", sku="s", product_name="n", stock_quantity=3.5)[1] == {"stock_quantity": "int_from_float"}
    assert errors_of(spark, "review", review_id=" ", product_id="p", customer_id="c", rating="6")[1] == {"review_id": "value_error", "rating": "less_than_equal"}


def test_transforms_set_to_null(spark):
    row, found = errors_of(spark, "customer", customer_id="CUS-1", full_name="n", email="user@", registration_date="2099-12-31", last_purchase_date="junk")
    assert row.email is None and row.registration_date is None and found == {"last_purchase_date": "value_error"}
    row, found = errors_of(spark, "invoice", invoice_id="INV-A1", vendor_id="v", tax_rate="1.5", payment_method=" Credit Card ")
    assert row.tax_rate is None and row.payment_method == "credit_card" and not found
    assert [c for c in row.asDict() if c[0] != "_"] == ENTITIES["invoice"].columns


def test_first_row_of_a_key_stays(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 3)], "k string, o long")
    assert sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect()), key=str) == sorted([("a", 1), (None, 4), ("b", 3)], key=str)


def test_orphans_and_their_errors_come_first(spark):
    df = spark.createDataFrame([("r1", "p1", "c1", "9", 0), ("r2", "px", "cx", "9", 1), ("r3", "", "c1", "3", 2), ("r4", "p1", "c1", "3", 3)], "review_id string, product_id string, customer_id string, rating string, _row_id long")
    parents = {"product": spark.createDataFrame([("p1",), ("p1",), (None,)], "id string"), "customer": spark.createDataFrame([("c1",)], "id string")}
    x = judge(df, ENTITIES["review"], parents, DAY)
    assert {r.row_index: [e.type for e in r.errors] for r in quarantined(x).collect()} == {0: ["less_than_equal"], 1: ["referential_integrity"] * 2}
    assert {r.review_id for r in valid(x).collect()} == {"r3", "r4"}
    assert [tuple(r) for r in histogram(x).collect()] == [("less_than_equal", 1), ("referential_integrity", 1)]
    assert quarantined(x).filter("row_index = 1").first().record["product_id"] == "px"
    assert orphans(df, {}).filter(F.size("_orphan") > 0).count() == 0


def test_line_items(spark):
    items = json.dumps([{"line_number": 1, "product_id": "PRD-001", "quantity": 2, "unit_cost": 1.5, "line_total": 3}, {"line_number": 2, "product_id": "PRD-UNKNOWN", "quantity": "x", "unit_cost": 1, "line_total": 1}, {"line_number": 3, "product_id": "PRD-NO", "line_total": 1}])
    df = spark.createDataFrame([("INV-1", items), ("INV-2", items), ("INV-3", "no list"), ("INV-4", None)], "invoice_id string, line_items_json string")
    found = line_items(df, spark.createDataFrame([("INV-1",), ("INV-3",), ("INV-4",)], "invoice_id string"))
    assert sorted((r.invoice_id, r._row_id) for r in found.collect()) == [("INV-1", 0), ("INV-1", 1), ("INV-1", 2)]
    judged = judge_line_items(found, spark.createDataFrame([("PRD-001",)], "product_id string"), DAY)
    assert [(r.line_number, r.quantity, r.line_total) for r in valid(judged).collect()] == [(1, 2, 3.0)]
    assert {r.row_index: [e.type for e in r.errors] for r in quarantined(judged).collect()} == {1: ["int_parsing"], 2: ["referential_integrity"]}
    assert valid(judge_line_items(found, None, DAY)).count() == 2


# --- runs ---


def test_silver(spark, raw, tmp_path):
    BronzeIngester(spark, raw, f"{tmp_path}/bronze", THREE).ingest_all()
    processor = SilverProcessor(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/quarantine", THREE)
    for _ in range(2):
        results = processor.process_all()
        figures = {k: (r.total, r.valid, r.quarantined, r.duplicates_removed, r.orphaned) for k, r in results.items()}
        assert figures == {"vendors": (2, 2, 0, 0, 0), "products": (6, 2, 3, 1, 1), "customers": (4, 2, 1, 1, 0)}
    products = {r.product_id: r for r in spark.read.parquet(f"{tmp_path}/silver/products").collect()}
    assert (products["PRD-7020"].product_name, products["PRD-7020"].is_active, products["PRD-7010"].stock_quantity, products["PRD-7010"].is_active) == ("Bean seed", False, 12, True)
    assert spark.read.parquet(f"{tmp_path}/silver/products").columns == [*ENTITIES["product"].columns, "source_file", "loaded_at", "_row_id"]
    customers = {r.customer_id: r for r in spark.read.parquet(f"{tmp_path}/silver/customers").collect()}
    ines, ola = customers["CUS-80"], customers["CUS-81"]
    assert (ines.full_name, ines.email, ines.phone, ines.registration_date, ines.total_spend) == ("Ines Holm", "ines.holm@post.example", "4722334455", "2023-02-07", 31.0)
    assert ola.email is ola.registration_date is ola.is_active is None and ola.total_spend == 12.5
    bad = {r.record.product_id: [e.type for e in r.errors] for r in spark.read.json(f"{tmp_path}/quarantine/products").collect()}
    assert bad == {"PRD-7030": ["greater_than_equal"], "PRD-7040": ["referential_integrity"], "PRD-7050": ["missing"]}
    assert results["products"].errors == {"greater_than_equal": 1, "referential_integrity": 1, "missing": 1} and results["customers"].errors == {"float_parsing": 1}
    assert "status" in results["vendors"].cleaned and results["products"].pass_rate == pytest.approx(1 / 3)


def test_whole_run_twice(spark, raw, tmp_path):
    item = '"[{""line_number"": 1, ""product_id"": ""PRD-7020"", ""quantity"": 3, ""line_total"": 7.5}]"'
    (tmp_path / "invoices.csv").write_text(f"invoice_id,vendor_id,invoice_date,due_date,total_amount,payment_status,payment_terms,line_items_json\nINV-0F,VND-31,2025-03-01,2025-03-31,7.5,Unpaid,NET30,{item}\nINV-1E,VND-900,2025-03-01,2025-03-31,1,paid,NET30,[]\n")
    sales = [("TXN-A1", "CUS-80", "PRD-7010", "2025-11-03", 1, 24.9), ("TXN-B2", "CUS-99", "PRD-7010", "2025-11-04", 1, 24.9), ("TXN-C3", "CUS-81", "PRD-7020", "2025-11-05", -1, -2.5)]
    spark.createDataFrame(sales, "transaction_id string, customer_id string, product_id string, transaction_date string, quantity int, total_amount double").write.parquet(f"{raw}/sales_transactions.parquet")
    (tmp_path / "product_reviews.json").write_text(json.dumps({"reviews": [{"review_id": "R-5", "product_id": "PRD-7020", "customer_id": "CUS-81", "rating": 2, "response": {"responder": "shop", "response_text": "sorry"}}]}))
    sources = (*THREE, SourceSpec("transactions", "sales_transactions.parquet", "parquet", "transaction"), SourceSpec("invoices", "invoices.csv", "csv", "invoice"), SourceSpec("reviews", "product_reviews.json", "json", "review", "reviews"))
    config = load_config(env={"PIPELINE_DATA__INPUT_DIR": raw, "PIPELINE_DATA__OUTPUT_DIR": f"{tmp_path}/out"})
    results = [run_pipeline(spark, config, fresh=fresh, sources=sources) for fresh in (False, True)]
    counts = [{t: f.row_count for t, f in r["gold"].items()} | {t: g.records_loaded for t, g in r["graph"].items()} for r in results]
    assert counts[0] == counts[1]
    assert [len(f.columns) for f in results[0]["gold"].values()] == [20, 18, 16, 15]
    assert (counts[0]["customer_features"], counts[0]["purchased"], counts[0]["region"]) == (2, 2, 2) and counts[0]["invoice_item"] == counts[0]["reviewed"] == counts[0]["located_in"] == 1
    invoice = spark.read.parquet(f"{tmp_path}/out/processed/gold/invoice_features").first()
    assert (invoice.reconciliation_flag, invoice.line_item_diversity, invoice.is_overdue, invoice.payment_terms_days) == ("OK", 1, True, 30)
    report = results[0]["report"]["path"].read_text()
    assert "| products | 6 | 2 | 3 | 1 | 1 | 33.3% |" in report
    assert "| referential integrity to vendor | products | 1 | quarantined |" in report and "| repeated customer_id | customers | 1 | the first row stays |" in report
    assert "| email: no address | customers |  | set to null |" in report and f"- `{tmp_path}/out/quarantine/customers`: 1 records" in report
    assert overall_pass_rate(results[0]["bronze"], results[0]["silver"]) == pytest.approx(10 / 18)
    assert set(run_pipeline(spark, config, ["bronze"], sources=sources)) == {"bronze"}
    graph = GraphLoader(spark, f"{tmp_path}/out/processed/silver", f"{tmp_path}/out/processed/graph").load()
    assert graph.edges["located_in"].first().dst == "North_and_West"
    GoldProcessor(spark, f"{tmp_path}/out/processed/silver", f"{tmp_path}/out/processed/gold").close()


SCHEMAS = """
schemas:
  vendor:
    primary_key: vendor_id
    fields:
      vendor_id: {type: string, required: true, pattern: '^VND-\\d+$'}
      status: {type: string, clean: shout}
      country: {clean: not_there}
      score: {type: float, min: 0, max: 90}
  product:
    primary_key: product_id
    fields:
      product_id: {type: string, required: true}
      vendor_id: {type: string, required: true, foreign_key: vendor}
      is_active: {type: boolean, clean: yes_no}
"""
RULES = """
cleaners:
  shout: {type: case, case: upper}
  yes_no: {type: boolean}
  odd: {type: nothing}
"""


def test_silver_from_files_alone(spark, tmp_path):
    """Schemas and rules come from files; an unknown rule, and one of an unknown type, change nothing."""
    (tmp_path / "schemas.yaml").write_text(SCHEMAS)
    (tmp_path / "rules.yaml").write_text(RULES)
    vendors = [{"vendor_id": "VND-1", "status": "open", "country": " no ", "score": 90}, {"vendor_id": "VND-2", "status": "shut", "country": "se", "score": 90.5}, {"vendor_id": "VND-1", "status": "again", "country": "no", "score": 1}]
    (tmp_path / "vendors.json").write_text(json.dumps(vendors))
    (tmp_path / "products.csv").write_text("product_id,vendor_id,is_active,price\np1,VND-1,Yes,3\np2,VND-2,no,4\n,VND-1,no,5\n")
    sources = (SourceSpec("products", "products.csv", "csv", "product"), SourceSpec("vendors", "vendors.json", "json", "vendor"))
    BronzeIngester(spark, str(tmp_path), f"{tmp_path}/bronze", sources).ingest_all()
    entities, rules = load_schemas(tmp_path / "schemas.yaml"), load_rules(tmp_path / "rules.yaml")
    results = SilverProcessor(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/quarantine", sources, entities=entities, rules=rules, quarantine_array=True).process_all()
    assert list(results) == ["vendors", "products"]
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/silver/vendors").collect()] == [("VND-1", "OPEN", " no ", 90.0)]
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/silver/products").collect()] == [("p1", "VND-1", True)]
    assert results["vendors"].cleaned == ["status"] and results["vendors"].errors == {"less_than_equal": 1}
    found = json.loads((tmp_path / "quarantine/products").read_text())
    assert [(r["row_index"], r["record"]["product_id"], [e["type"] for e in r["errors"]]) for r in found] == [(1, "p2", ["referential_integrity"]), (2, None, ["missing"])]
    assert load_schemas(tmp_path / "none.yaml") == {} and load_rules(tmp_path / "none.yaml") == {"cleaners": {}}
    with pytest.raises(ValueError, match="unknown type"):
        entities_of({"schemas": {"a": {"fields": {"b": {"type": "money"}}}}})


def test_cleaner_of_described_rules(spark):
    described = {"cleaners": {"name": {"type": "case", "case": "title"}, "tidy": {"type": "string", "operations": ["normalize_whitespace", "trim", "other"]}, "odd": {"type": "case", "case": "none"}, "none": {"type": "string", "operations": []}}}
    cleaner = SilverCleaner(described)
    df = spark.createDataFrame([(" a  b ", 1)], "s string, n int")
    assert cleaner.clean_column(df, "s", "name")[0].first().s == " A  B " and cleaner.clean_column(df, "s", "tidy")[0].first().s == "a b"
    assert [cleaner.clean_column(df, c, r)[1] for c, r in (("s", "odd"), ("s", "none"), ("s", "lowercase"), ("n", "name"), ("x", "name"))] == [False] * 5
    assert SilverCleaner({}).rules == {} and "date_iso" in SilverCleaner().rules


def test_json_array_sink(spark, tmp_path):
    df = spark.range(500).selectExpr("499 - id as row_index", "nullif(id % 3, 0) as v", "array(id) as l").repartition(7)
    write_json_array(df, f"{tmp_path}/a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"row_index": k, "v": (499 - k) % 3 or None, "l": [499 - k]} for k in range(500)]
    write_json_array(df.limit(0), f"{tmp_path}/a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == []
    write_json_array(df.withColumn("row_index", F.lit(1)), f"{tmp_path}/a.json")
    assert len(json.loads((tmp_path / "a.json").read_text())) == 500


# --- settings ---


def test_settings_and_specs(tmp_path):
    (tmp_path / "c.yaml").write_text("pipeline: {name: mine}\nlayers: {graph: false}\nfeature_engineering: {reference_date: 2025-05-05}\n")
    config = load_config(tmp_path / "c.yaml", env={"PIPELINE_VALIDATION__STRICT_MODE": "true", "PIPELINE_NONE": "1", "PIPELINE_VERSION": "2"})
    assert (config.name, config.layers.graph, config.layers.gold, config.feature_engineering.reference_date, config.validation.strict_mode, config.version) == ("mine", False, True, dt.date(2025, 5, 5), True, "2")
    assert load_config(tmp_path / "none.yaml", env={}).validation.max_quarantine_rate == 0.2
    (tmp_path / "s.yaml").write_text("sources: {a: {file: a.csv, format: csv, schema: review}, b: {file: b.json, format: json, data_key: b}}\n")
    assert [s.data_key for s in load_sources(tmp_path / "s.yaml")] == [None, "b"]
    with pytest.raises(ValueError, match="unknown"):
        get_schema("nothing")
    assert [s.name for s in in_order((*THREE[1:], THREE[0]))] == ["customers", "vendors", "products"]


def test_logging(tmp_path):
    path = setup_logging(str(tmp_path / "logs"), "INFO", console=False, log_format="%(levelname)s <%(message)s>")
    get_logger("x").info("said")
    assert path.read_text() == "INFO <said>\n"
    setup_logging(None, console=False)


def test_first_places_keep_what_the_window_keeps(spark, tmp_path):
    """Repeated and null keys; only keys and places are shuffled."""
    from tessera.operators.integrity import first_places

    df = spark.range(300).selectExpr("if(id % 7 = 0, null, cast(id % 100 as string)) as key", "299 - id as _row_id", "repeat('x', 50) as wide")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = first_places(df, ["key"], "_row_id", str(tmp_path / "again"))
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, keep_first(df, ["key"], ["_row_id"]).collect()))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("again", [0, 40])
def test_silver_of_invoices_keeps_records_of_bad_rows_alone(spark, tmp_path, again):
    """With few and with many repeated keys, and dates of known and of odd forms."""
    from tessera.plans.silver import SilverProcessor
    from tessera.specs import SourceSpec

    item = '[{"line_number": "1", "product_id": "P", "quantity": "2", "line_total": "3"}]'
    rows = [(f"INV-{k:X}" if k % 10 else "bad", "V", "2024-01-02" if k % 3 else "Jan 2nd 2024", "2024-01-03", item, k) for k in [*range(100), *range(again)]]
    rows = [(*r[:5], n) for n, r in enumerate(rows)]
    spark.createDataFrame(rows, "invoice_id string, vendor_id string, invoice_date string, due_date string, line_items_json string, _row_id long").write.parquet(f"{tmp_path}/bronze/invoices")
    found = SilverProcessor(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/quarantine", (SourceSpec("invoices", "x", "csv", "invoice"),), DAY).process_all()
    r = found["invoices"]
    assert (r.total, r.valid, r.quarantined, r.duplicates_removed) == (100 + again, 90, 1, 9 + again)
    silver = spark.read.parquet(f"{tmp_path}/silver/invoices")
    assert {x.invoice_date for x in silver.select("invoice_date").distinct().collect()} == {"2024-01-02"} and "_items" not in silver.columns
    judged = spark.read.parquet(f"{tmp_path}/silver/_judged/invoices")
    assert judged.filter("_raw is not null").count() == 1
    assert (found["invoice_line_items"].total, found["invoice_line_items"].valid) == (90, 90)
    (bad,) = spark.read.json(f"{tmp_path}/quarantine/invoices").collect()
    assert bad.record.line_items_json == item and bad.record.invoice_date == "2024-01-02" and "_items" not in bad.record.asDict()


def test_packed_rows_come_back(spark):
    """Records and errors pass as text: empty cells, quotes, line breaks and characters beyond ASCII stay, and good rows carry neither."""
    from tessera.operators.integrity import packed, sound, unpacked

    rows = [("PRD-1", "VND-1", "s", "fine", "1", 0), ("PRD-2", None, 'q"\n\\', "ü\t☃ 😀", "x", 1), ("PRD-3", "VND-9", "s", "lost", "2", 2)]
    df = spark.createDataFrame(rows, "product_id string, vendor_id string, sku string, product_name string, price string, _row_id long")
    judged = judge(df, ENTITIES["product"], {"vendor": spark.createDataFrame([("VND-1",)], "vendor_id string")}, DAY)
    assert [r.product_id for r in judged.filter("_raw is null").collect()] == ["PRD-1"]
    table = packed(judged)
    assert sorted(map(str, sound(table).collect())) == sorted(map(str, valid(judged).collect()))
    assert sorted(map(str, quarantined(unpacked(table)).collect())) == sorted(map(str, quarantined(judged).collect()))
    (bad,) = quarantined(unpacked(table)).filter("row_index = 1").collect()
    assert bad.record == dict(zip(df.columns[:5], rows[1], strict=False)) and [e.type for e in bad.errors] == ["missing", "float_parsing"]


def most_rows_sent(spark, since=0):
    """(the most rows of a side of a join that was sent to all tasks, how many executions there were)"""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    done = store.executionsList()
    for i in range(since, done.size()):
        values, nodes = store.executionMetrics(done.apply(i).executionId()), store.planGraph(done.apply(i).executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, done.size()


@pytest.fixture
def one_mb(spark):
    """Spark sends files of up to 1 MB to all tasks."""
    spark.conf.set(key := "spark.sql.autoBroadcastJoinThreshold", "1m")
    yield key
    spark.conf.unset(key)


@pytest.mark.parametrize(("n", "most", "sent"), [(90_000, "1m", 100), (900, "-1", 0), (900, "1m", 900)])
def test_keys_go_to_all_tasks_by_their_rows(spark, tmp_path, one_mb, n, most, sent):
    """Files of 90,000 keys take less than 1 MB, and their rows more; lost, empty and null references are judged alike."""
    from tessera.plans.silver import SilverProcessor

    spark.conf.set(one_mb, most)
    _, since = most_rows_sent(spark)
    spark.range(n).selectExpr("concat('VND-', id) as vendor_id", "'V' as vendor_name", "id as _row_id").write.parquet(f"{tmp_path}/bronze/vendors")
    vendor = f"case when id % 10 = 3 then concat('VND-', {n} + id) when id % 10 = 5 then '' when id % 10 <> 7 then concat('VND-', id) end"
    spark.range(100).selectExpr("concat('PRD-', id) as product_id", f"{vendor} as vendor_id", "'s' as sku", "'p' as product_name", "id as _row_id").write.parquet(f"{tmp_path}/bronze/products")
    sources = (SourceSpec("vendors", "x", "csv", "vendor"), SourceSpec("products", "x", "csv", "product"))
    found = SilverProcessor(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/quarantine", sources, DAY).process_all()
    assert found["vendors"].valid == n
    assert (found["products"].valid, found["products"].orphaned, found["products"].errors) == (70, 10, {"referential_integrity": 10, "string_pattern_mismatch": 10, "missing": 10})
    assert {r.row_index % 10 for r in spark.read.json(f"{tmp_path}/quarantine/products").filter("errors[0].type = 'referential_integrity'").collect()} == {3}
    assert most_rows_sent(spark, since)[0] <= sent


def test_graph_sends_no_table_that_only_looks_small(spark, tmp_path, one_mb):
    """Ids of one category take little room in files. What the session was told before holds again behind the graph."""
    n = 90_000
    _, since = most_rows_sent(spark)
    spark.range(n).selectExpr("concat('PRD-', id) as product_id", "'VND-1' as vendor_id", "'a category with a name of some length' as category", "id as _row_id").write.parquet(f"{tmp_path}/silver/products")
    found = GraphLoader(spark, f"{tmp_path}/silver", f"{tmp_path}/graph").load_all()
    assert (found["product"].records_loaded, found["similar_to"].records_loaded) == (n, 3 * n)
    assert most_rows_sent(spark, since)[0] < 1000
    assert spark.conf.get(one_mb) == "1m" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_json_array_of_texts_that_start_alike(spark, tmp_path):
    """Rows of one place in the order are dealt by the start of their texts, and sorted by the whole of them."""
    df = spark.range(300).selectExpr("1 as row_index", "concat(repeat('x', 100), lpad(cast(299 - id as string), 3, '0')) as v").repartition(5)
    write_json_array(df, f"{tmp_path}/a.json")
    assert [r["v"][-3:] for r in json.loads((tmp_path / "a.json").read_text())] == [f"{k:03}" for k in range(300)]
