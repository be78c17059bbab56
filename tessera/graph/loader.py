"""Node and edge tables from the Silver tables: a projection each, with no step per row."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import safe_bool, safe_float, safe_int, safe_str, sanitize_id, slug
from ..session import side_by_side
from ..sizes import measured_joins
from ..sources.places import ROW
from ..sources.reader import exists
from ..sources.sinks import scratch, write_table
from .schema import EDGES, NODES, get_schema_statements, required

log = logging.getLogger(__name__)

_SAFE: dict[str, Callable[[Column], Column]] = {"string": safe_str, "double": safe_float, "bigint": safe_int, "boolean": safe_bool}
#: How many of the next products of its category a product is similar to.
NEIGHBOURS = 3
#: How many rows of its source a row stands for.
COUNT = "_rows"


@dataclass
class LoadResult:
    table: str
    table_type: str
    records_loaded: int = 0
    errors: int = 0


def _cell(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _props(df: DataFrame, properties: tuple[tuple[str, str, bool], ...], source: dict[str, str] | None = None) -> list[Column]:
    out = []
    for name, kind, needed in properties:
        c = _cell(df, (source or {}).get(name, name))
        out.append((F.coalesce(c.cast("string"), F.lit("")) if needed and kind == "string" else _SAFE[kind](c)).alias(name))
    return out


def _least(df: DataFrame, *columns: str) -> Column:
    """The struct of ``columns`` of a group's first row by the place in its source; where that is not known, the least struct."""
    return F.min_by(F.struct(*columns), ROW) if ROW in df.columns else F.min(F.struct(*columns))


def _place(df: DataFrame) -> list[Column]:
    return [F.col(ROW)] if ROW in df.columns else []


def counted_nodes(df: DataFrame, table: str, id_col: str) -> DataFrame:
    """(id, properties, _rows): each id once, with its first row and the number of its rows; all rows without an id are one with a null id."""
    x = df.select(F.nullif(sanitize_id(safe_str(F.col(id_col))), F.lit("")).alias("id"), *_props(df, NODES[table]), *_place(df))
    rest = [c for c in x.columns if c not in ("id", ROW)]
    return x.groupBy("id").agg(_least(x, *rest).alias("p"), F.count("*").alias(COUNT)).select("id", "p.*", COUNT)


def node(df: DataFrame, table: str, id_col: str) -> DataFrame:
    """(id, properties): rows without an id are left out, and of rows with one id the first stays."""
    return _plain(counted_nodes(df, table, id_col))


def _plain(counted: DataFrame) -> DataFrame:
    return counted.filter(F.col(counted.columns[0]).isNotNull()).drop(COUNT)


def named(df: DataFrame, column: str) -> DataFrame:
    """(id, name, _rows): the distinct values of a column under their slugs; of values with one slug the first by name stays."""
    name = safe_str(F.col(column))
    x = df.select(slug(name).alias("id"), name.alias("name")).filter("name is not null")
    return x.distinct().groupBy("id").agg(F.min("name").alias("name"), F.count("*").alias(COUNT))


def agents(tickets: DataFrame | None, calls: DataFrame | None) -> DataFrame:
    """(id, name): agents of tickets and calls; a name comes from the last of the calls that have one, else it is made from the id.

    The last call is that with the largest place, or call_id where places are not known.
    """
    parts = []
    if tickets is not None:
        parts.append(tickets.select(safe_str(_cell(tickets, "agent_id")).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("place"), F.lit("").alias("at")))
    if calls is not None:
        place = F.col(ROW) if ROW in calls.columns else F.lit(None).cast("long")
        parts.append(calls.select(safe_str(_cell(calls, "agent_id")).alias("id"), safe_str(_cell(calls, "agent_name")).alias("name"), place.alias("place"), F.coalesce(_cell(calls, "call_id"), F.lit("")).alias("at")))
    x = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    last = F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("place", "at", "name")))
    return x.filter("id is not null").groupBy("id").agg(last.alias("name")).select("id", F.coalesce("name", F.concat(F.lit("Agent "), F.col("id"))).alias("name"))


def counted_edges(df: DataFrame, table: str, src: str, dst: str | Column, source: dict[str, str] | None = None) -> DataFrame:
    """(src, dst, properties, _rows): what the schema calls unique once, with its first row and the number of its rows; rows without both ends are left out."""
    _, _, properties, unique = EDGES[table]
    end = safe_str(F.col(dst)) if isinstance(dst, str) else dst
    x = df.select(safe_str(F.col(src)).alias("src"), end.alias("dst"), *_props(df, properties, source), *_place(df)).filter("src is not null and dst is not null")
    if table in _KEYED:
        x = x.filter(F.col(_KEYED[table]).isNotNull())
    columns = [c for c in x.columns if c != ROW]
    if not unique:
        return x.select(*columns, F.lit(1).cast("long").alias(COUNT))
    keys = list(unique)
    rest = [c for c in columns if c not in keys]
    if not rest:
        return x.groupBy(*keys).agg(F.count("*").alias(COUNT)).select(*columns, COUNT)
    return x.groupBy(*keys).agg(_least(x, *rest).alias("p"), F.count("*").alias(COUNT)).select(*[c if c in keys else f"p.{c}" for c in columns], COUNT)


def edge(df: DataFrame, table: str, src: str, dst: str | Column, source: dict[str, str] | None = None) -> DataFrame:
    """(src, dst, properties): rows without both ends are left out, and what the schema calls unique is kept once, its first row."""
    return _plain(counted_edges(df, table, src, dst, source))


def located_in(customers: DataFrame, vendors: DataFrame) -> DataFrame:
    """Customer to region, counted: of the last vendor, by place or else by id, of the customer's country, else the customer's own region."""
    country, region, last = safe_str(F.col("country")), safe_str(F.col("region")), ROW if ROW in vendors.columns else "vendor_id"
    by_country = vendors.select(country.alias("c"), region.alias("r"), last).filter("c is not null and r is not null").groupBy("c").agg(F.max_by("r", last).alias("r"))
    own = F.coalesce(safe_str(_cell(customers, "address_country")), safe_str(_cell(customers, "country")))
    x = customers.select("customer_id", own.alias("own"), safe_str(_cell(customers, "region")).alias("region"), *_place(customers))
    x = x.join(by_country, x.own == by_country.c, "left").withColumn("to", F.coalesce("r", "region"))
    return counted_edges(x, "located_in", "customer_id", slug(F.col("to")))


def similar_to(products: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Product to the next products of its category by id, around the end to the first.

    Places within a category come from two passes, so that no task has to sort a
    whole category: ids are dealt to ranges of the sorted table, ranges are counted,
    and a row's place is the count of the ranges before plus its place in its range.
    """
    x = products.select(safe_str(F.col("category")).alias("category"), safe_str(F.col("product_id")).alias("id")).filter("category is not null and id is not null").distinct()
    # Written, so that the count of each range and the rows in it come from one and the same cut, also if an executor is lost.
    x = write_table(x.repartitionByRange("category", "id").withColumn("part", F.spark_partition_id()), scratch(x.sparkSession))
    counts = x.groupBy("category", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("category").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("category", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("category")).alias("size"))
    inside = F.row_number().over(W.partitionBy("category", "part").orderBy("id")) - 1
    x = x.withColumn("inside", inside).join(counts, ["category", "part"]).select("category", "id", (F.col("start") + F.col("inside")).alias("place"), "size").filter("size > 1")
    steps = F.explode(F.sequence(F.lit(1), F.least(F.col("size") - 1, F.lit(neighbours)).cast("int")))
    a = x.select("category", F.col("id").alias("src"), "place", "size", steps.alias("step")).select("category", "src", ((F.col("place") + F.col("step")) % F.col("size")).alias("place"))
    b = x.select("category", "place", F.col("id").alias("dst"))
    return a.join(b, ["category", "place"]).select("src", "dst").filter("src <> dst").distinct()


# Where nodes and edges come from: Silver table and columns.
_NODES_OF = {"vendor": ("vendors", "vendor_id"), "customer": ("customers", "customer_id"), "product": ("products", "product_id"), "invoice": ("invoices", "invoice_id"), "support_ticket": ("support_tickets", "ticket_id"), "call_transcript": ("call_transcripts", "call_id")}
_NAMES_OF = {"category": ("products", "category"), "region": ("vendors", "region")}
_EDGES_OF = {
    "supplies": ("products", "vendor_id", "product_id"),
    "belongs_to": ("products", "product_id", "category"),
    "based_in": ("vendors", "vendor_id", "region"),
    "purchased": ("transactions", "customer_id", "product_id"),
    "billed": ("invoices", "vendor_id", "invoice_id"),
    "invoice_item": ("invoice_line_items", "invoice_id", "product_id"),
    "reviewed": ("reviews", "customer_id", "product_id"),
    "raised": ("support_tickets", "customer_id", "ticket_id"),
    "about": ("support_tickets", "ticket_id", "product_id"),
    "handled_by": ("support_tickets", "ticket_id", "agent_id"),
    "includes_transcript": ("call_transcripts", "ticket_id", "call_id"),
    "conducted_by": ("call_transcripts", "call_id", "agent_id"),
}
#: Edges that a row makes only if it has this column.
_KEYED = {"purchased": "transaction_id", "reviewed": "review_id"}
_RENAMED = {"reviewed": {"response_text": "response_response_text", "response_date": "response_response_date"}}


def _end(table: str, column: str) -> Column:
    """The id that an edge ends at: names stand under their slugs."""
    value = safe_str(F.col(column))
    return slug(value) if EDGES[table][1] in _NAMES_OF else value


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __or__(self, other: Mapping[str, DataFrame]) -> Tables:
        return Tables(self.makers | {n: lambda n=n: other[n] for n in other})

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


class Graph:
    """Node and edge tables by name."""

    def __init__(self, nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> None:
        self.nodes, self.edges = nodes, edges


def build(silver: Mapping[str, DataFrame], counted: bool = False) -> Graph:
    """The graph of the Silver tables that are given; a table that is missing leaves out what needs it.

    ``counted``: tables have a column _rows, the number of source rows that a row
    stands for, and rows without an id are one with a null id.
    """
    get = silver.get
    nodes: dict[str, Callable[[], DataFrame]] = {}
    edges: dict[str, Callable[[], DataFrame]] = {}
    for table, (name, key) in _NODES_OF.items():
        if name in silver:
            nodes[table] = lambda table=table, name=name, key=key: counted_nodes(silver[name], table, key)
    for table, (name, column) in _NAMES_OF.items():
        if name in silver:
            nodes[table] = lambda name=name, column=column: named(silver[name], column)
    if "support_tickets" in silver or "call_transcripts" in silver:
        nodes["agent"] = lambda: agents(get("support_tickets"), get("call_transcripts"))
    for table, (name, src, dst) in _EDGES_OF.items():
        if name in silver and {src, dst} <= set(silver[name].columns):
            edges[table] = lambda table=table, name=name, src=src, dst=dst: counted_edges(silver[name], table, src, _end(table, dst), _RENAMED.get(table))
    if "customers" in silver and "vendors" in silver:
        edges["located_in"] = lambda: located_in(silver["customers"], silver["vendors"])
    if "products" in silver:
        edges["similar_to"] = lambda: similar_to(silver["products"])

    def given(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        def made() -> DataFrame:
            df = make()
            if COUNT not in df.columns:
                return df.withColumn(COUNT, F.lit(1).cast("long")) if counted else df
            return df if counted else _plain(df)

        return made

    return Graph(Tables({n: given(f) for n, f in nodes.items()}), Tables({e: given(edges[e]) for e in EDGES if e in edges}))


def sizes(silver: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, tbl, records): how many rows each table of the graph has, in one pass over each Silver table.

    Only agents, located_in and similar_to, which come from two tables or from places
    in an order, are made to be counted.
    """
    graph, wanted = build(silver), {}
    for table, (name, key) in _NODES_OF.items():
        wanted.setdefault(name, []).append(("node", table, F.countDistinct(F.nullif(sanitize_id(safe_str(F.col(key))), F.lit("")))))
    for table, (name, column) in _NAMES_OF.items():
        wanted.setdefault(name, []).append(("node", table, F.countDistinct(slug(safe_str(F.col(column))))))
    for table, (name, src, dst) in _EDGES_OF.items():
        if table not in graph.edges:
            continue
        start, end, unique = safe_str(F.col(src)), _end(table, dst), EDGES[table][3]
        both, keyed = start.isNotNull() & end.isNotNull(), F.lit(True)
        if table in _KEYED:
            keyed = F.nullif(safe_str(F.col(_KEYED[table])), F.lit("")).isNotNull()
        # A distinct pair counts if neither end is null.
        count = F.countDistinct(start, end) if unique == ("src", "dst") else F.countDistinct(F.when(both, safe_str(F.col(unique[0])))) if unique else F.count_if(both & keyed)
        wanted.setdefault(name, []).append(("edge", table, count))
    out = []
    for name, counts in wanted.items():
        if name in silver:
            found = silver[name].agg(*[c.alias(table) for _, table, c in counts])
            out.append(found.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(table).alias("tbl"), F.col(table).alias("records")) for kind, table, _ in counts])).alias("r")).select("r.*"))
    for kind, tables, made in (("node", graph.nodes, ("agent",)), ("edge", graph.edges, ("located_in", "similar_to"))):
        out += [tables[t].agg(F.count("*").alias("records")).select(F.lit(kind).alias("kind"), F.lit(t).alias("tbl"), "records") for t in made if t in tables]
    return reduce(DataFrame.unionByName, out)


class GraphLoader:
    """Builds the graph of a Silver folder and writes its tables under ``output_dir``, or into a database of the catalog once connected to one."""

    # The Silver tables.
    TABLES = ("vendors", "customers", "products", "transactions", "invoices", "invoice_line_items", "reviews", "support_tickets", "call_transcripts")

    def __init__(self, spark: SparkSession, silver_dir: str, output_dir: str) -> None:
        self.spark, self.silver_dir, self.output_dir, self.database = spark, silver_dir, output_dir, None

    def connect(self, database: str) -> None:
        """Load into this database of the catalog from now on; it is made if it isn't there."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.database = database

    def close(self) -> None:
        """Load into the folder again."""
        self.database = None

    def apply_schema(self, statements: list[str] | None = None) -> int:
        """Make the tables of the schema in the database; how many statements went well. One that fails is logged, and the others go on."""
        if self.database is None:
            raise ValueError("not connected to a database")
        done, before = 0, self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.database)
        try:
            for statement in get_schema_statements() if statements is None else statements:
                try:
                    self.spark.sql(statement)
                    done += 1
                except Exception as e:
                    log.warning("schema statement failed: %s: %s", statement[:60], e)
        finally:
            self.spark.catalog.setCurrentDatabase(before)
        return done

    def silver(self) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(f"{self.silver_dir}/{t}") for t in self.TABLES if exists(self.spark, f"{self.silver_dir}/{t}")}

    def graph(self) -> Graph:
        return build(self.silver())

    def load_all(self) -> dict[str, LoadResult]:
        """Write all tables. Rows without an id, repeated rows and rows that lack what must not be null are errors, counted while the table is written."""
        with measured_joins(self.spark):
            graph = build(self.silver(), counted=True)
            return side_by_side(self.spark, {name: partial(self.insert, name, df) for tables in (graph.nodes, graph.edges) for name, df in tables.items()})

    def insert(self, name: str, rows: DataFrame) -> LoadResult:
        """Write the rows of one node or edge table, in place of those it has. Rows that lack what must not be null are left out and counted as errors.

        Spark's file tables take such rows from plain SQL, so the check is made here. A
        column _rows says how many source rows a row stands for, of which one is loaded.
        """
        kind, counted = "node" if name in NODES else "edge", rows if COUNT in rows.columns else rows.withColumn(COUNT, F.lit(1).cast("long"))
        seen, sound = Observation(), F.lit(True)
        for column in required(name):
            sound = sound & F.col(column).isNotNull()
        # Behind the last shuffle, so that a stage that runs anew is not counted twice.
        good = counted.observe(seen, F.count_if(sound).alias("loaded"), F.sum(F.col(COUNT) - sound.cast("int")).alias("errors")).filter(sound).drop(COUNT)
        if self.database is None:
            write_table(good, f"{self.output_dir}/{kind}s/{name}")
        else:
            good.select(*self.spark.table(f"`{self.database}`.`{name}`").columns).write.insertInto(f"`{self.database}`.`{name}`", overwrite=True)
        return LoadResult(name, kind, seen.get["loaded"], seen.get["errors"] or 0)

    def load(self) -> Graph:
        """The graph as written."""
        if self.database is not None:
            here = {t.name for t in self.spark.catalog.listTables(self.database)}
            table = lambda names: {n: self.spark.table(f"`{self.database}`.`{n}`") for n in names if n in here}
            return Graph(table(NODES), table(EDGES))
        read = lambda kind, names: {n: self.spark.read.parquet(f"{self.output_dir}/{kind}/{n}") for n in names if exists(self.spark, f"{self.output_dir}/{kind}/{n}")}
        return Graph(read("nodes", NODES), read("edges", EDGES))
