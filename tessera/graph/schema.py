"""The property graph: what each node and edge table holds."""

from __future__ import annotations

# Node tables and their properties: name, type, whether it must not be null.
NODES = {
    "vendor": (("vendor_name", "string", True), ("country", "string", False), ("region", "string", False), ("reliability_score", "double", False), ("status", "string", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "customer": (("full_name", "string", True), ("email", "string", False), ("phone", "string", False), ("segment", "string", False), ("total_spend", "double", False), ("registration_date", "string", False), ("last_purchase_date", "string", False), ("is_active", "boolean", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "product": (("product_name", "string", True), ("sku", "string", True), ("category", "string", False), ("price", "double", False), ("cost", "double", False), ("stock_quantity", "bigint", False), ("rating", "double", False), ("is_active", "boolean", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "invoice": (("invoice_date", "string", False), ("due_date", "string", False), ("payment_date", "string", False), ("total_amount", "double", False), ("payment_status", "string", False), ("payment_terms", "string", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "support_ticket": (("status", "string", True), ("priority", "string", True), ("satisfaction_score", "bigint", False), ("created_at", "string", False), ("resolved_at", "string", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "call_transcript": (("sentiment_overall", "string", False), ("duration_seconds", "bigint", False), ("quality_score", "double", False), ("transfers", "bigint", False), ("call_start", "string", False), ("source_file", "string", False), ("loaded_at", "string", False),),
    "category": (("name", "string", True),),
    "region": (("name", "string", True),),
    "agent": (("name", "string", True),),
}

# Edge tables, their ends, properties, and what is unique.
EDGES = {
    "supplies": ("vendor", "product", (), ("src", "dst")),
    "belongs_to": ("product", "category", (), ("src", "dst")),
    "based_in": ("vendor", "region", (), ("src", "dst")),
    "located_in": ("customer", "region", (), ("src", "dst")),
    "purchased": ("customer", "product", (("transaction_id", "string", False), ("quantity", "bigint", False), ("total_amount", "double", False), ("transaction_date", "string", False), ("order_status", "string", False), ("discount_percent", "double", False), ("tax_rate", "double", False), ("payment_status", "string", False),), ()),
    "billed": ("vendor", "invoice", (), ("src", "dst")),
    "invoice_item": ("invoice", "product", (("line_number", "bigint", False), ("quantity", "bigint", False), ("unit_cost", "double", False), ("line_total", "double", False),), ()),
    "reviewed": ("customer", "product", (("review_id", "string", False), ("rating", "bigint", False), ("sentiment", "string", False), ("verified_purchase", "boolean", False), ("response_text", "string", False), ("response_date", "string", False),), ("review_id",)),
    "similar_to": ("product", "product", (), ("src", "dst")),
    "raised": ("customer", "support_ticket", (), ()),
    "about": ("support_ticket", "product", (), ()),
    "handled_by": ("support_ticket", "agent", (), ()),
    "includes_transcript": ("support_ticket", "call_transcript", (), ()),
    "conducted_by": ("call_transcript", "agent", (), ()),
}

NODE_TABLES, EDGE_TABLES = list(NODES), list(EDGES)


def required(table: str) -> list[str]:
    """The columns of a node or edge table that must not be null."""
    ends = ["id"] if table in NODES else ["src", "dst"]
    return ends + [name for name, _, needed in (NODES[table] if table in NODES else EDGES[table][2]) if needed]


def get_schema_statements() -> list[str]:
    """The tables as SQL statements for a Spark catalog."""

    def made(table: str, ends: tuple[str, ...], properties: tuple[tuple[str, str, bool], ...]) -> str:
        needed = required(table)
        columns = [(c, "string") for c in ends] + [(c, t) for c, t, _ in properties]
        return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{c} {t}' + ' NOT NULL' * (c in needed) for c, t in columns)}) USING parquet"

    return [made(n, ("id",), properties) for n, properties in NODES.items()] + [made(e, ("src", "dst"), properties) for e, (_, _, properties, _) in EDGES.items()]
