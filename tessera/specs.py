"""What each source and entity looks like: the one description that ingestion, cleaning, validation and integrity read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

SPARK_TYPES = {"string": "string", "date": "string", "json": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    required: bool = False
    pattern: str | None = None
    lo: float | None = None
    hi: float | None = None
    clean: str | None = None
    transform: str | None = None
    not_blank: bool = False


@dataclass(frozen=True)
class EntitySpec:
    name: str
    key: str
    fields: tuple[FieldSpec, ...]
    foreign: dict[str, str] = field(default_factory=dict)

    @cached_property
    def by_name(self) -> dict[str, FieldSpec]:
        return {f.name: f for f in self.fields}

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class SourceSpec:
    name: str
    file: str
    format: str
    schema: str
    data_key: str | None = None
    #: Of CSV: whether cells may hold line breaks. Without them Spark splits a file among tasks.
    multiline: bool = True


def _text(names: tuple[str, ...], **more) -> list[FieldSpec]:
    return [FieldSpec(n, **more) for n in names]


def _entity(name: str, key: str, order: tuple[str, ...], groups: list[list[FieldSpec]], foreign: dict[str, str] | None = None) -> EntitySpec:
    """Fields in the order given; a field that no group describes is a plain string."""
    known = {f.name: f for group in groups for f in group}
    return EntitySpec(name, key, tuple(known.get(n, FieldSpec(n)) for n in order), foreign or {})


_bool = {"type": "boolean", "clean": "boolean_normalize"}
_date = {"type": "date", "clean": "date_iso"}
_int, _float = {"type": "integer"}, {"type": "float"}
_lower, _upper = {"clean": "lowercase"}, {"clean": "uppercase"}

# The entities' columns, in order, with their bounds, patterns and cleaning rules.
ENTITIES = {
    e.name: e
    for e in (
        _entity(
            "customer",
            "customer_id",
            (
                "customer_id", "full_name", "first_name", "last_name", "email", "phone", "gender", "age",
                "date_of_birth", "address_street", "address_city", "address_state", "address_postal_code",
                "address_country", "segment", "total_spend", "registration_date", "last_purchase_date", "is_active",
                "email_verified", "phone_verified", "preferences_newsletter", "preferences_sms_notifications",
                "preferences_preferred_language", "preferences_preferred_currency", "metadata_source",
                "total_orders", "average_order_value", "metadata_created_at", "metadata_updated_at",
            ),
            [
                _text(("customer_id",), required=True, pattern=r"CUS-\d+"),
                _text(("full_name",), required=True),
                _text(("email",), clean="lowercase", transform="email"),
                _text(("phone",), clean="phone_normalize"),
                _text(("gender", "preferences_preferred_language"), **_lower),
                _text(("preferences_preferred_currency",), **_upper),
                _text(("age",), **_int),
                _text(("date_of_birth", "metadata_created_at", "metadata_updated_at"), **_date),
                _text(("registration_date", "last_purchase_date"), transform="not_future", **_date),
                _text(("total_spend",), **_float),
                _text(("total_orders",), lo=0, **_int),
                _text(("average_order_value",), lo=0, **_float),
                _text(("is_active", "email_verified", "phone_verified", "preferences_newsletter", "preferences_sms_notifications"), **_bool),
            ],
        ),
        _entity(
            "product",
            "product_id",
            (
                "product_id", "vendor_id", "sku", "product_name", "description", "category", "subcategory",
                "currency", "price", "cost", "stock_quantity", "reorder_level", "weight_kg", "rating",
                "review_count", "is_active", "tags", "created_date", "last_updated",
            ),
            [
                _text(("product_id",), required=True, pattern=r"PRD-\d+"),
                _text(("vendor_id",), required=True, pattern=r"VND-\d+"),
                _text(("sku", "product_name"), required=True),
                _text(("currency",), **_upper),
                _text(("price", "cost"), lo=0, **_float),
                _text(("stock_quantity", "reorder_level", "review_count"), **_int),
                _text(("weight_kg",), **_float),
                _text(("rating",), lo=0, hi=5, **_float),
                _text(("is_active",), **_bool),
                _text(("tags",), type="json"),
                _text(("created_date",), type="date"),
                _text(("last_updated",), **_date),
            ],
            {"vendor_id": "vendor"},
        ),
        _entity(
            "transaction",
            "transaction_id",
            (
                "transaction_id", "order_id", "customer_id", "product_id", "transaction_date",
                "transaction_timestamp", "quantity", "unit_price", "subtotal", "tax_amount", "tax_rate",
                "shipping_cost", "discount_amount", "discount_percent", "total_amount", "is_gift", "notes",
                "payment_status", "payment_method", "shipping_method", "channel", "region", "order_status",
            ),
            [
                _text(("transaction_id",), required=True, pattern="TXN-[A-F0-9]+"),
                _text(("transaction_date", "transaction_timestamp"), **_date),
                _text(("quantity",), **_int),
                _text(("unit_price", "subtotal", "tax_amount", "tax_rate", "shipping_cost", "discount_amount", "total_amount"), **_float),
                _text(("discount_percent",), lo=0, hi=100, **_float),
                _text(("is_gift",), **_bool),
                _text(("payment_status", "payment_method", "shipping_method", "channel"), **_lower),
                _text(("order_status",), **_upper),
            ],
            {"customer_id": "customer", "product_id": "product"},
        ),
        _entity(
            "vendor",
            "vendor_id",
            (
                "vendor_id", "vendor_name", "vendor_code", "country", "country_code", "lead_time_days",
                "payment_terms", "currency", "contact_primary_name", "contact_email", "contact_phone",
                "address_street", "address_city", "address_state", "address_postal_code", "address_country",
                "categories", "certifications", "created_at", "updated_at", "region", "reliability_score", "status",
            ),
            [
                _text(("vendor_id",), required=True, pattern=r"VND-\d+"),
                _text(("vendor_name",), required=True),
                _text(("country_code", "currency"), **_upper),
                _text(("lead_time_days",), **_int),
                _text(("contact_email", "status"), **_lower),
                _text(("contact_phone",), clean="phone_normalize"),
                _text(("categories", "certifications"), type="json"),
                _text(("created_at", "updated_at"), **_date),
                _text(("reliability_score",), lo=0, hi=100, **_float),
            ],
        ),
        _entity(
            "invoice",
            "invoice_id",
            (
                "invoice_id", "vendor_id", "invoice_number", "invoice_date", "due_date", "payment_date", "po_number",
                "subtotal", "tax_rate", "tax_amount", "shipping_handling", "amount_paid", "balance_due",
                "total_amount", "vendor_name", "currency", "payment_status", "payment_method", "payment_terms",
                "approved_by", "notes", "created_at", "updated_at",
            ),
            [
                _text(("invoice_id",), required=True, pattern="INV-[A-F0-9]+"),
                _text(("vendor_id",), required=True),
                _text(("invoice_date", "due_date", "payment_date", "created_at", "updated_at"), **_date),
                _text(("subtotal", "tax_amount", "shipping_handling", "amount_paid", "balance_due", "total_amount"), **_float),
                _text(("tax_rate",), transform="unit_interval", **_float),
                _text(("currency",), **_upper),
                _text(("payment_status",), **_lower),
                _text(("payment_method",), clean="lowercase", transform="snake"),
            ],
            {"vendor_id": "vendor"},
        ),
        _entity(
            "invoice_line_item",
            "",
            (
                "invoice_id", "line_number", "product_id", "description", "quantity", "unit_cost", "line_total",
            ),
            [_text(("invoice_id",), required=True), _text(("line_number",), required=True, **_int), _text(("quantity",), **_int), _text(("unit_cost", "line_total"), **_float)],
            {"product_id": "product"},
        ),
        _entity(
            "review",
            "review_id",
            (
                "review_id", "product_id", "customer_id", "rating", "title", "review_text", "review_date",
                "sentiment", "verified_purchase", "helpful_votes", "images", "response", "response_responder",
                "response_response_text", "response_response_date",
            ),
            [
                _text(("review_id",), required=True, not_blank=True),
                _text(("product_id", "customer_id"), required=True),
                _text(("rating",), lo=1, hi=5, **_int),
                _text(("review_date", "response_response_date"), **_date),
                _text(("sentiment",), **_lower),
                _text(("verified_purchase",), **_bool),
                _text(("helpful_votes",), **_int),
                _text(("images",), type="json"),
            ],
            {"product_id": "product", "customer_id": "customer"},
        ),
        _entity(
            "support_ticket",
            "ticket_id",
            (
                "ticket_id", "customer_id", "product_id", "channel", "priority", "status", "satisfaction_score",
                "created_at", "resolved_at", "agent_id", "transcript", "summary", "tags", "resolution_type",
            ),
            [
                _text(("ticket_id",), required=True, not_blank=True),
                _text(("customer_id",), required=True),
                _text(("channel", "priority", "status", "resolution_type"), **_lower),
                _text(("satisfaction_score",), lo=1, hi=5, **_int),
                _text(("created_at", "resolved_at"), **_date),
                _text(("tags",), type="json"),
            ],
            {"customer_id": "customer", "product_id": "product"},
        ),
        _entity(
            "call_transcript",
            "call_id",
            (
                "call_id", "ticket_id", "customer_id", "agent_id", "agent_name", "call_start", "call_end",
                "duration_seconds", "call_type", "phone_number", "queue_wait_seconds", "hold_time_seconds",
                "transfers", "language", "quality_score", "resolution_achieved", "sentiment_overall", "utterances",
                "keywords_detected", "action_items",
            ),
            [
                _text(("call_id",), required=True),
                _text(("customer_id",), required=True),
                _text(("call_start", "call_end"), **_date),
                _text(("duration_seconds", "transfers"), lo=0, **_int),
                _text(("queue_wait_seconds", "hold_time_seconds"), **_int),
                _text(("quality_score",), lo=0, hi=100, **_float),
                _text(("resolution_achieved",), **_bool),
                _text(("call_type", "language", "sentiment_overall"), **_lower),
                _text(("phone_number",), clean="phone_normalize"),
                _text(("utterances", "keywords_detected", "action_items"), type="json"),
            ],
            {"ticket_id": "support_ticket", "customer_id": "customer"},
        ),
    )
}

# The sources; parents stand before the entities that refer to them.
SOURCES = (
    SourceSpec("vendors", "vendors.json", "json", "vendor", "vendors"),
    SourceSpec("products", "products.csv", "csv", "product"),
    SourceSpec("customers", "customers.json", "json", "customer", "customers"),
    SourceSpec("transactions", "sales_transactions.parquet", "parquet", "transaction"),
    SourceSpec("invoices", "invoices.csv", "csv", "invoice"),
    SourceSpec("reviews", "product_reviews.json", "json", "review", "reviews"),
    SourceSpec("support_tickets", "support_tickets.json", "json", "support_ticket", "support_tickets"),
    SourceSpec("call_transcripts", "call_transcripts.json", "json", "call_transcript", "call_transcripts"),
)


def get_schema(name: str) -> EntitySpec:
    """The entity of this name; ValueError if there is none."""
    if name not in ENTITIES:
        raise ValueError(f"unknown schema: {name}")
    return ENTITIES[name]


def in_order(sources: tuple[SourceSpec, ...], entities: dict[str, EntitySpec] = ENTITIES) -> list[SourceSpec]:
    """Sources with the entities they refer to first; otherwise in the given order."""
    left, done, out = list(sources), set(), []
    here = {s.schema for s in sources}
    while left:
        free = [s for s in left if all(p in done or p not in here for p in (entities[s.schema].foreign if s.schema in entities else {}).values())]
        if not free:
            raise ValueError(f"sources refer to each other: {[s.name for s in left]}")
        out.append(free[0])
        done.add(free[0].schema)
        left.remove(free[0])
    return out


def levels(sources: tuple[SourceSpec, ...], entities: dict[str, EntitySpec] = ENTITIES) -> list[list[SourceSpec]]:
    """The same order, cut where a source refers to the entity of one before it."""
    out: list[list[SourceSpec]] = []
    for s in in_order(sources, entities):
        parents = set(entities[s.schema].foreign.values()) if s.schema in entities else set()
        if not out or any(t.schema in parents for t in out[-1]):
            out.append([])
        out[-1].append(s)
    return out
