"""Document schemas: one StructType per document type, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

_AMOUNTS = {
    "subtotal", "discount_total", "tax_rate", "tax_amount", "service_charge", "tip", "shipping", "total",
    "amount_paid", "change_due", "balance_due", "quantity", "unit_price", "discount",
}


def _struct(names: str) -> T.StructType:
    fields = []
    for name in names.split():
        kind = T.DoubleType() if name in _AMOUNTS else T.IntegerType() if name == "page_count" else T.ArrayType(LINE_ITEM) if name == "items" else T.StringType()
        fields.append(T.StructField(name, kind, True, {"description": name.replace("_", " ")}))
    return T.StructType(fields)


# The fields of the document types, in order.
LINE_ITEM = _struct("description description_ar sku quantity unit unit_price discount tax_rate tax_amount total")
RECEIPT = _struct(
    "merchant_name merchant_name_ar branch merchant_address merchant_phone tax_number receipt_number date time currency "
    "subtotal discount_total tax_rate tax_amount service_charge tip total amount_paid change_due payment_method card_last4 cashier terminal_id items"
)
INVOICE = _struct(
    "invoice_number purchase_order_number issue_date due_date service_period_start service_period_end vendor_name vendor_name_ar "
    "vendor_address vendor_tax_number vendor_phone vendor_email customer_name customer_name_ar customer_address customer_tax_number currency "
    "subtotal discount_total tax_rate tax_amount shipping total amount_paid balance_due payment_terms payment_method bank_name iban items"
)
GENERIC = _struct("title title_ar document_number date issuer issuer_ar recipient subject language page_count summary full_text")

#: Document types by name; a new type is registered here and, if it has rules, in operators.rules.
DOC_TYPES: dict[str, T.StructType] = {"receipt": RECEIPT, "invoice": INVOICE, "document": GENERIC}

ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message", "severity", "field", "expected", "actual")])
LEAF = "struct<kind:string,num:double,str:string>"


def schema_for(doc_type: str) -> T.StructType:
    """The schema of a document type; spacing and case of the name don't matter."""
    key = (doc_type or "").strip().lower()
    if key not in DOC_TYPES:
        raise ValueError(f"unknown doc_type {doc_type!r}; valid: {', '.join(DOC_TYPES)}")
    return DOC_TYPES[key]


def json_schema(kind: T.DataType) -> dict:
    """A JSON Schema with every scalar nullable."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) | ({"description": f.metadata["description"]} if "description" in f.metadata else {}) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    name = "number" if isinstance(kind, T.DoubleType) else "integer" if isinstance(kind, T.IntegerType) else "string"
    return {"type": [name, "null"]}
