"""Validation of typed documents and the review gate, as Column expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import present, strip
from ..types import ISSUE

# Thresholds, and which fields the rules read.
TOLERANCE = 0.02
REVIEW_CONFIDENCE = 0.80
EARLIEST = "1990-01-01"
REQUIRED = {
    "receipt": (("merchant_name", ("merchant_name", "merchant_name_ar")), ("total", ("total",))),
    "invoice": (("invoice_number", ("invoice_number",)), ("vendor_name", ("vendor_name", "vendor_name_ar")), ("total", ("total",))),
    "document": (),
}
#: Date fields, and whether a date to come is fine.
DATES = {
    "receipt": (("date", False),),
    "invoice": (("issue_date", False), ("due_date", True), ("service_period_start", False), ("service_period_end", True)),
    "document": (("date", False),),
}
CHARGES = ("tax_amount", "service_charge", "tip", "shipping")


def issue(code: str, severity: str, field, message, expected=None, actual=None) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (code, message, severity, field, expected, actual)
    return F.struct(*[column(v).cast("string").alias(n) for n, v in zip(ISSUE.names, values)])


def money(c: Column) -> Column:
    return F.format_string("%.2f", c)


class Rules:
    """The rules of one document type over a struct column; fields that its schema lacks are null."""

    def __init__(self, doc: Column, doc_type: str, schema: T.StructType, as_of: Column | None = None, tolerance: float = TOLERANCE):
        self.doc, self.kind, self.names = doc, doc_type, set(schema.names)
        items = [f for f in schema.fields if f.name == "items"]
        self.item_names = set(items[0].dataType.elementType.names) if items else set()
        self.today, self.tolerance = F.current_date() if as_of is None else as_of, tolerance

    def get(self, name: str, kind: str) -> Column:
        return self.doc[name].cast(kind) if name in self.names else F.lit(None).cast(kind)

    def item(self, x: Column, name: str) -> Column:
        return x[name].cast("double") if name in self.item_names else F.lit(None).cast("double")

    def off(self, difference: Column) -> Column:
        return (F.abs(difference) > F.lit(self.tolerance)) & ~F.isnan(difference)

    def date(self, name: str) -> Column:
        text = strip(self.get(name, "string"))
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), text).try_cast("date")

    def required(self) -> list[Column]:
        out = []
        for label, spellings in REQUIRED.get(self.kind, ()):
            there = F.lit(False)
            for name in spellings:
                there = there | present(self.get(name, "string"))
            out.append(F.when(~there, issue("missing_required_field", "error", spellings[0], f"{self.kind} has no {label}")))
        return out

    def dates(self) -> list[Column]:
        out = []
        for name, later in DATES.get(self.kind, ()):
            text, parsed = strip(self.get(name, "string")), self.date(name)
            found = F.when(~present(self.get(name, "string")), None).when(~text.rlike(r"(?U)^\d{4}-\d{2}-\d{2}$"), issue("date_format", "error", name, F.concat(F.lit(f"{name} is not a year, month and day: "), text), "YYYY-MM-DD", text))
            found = found.when(parsed.isNull(), issue("date_invalid", "error", name, F.concat(F.lit(f"{name} is no day: "), text), "an existing calendar date", text))
            found = found.when(parsed < F.lit(EARLIEST).cast("date"), issue("date_out_of_range", "error", name, F.concat(F.lit(f"{name} is too early: "), text), f"on or after {EARLIEST}", text))
            if not later:
                limit = F.concat(F.lit("on or before "), self.today.cast("string"))
                found = found.when(parsed > F.date_add(self.today, 1), issue("date_in_future", "error", name, F.concat(F.lit(f"{name} is yet to come: "), text), limit, text))
            out.append(found)
        return out

    def due_order(self) -> list[Column]:
        if self.kind != "invoice":
            return []
        issued, due = self.date("issue_date"), self.date("due_date")
        return [F.when(due < issued, issue("due_before_issue", "error", "due_date", "due before it was issued", F.concat(F.lit("on or after "), issued.cast("string")), due.cast("string")))]

    def currency(self) -> list[Column]:
        text = strip(self.get("currency", "string"))
        return [F.when(present(self.get("currency", "string")) & ~text.rlike("^[A-Z]{3}$"), issue("currency_format", "warning", "currency", F.concat(F.lit("no currency code: "), text), "three uppercase letters, e.g. SAR", text))]

    def line_sum(self) -> Column:
        """The line totals added in order; null if a line or its total is missing."""
        items = self.doc["items"]
        whole = F.forall(items, lambda x: x.isNotNull() & self.item(x, "total").isNotNull()) & (F.size(items) > 0)
        return F.when(whole, F.aggregate(items, F.lit(0.0), lambda a, x: a + self.item(x, "total")))

    def sums(self) -> list[Column]:
        if not self.item_names:
            return []
        subtotal, lines = self.get("subtotal", "double"), self.line_sum()
        return [F.when(self.off(lines - subtotal), issue("lines_do_not_sum", "error", "subtotal", F.format_string("lines add to %.2f, subtotal is %.2f", lines, subtotal), money(lines), money(subtotal)))]

    def total(self) -> list[Column]:
        if "total" not in self.names:
            return []
        zero = F.lit(0.0)
        charges = zero
        for name in CHARGES:
            charges = charges + F.coalesce(self.get(name, "double"), zero)
        expected = self.get("subtotal", "double") + charges - F.coalesce(self.get("discount_total", "double"), zero)
        total = self.get("total", "double")
        return [F.when(self.off(expected - total), issue("total_mismatch", "error", "total", F.format_string("parts come to %.2f, total is %.2f", expected, total), money(expected), money(total)))]

    def line_arithmetic(self) -> Column:
        """An array: one issue for each line that does not multiply out."""

        def one(x: Column, i: Column) -> Column:
            expected = self.item(x, "quantity") * self.item(x, "unit_price") - F.coalesce(self.item(x, "discount"), F.lit(0.0))
            total = self.item(x, "total")
            return F.when(self.off(expected - total), issue("line_total_mismatch", "warning", F.concat(F.lit("items."), i, F.lit(".total")), F.format_string("line %d comes to %.2f, reads %.2f", i + 1, expected, total), money(expected), money(total)))

        empty = F.array().cast(T.ArrayType(ISSUE))
        return F.coalesce(F.filter(F.transform(self.doc["items"], one), lambda x: x.isNotNull()), empty) if self.item_names else empty

    def all(self) -> Column:
        """All issues in the rules' order; a null document has the one issue that it is missing."""
        each = [*self.required(), *self.dates(), *self.currency(), *self.sums(), *self.total()]
        found = F.concat(F.array_compact(F.array(*each)), self.line_arithmetic(), F.array_compact(F.array(*self.due_order())) if self.kind == "invoice" else F.array().cast(T.ArrayType(ISSUE)))
        return F.when(self.doc.isNull(), F.array(issue("no_document", "error", None, "the engine returned no document"))).otherwise(found)


def validate(doc: Column, doc_type: str, schema: T.StructType, as_of: Column | None = None, tolerance: float = TOLERANCE) -> Column:
    return Rules(doc, doc_type, schema, as_of, tolerance).all()


def needs_review(issues: Column, confidence: Column | None = None, notes: Column | None = None, threshold: float = REVIEW_CONFIDENCE) -> Column:
    """Whether anything at all was found, or the confidence is known and under the threshold."""
    out = F.coalesce(F.size(issues) > 0, F.lit(False))
    if notes is not None:
        out = out | F.coalesce(F.size(notes) > 0, F.lit(False))
    return out if confidence is None else out | F.coalesce(confidence < threshold, F.lit(False))
