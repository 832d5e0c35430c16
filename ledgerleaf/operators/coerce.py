"""Lenient coercion of JSON into typed documents: what can be salvaged is, the rest is reported.

Every field is optional, so each is judged by itself: a bad scalar becomes null, a bad line is
removed, and each leaves an issue.  All of it is expressions over VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, strip, to_number, to_text
from ..types import ISSUE
from .rules import issue

#: Fields that are kept as they stand.
RAW_TEXT = ("full_text",)


def _kind(v: Column) -> Column:
    """Type name of a variant, without parameters; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


#: How a field of each kind is read; texts of RAW_TEXT as they stand.
_WANT = {T.DoubleType: "number", T.IntegerType: "whole"}


def _scalars(v: Column, fields: list[T.StructField], prefix: Column) -> Column:
    """array<struct<number, whole, text, issue>>, one element a field.

    All fields go through one lambda, so the plan does not grow by their number: each adds but its
    name and the access to its value."""
    asked = [F.struct(F.lit(f.name).alias("name"), F.lit("raw" if f.name in RAW_TEXT else _WANT.get(type(f.dataType), "text")).alias("want"), _get(v, f.name).alias("x")) for f in fields]
    seen = F.transform(F.array(*asked), lambda s: F.struct(F.concat(prefix, s["name"]).alias("path"), s["want"].alias("want"), s["x"].alias("x"), _kind(s["x"]).alias("kind"), F.try_variant_get(s["x"], "$", "string").alias("text")))
    return F.transform(seen, _judged)


def _judged(s: Column) -> Column:
    x, kind, text, want = s["x"], s["kind"], s["text"], s["want"]
    missing = x.isNull() | (kind == "VOID")
    printed, nested = kind == "STRING", kind.isin("OBJECT", "ARRAY")
    numeric = kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "TINYINT", "SMALLINT")
    plain = F.when(numeric, F.try_variant_get(x, "$", "double")).when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0))

    def made(n: Column) -> Column:
        """n: the amount that a text prints, and the whole number."""
        exact = F.when((n["whole"] == F.floor(n["whole"])) & (F.abs(n["whole"]) < 2**31), n["whole"].cast("int"))
        amount = F.when(printed, n["amount"]["value"]).otherwise(n["plain"])
        error = (
            F.when(missing, None)
            .when(want == "number", F.when(printed & n["amount"]["invalid"], "float_parsing").when(nested, "float_type"))
            .when(want == "whole", F.when(exact.isNull(), F.when(nested, "int_type").when(numeric, "int_from_float").otherwise("int_parsing")))
            .when(~printed, "string_type")
        )
        shown = F.when(printed & want.isin("text", "raw"), F.when(want == "raw", text).otherwise(to_text(text)))
        return F.struct(F.when((want == "number") & ~missing, amount).alias("number"), F.when((want == "whole") & ~missing, exact).alias("whole"), shown.alias("text"), let(error, lambda e: _problem(s["path"], e, x)).alias("issue"))

    whole = F.when(printed & strip(text).rlike("^[+-]?[0-9]+$"), strip(text).try_cast("double")).otherwise(plain)
    return let(F.struct(F.when(want == "number", to_number(F.when(printed, text))).alias("amount"), plain.alias("plain"), F.when(want == "whole", whole).alias("whole")), made)


def _value(parts: Column, fields: list[T.StructField], field: T.StructField) -> Column:
    part = {T.DoubleType: "number", T.IntegerType: "whole"}.get(type(field.dataType), "text")
    return F.get(parts, F.lit(fields.index(field)))[part].alias(field.name)


def _problem(path: Column, error: Column, v: Column) -> Column:
    shown = F.regexp_replace(F.to_json(v), r"\s+", " ")
    short = F.when(F.length(shown) > 120, F.concat(F.substring(shown, 1, 120), F.lit("..."))).otherwise(shown)
    return F.when(error.isNotNull(), issue("field_invalid", "warning", path, F.concat(path, F.lit(" was dropped: "), error), error, short))


def _lines(array: Column, field: T.StructField) -> Column:
    """array<struct<line, issues>>: the elements, typed if they are objects, else null."""
    fields = field.dataType.elementType.fields

    def one(e: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{field.name}."), i.cast("string"))
        bad = F.struct(F.lit(None).cast(field.dataType.elementType).alias("line"), F.array(_problem(at, F.lit("model_type"), e)).alias("issues"))
        good = lambda p: F.struct(F.struct(*[_value(p, fields, f) for f in fields]).alias("line"), _issues(p).alias("issues"))
        return F.when(F.coalesce(_kind(e) == "OBJECT", F.lit(False)), let(_scalars(e, fields, F.concat(at, F.lit("."))), good)).otherwise(bad)

    return F.transform(array, one)


def _issues(parts: Column) -> Column:
    return F.array_compact(F.transform(parts, lambda p: p["issue"]))


def coerce(json: Column, schema: T.StructType) -> Column:
    """struct<doc, issues> of a JSON text; doc is null if it is no object."""
    no_issues = F.array().cast(T.ArrayType(ISSUE))
    scalars = [f for f in schema.fields if not isinstance(f.dataType, T.ArrayType)]
    lists = [f for f in schema.fields if isinstance(f.dataType, T.ArrayType)]

    def parts(v: Column) -> Column:
        return F.struct(_scalars(v, scalars, F.lit("")).alias("_scalars"), *[_list(v, f).alias(f.name) for f in lists], F.coalesce(_kind(v) == "OBJECT", F.lit(False)).alias("_is_object"))

    def result(p: Column) -> Column:
        doc = F.struct(*[_value(p["_scalars"], scalars, f) if f in scalars else p[f.name]["lines"].alias(f.name) for f in schema.fields])
        own = _issues(p["_scalars"])
        found = F.concat(own, *[F.array_compact(F.array(p[f.name]["issue"])) for f in lists], *[p[f.name]["issues"] for f in lists], no_issues)
        wrong = F.array(issue("not_an_object", "error", None, "the answer is no JSON object"))
        return F.struct(F.when(p["_is_object"], doc).alias("doc"), F.when(p["_is_object"], found).otherwise(wrong).alias("issues"))

    return let(F.try_parse_json(json), lambda v: let(parts(v), result))


def _list(v: Column, field: T.StructField) -> Column:
    """struct<lines, issue, issues> of a list of objects."""

    def judged(x: Column) -> Column:
        array = F.when(_kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>"))
        bad = _problem(F.lit(field.name), F.when(x.isNotNull() & (_kind(x) != "ARRAY"), "list_type"), x)
        empty, no_issues = F.array().cast(field.dataType), F.array().cast(T.ArrayType(ISSUE))
        lines = lambda r: F.struct(F.coalesce(F.array_compact(F.transform(r, lambda e: e["line"])), empty).alias("lines"), bad.alias("issue"), F.coalesce(F.flatten(F.transform(r, lambda e: e["issues"])), no_issues).alias("issues"))
        return let(_lines(array, field), lines)

    return let(_get(v, field.name), judged)
