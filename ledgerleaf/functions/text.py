"""Column functions on printed text: coercion of numbers and text, and extraction by label and
pattern.  All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and separators, words for "no value", labels, currencies, scripts.
_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.")
NULLISH = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "not available")
TOTAL_LABELS = ("grand total", "amount due", "total due", "balance due", "الإجمالي", "المبلغ الإجمالي")
LOOSE_TOTAL_LABELS = ("total", "المجموع")
SUBTOTAL_MARKERS = ("subtotal", "sub total", "sub-total", "المجموع الفرعي")
INVOICE_NUMBER_LABELS = ("invoice no", "invoice number", "invoice #", "inv no", "inv#", "فاتورة رقم", "رقم الفاتورة")
CURRENCIES = "SAR AED EGP USD EUR GBP KWD QAR BHD OMR JOD SDG SYP IQD LYD MAD TND DZD LBP"
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "﷼": "SAR"}
_ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def present(c: Column) -> Column:
    """Not null and not blank."""
    return c.isNotNull() & (strip(c.cast("string")) != "")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalise_digits(c: Column) -> Column:
    return F.translate(c, *_DIGITS)


def to_number(c: Column) -> Column:
    """struct<value: double, invalid: boolean> of a printed amount; invalid: something numeric is
    there that is no number."""
    text = normalise_digits(strip(c))
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) >= 1)
    noise = F.regexp_replace(F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text), r"[^0-9.\-]", "")
    trailing = noise.endswith("-")
    digits = F.when(trailing, F.substring(noise, F.lit(1), F.length(noise) - 1)).otherwise(noise)
    signed = F.when((bracketed | trailing) & ~digits.startswith("-"), F.concat(F.lit("-"), digits)).otherwise(digits)
    cleaned = F.when(~digits.isin("", "-", ".", "-."), signed)
    value = F.when(cleaned.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), cleaned).try_cast("double")
    return F.struct(value.alias("value"), (cleaned.isNotNull() & value.isNull()).alias("invalid"))


def to_text(c: Column) -> Column:
    text = collapse(c)
    return F.when(~F.lower(text).isin(*NULLISH), text)


def script(c: Column) -> Column:
    arabic, latin = c.rlike(_ARABIC), c.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "ar").when(latin, "en")


def lines(c: Column) -> Column:
    return F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def _any_in(c: Column, labels: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in labels])


def let(x: Column, made) -> Column:
    """``made(x)`` with x evaluated once: a lambda's argument, where Catalyst would copy the
    expression into each of its uses."""
    return F.get(F.transform(F.array(x), lambda y: made(y)), F.lit(0))


def amount_on_line(c: Column) -> Column:
    """The last amount on a line, as printed."""
    found = F.regexp_extract_all(normalise_digits(c), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0)
    return F.try_element_at(found, F.lit(-1))


def find_amount(c: Column, exact: tuple[str, ...] = TOTAL_LABELS, loose: tuple[str, ...] = LOOSE_TOTAL_LABELS, exclude: tuple[str, ...] = SUBTOTAL_MARKERS) -> Column:
    """The amount of the last line with an exact label; failing that, of the last with a loose one
    that is no subtotal."""
    # Only lines with a digit can hold an amount; each is folded once.
    seen = F.transform(F.filter(lines(c), lambda x: normalise_digits(x).rlike("[0-9]")), lambda x: F.struct(casefold(x).alias("folded"), x.alias("line")))
    last = lambda held, keep: F.try_element_at(F.filter(held, lambda x: keep(x["folded"])), F.lit(-1))["line"]
    either = lambda held: F.coalesce(last(held, lambda x: _any_in(x, exact)), last(held, lambda x: _any_in(x, loose) & ~_any_in(x, exclude)))
    return let(let(seen, either), amount_on_line)


def find_label_value(c: Column, labels: tuple[str, ...] = INVOICE_NUMBER_LABELS) -> Column:
    """What follows the first label that has something after it on its line."""
    rest = lambda x, label: F.regexp_replace(F.substring(x["line"], F.locate(label, x["folded"]) + len(label), F.length(x["line"])), r"^[ \t:#\-–—.]+|[ \t:#\-–—.]+$", "")
    of_line = lambda x: F.coalesce(*[F.when(F.locate(a, x["folded"]) > 0, F.nullif(rest(x, a), F.lit(""))) for a in labels])
    seen = F.filter(F.transform(lines(c), lambda x: F.struct(casefold(x).alias("folded"), x.alias("line"))), lambda x: _any_in(x["folded"], labels))
    return F.try_element_at(F.filter(F.transform(seen, of_line), lambda x: x.isNotNull()), F.lit(1))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.cast("int") >= 1, F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def find_date(c: Column) -> Column:
    """The first year-first date that is a real day; else the first day-first one."""
    text = normalise_digits(c)
    iso = r"(?U)\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b"
    dmy = r"(?U)\b([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})\b"
    part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    year = part(dmy, 3)
    full = F.when(F.length(year) == 4, year).otherwise((F.when(year.cast("int") < 70, 2000).otherwise(1900) + year.cast("int")).cast("string"))
    return F.coalesce(_date(part(iso, 1), part(iso, 2), part(iso, 3)), _date(full, part(dmy, 2), part(dmy, 1)))


def find_currency(c: Column) -> Column:
    code = F.nullif(F.regexp_extract(F.upper(c), rf"(?U)\b({CURRENCIES.replace(' ', '|')})\b", 1), F.lit(""))
    return F.coalesce(code, *[F.when(F.contains(c, F.lit(s)), F.lit(v)) for s, v in SYMBOLS.items()])


def first_named_line(c: Column) -> Column:
    """struct<latin, arabic>: the first line that is not blank, in the slot of its script."""
    line = F.try_element_at(F.filter(F.transform(lines(c), strip), lambda x: x != ""), F.lit(1))
    arabic = F.coalesce(script(line) == "ar", F.lit(False))
    return F.struct(F.when(~arabic, line).alias("latin"), F.when(arabic, line).alias("arabic"))


def structure(doc_type: str, c: Column) -> Column:
    """The fields that patterns can find in a text."""
    name = first_named_line(c)
    found = [find_date(c), find_currency(c).alias("currency"), find_amount(c).alias("total")]
    if doc_type == "receipt":
        return F.struct(name["latin"].alias("merchant_name"), name["arabic"].alias("merchant_name_ar"), found[0].alias("date"), *found[1:])
    if doc_type == "invoice":
        return F.struct(find_label_value(c).alias("invoice_number"), name["latin"].alias("vendor_name"), name["arabic"].alias("vendor_name_ar"), found[0].alias("issue_date"), *found[1:])
    return F.struct(c.alias("full_text"))


def has_text_layer(pages: Column, per_page: int = 40) -> Column:
    """Whether an array of page texts has enough characters that are no white space."""
    held = F.aggregate(pages, F.lit(0), lambda n, t: n + F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s", "")))
    return F.coalesce((F.size(pages) > 0) & (held >= per_page * F.size(pages)), F.lit(False))


def trigrams(c: Column) -> Column:
    text = F.lower(collapse(c))
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
