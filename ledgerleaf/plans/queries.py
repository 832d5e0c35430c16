"""The library's registered queries, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .. import store
from ..operators import layout, paths, rules, score
from ..operators.review import by_severity
from ..sources import files
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(docs: DataFrame) -> rules.Rules:
    return rules.Rules(F.col("doc"), "invoice", docs.schema["doc"].dataType, F.lit(fx.AS_OF).cast("date"))


def _issues(docs: DataFrame, found) -> DataFrame:
    """One row an issue; ``found``: nullable issue columns, or one array."""
    array = F.array_compact(F.array(*found)) if isinstance(found, list) else found
    return docs.select("k", F.explode(array).alias("i")).select("k", "i.code", "i.severity", "i.field", "i.expected", "i.actual")


# --- validation

_REQUIRED_SQL = """SELECT k, 'missing_required_field' AS code, 'error' AS severity, 'vendor_name' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual
FROM inv WHERE vendor_name IS NULL OR trim(vendor_name) = ''"""
_D = """SELECT k, {code} AS code, 'error' AS severity, '{f}' AS field, {expected} AS expected, {f} AS actual FROM (
  SELECT *, regexp_full_match({f}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS shaped, try_cast({f} AS date) AS d FROM inv) WHERE {where}"""


def _date_sql(f: str, later: bool) -> str:
    kinds = [
        ("'date_format'", "'YYYY-MM-DD'", "NOT shaped"),
        ("'date_invalid'", "'an existing calendar date'", "shaped AND d IS NULL"),
        ("'date_out_of_range'", "'on or after 1990-01-01'", "shaped AND d < DATE '1990-01-01'"),
    ] + ([] if later else [("'date_in_future'", f"'on or before {fx.AS_OF}'", f"shaped AND d > DATE '{fx.AS_OF}' + 1")])
    return " UNION ALL ".join(_D.format(code=c, f=f, expected=e, where=w) for c, e, w in kinds)


_DATES_SQL = _date_sql("issue_date", False) + " UNION ALL " + _date_sql("due_date", True)
_DUE_SQL = """SELECT k, 'due_before_issue' AS code, 'error' AS severity, 'due_date' AS field, concat('on or after ', i) AS expected, due_date AS actual
FROM (SELECT *, try_cast(issue_date AS date) AS i, try_cast(due_date AS date) AS d FROM inv WHERE regexp_full_match(issue_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) WHERE d < i"""
_CURRENCY_SQL = """SELECT k, 'currency_format' AS code, 'warning' AS severity, 'currency' AS field, 'three uppercase letters, e.g. SAR' AS expected, currency AS actual
FROM inv WHERE NOT regexp_full_match(currency, '[A-Z]{3}')"""
_MONEY = "printf('%d.%02d', ({0}) // 100, ({0}) % 100)"
_SUMS_SQL = f"""SELECT inv.k, 'lines_do_not_sum' AS code, 'error' AS severity, 'subtotal' AS field, {_MONEY.format("s")} AS expected, {_MONEY.format("sub_c")} AS actual
FROM inv JOIN (SELECT k, sum(printed_c)::BIGINT AS s FROM ln GROUP BY k HAVING count(printed_c) = count(*)) t USING (k) WHERE abs(s - sub_c) > 2"""
_TOTAL_SQL = f"""SELECT k, 'total_mismatch' AS code, 'error' AS severity, 'total' AS field, {_MONEY.format("e")} AS expected, {_MONEY.format("total_c")} AS actual
FROM (SELECT *, sub_c + tax_c + coalesce(ship_c, 0) AS e FROM inv) WHERE abs(e - total_c) > 2"""
_LINE_SQL = f"""SELECT k, 'line_total_mismatch' AS code, 'warning' AS severity, concat('items.', idx, '.total') AS field, {_MONEY.format("true_c")} AS expected, {_MONEY.format("printed_c")} AS actual
FROM ln JOIN orders ON k = o_orderkey WHERE abs(true_c - printed_c) > 2"""
_ALL_SQL = " UNION ALL ".join([_REQUIRED_SQL, _DATES_SQL, _DUE_SQL, _CURRENCY_SQL, _SUMS_SQL, _TOTAL_SQL, _LINE_SQL])


def _rule_query(name: str, sql: str, pick) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = fx.invoice_docs(spark, sf_dir)
        return _issues(docs, pick(_rules(docs)))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"{fx.CTE} {sql}"


_rule_query("validate_required", _REQUIRED_SQL, lambda r: r.required())
_rule_query("validate_dates", _DATES_SQL, lambda r: r.dates())
_rule_query("validate_due_order", _DUE_SQL, lambda r: r.due_order())
_rule_query("validate_currency", _CURRENCY_SQL, lambda r: r.currency())
_rule_query("validate_line_sum", _SUMS_SQL, lambda r: r.sums())
_rule_query("validate_total", _TOTAL_SQL, lambda r: r.total())
_rule_query("validate_line_arith", _LINE_SQL, lambda r: r.line_arithmetic())
_rule_query("validate_all", _ALL_SQL, lambda r: r.all())


@query(f"""{fx.CTE}, i AS ({_ALL_SQL}), c AS (SELECT k, cast(k % 101 AS double) / 100 AS confidence FROM inv WHERE k % 3 <> 0)
SELECT inv.k, coalesce(n, 0)::BIGINT AS n_issues, coalesce(n, 0) > 0 OR coalesce(confidence < cast(0.8 as double), false) AS needs_review,
CASE WHEN coalesce(n, 0) > 0 OR coalesce(confidence < cast(0.8 as double), false) THEN 'pending_review' ELSE 'approved' END AS status
FROM inv LEFT JOIN (SELECT k, count(*) AS n FROM i GROUP BY k) x ON inv.k = x.k LEFT JOIN c ON inv.k = c.k""")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.invoice_docs(spark, sf_dir)
    confidence = F.when(F.col("k") % 3 != 0, (F.col("k") % 101).cast("double") / 100)
    gated = docs.select("k", _rules(docs).all().alias("issues"), confidence.alias("c"))
    review = rules.needs_review(F.col("issues"), F.col("c"))
    return gated.select("k", F.size("issues").cast("long").alias("n_issues"), review.alias("needs_review"), F.when(review, "pending_review").otherwise("approved").alias("status"))


@query(f"{fx.CTE}, i AS ({_ALL_SQL}) SELECT code, severity, count(*) AS n, count(DISTINCT k) AS documents FROM i GROUP BY 1, 2")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.invoice_docs(spark, sf_dir)
    # Errors first, then warnings, as a reviewer sees them.
    sorted_out = docs.select("k", by_severity(_rules(docs).all()).alias("i"))
    rows = sorted_out.select("k", F.explode(F.concat("i.errors", "i.warnings")).alias("i")).select("k", "i.code", "i.severity")
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("k").alias("documents"))


# --- paths

_NUM = "cast({} as double) / cast(100 as double)"


def _flat_sql(vendor="vendor_name", total="total_c", q="q", ln="ln", inv="inv") -> str:
    texts = ["invoice_number", vendor, "customer_name", "issue_date", "due_date", "currency"]
    names = ["invoice_number", "vendor_name", "customer_name", "issue_date", "due_date", "currency"]
    rows = [f"SELECT k, '{n}' AS path, NULL::DOUBLE AS num, {c}::VARCHAR AS str, CASE WHEN {c} IS NULL THEN 'null' ELSE 'str' END AS kind FROM {inv}" for n, c in zip(names, texts)]
    rows += [f"SELECT k, '{n}', {_NUM.format(c)}, NULL, CASE WHEN {c} IS NULL THEN 'null' ELSE 'num' END FROM {inv}" for n, c in (("subtotal", "sub_c"), ("tax_amount", "tax_c"), ("shipping", "ship_c"), ("total", total))]
    item = "SELECT l.k, concat('items.', idx, '.{n}'), {v}, NULL, CASE WHEN {v} IS NULL THEN 'null' ELSE 'num' END FROM {ln} l JOIN {inv} i ON l.k = i.k"
    rows += [item.format(n=n, v=v, ln=ln, inv=inv) for n, v in (("quantity", f"cast({q} as double)"), ("unit_price", _NUM.format("unit_c")), ("total", _NUM.format("printed_c")))]
    rows.append(f"SELECT k, 'items', NULL, NULL, 'empty_list' FROM {inv} WHERE k NOT IN (SELECT k FROM {ln})")
    return " UNION ALL ".join(rows)


_A = f"fa AS ({_flat_sql()})"
_B = f"""lb AS (SELECT * EXCLUDE (last_idx) FROM (SELECT *, max(idx) OVER (PARTITION BY k) AS last_idx FROM ln) WHERE NOT (k % 9 = 0 AND idx = last_idx)),
ib AS (SELECT * FROM inv WHERE k % 41 <> 0),
fb AS ({_flat_sql("CASE WHEN k % 12 <> 0 THEN vendor_name END", "(CASE WHEN k % 10 = 0 THEN total_c + 100 ELSE total_c END)", "CASE WHEN l.k % 8 = 0 AND idx = 0 THEN q + 1 ELSE q END", "lb", "ib")})"""
_SAME = "(coalesce(a.kind, 'null') = coalesce(b.kind, 'null') AND a.num IS NOT DISTINCT FROM b.num AND a.str IS NOT DISTINCT FROM b.str)"


@query(f"{fx.CTE}, {_A} SELECT k, path, kind, num, str FROM fa")
def flatten_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.flat_rows(fx.invoice_docs(spark, sf_dir), "k", "doc").select("k", "path", "leaf.kind", "leaf.num", "leaf.str")


_NATURAL = "list_transform(string_split(path, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN concat('1', lpad(p, 12, '0')) ELSE concat('0', p) END)"


@query(f"{fx.CTE}, {_A} SELECT k, path, row_number() OVER (PARTITION BY k ORDER BY {_NATURAL}) AS place FROM fa")
def natural_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.invoice_docs(spark, sf_dir)
    # Within a document, so no task sorts more than one document's paths at once.
    ordered = F.array_sort(F.transform(paths.flatten(F.col("doc"), docs.schema["doc"].dataType), lambda x: F.struct(paths.natural(x["path"]).alias("key"), x["path"].alias("path"))))
    return docs.select("k", F.posexplode(ordered).alias("p", "x")).select("k", "x.path", (F.col("p") + 1).cast("long").alias("place"))


_DIFF_SQL = f"""SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, CASE WHEN a.kind = 'empty_list' THEN '[]' ELSE a.str END AS old_str, a.num AS old_num,
CASE WHEN b.kind = 'empty_list' THEN '[]' ELSE b.str END AS new_str, b.num AS new_num
FROM fa a FULL JOIN fb b ON a.k = b.k AND a.path = b.path WHERE NOT {_SAME}"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.document_diff(fx.both_docs(spark, sf_dir), "k", "a", "b")


def _split(c: str, name: str) -> list:
    number = F.when(F.col(c).rlike(r"^-?[0-9.]+(E-?[0-9]+)?$"), F.col(c)).try_cast("double")
    text = F.when(number.isNull(), F.when(F.col(c).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "v string")["v"]).otherwise(F.col(c)))
    return [text.alias(f"{name}_str"), number.alias(f"{name}_num")]


@query(f"{fx.CTE}, {_A}, {_B} {_DIFF_SQL}")
def diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("k", "path", *_split("old", "old"), *_split("new", "new"))


@query(f"""{fx.CTE}, {_A}, {_B}, d AS ({_DIFF_SQL})
SELECT CASE k % 2 WHEN 0 THEN 'traditional' ELSE 'vlm' END AS engine, array_to_string(list_filter(string_split(path, '.'), lambda p: NOT regexp_full_match(p, '[0-9]+')), '.') AS field, count(*) AS corrections, count(DISTINCT k) AS documents FROM d GROUP BY 1, 2""")
def corrections_by_engine_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.when(F.col("k") % 2 == 0, "traditional").otherwise("vlm").alias("engine")
    return store.correction_rates(_changes(spark, sf_dir).select("k", "path", engine), "k")


@query(f"""{fx.CTE}, r AS (SELECT k, s, total_c + s * 100 AS t FROM inv, (VALUES (0), (1), (2)) v(s) WHERE s <= k % 3)
SELECT k, max(s)::BIGINT AS seq, arg_max(t, s)::BIGINT AS total_c, count(*) AS versions FROM r GROUP BY k""")
def current_after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.invoices(spark, sf_dir).select("k", "total_c", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("s"))
    log = log.select("k", F.col("s").cast("long").alias("s"), (F.col("total_c") + F.col("s") * 100).alias("t"))
    return store.latest(log.withColumnsRenamed({"s": "seq", "t": "total"}), "k", "seq", "total").withColumnRenamed("total", "total_c")


# --- comparison of engines


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = lambda i: ((F.col("k") * (7 + 4 * i)) % 1000).cast("double").alias("latency_ms")
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(e).alias("engine"), F.col(e).alias("doc"), latency(i)) for i, e in enumerate("ab")]
    return fx.both_docs(spark, sf_dir).select("k", F.inline(F.array(*rows)))


_COMPARE_SQL = f"""SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, ({_SAME} AND coalesce(a.k, b.k) % 41 <> 0) AS agree
FROM fa a FULL JOIN fb b ON a.k = b.k AND a.path = b.path"""


@query(f"{fx.CTE}, {_A}, {_B} {_COMPARE_SQL}")
def compare_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.compare(_answers(spark, sf_dir), "k").select("k", "path", "agree")


@query(f"{fx.CTE}, {_A}, {_B}, c AS ({_COMPARE_SQL}) SELECT k, avg(cast(cast(agree as int) as double)) AS agreement FROM c GROUP BY k")
def compare_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.agreement(paths.compare(_answers(spark, sf_dir), "k"), "k")


# --- evaluation

_NORMAL = "CASE WHEN {0}.num IS NOT NULL THEN printf('n:%.2f', {0}.num) WHEN {0}.kind = 'str' THEN concat('s:', lower({0}.str)) WHEN {0}.kind = 'empty_list' THEN 'empty_list:' END"
_EVAL_SQL = " UNION ALL ".join(
    f"""SELECT coalesce(a.k, b.k) AS k, '{e}' AS engine, coalesce(a.path, b.path) AS path,
array_to_string(list_filter(string_split(coalesce(a.path, b.path), '.'), lambda p: NOT regexp_full_match(p, '[0-9]+')), '.') AS field,
({_NORMAL.format("a")}) IS NOT DISTINCT FROM ({_NORMAL.format("b")}) AS correct FROM fa a FULL JOIN f{e} b ON a.k = b.k AND a.path = b.path"""
    for e in "ab"
)


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers = _answers(spark, sf_dir)
    return score.field_results(fx.invoice_docs(spark, sf_dir), answers, "k"), answers


@query(f"{fx.CTE}, {_A}, {_B} {_EVAL_SQL}")
def eval_field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[0]


@query(f"""{fx.CTE}, {_A}, {_B}, r AS ({_EVAL_SQL}), s AS (SELECT engine, count(*) AS field_count, count(*) FILTER (correct) AS correct_count FROM r GROUP BY 1),
t AS (SELECT e AS engine, count(*) AS document_count, count(*) FILTER (e = 'b' AND k % 41 = 0) AS failed_count, median(cast((k * (CASE e WHEN 'a' THEN 7 ELSE 11 END)) % 1000 as double)) AS median_latency_ms FROM inv, (VALUES ('a'), ('b')) v(e) GROUP BY 1)
SELECT engine, document_count, failed_count, field_count, correct_count, cast(correct_count as double) / field_count AS accuracy, median_latency_ms FROM t JOIN s USING (engine)""")
def eval_engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.engine_summary(*_results(spark, sf_dir))


@query(f"""{fx.CTE}, {_A}, {_B}, r AS ({_EVAL_SQL}), s AS (SELECT engine, field, avg(cast(cast(correct as int) as double)) AS accuracy, count(*) AS total FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY engine ORDER BY accuracy, total DESC, field) AS rank FROM s QUALIFY rank <= 5""")
def eval_weakest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.weakest_fields(_results(spark, sf_dir)[0])


# --- printed text

_DIGITS_SQL = "translate({}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
_TXT_LINES = "string_split(text, chr(10))"
_LAST_AMOUNT = f"regexp_extract_all({_DIGITS_SQL.format('{0}')}, '[0-9][0-9,]*(?:\\.[0-9]+)?')[-1]"
_SQL = {
    "find_amount": _LAST_AMOUNT.format(f"list_filter({_TXT_LINES}, lambda x: contains(lower(x), 'total') AND NOT contains(lower(x), 'subtotal'))[-1]"),
    "find_label_value": "invoice_number",
    "find_date": "CASE WHEN k % 4 = 0 THEN '1999-03-07' WHEN issue_date = '14/03/2024' THEN '2024-03-14' WHEN issue_date = '2024-02-31' THEN NULL ELSE issue_date END",
    "find_currency": "CASE k % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'SAR' WHEN 2 THEN 'EUR' END",
    "script_detect": "CASE WHEN k % 7 = 0 OR k % 6 = 0 THEN 'mixed' ELSE 'en' END",
}
_WITH = f"{fx.CTE}, t AS (SELECT txt.*, invoice_number, vendor_name, issue_date FROM txt JOIN inv USING (k))"


def _text_query(name: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.rendered(spark, sf_dir).select("k", make(F.col("text")).alias("found"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"{_WITH} SELECT k, {_SQL[name]} AS found FROM t"


for _name, _make in (("find_amount", X.find_amount), ("find_label_value", X.find_label_value), ("find_date", X.find_date), ("find_currency", X.find_currency), ("script_detect", X.script)):
    _text_query(_name, _make)

_NAMED = "CASE WHEN k % 6 = 0 THEN {a} ELSE {b} END"
_FIRST = "coalesce(vendor_name, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1])"


@query(f"{_WITH} SELECT k, {_NAMED.format(a='NULL', b=_FIRST)} AS latin, {_NAMED.format(a=chr(39) + 'شركة النور' + chr(39), b='NULL')} AS arabic FROM t")
def first_named_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.rendered(spark, sf_dir).select("k", X.first_named_line(F.col("text")).alias("n")).select("k", "n.*")


@query(f"""{_WITH} SELECT k, {_SQL["find_label_value"]} AS invoice_number, {_NAMED.format(a="NULL", b=_FIRST)} AS vendor_name,
{_NAMED.format(a=chr(39) + "شركة النور" + chr(39), b="NULL")} AS vendor_name_ar, {_SQL["find_date"]} AS issue_date, {_SQL["find_currency"]} AS currency, {_SQL["find_amount"]} AS total FROM t""")
def structure_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.rendered(spark, sf_dir).select("k", X.structure("invoice", F.col("text")).alias("s")).select("k", "s.*")


_MESSY = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN concat('SAR ', o_orderkey, ',234.50') WHEN 1 THEN concat('(', o_orderkey, '.00)') WHEN 2 THEN concat(o_orderkey, '-') WHEN 3 THEN 'n/a'
WHEN 4 THEN translate(concat(cast(o_orderkey as string), '٫5'), '0123456789', '٠١٢٣٤٥٦٧٨٩') WHEN 5 THEN '1.2.3' WHEN 6 THEN '  Not   Available ' WHEN 7 THEN '5%' ELSE concat('-', o_orderkey) END AS raw FROM {orders}"""


@query(f"""WITH m AS ({_MESSY.format(orders="orders")}) SELECT k, CASE k % 9 WHEN 0 THEN cast(concat(k, '234.50') as double) WHEN 1 THEN -cast(k as double) WHEN 2 THEN -cast(k as double) WHEN 4 THEN cast(k as double) + cast(0.5 as double)
WHEN 7 THEN cast(5 as double) WHEN 8 THEN -cast(k as double) END AS value, k % 9 = 5 AS invalid FROM m""")
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_MESSY, orders=_table(spark, sf_dir, "orders"))
    return raw.select("k", X.to_number(F.col("raw")).alias("n")).select("k", "n.*")


@query(f"WITH m AS ({_MESSY.format(orders='orders')}) SELECT k, CASE WHEN k % 9 IN (3, 6) THEN NULL ELSE raw END AS value FROM m")
def coerce_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MESSY, orders=_table(spark, sf_dir, "orders")).select("k", X.to_text(F.col("raw")).alias("value"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x20\\x85\\xA0\\x{2028}\\x{3000}]', '', 'g')) >= 40 AS has_text_layer FROM documents")
def text_layer_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.has_text_layer(F.array("text")).alias("has_text_layer"))


# --- layout


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document as boxes: 40 lines to a page, jittered heights, scrambled arrival."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    words = docs.select("doc_id", "i", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("j", "text"))
    y = (F.col("i") % 40 * 40 + 7 * F.col("j") % 5).cast("double")
    x = (F.col("j") * 50).cast("double")
    confidence = ((F.col("doc_id") * 31 + F.col("i") * 7 + F.col("j")) % 101).cast("double") / 100
    seq = F.pmod(F.col("i") * 7919 + F.col("j") * 104729, F.lit(1000003))
    return words.select("doc_id", "i", "j", seq.alias("seq"), "text", F.array(x, y, x + 40, y + 20).alias("bbox"), (F.floor(F.col("i") / 40) + 1).cast("int").alias("page"), confidence.alias("confidence"))


_BLOCKS_SQL = """WITH l AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')) AS line, generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> ''), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS text, generate_subscripts(list_filter(string_split(line, ' '), lambda x: x <> ''), 1) - 1 AS j FROM l),
b AS (SELECT *, cast((doc_id * 31 + i * 7 + j) % 101 as double) / 100 AS confidence FROM w)"""


@query(f"""{_BLOCKS_SQL}, t AS (SELECT doc_id, i, string_agg(text, ' ' ORDER BY j) AS t FROM b GROUP BY 1, 2),
p AS (SELECT doc_id, i // 40 AS p, string_agg(t, chr(10) ORDER BY i) AS t FROM t GROUP BY 1, 2) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY p) AS text FROM p GROUP BY 1""")
def reading_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_blocks(spark, sf_dir))


@query(f"{_BLOCKS_SQL} SELECT doc_id, count(*) AS blocks, count(*) FILTER (confidence >= cast(0.5 as double)) AS kept FROM b GROUP BY 1")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(layout.confident(F.col("text"), F.col("confidence"))).alias("kept"))


# Halves are rounded up in whole numbers: both engines' doubles may lie on either side of them.
@query(f"{_BLOCKS_SQL} SELECT doc_id, ((20000 * s + 100 * n) // (200 * n))::DOUBLE / 10000 AS confidence FROM (SELECT doc_id, sum((doc_id * 31 + i * 7 + j) % 101 * length(text))::BIGINT AS s, sum(length(text))::BIGINT AS n FROM b GROUP BY 1)")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(layout.overall_confidence(F.col("text"), F.col("confidence")).alias("confidence"))


@query(f"""{_BLOCKS_SQL} SELECT doc_id, i AS line, string_agg(text, ' ' ORDER BY j) AS text, round(avg(confidence), 6) AS conf, cast(min(j * 50) as double) AS x0, cast(min(i % 40 * 40 + 7 * j % 5) as double) AS y0,
cast(max(j * 50) + 40 as double) AS x1, cast(max(i % 40 * 40 + 7 * j % 5) + 20 as double) AS y1 FROM b GROUP BY 1, 2""")
def tesseract_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    words = _blocks(spark, sf_dir).select("doc_id", F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("i").cast("long").alias("line"), F.col("j").alias("word"), "text", F.col("confidence").alias("conf"), *box)
    return layout.regroup_words(words, "doc_id").drop("block", "par").withColumn("conf", F.round("conf", 6))


@query(f"{_BLOCKS_SQL} SELECT doc_id, cast(min(j * 50) as double) AS x0, cast(min(i % 40 * 40 + 7 * j % 5) as double) AS y0, cast(max(j * 50) + 40 as double) AS x1, cast(max(i % 40 * 40 + 7 * j % 5) + 20 as double) AS y1 FROM b GROUP BY 1")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"), F.max(at(2)).alias("x1"), F.max(at(3)).alias("y1"))


# --- store access paths


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending_review' END AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def queue_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the review queue: a top-k, which sorts no more than it returns."""
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending_review")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return store.listing(rows, status="pending_review", limit=50, offset=50)


@query(f"{fx.CTE} SELECT k, invoice_number, currency, {_NUM.format('total_c')} AS total FROM inv")
def scan_prune_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.invoices(spark, sf_dir).select("k", "invoice_number", "currency", (F.col("total_c") / F.lit(100.0)).alias("total"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copies FROM documents QUALIFY copies > 1")
def content_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return store.copies(rows, "doc_id")


@query(f"{fx.CTE} SELECT k, invoice_number FROM inv WHERE currency = 'USD' AND {_NUM.format('total_c')} > cast(1000 as double)")
def jsonb_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.invoice_docs(spark, sf_dir)
    found = store.containing(paths.flat_rows(docs, "k", "doc"), "k", "currency", '"USD"')
    return docs.filter(F.col("doc.total") > 1000).select("k", "doc.invoice_number").join(found, "k", "left_semi")


@query("SELECT event_id, key AS path, CAST(value AS VARCHAR) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) e, LATERAL (SELECT json_extract_string(props, concat('$.', key)) AS value) x")
def flatten_json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return spark.sql("SELECT event_id, x.key AS path, cast(x.value AS string) AS value FROM {events}, LATERAL variant_explode(v) AS x", events=events)


_TRI = "list_distinct(list_transform(range(1, length(lower({0})) - 1), lambda i: substr(lower({0}), i, 3)))"


@query(f"SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p_partkey, {_TRI.format('p_name')} AS a, {_TRI.format(chr(39) + 'small steel' + chr(39))} AS b FROM part)")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = X.trigrams(F.col("p_name")), X.trigrams(F.lit("small steel"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double"), 6).alias("similarity"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def labelled_samples_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.paired(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")[0]


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.paired(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), "doc_id")[1]


@query("SELECT conv_id, list(role ORDER BY turn) AS pages, count(*) AS source_page_count, count(*) > 3 AS truncated FROM conversations WHERE turn IS NOT NULL GROUP BY 1".replace("list(role ORDER BY turn)", "array_to_string(list(role ORDER BY turn)[1:3], ',')"))
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    pages = F.array_join(F.transform(files.cap_pages(turns, 3), lambda x: x["role"]), ",")
    return _table(spark, sf_dir, "conversations").filter("turn IS NOT NULL").groupBy("conv_id").agg(pages.alias("pages"), F.count("*").alias("source_page_count"), (F.count("*") > 3).alias("truncated"))


# --- coercion, replies, sources

# Braces are doubled: the text is a format for the table.
_RAW_JSON = """SELECT o_orderkey AS k, CASE o_orderkey % 6
WHEN 0 THEN concat('{{"invoice_number":" INV  ', o_orderkey, ' ","total":"SAR ', o_orderkey, ',000.50","items":[],"extra":1}}')
WHEN 1 THEN '[1,2]' WHEN 2 THEN '{{"total":"1.2.3","vendor_name":12,"currency":"n/a"}}' WHEN 3 THEN '{{"items":["x",{{"total":"(5)"}},{{"total":[1]}}],"total":true}}'
WHEN 4 THEN 'no json' ELSE concat('{{"total":', o_orderkey, ',"items":{{}}}}') END AS raw FROM {orders}"""


@query(f"""WITH r AS ({_RAW_JSON.format(orders="orders")}) SELECT k, CASE k % 6 WHEN 0 THEN concat('INV ', k) END AS invoice_number,
CASE k % 6 WHEN 0 THEN cast(concat(k, '000.50') as double) WHEN 3 THEN 1.0 WHEN 5 THEN cast(k as double) END AS total, CASE WHEN k % 6 IN (1, 4) THEN NULL WHEN k % 6 = 3 THEN 2 ELSE 0 END AS n_items,
CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'not_an_object' WHEN 4 THEN 'not_an_object' WHEN 2 THEN 'vendor_name=string_type,total=float_parsing' WHEN 3 THEN 'items.0=model_type,items.2.total=float_type' ELSE 'items=list_type' END AS issues FROM r""")
def coerce_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.coerce import coerce
    from ..types import INVOICE

    raw = spark.sql(_RAW_JSON, orders=_table(spark, sf_dir, "orders"))
    made = raw.select("k", coerce(F.col("raw"), INVOICE).alias("c"))
    said = F.array_join(F.transform("c.issues", lambda i: F.when(i["code"] == "field_invalid", F.concat_ws("=", i["field"], i["expected"])).otherwise(i["code"])), ",")
    return made.select("k", "c.doc.invoice_number", "c.doc.total", F.when(F.col("c.doc").isNotNull(), F.size("c.doc.items")).alias("n_items"), said.alias("issues"))


_REPLY = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('Here: ', props, ' done') WHEN 2 THEN concat('[', props, ']') WHEN 3 THEN 'null' WHEN 4 THEN concat('{{ ', props) ELSE props END AS reply FROM {events}"""


@query("SELECT event_id, CASE WHEN event_id % 6 IN (2, 3) THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def parse_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.replies import parse_json_object as parse

    replies = spark.sql(_REPLY, events=_table(spark, sf_dir, "events"))
    return replies.select("event_id", F.get_json_object(parse("reply"), "$.k").alias("k"))


@query(f"""{fx.CTE}, v AS (SELECT k, engine FROM inv, (VALUES ('a'), ('b')) e(engine)) SELECT engine, count(*) AS answers, count(DISTINCT k) AS documents FROM v GROUP BY 1""")
def samples_by_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample is asked of every engine: the engines are a literal of two rows."""
    engines = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("engine")
    return fx.invoices(spark, sf_dir).select("k", engines).groupBy("engine").agg(F.count("*").alias("answers"), F.count_distinct("k").alias("documents"))


@query(f"""{fx.CTE}, {_A}, {_B}, d AS ({_DIFF_SQL}), n AS (SELECT k, count(*) AS n_corrections, min(path) AS first_path FROM d GROUP BY k)
SELECT inv.k, invoice_number, coalesce(n_corrections, 0) AS n_corrections, first_path FROM inv LEFT JOIN n USING (k)""")
def point_lookup_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their corrections nested; the corrections are grouped before the join."""
    joined = store.with_corrections(fx.invoices(spark, sf_dir).select("k", "invoice_number"), _changes(spark, sf_dir), "k", "path", "old", "new")
    return joined.select("k", "invoice_number", F.coalesce(F.size("corrections"), F.lit(0)).cast("long").alias("n_corrections"), F.get("corrections", F.lit(0))["path"].alias("first_path"))


@query(f"{fx.CTE}, {_A}, {_B} {_DIFF_SQL.replace('SELECT coalesce(a.k, b.k) AS k', 'SELECT CASE coalesce(a.k, b.k) % 2 WHEN 0 THEN ' + chr(39) + 'traditional' + chr(39) + ' ELSE ' + chr(39) + 'vlm' + chr(39) + ' END AS engine, coalesce(a.k, b.k) AS k')}")
def corrections_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the corrections table: the engine is copied from the document at review time."""
    engine = F.when(F.col("k") % 2 == 0, "traditional").otherwise("vlm").alias("engine")
    return _changes(spark, sf_dir).select(engine, "k", "path", *_split("old", "old"), *_split("new", "new"))


# --- review, images, streams


@query("SELECT p_partkey, (p_size % 3 = 0 OR p_size % 5 <> 0)::INT + (p_size % 2 = 0)::INT AS n_items FROM part")
def drop_blank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.review import drop_blank_items as drop
    from ..types import LINE_ITEM

    at = lambda test, value: F.when(F.expr(test), value)
    named = F.struct(at("p_size % 3 = 0", F.col("p_name")).otherwise("").alias("description"), (F.col("p_size") % 5).cast("double").alias("quantity"))
    other = F.struct(F.lit("").alias("description"), at("p_size % 2 = 0", F.lit(1.5)).otherwise(0.0).alias("quantity"))
    kept = [f for f in LINE_ITEM.fields if f.name in ("description", "quantity")]
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(drop(F.array(named, other), type(LINE_ITEM)(kept))).alias("n_items"))


@query(f"{fx.CTE}, {_A}, {_B} SELECT k, path FROM ({_COMPARE_SQL}) WHERE NOT agree")
def compare_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.review import disagreements

    return disagreements(paths.compare(_answers(spark, sf_dir), "k")).select("k", "path")


@query("SELECT vec_id, 'ffd8ff' AS head, 16 AS height, len(embedding)::INT AS width FROM embeddings")
def wire_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn as gray stripes and sent as JPEG; height and width as the files give them."""
    from ..operators.pages import wire_pages as encode

    row = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor(x * 100), F.lit(256))), 2, "0")), "")
    drawn = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("path"), F.lit(1).alias("page"), F.lit(1).alias("pages"), F.lit(16).alias("height"), F.size("embedding").alias("width"),
        F.unhex(F.repeat(row, F.lit(16))).alias("data"), F.lit(None).cast("string").alias("note"),
    )
    # Where the frame's size stands: after the first header and two quantisation tables.
    at = lambda i: F.conv(F.hex(F.substring("jpeg", i, 2)), 16, 10).cast("int")
    return encode(drawn).select(F.col("path").cast("long").alias("vec_id"), F.lower(F.hex(F.substring("jpeg", 1, 3))).alias("head"), at(164).alias("height"), at(166).alias("width"))


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the tables, ingested by a stream that ends when it has read what is there."""
    import tempfile
    import uuid

    from ..sources.files import file_name
    from ..streaming.ingest import hashed_files, watch

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerleaf-")
    place = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    watch(spark, sf_dir, hashed_files, f"{place}/out", f"{place}/state", "*.parquet", content=False).awaitTermination()
    return spark.read.parquet(f"{place}/out").select(file_name(F.col("path")).alias("name"), "length", "content_hash")
