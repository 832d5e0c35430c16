"""Operator 6: quality rules as a ledger of failure bits, on DataFrame functions only.

``ledger`` evaluates every rule once per document and stores its measurements and one bit per
failed rule.  Policies are versioned bit masks over the ledger: applying one, or asking what each
rule would change, reads bits and no text.

Null and empty texts have no words, so they fail the rules on length.  Repeated rows and null ids
are judged row by row.  ``ledger`` returns the id and its own columns alone; ``apply_policy`` keeps
the columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rule by bit; each reads the measurements.  Words count as in the contract of the query.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_words > 0 AND 100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("long_words", "n_words > 0 AND 100 * n_long_words > 10 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the bits that reject a document.
POLICIES = {1: BIT["too_short"] | BIT["repeats_itself"], 2: (1 << len(RULES)) - 1}
CURRENT = 2
#: Code points from which on a word counts as long.
LONG_WORD = 40

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` that occur twice or more in the array ``words``.

    Texts of distinct windows, told by one hash set, are done at once.  Else the windows are sorted
    with their places, so that equal ones are neighbours; the places of windows with an equal
    neighbour are sorted and the words that they cover are counted.
    """
    n = F.size(words)

    def covered(places: Column) -> Column:
        gap = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
        return F.aggregate(gap, F.lit(0), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        at = lambda i: F.get(pairs, i)["h"]
        same = F.filter(pairs, lambda x, i: (x["h"] == F.coalesce(at(i - 1), x["h"] + 1)) | (x["h"] == F.coalesce(at(i + 1), x["h"] + 1)))
        return F.aggregate(F.transform(F.array(F.array_sort(F.transform(same, lambda x: x["p"]))), covered), F.lit(0), lambda a, x: a + x)

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        held = F.aggregate(F.transform(F.array(pairs), repeated), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(held)

    each = F.transform(words, lambda w: F.xxhash64(w))
    # One hash per word, then three per window: words are hashed once, not once a window.
    window = lambda h: F.zip_with(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(h, 3, F.size(h)), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c)))
    hashes = F.transform(F.array(each), lambda h: F.slice(window(h), 1, F.greatest(F.size(h) - (size - 1), F.lit(0))))
    return F.when(n < size + 1, F.lit(0)).otherwise(F.aggregate(F.transform(hashes, counted), F.lit(0), lambda a, x: a + x))


def _judged(docs: DataFrame, carried: Column) -> DataFrame:
    """``carried`` with the measurements and failure bits of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    cut = docs.select(carried.alias("c"), text.alias("t"), words.alias("w"), lines.alias("l"))
    long = lambda c, name: c.cast("long").alias(name)
    measured = cut.select(
        "c",
        long(F.size("w"), "n_words"),
        long(F.length(F.array_join("w", "")), "word_chars"),
        long(F.regexp_count("t", F.lit(r"[#*$%&|<>]")), "n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l")), "n_dup_lines"),
        long(_repeat_words(F.col("w")), "n_repeat_words"),
        long(F.size("l"), "n_lines"),
        long(F.size(F.filter("w", lambda w: F.length(w) >= LONG_WORD)), "n_long_words"),
    )
    failures = F.lit(0)
    for i, (_, rule) in enumerate(RULES):
        failures = failures.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0))
    return measured.withColumn("failures", failures.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and ``failures`` (bits of RULES) of each row of (doc_id, text)."""
    return _judged(docs, F.col("doc_id").cast("long")).withColumnRenamed("c", "doc_id")


def rejected(version: int = CURRENT) -> Column:
    return F.col("failures").bitwiseAND(F.lit(POLICIES[version])) != 0


def ablation(records: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects.  One
    pass of bit counts over a ledger; no text is read again."""
    mask = POLICIES[version]
    held = F.col("failures").bitwiseAND(F.lit(mask))
    used = [(name, bit) for name, bit in BIT.items() if bit & mask]
    counts = [F.count_if(held.bitwiseAND(F.lit(bit)) != 0).alias(f"f{bit}") for _, bit in used]
    counts += [F.count_if(held == bit).alias(f"a{bit}") for _, bit in used]
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"f{bit}").alias("failed"), F.col(f"a{bit}").alias("only_by_this")) for name, bit in used]
    return records.agg(*counts).select(F.inline(F.array(*rows)))


def apply_policy(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    # The row travels beside its measurements; nothing is joined or shuffled.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, whole).filter(~rejected(version)).select("c.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = POLICIES[1]
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        (~rejected()).alias("kept"),
        "failures",
    )


_W = r"[^\x20\x09-\x0D]"
OP6_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_W}+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM cut
), win AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words)
), rep AS (
  SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - p, 3)))::BIGINT AS n
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM rep) GROUP BY doc_id
), m AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: length(x) >= {LONG_WORD})) AS n_long_words
  FROM words LEFT JOIN cov ON words.doc_id IS NOT DISTINCT FROM cov.doc_id
), f AS (
  SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))})::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & {POLICIES[1]}) <> 0 AS base_failed, (failures & {POLICIES[CURRENT]}) = 0 AS kept, failures FROM f
"""
