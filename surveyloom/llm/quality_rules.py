"""Quality rules as a bitmask ledger (native).

`ledger` measures every document and evaluates every rule once: the failures are bits of one integer, the
measurements stay beside it. `apply_policy` turns a version's mask into verdicts and `ablation` counts, by bitwise
aggregation, what each rule of a policy costs; neither touches texts again.

Edge cases: a null text counts as empty (0 words, all measurements 0, fails `few_words`); each input row gives one
output row, repeated rows and null ids too; columns of `docs` other than the id and the text are ignored, so names
can't clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = " \t\n\x0b\x0c\r"

#: Rules in bit order; each is (name, failure as SQL over the measurements). Base rules come first.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("shouting", "10 * n_upper > 5 * word_chars"),
    ("tables", "10 * n_bars > 2 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Masks of rules by policy version; versions are added, never changed.
POLICIES = {
    1: BASE,
    2: BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["word_length"] | BITS["shouting"] | BITS["tables"],
}


def _repeat_positions() -> str:
    """Starts of 3-word windows that occur again: sorted (hash | position) longs, equal neighbours compared as words."""
    same = (
        "shiftrightunsigned(x, shift) = shiftrightunsigned(packed[{j}], shift)"
        " and slice(words, cast(x & mask as int) + 1, 3) = slice(words, cast(packed[{j}] & mask as int) + 1, 3)"
    )
    return (
        "sort_array(transform(filter(packed, (x, j) ->"
        f" (j > 0 and {same.format(j='greatest(j - 1, 0)')})"
        f" or (j < size(packed) - 1 and {same.format(j='least(j + 1, size(packed) - 1)')})), x -> x & mask))"
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bars."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaces = r"[\x20\x09-\x0D]+"
    trimmed = F.btrim(F.col("_t"), F.lit(WHITE))
    first = (
        docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
        .withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, spaces)))
        .withColumn("lines", F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    )

    def lost(pattern: str) -> Column:
        return (F.char_length("_t") - F.char_length(F.regexp_replace("_t", pattern, ""))).cast("long")

    counted = first.select(
        "_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        lost(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        lost(r"\p{Lu}").alias("n_upper"),
        (F.char_length("_t") - F.char_length(F.replace("_t", F.lit("|"), F.lit("")))).cast("long").alias("n_bars"),
        F.expr("length(bin(size(words)))").alias("shift"),
    )
    packed = F.expr(
        "case when n_words < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(n_words as int) - 3),"
        " i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), shift) | cast(i as bigint))) end"
    )
    ranked = counted.withColumn("packed", packed).withColumn("mask", F.expr("shiftleft(1L, shift) - 1"))
    found = ranked.withColumn("again", F.expr(_repeat_positions()))
    covered = F.expr(
        "aggregate(again, named_struct('last', -3L, 'n', 0L),"
        " (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)"
    )
    kept = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    return found.select(F.col("_id").alias(id_col), *kept, covered.alias("n_repeat_words"), "n_lines", "n_upper", "n_bars")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() and `fail_bits`, bit i set where RULES[i] fails."""
    bits = " | ".join(f"case when {rule} then {1 << i}L else 0L end" for i, (_, rule) in enumerate(RULES))
    return measure(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(book: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with `policy`, `policy_bits` (the failures that count) and `kept`."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    return book.withColumns({"policy": F.lit(version), "policy_bits": bits, "kept": bits == 0})


def ablation(book: DataFrame, version: int = 2) -> DataFrame:
    """Per rule of a policy: documents failing it, failing only it (what dropping it would give back), and all rows.

    Rows are first summed by distinct bit pattern, so the second step reads at most 2**rules rows.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    patterns = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    own = [
        F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
        for name, bit in BITS.items()
        if POLICIES[version] & bit
    ]
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.withColumn("r", F.explode(F.array(*own)))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
            F.sum("n").alias("documents"),
        )
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(f"(fail_bits & {BASE}) != 0").alias("base_failed"), "kept", "fail_bits", "n_lines", "n_upper", "n_bars",
    )


_RULE_SQL = "\n".join(f"| (case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))
ORACLE_SQL = {
    "op3_quality_rules": rf"""
with base as (
  select doc_id, coalesce(text, '') t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
places as (select doc_id, unnest(range(1, greatest(len(w) - 1, 1))) i, w from base where len(w) >= 3),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from places),
again as (select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct p)::bigint n from (select doc_id, unnest([i, i + 1, i + 2]) p from again) group by doc_id),
m as (
  select b.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::bigint n_upper,
    (length(t) - length(replace(t, '|', '')))::bigint n_bars
  from base b left join covered c using (doc_id)),
f as (select *, (0 {_RULE_SQL})::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 base_failed,
  (fail_bits & {POLICIES[2]}) = 0 kept, fail_bits, n_lines, n_upper, n_bars from f""",
}
QUERIES = {"op3_quality_rules": op3_quality_rules}
