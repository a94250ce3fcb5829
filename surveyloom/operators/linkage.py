"""Record linkage, verification, referential checks and dictionary encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import recode as R
from ..sources.storage import stored
from . import titles
from .graph import components


def group_records(records: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """records with `group`: the smallest key reachable over shared values of any of the key columns (nulls and '' link nothing)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]))
    links = records.select(F.col(key).cast("long").alias("v"), pairs.alias("p")).select("v", "p.kind", "p.value").where("value is not null and value <> ''")
    least = links.groupBy("kind", "value").agg(F.min("v").alias("u"))  # a star to the smallest record of each value
    found = components(links.join(least, ["kind", "value"]).select("u", "v"))
    return records.join(found, records[key] == found["node"], "left").withColumn("group", F.coalesce("component", key)).drop("node", "component")


def merge_survivors(grouped: DataFrame, key: str, priority: list[str], fill: list[str], lists: list[str], flag: str, source: str) -> DataFrame:
    """One row a group: the first record by priority, its empty fields filled with the longest value of the others.

    `lists` become sorted distinct unions, `flag` holds if it does for any record, `ids` maps each source to its first
    record's key, n counts records. Ties go to the smallest key.
    """
    order = F.struct(*priority, key)

    def filled(c):
        own, given = F.min_by(c, order), F.col(c).isNotNull() & (F.col(c) != "")
        longest = F.min_by(c, F.when(given, F.struct(-F.length(c), F.col(c))))
        return F.when(F.coalesce(own != "", F.lit(False)), own).otherwise(longest).alias(c)

    ids = F.array_sort(F.collect_set(F.struct(F.col(source).alias("s"), F.col(key).alias("k"))))
    out = grouped.groupBy("group").agg(
        F.min_by(key, order).alias(key), *[filled(c) for c in fill], *[F.array_sort(F.collect_set(c)).alias(c) for c in lists], F.max(flag).alias(flag), ids.alias("_ids"), F.count("*").alias("n")
    )
    first = F.expr("filter(_ids, (x, i) -> i = 0 or _ids[greatest(i - 1, 0)].s <> x.s)")
    return out.withColumn("ids", F.map_from_entries(first)).drop("_ids")


def token_coverage(needle: Column, hay: Column, longer: int = 3) -> Column:
    """Share of the needle's words of more than `longer` letters, each as often as it stands, that the other text holds; null without any."""
    words = F.filter(F.split(needle, " "), lambda w: F.length(w) > longer)
    return F.try_divide(F.size(F.filter(words, lambda w: F.contains(hay, w))), F.size(words))


def title_similarity(a: Column, b: Column) -> Column:
    """1 if one normalised title holds the other, else 1 - edit distance / longer length; 0 for an empty one."""
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(ratio)


#: Rows of an author and year, and letters of their titles (an eighth of those of their texts), that are one slice of their comparisons.
SLICE, SLICE_LETTERS = 4096, 1 << 20
#: Letters of titles that a task returns at a time.
RETURNED = 1 << 23


def _met(least: float, coverage: float | None):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left = table.column("_left").to_numpy()
        a, b = (table.filter(pa.array(side)).combine_chunks() for side in (left, ~left))
        if not a.num_rows or not b.num_rows:
            return
        ta, tb = a.column("title").to_pylist(), b.column("title").to_pylist()
        long_a, long_b = (np.array([len(t or "") for t in ts], np.int64) for ts in (ta, tb))
        for i, j, share in titles.meet(ta, tb, b.column("text").to_pylist(), least, coverage):
            cuts = np.flatnonzero(np.diff(np.cumsum(long_a[i] + long_b[j] + 64) // RETURNED)) + 1
            for x, y in zip([0, *cuts], [*cuts, i.size]):
                at_a, at_b = pa.array(i[x:y]), pa.array(j[x:y])
                columns = [t.column(c).take(k).combine_chunks() for t, k, c in ((a, at_a, "_a"), (b, at_b, "_b"), (a, at_a, "title"), (b, at_b, "title"))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(share[x:y])], names=["_a", "_b", "ta", "tb", "coverage"])

    return met


def _meeting(where_a: DataFrame, where_b: DataFrame, least: float, coverage: float | None) -> DataFrame:
    """Pairs (_a, _b) of an author and year with titles ta and tb that may agree (all that do, and few others), and the share of
    the words of ta that the text holds.

    Quadratic in the rows of an author and year: slices of both sides meet in a task each, where titles and words are looked up.
    """
    parts = int(where_a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["author", "year"]
    known = F.col("author").isNotNull() & F.col("year").isNotNull()
    a, b = where_a.where(known & (F.col("ta") != "")), where_b.where(known)
    # Rows and letters bound what a task holds: a title's letters take much more room there than a text's.
    letters = lambda c, share: F.coalesce(F.sum(F.length(c)), F.lit(0)) / (SLICE_LETTERS * share)
    slices = lambda n: F.ceil(F.least(F.count("*"), F.greatest(F.count("*") / SLICE, n))).cast("int")
    both = a.groupBy(key).agg(slices(letters("ta", 1)).alias("_m")).join(b.groupBy(key).agg(slices(letters("tb", 1) + letters("text", 8)).alias("_n")), key)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind_a, kind_b = where_a.schema["_a"].dataType, where_b.schema["_b"].dataType
    sent_a = a.join(both, key).select(*key, own("_a", "_m").alias("_i"), each("_n").alias("_j"), F.lit(True).alias("_left"), "_a", F.lit(None).cast(kind_b).alias("_b"), F.col("ta").alias("title"), F.lit(None).cast("string").alias("text"))
    sent_b = b.join(both, key).select(*key, each("_m").alias("_i"), own("_b", "_n").alias("_j"), F.lit(False).alias("_left"), F.lit(None).cast(kind_a).alias("_a"), "_b", F.col("tb").alias("title"), "text")
    # Partitions by number aren't put together by their size: few bytes are much work.
    sent = sent_a.unionByName(sent_b).repartition(parts, *key, "_i", "_j")
    return sent.groupBy(*key, "_i", "_j").applyInArrow(_met(least, coverage), f"_a {kind_a.simpleString()}, _b {kind_b.simpleString()}, ta string, tb string, coverage double")


def _alike_titles(where_a: DataFrame, where_b: DataFrame, least: float) -> DataFrame:
    """Pairs (_a, _b) of an author and year whose titles are at `least` alike or hold one another; texts don't count."""
    met = _meeting(where_a, where_b.withColumn("text", F.lit(None).cast("string")), least, None)
    return met.where(title_similarity(F.col("ta"), F.col("tb")) >= least).select("_a", "_b")


def verified_pairs(records: DataFrame, found: DataFrame, least: float = 0.8, coverage: float = 0.75) -> DataFrame:
    """Pairs of a record and a found one by the same author, a year apart at most, whose titles agree.

    records: id, author, year, title; found: id, author, year, title, text (normalised). Author and year make the blocks;
    titles below `least` pass if the found text holds enough of the record's title (`token_coverage`). Null
    authors, years and titles agree with nothing (a null text holds nothing).
    """
    near = F.explode(F.array(*[F.col("year") + o for o in (-1, 0, 1)])).alias("year")
    left = stored(records.select(F.col("id").alias("_a"), "author", "year", F.col("title").alias("ta")))
    right = stored(found.select(F.col("id").alias("_b"), "author", "year", F.col("title").alias("tb"), "text"))
    both = _meeting(left.select("_a", "author", near, "ta"), right, least, coverage).where("_a <> _b")
    scored = both.select(F.col("_a").alias("a"), F.col("_b").alias("b"), title_similarity(F.col("ta"), F.col("tb")).alias("similarity"), "coverage")
    return scored.where((F.col("coverage") >= coverage) | (F.col("similarity") >= least)).withColumn("by", F.when(F.col("similarity") >= least, "title").otherwise("text"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def referential_report(child: DataFrame, parent: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """(check, n): repeated keys, empty needed fields, keys that the parent lacks, and parent keys that no child has."""
    repeated = child.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated key").alias("check"), F.count("*").alias("n"))
    out = repeated
    for c in needed:
        empty = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        out = out.unionByName(child.agg(F.lit(f"empty {c}").alias("check"), F.count_if(empty).alias("n")))
    for name, a, b in (("unknown key", child, parent), ("unused key", parent, child)):
        out = out.unionByName(a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n")))
    return out


def dictionary_encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dictionary: column, code, value; df with codes). Codes follow the sorted values from 0; null comes last."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.column", "p.value").distinct()
    dictionary = values.withColumn("code", (F.row_number().over(Window.partitionBy("column").orderBy(F.asc_nulls_last("value"))) - 1).cast("int"))
    coded = df
    for c in columns:
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        coded = coded.join(own, coded[c].cast("string").eqNullSafe(F.col("_v"))).withColumn(c, F.col("_c")).drop("_v", "_c")
    return dictionary, coded


def dictionary_decode(dictionary: DataFrame, coded: DataFrame, columns: list[str]) -> DataFrame:
    out = coded
    for c in columns:
        own = dictionary.where(F.col("column") == c).select(F.col("code").alias("_c"), F.col("value").alias("_v"))
        out = out.join(own, out[c] == F.col("_c")).withColumn(c, F.col("_v")).drop("_c", "_v")
    return out


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slug) of every <cite:a; b> and <citet:a> mark."""
    inside = F.regexp_extract_all(text, F.lit(r"<citet?:([^>]+)>"), 1)
    slugs = F.flatten(F.transform(inside, lambda x: F.transform(F.split(x, ";"), lambda s: F.trim(s))))
    return df.select(key, F.explode(slugs).alias("slug")).where("slug <> ''")


def resolve(cited: DataFrame, references: DataFrame, slug: str = "slug") -> DataFrame:
    """(slug, n, known): each cited slug, how often, and whether the reference table has it; unknown ones are errors."""
    used = cited.groupBy(slug).agg(F.count("*").alias("n"))
    have = references.select(slug).distinct().withColumn("_k", F.lit(True))
    return used.join(have, slug, "left").select(slug, "n", F.coalesce("_k", F.lit(False)).alias("known"))


def search_log(df: DataFrame, source: str, text: str, terms: list[str]) -> DataFrame:
    """(source, term, hits, records): normalised records of each source, and how many hold all words of a term."""
    words = {t: F.filter(F.split(F.lit(t), " "), lambda w: w != "") for t in terms}
    found = [F.count_if(F.forall(w, lambda x: F.contains(F.col(text), x))).alias(f"_{i}") for i, w in enumerate(words.values())]
    sums = df.groupBy(source).agg(F.count("*").alias("records"), *found)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_{i}").alias("hits")) for i, t in enumerate(terms)]))
    return sums.select(source, "records", pairs.alias("p")).select(source, "p.term", "p.hits", "records")


def topics(df: DataFrame, text: str, rules: list[tuple[str, str]], default: str, overrides: DataFrame, key: str, mention: str) -> DataFrame:
    """df with topic (the first rule whose pattern stands in the text, but for overridden keys) and mentioned (another pattern's flag)."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(out)
    fixed = overrides.select(F.col(key), F.col("topic").alias("_topic")).dropDuplicates([key])
    return df.join(fixed, key, "left").withColumns({"topic": F.coalesce("_topic", out), "mentioned": F.col(text).rlike(mention)}).drop("_topic")


def overlay(candidates: DataFrame, key: str, title: str, corrections: DataFrame, external: DataFrame, override: list[str], manual: DataFrame, previous: DataFrame) -> DataFrame:
    """Candidates with field-level corrections, then external metadata (filling empty fields, or overriding those listed), and
    manual rows; slugs of the previous run stay with records of the same normalised title.

    corrections: key, field, value; external: key and fields; previous: title_key, slug. New records have a null slug.
    """
    fields = [c for c in candidates.columns if c != key]
    fixes = corrections.groupBy(key).pivot("field", fields).agg(F.max("value"))
    fixed = candidates.join(fixes.withColumnsRenamed({c: f"_f_{c}" for c in fields}), key, "left")
    extra = external.withColumnsRenamed({c: f"_e_{c}" for c in external.columns if c != key})
    joined = fixed.join(extra, key, "left")

    def value(c: str) -> Column:
        own = F.coalesce(F.col(f"_f_{c}"), F.col(c))
        given = F.col(f"_e_{c}") if c in external.columns else F.lit(None)
        blank = F.nullif(own, F.lit(""))
        return (F.coalesce(F.col(f"_f_{c}"), given, F.col(c)) if c in override else F.coalesce(blank, given)).alias(c)

    merged = joined.select(key, *[value(c) for c in fields]).unionByName(manual.select(key, *fields))
    named = merged.withColumn("title_key", R.title_key(F.col(title)))
    return named.join(previous.select("title_key", "slug").dropDuplicates(["title_key"]), "title_key", "left").drop("title_key")


def evidence_matrix(df: DataFrame, themes: str, order: list[str]) -> DataFrame:
    """A row per record and theme it carries, in order of theme and `order`."""
    rows = df.withColumn("theme", F.explode(themes)).drop(themes)
    return rows.repartitionByRange("theme", *order).sortWithinPartitions("theme", *order)


def status_log(df: DataFrame, group: str, reason: Column) -> DataFrame:
    """(group, status, n) with the total as status 'total': a record is ok unless a reason is given."""
    marked = df.withColumn("status", F.coalesce(reason, F.lit("ok")))
    return marked.rollup(group, "status").agg(F.count("*").alias("n")).where(F.col(group).isNotNull()).withColumn("status", F.coalesce("status", F.lit("total")))
