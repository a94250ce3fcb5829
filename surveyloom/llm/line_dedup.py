"""Line dedup by content-defined line chunks (native).

A rolling hash over the hashes of a line and the line before it chooses boundary lines: a line is one if its rolling hash
is the lesser of two neighbouring lines', or if it and the line before it hold LONG_WORDS words. A chunk is a boundary line
with the line before it. Of any two neighbouring lines one at least is a boundary, and in a run of three lines that choice
rests on the run alone: equal runs of three lines, or of two long ones, share a chunk wherever they stand. A chunk that stands more than once, in any documents, ties each later
place to its first (smallest id, then smallest position). Along such a tie (two documents and the distance of the lines)
all runs of two equal lines or more go from the later document: chunks lead to the ties, their neighbours are
compared line by line. What meets by hash is removed only after the bytes of both runs are compared.

A line that goes always stands in an earlier place too, and the earliest place of every run stays.

Edge cases: a null text has no lines, is kept as it is and loses nothing; an empty text is one empty line; rows with
equal id and text (repeated rows) are one document and get the same result, in as many rows; null ids come first in
order; rows with equal id and different texts are different documents; all columns of `docs` come back, whatever
their names (the column of facts takes a free name, see `facts_column`); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table

#: A line that with the one before it holds so many words (parted by blanks) is a boundary too.
LONG_WORDS = 50
#: Equal lines in a row that count as a repeated run.
MIN_LINES = 2
#: Rolling hash: FACTOR times the hash of the line before, plus that of the line, modulo MODULUS.
FACTOR, MODULUS = 31, 1000003


def _hash(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as bigint)"


def facts_column(docs: DataFrame) -> str:
    """The name of dedup()'s column of facts: _dedup, or the first free name made of it."""
    return fresh("_dedup", docs.columns)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, print, h and w (the hashes and numbers of words of the lines), one row per document with a text."""
    lined = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"),
        F.expr(f"transform(split(`{text_col}`, '\n'), x -> {_hash('x')})").alias("h"), F.expr(f"transform(split(`{text_col}`, '\n'), x -> size(split(x, ' ')))").alias("w"),
    )
    return lined.groupBy("id", "print").agg(F.first("h").alias("h"), F.first("w").alias("w"))


def _chunks(hashed: DataFrame, long_words: int) -> DataFrame:
    """id, print, first, k1, k2 of each chunk."""
    rolling = F.expr(f"transform(slice(h, 2, size(h) - 1), (x, i) -> ({FACTOR} * (h[i] % {MODULUS}) + x % {MODULUS}) % {MODULUS})")
    least = f"i = 0 or i = size(r) - 1 or w[i] + w[i + 1] >= {long_words} or x < get(r, i + 1) or x <= get(r, i - 1)"
    rows = hashed.where(F.size("h") > 1).withColumn("r", rolling)
    rows = rows.select("id", "print", "h", F.explode(F.expr(f"filter(transform(r, (x, i) -> case when {least} then i end), i -> i is not null)")).alias("first"))
    pair = (F.expr("h[first]"), F.expr("h[first + 1]"))
    return rows.select("id", "print", "first", F.xxhash64(*pair).alias("k1"), F.xxhash64(F.lit(MODULUS), *pair).alias("k2"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """id, print, first, n, kept_id, kept_print, kept_first: runs that stand in an earlier place too, met by hash."""
    hashed = materialise(_hashed(docs, id_col, text_col))
    chunks = _chunks(hashed, long_words)
    place = F.struct("id", "print", "first")
    kept = chunks.groupBy("k1", "k2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("not kept <=> last").select("k1", "k2", "kept")
    ties = (
        chunks.join(kept, ["k1", "k2"]).where(~place.eqNullSafe(F.col("kept")))
        .select("id", "print", F.col("kept.id").alias("kept_id"), F.col("kept.print").alias("kept_print"), (F.col("first") - F.col("kept.first")).alias("shift"))
        .distinct()
    )
    own, other = hashed.alias("o"), hashed.select("id", "print", F.col("h").alias("g")).alias("k")
    both = ties.alias("t").join(own, F.col("t.id").eqNullSafe(F.col("o.id")) & (F.col("t.print") == F.col("o.print")))
    both = both.join(other, F.col("t.kept_id").eqNullSafe(F.col("k.id")) & (F.col("t.kept_print") == F.col("k.print")))
    lined = both.select("t.id", "t.print", "t.kept_id", "t.kept_print", "t.shift", "h", "g")
    differing = F.expr("filter(transform(h, (x, i) -> case when x <=> get(g, i - shift) then null else i end), x -> x is not null)")
    edges = F.concat(F.array(F.lit(-1)), F.col("_d"), F.array(F.size("h")))
    gaps = F.expr(f"filter(transform(slice(_e, 1, size(_e) - 1), (e, j) -> named_struct('first', e + 1, 'n', _e[j + 1] - e - 1)), r -> r.n >= {min_lines})")
    runs = lined.withColumn("_d", differing).withColumn("_e", edges).select("id", "print", "kept_id", "kept_print", "shift", F.explode(gaps).alias("r"))
    return runs.select("id", "print", F.col("r.first").alias("first"), F.col("r.n").alias("n"), "kept_id", "kept_print", (F.col("r.first") - F.col("shift")).alias("kept_first"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """`docs` with the text after removal and facts_column(docs): struct(lines, chunks, removed_spans, removed_lines)."""
    runs = materialise(repeated_runs(docs, id_col, text_col, long_words, min_lines))
    # Each document reads its text once: for its own runs and for those that others compare with it.
    asked = runs.groupBy("kept_id", "kept_print").agg(F.collect_set(F.struct("kept_first", "n")).alias("asked")).select(
        F.col("kept_id").alias("id"), F.col("kept_print").alias("print"), F.lit(None).cast("array<struct<first:int,n:int,kept_id:string,kept_print:bigint,kept_first:int>>").alias("later"),
        F.transform("asked", lambda x: F.struct(x["kept_first"].alias("first"), x["n"].alias("n"))).alias("asked"),
    )
    later = runs.groupBy("id", "print").agg(F.collect_set(F.struct("first", "n", F.col("kept_id").cast("string").alias("kept_id"), "kept_print", "kept_first")).alias("later"))
    marks = later.withColumn("asked", F.lit(None).cast("array<struct<first:int,n:int>>")).unionByName(asked).groupBy("id", "print").agg(
        F.flatten(F.collect_list("later")).alias("later"), F.flatten(F.collect_list("asked")).alias("asked")
    )
    names = [*docs.columns, text_col]
    i, p, m, b = (fresh(x, names) for x in ("id_", "print_", "marks_", "bad_"))
    marks = marks.select(F.col("id").alias(i), F.col("print").alias(p), F.struct("later", "asked").alias(m))
    marked = docs.join(marks, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(p)), "left")

    some = marked.where(F.col(m).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.split(F.col(text_col), "\n").alias("lines"), F.col(m).alias("m"))
    wanted = F.expr(
        "concat(transform(m.later, x -> named_struct('k', x.kept_id, 'p', x.kept_print, 'f', x.kept_first, 'n', x.n, 'at', x.first)),"
        " transform(m.asked, x -> named_struct('k', cast(id as string), 'p', print, 'f', x.first, 'n', x.n, 'at', x.first)))"
    )
    slices = some.select("lines", F.explode(wanted).alias("s")).select("s.k", "s.p", "s.f", "s.n", F.expr("array_join(slice(lines, s.at + 1, s.n), '\n')").alias("piece"))
    bad = slices.groupBy("k", "p", "f", "n").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high")
    wrong = runs.join(bad, F.col("kept_id").cast("string").eqNullSafe(F.col("k")) & (F.col("kept_print") == F.col("p")) & (F.col("kept_first") == F.col("f")) & (runs["n"] == bad["n"]), "left_semi")
    wrong = wrong.groupBy("id", "print").agg(F.collect_set(F.struct("first", "n")).alias(b)).select(F.col("id").alias(f"{i}w"), F.col("print").alias(f"{p}w"), b)
    judged = marked.join(wrong, F.col(id_col).eqNullSafe(F.col(f"{i}w")) & (F.xxhash64(text_col) == F.col(f"{p}w")), "left")

    good = f"filter(transform({m}.later, x -> named_struct('first', x.first, 'n', x.n)), x -> not coalesce(array_contains({b}, x), false))"
    lost = F.expr(f"array_sort(array_distinct(flatten(transform({good}, r -> sequence(r.first, r.first + r.n - 1)))))")
    x, y, z = (fresh(c, names) for c in ("lines_", "lost_", "runs_"))
    lines = judged.withColumn(x, F.split(F.col(text_col), "\n")).withColumn(y, F.concat(F.array(F.lit(-1)), F.coalesce(lost, F.array().cast("array<int>"))))
    # Runs of kept lines are the gaps between lost ones; a set membership test a line would be quadratic in long texts.
    gaps = f"filter(transform({y}, (v, j) -> named_struct('a', v + 1, 'b', coalesce(get({y}, j + 1), size({x})))), r -> r.b > r.a)"
    lines = lines.withColumn(z, F.expr(gaps))
    left = F.expr(f"case when size({y}) = 1 then `{text_col}` else array_join(flatten(transform({z}, r -> slice({x}, r.a + 1, r.b - r.a))), '\n') end")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(x)).cast("long")
    spans = F.expr(f"size(filter(transform({y}, (v, j) -> j > 0 and (j = 1 or v > {y}[j - 1] + 1)), q -> q))").cast("long")
    facts = F.struct(n_lines.alias("lines"), spans.alias("removed_spans"), (F.size(y) - 1).cast("long").alias("removed_lines"))
    name = facts_column(docs)
    return lines.withColumns({name: facts, text_col: F.when(F.col(text_col).isNotNull(), left)}).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_dedup.lines").alias("n_lines"),
        F.col("_dedup.removed_spans").alias("n_removed_spans"),
        F.col("_dedup.removed_lines").alias("n_removed_lines"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = {
    "op2_line_dedup": f"""
with l as (select doc_id, generate_subscripts(x, 1) - 1 i, unnest(x) line, len(x) n
           from (select doc_id, string_split(text, chr(10)) x from documents where text is not null)),
h as (select *, ('0x' || substr(md5(line), 1, 15))::bigint h, len(string_split(line, ' ')) w from l),
p as (select doc_id, i, n, ({FACTOR} * (lag(h) over o % {MODULUS}) + h % {MODULUS}) % {MODULUS} r, lag(w) over o + w w, lag(line) over o || chr(10) || line chunk
      from h window o as (partition by doc_id order by i)),
c as (select doc_id, i - 1 "first", chunk from p window o as (partition by doc_id order by i)
      qualify i > 0 and (i = 1 or i = n - 1 or w >= {LONG_WORDS} or r < lead(r) over o or r <= lag(r) over o)),
k as (select chunk, min(row(doc_id, first)) kept from c group by chunk having count(*) > 1),
t as (select distinct c.doc_id, kept[1] kept_id, first - kept[2] shift from c join k using (chunk) where row(doc_id, first) <> kept),
m as (select t.doc_id, kept_id, shift, a.i, a.i - row_number() over (partition by t.doc_id, kept_id, shift order by a.i) island
      from t join l a on a.doc_id = t.doc_id join l z on z.doc_id = kept_id and z.i = a.i - shift and z.line = a.line),
g as (select distinct doc_id, i from (select *, count(*) over (partition by doc_id, kept_id, shift, island) n from m) where n >= {MIN_LINES}),
r as (select doc_id, count(*) n, count(*) filter (starts) spans from
        (select *, coalesce(i - lag(i) over (partition by doc_id order by i), 2) > 1 starts from g) group by doc_id),
s as (select l.doc_id, count(*) n_lines, sha256(coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '')) kept_sha256
      from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(spans, 0)::bigint n_removed_spans, coalesce(r.n, 0)::bigint n_removed_lines, coalesce(kept_sha256, sha256('')) kept_sha256
from documents left join s using (doc_id) left join r using (doc_id)""",
}
QUERIES = {"op2_line_dedup": op2_line_dedup}
