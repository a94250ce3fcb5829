"""License scans by diagonal voting (native).

Every rolling k-word window of every text is hashed and joined with the windows of license templates. A hit votes for
the diagonal (position in the text minus position in the template); votes are summed by diagonal and neighbouring
diagonals (a few words put in or left out) are merged into spans. Each vote is verified word by word, so equal hashes of
other words don't count, and so is each span: a template's window counts once, at its first place in the span, and
only if that lies behind those of all earlier windows; these must cover enough of the template. A phrase stands in the
text where one diagonal has the votes of all its windows.

Edge cases: a null text counts as empty; each input row gives one output row (repeated rows and null ids too), with
null first_word/last_word, empty labels and score 0 where nothing is found; other columns of `docs` are ignored.
The templates are a parameter of fixed size (a few hundred words), so they are broadcast; the size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Phrases whose every place counts, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Wordings of licenses that may differ in a few words; the method's own labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 3
#: Diagonals up to so many words apart are one span.
SLACK = 3
#: Covered share of a template from which its label is given.
COVER = 0.8
MAX_TEMPLATE_WINDOWS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = -1


def template_windows(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per k-word window of a template: tid, tpos, gram (its words); bounded and checked, to be broadcast."""
    rows = []
    for tid, (_, text) in enumerate([*phrases, *templates]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(tid, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    if len(rows) > MAX_TEMPLATE_WINDOWS:
        raise ValueError(f"{len(rows)} template windows; {MAX_TEMPLATE_WINDOWS} at most are broadcast")
    return spark.createDataFrame([*rows, (END, 0, [])], "tid int, tpos int, gram array<string>")


def template_facts(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """tid, label, phrase (every place counts), windows, length; one row per template."""
    rows = [
        (tid, label, tid < len(phrases), len(text.split()) - k + 1, len(text.split()))
        for tid, (label, text) in enumerate([*phrases, *templates])
    ]
    return spark.createDataFrame(rows, "tid int, label string, phrase boolean, windows int, length int")


def votes(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame, k: int = K) -> DataFrame:
    """Verified votes: row, id, n_words, tid, tpos, pos; each input row also has one with tid = END."""
    # Lower-casing the Kelvin sign would make an ASCII letter of it; every other capital outside A-Z stays outside.
    text = F.lower(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.array_remove(F.split(text, SEPARATORS), "").alias("words"),
    )
    hashes = (
        f"case when size(words) < {k} then cast(array() as array<bigint>) else transform(sequence(0, size(words) - {k}),"
        f" i -> xxhash64({', '.join(f'words[i + {j}]' for j in range(k))})) end"
    )
    rolled = words.select(
        "row", "id", "words", F.size("words").alias("n_words"),
        F.posexplode(F.expr(f"concat({hashes}, array({END}L))")).alias("pos", "hash"),
    )
    known = windows.select(
        "tid", "tpos", "gram",
        F.when(F.col("tid") == END, F.lit(END)).otherwise(F.xxhash64(*[F.col("gram")[j] for j in range(k)])).alias("hash"),
    )
    last = F.col("pos") == F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    verified = F.when(F.col("tid") == END, last).otherwise(~last & (F.slice("words", F.col("pos") + 1, k) == F.col("gram")))
    return rolled.join(F.broadcast(known), "hash").where(verified).select("row", "id", "n_words", "tid", "tpos", "pos")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). spans: row, id, label, phrase, first_word, last_word (of the span), coverage, places."""
    spark = docs.sparkSession
    found = votes(docs, id_col, text_col, template_windows(spark, phrases, templates, k), k)
    diagonals = found.groupBy("row", "id", "n_words", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list(F.struct("tpos", "pos")).alias("own")
    )
    facts = F.broadcast(template_facts(spark, phrases, templates, k))
    near = Window.partitionBy("row", "tid").orderBy("diagonal")
    islands = (
        diagonals.join(facts, "tid", "left")
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > SLACK).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("new").over(near))
    )
    spans = islands.groupBy("row", "id", "n_words", "tid", "label", "phrase", "windows", "island").agg(
        F.array_sort(F.flatten(F.collect_list("own"))).alias("own"),
        F.min("first").alias("first_word"),
        F.max(F.col("last") + k - 1).alias("last_word"),
        F.sum((F.col("votes") == F.col("windows")).cast("long")).alias("places"),
        F.min(F.when(F.col("votes") == F.col("windows"), F.col("diagonal"))).alias("first_place"),
        F.max(F.when(F.col("votes") == F.col("windows"), F.col("diagonal"))).alias("last_place"),
    )
    in_order = F.expr(
        "aggregate(own, named_struct('t', -1, 'p', -1, 'n', 0), (a, x) -> named_struct('t', x.tpos,"
        " 'p', case when x.tpos = a.t then a.p else greatest(a.p, x.pos) end,"
        " 'n', a.n + case when x.tpos > a.t and x.pos > a.p then 1 else 0 end), a -> a.n)"
    )
    spans = spans.withColumn("coverage", F.when(F.col("tid") == END, 0.0).otherwise(in_order / F.col("windows"))).drop("own")
    base = F.col("phrase") & (F.col("places") > 0)
    own = F.col("coverage") >= COVER

    def joined(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    documents = spans.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last_place"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | (~F.col("phrase") & own)).alias("labels"),
        F.round(F.coalesce(F.max("coverage"), F.lit(0.0)), 6).alias("score"),
    )
    return documents.drop("row"), spans.where((F.col("tid") != END) & (base | own))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))[0]


def _oracle() -> str:
    """The same by joining words with words in SQL."""
    rows = [
        f"({tid}, '{label}', {tid < len(PHRASES)}, {len(text.split()) - K + 1}, {i}, '{' '.join(text.split()[i : i + K])}')"
        for tid, (label, text) in enumerate([*PHRASES, *TEMPLATES])
        for i in range(len(text.split()) - K + 1)
    ]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with t(tid, label, phrase, windows, tpos, gram) as (values {', '.join(rows)}),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
p as (select doc_id, unnest(range(0, greatest(len(w) - {K - 1}, 0))) pos, w from d),
v as (select doc_id, tid, label, phrase, windows, tpos, pos, pos - tpos diagonal
      from (select doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] gram from p) join t using (gram)),
a as (select doc_id, tid, label, phrase, windows, diagonal, count(*) votes from v group by all),
n as (select *, coalesce((diagonal - lag(diagonal) over x > {SLACK})::int, 1) new from a window x as (partition by doc_id, tid order by diagonal)),
i as (select *, sum(new) over (partition by doc_id, tid order by diagonal) island from n),
f as (select doc_id, tid, island, tpos, min(pos) pos from v join i using (doc_id, tid, diagonal) group by all),
o as (select *, pos > coalesce(max(pos) over (partition by doc_id, tid, island order by tpos rows between unbounded preceding and 1 preceding), -1) good from f),
c as (select doc_id, tid, island, count(*) filter (good) n from o group by all),
s as (select doc_id, tid, label, phrase, island, n::double / windows coverage, count(*) filter (votes = windows) places,
        min(diagonal) filter (votes = windows) a, max(diagonal) filter (votes = windows) b
      from i join c using (doc_id, tid, island) group by doc_id, tid, label, phrase, island, windows, n),
g as (select doc_id, sum(places) filter (phrase) n_base, min(a) filter (phrase) first_word, max(b) filter (phrase) last_word,
        string_agg(distinct label, ',' order by label) filter (phrase and places > 0) base_labels,
        string_agg(distinct label, ',' order by label) filter ((phrase and places > 0) or (not phrase and coverage >= {COVER})) labels,
        max(coverage) score from s group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, round(coalesce(score, 0), 6) score
from d left join g using (doc_id)"""


ORACLE_SQL = {"op1_license_scan": _oracle()}
QUERIES = {"op1_license_scan": op1_license_scan}
