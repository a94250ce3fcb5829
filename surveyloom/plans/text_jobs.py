"""Text, JSON, HTML and record-linkage jobs."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import linkage as L
from .fixtures import WITH, persons
from .registry import query

_ACC = f"translate({{}}, '{R.ACCENTS[0]}', '{R.ACCENTS[1]}')"
_NORM = "trim(regexp_replace(regexp_replace(lower(" + _ACC + "), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query("f01_normalise", f"select doc_id, {_NORM.format('text')} norm, substr({_NORM.format('text')}, 1, 120) chave from documents")
def f01(spark, d):
    return docs(spark, d).select("doc_id", R.normalise(F.col("text")).alias("norm"), R.title_key(F.col("text")).alias("chave"))


@query("f03_html_text", r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) texto from pages""")
def f03(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", R.html_text(F.col("html")).alias("texto"))


@query("f04_token_coverage", f"with k as (select a.conv_id, a.turn, {_NORM.format('a.text')} n, {_NORM.format('b.text')} h from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1), w as (select conv_id, turn, list_filter(string_split(n, ' '), lambda x: length(x) > 3) w, h from k) select conv_id, turn, round(case when len(w) > 0 then len(list_filter(w, lambda x: contains(h, x))) / len(w) end, 6) cob from w")
def f04(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", R.normalise(F.col("text")).alias("n"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("h"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(L.token_coverage(F.col("n"), F.col("h")), 6).alias("cob"))


@query("f12_redact", r"select conv_id, turn, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') as text from conversations")
def f12(spark, d):
    return R.redact(spark.read.parquet(f"{d}/conversations.parquet")).select("conv_id", "turn", "text")


@query("s07_json_fields", "select event_id, try_cast(props->>'$.k' as bigint) k from events")
def s07(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("s09_html_items", r"select page_id, (generate_subscripts(i, 1) - 1)::int pos, unnest(i) item from (select page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) i from pages)")
def s09(spark, d):
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(items).alias("pos", "item"))


@query("s10_locale_number", "select c_custkey, c_acctbal::decimal(18,2)::double valor from customer")
def s10(spark, d):
    text = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", R.locale_number(text).alias("valor"))


@query("s12_json_export", "select c_custkey, round(c_acctbal, 4) v, c_acctbal = floor(c_acctbal) inteiro from customer")
def s12(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    clean = F.when(~F.isnan("c_acctbal"), F.round("c_acctbal", 4))
    back = F.from_json(F.to_json(F.struct(clean.alias("v"))), "v double")
    return c.select("c_custkey", back["v"].alias("v"), (F.col("c_acctbal") == F.floor("c_acctbal")).alias("inteiro"))


_DIC = WITH + """, v as (select distinct u.* from (select unnest([{'column': 'segmento', 'value': segmento}, {'column': 'situacao', 'value': situacao}], recursive := true) from persons) u)
 , dic as (select *, (row_number() over (partition by "column" order by value nulls last) - 1)::int code from v) """


@query("s15_dictionary", _DIC + "select * from dic")
def s15(spark, d):
    return L.dictionary_encode(persons(spark, d).select("pessoa", "segmento", "situacao"), ["segmento", "situacao"])[0].select("column", "value", "code")


@query("s15_decode", WITH + "select pessoa, segmento, situacao from persons")
def s15b(spark, d):
    dic, coded = L.dictionary_encode(persons(spark, d).select("pessoa", "segmento", "situacao"), ["segmento", "situacao"])
    return L.dictionary_decode(dic, coded, ["segmento", "situacao"])


_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_PAGES = f"""select page_id, regexp_replace(url, '^https?://(www\\.|m\\.)?', '') url0, regexp_extract(url, '^https?://(?:www\\.|m\\.)?([^/?#]+)', 1) host,
 substr({_NORM.format(f"regexp_extract(html, '{_TITLE}', 1)")}, 1, 120) titulo, {_NORM.format(f"regexp_extract(html, '{_TITLE}', 1)")} inteiro, regexp_extract(html, '<html lang="([a-z]*)"', 1) lang from pages""".replace("\\\\", "\\")
_RECORDS = f"select *, regexp_replace(url0, '[?#].*$', '') ident from ({_PAGES})"


def records(spark, d):
    """Pages as records: their address without scheme and query, and the key of their title."""
    html_title = R.normalise(F.regexp_extract("html", _TITLE, 1))
    p = spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id", F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.)?", ""), r"[?#].*$", "").alias("ident"), F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/?#]+)", 1).alias("host"),
        F.substring(html_title, 1, 120).alias("titulo"), html_title.alias("inteiro"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), "html",
    )
    return p


_GROUPED = _RECORDS.replace("select *,", "with recursive r as (select *,", 1) + """), e as (select a.page_id u, b.page_id v from r a join r b on a.ident = b.ident and a.ident <> '' union select a.page_id, b.page_id from r a join r b on a.titulo = b.titulo and a.titulo <> ''),
 t as (select page_id node, page_id reach from r union select t.node, e.v from t join e on e.u = t.reach), g as (select node page_id, min(reach) "group" from t group by node) """


@query("b01_group_records", _GROUPED + 'select page_id, "group" from g')
def b01(spark, d):
    return L.group_records(records(spark, d), "page_id", ["ident", "titulo"]).select("page_id", "group")


@query("b02_survivors", _GROUPED + """, q as (select r.*, "group", lang = 'en' core from r join g using (page_id))
 select "group", arg_min(page_id, (lang, page_id)) page_id, case when coalesce(arg_min(titulo, (lang, page_id)), '') <> '' then arg_min(titulo, (lang, page_id)) else arg_min(titulo, (-length(titulo), titulo)) filter (titulo <> '') end titulo,
 string_agg(distinct host, ',' order by host) hosts, bool_or(core) core, count(*) n, (select string_agg(lang || '=' || k, ',' order by lang) from (select lang, min(page_id) k from q z where z."group" = q."group" group by lang)) ids from q group by "group" """)
def b02(spark, d):
    r = L.group_records(records(spark, d), "page_id", ["ident", "titulo"]).withColumn("core", F.col("lang") == "en")
    out = L.merge_survivors(r, "page_id", ["lang"], ["titulo"], ["host"], "core", "lang")
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("group", "page_id", "titulo", F.array_join("host", ",").alias("hosts"), "core", "n", ids.alias("ids"))


@query("b03_topics", "select d.doc_id, case when l.toxic = 1 then 'sensivel' when regexp_matches(lower(text), 'licen[sc]e') then 'licenca' when regexp_matches(lower(text), '[|]') then 'tabela' when regexp_matches(lower(text), 'http') then 'enderecos' else 'outro' end topico, regexp_matches(lower(text), '[0-9]{3}') cita from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1")
def b03(spark, d):
    fixed = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id", F.lit("sensivel").alias("topic"))
    rules = [("licen[sc]e", "licenca"), ("[|]", "tabela"), ("http", "enderecos")]
    out = L.topics(docs(spark, d).select("doc_id", F.lower("text").alias("t")), "t", rules, "outro", fixed, "doc_id", "[0-9]{3}")
    return out.select("doc_id", F.col("topic").alias("topico"), F.col("mentioned").alias("cita"))


_ALIKE = "case when x.t = '' or y.t = '' then 0.0 when contains(x.t, y.t) or contains(y.t, x.t) then 1.0 else 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t), 1)::double end"


@query("b04_verified_pairs", f"""with z as (select conv_id * 100 + turn id, role author, (conv_id % 97)::int as year, {_NORM.format("regexp_extract(text, '^[^\n]*', 0)")} t, {_NORM.format('text')} x from conversations),
 s as (select x.id a, y.id b, {_ALIKE} similarity, list_filter(string_split(x.t, ' '), lambda w: length(w) > 3) w, y.x hay from z x join z y on x.author = y.author and abs(x.year - y.year) <= 1 and x.id <> y.id),
 c as (select a, b, similarity, case when len(w) > 0 then len(list_filter(w, lambda k: contains(hay, k))) / len(w)::double else 0 end coverage from s)
 select a, b, round(similarity, 6) similarity, round(coverage, 6) coverage, case when similarity >= 0.8 then 'title' else 'text' end as by from c where similarity >= 0.8 or coverage >= 0.75""")
def b04(spark, d):
    """Turns as records: the role as author, a year, the whole first line as title, the whole text to fall back on."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("author"), (F.col("conv_id") % 97).cast("int").alias("year"),
        R.normalise(F.substring_index("text", "\n", 1)).alias("title"), R.normalise(F.col("text")).alias("text"),
    )
    out = L.verified_pairs(turns, turns)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"), "by")


@query("b05_referential", "select 'repeated key' as check, count(*) n from (select doc_id from documents group by 1 having count(*) > 1) union all select 'empty text', count(*) from documents where text is null or trim(text) = '' union all select 'empty lang', count(*) from documents where lang is null or trim(lang) = '' union all select 'unknown key', count(*) from (select distinct doc_id from documents where doc_id not in (select doc_id from labels)) union all select 'unused key', count(*) from (select distinct doc_id from labels where doc_id not in (select doc_id from documents))")
def b05(spark, d):
    return L.referential_report(docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"), "doc_id", ["text", "lang"])


_TERMS = ["the", "und der", "eau", "2 1"]


@query("b07_search_log", f"with n as (select source, {_NORM.format('text')} t from documents) select source, term, count(*) filter (len(list_filter(string_split(term, ' '), lambda w: not contains(t, w))) = 0) hits, count(*) records from n, (values {', '.join(f'({x!r})' for x in _TERMS)}) k(term) group by all")
def b07(spark, d):
    return L.search_log(docs(spark, d).select("source", R.normalise(F.col("text")).alias("t")), "source", "t", _TERMS)
