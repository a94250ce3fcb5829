"""Statistical disclosure control: thresholds, complementary suppression, an independent recount, rules R1-R8, stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recode as R

# Least persons and households of a published cell by wave; bands; columns that are never published.
LEAST = {1991: (10, 5), 2000: (10, 5), 2010: (10, 5), 2022: (20, 10)}
BANDS = ["5-9", "10-19", "20-49", "50-99", "100-499", ">=500"]
FORBIDDEN = ("controle", "ap", "cd_apond", "apond", "areap", "v0011", "v0300", "d0100", "p0100", "d0090", "p0090", "peso")
FUSED = "outros"


def limits(wave: Column) -> tuple[Column, Column]:
    """Least persons and households of a wave; null for a wave without limits."""
    table = [F.create_map(*[F.lit(x) for w, pair in LEAST.items() for x in (w, pair[i])]) for i in (0, 1)]
    return tuple(F.try_element_at(t, wave.cast("int")) for t in table)


def meets(wave: Column, n: Column, n_dom: Column) -> Column:
    least_n, least_h = limits(wave)
    return F.coalesce((n >= least_n) & (n_dom >= least_h), F.lit(False))


def threshold(cells: DataFrame, wave: str = "censo", n: str = "n", n_dom: str = "n_dom") -> DataFrame:
    """R1: cells with `publishable`; a wave without thresholds publishes nothing."""
    return cells.withColumn("publishable", meets(F.col(wave), F.col(n), F.col(n_dom)))


def patterns(df: DataFrame, group: list[str], cat: str, household: str, order: list[str], rest: Column | None = None) -> DataFrame:
    """Per group, all that the suppression rules ask of its records, whatever their number.

    members: bit of each category present, its persons n, and those of the complement rn; sets: households h (and rh, of the
    complement) by the set of categories they hold. `rest` marks records of the complement (R7); the others are the cell's own.
    Union counts of any categories follow from these. Categories outside `order` are left out.
    """
    rest = F.lit(False) if rest is None else F.coalesce(rest, F.lit(False))
    bit = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, 1 << i)])
    known = df.where(F.col(cat).isin(order)).select(*group, F.col(household).alias("_h"), bit[F.col(cat)].cast("long").alias("bit"), rest.alias("_rest"))
    people = known.groupBy(*group, "bit").agg(F.count_if(~F.col("_rest")).alias("n"), F.count_if("_rest").alias("rn"))
    per = known.groupBy(*group, "_rest", "_h").agg(F.expr("bit_or(bit)").alias("bits"))
    sets = per.groupBy(*group, "bits").agg(F.count_if(~F.col("_rest")).alias("h"), F.count_if("_rest").alias("rh"))
    left = people.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("bit", "n", "rn"))).alias("members"))
    right = sets.groupBy(*group).agg(F.collect_list(F.struct("bits", "h", "rh")).alias("sets"))
    return left.join(right, group)


def _total(entries: str, test: str, field: str) -> str:
    return f"aggregate(filter({entries}, e -> {test}), 0L, (a, e) -> a + e.{field})"


def _publishable(mask: str) -> str:
    """R1 for the union of the categories in the mask, and R7: what the complement then shows is nothing or enough."""
    n, rn = (_total("members", f"e.bit & ({mask}) <> 0", f) for f in ("n", "rn"))
    h, rh = (_total("sets", f"e.bits & ({mask}) <> 0", f) for f in ("h", "rh"))
    return f"({n} >= ln and {h} >= lh and ({rn} = 0 or ({rn} >= ln and {rh} >= lh)))"


def suppress(table: DataFrame, group: list[str], order: list[str], wave: Column, ordinal: bool = False, partners: dict[str, str] | None = None, pooled: str | None = None) -> DataFrame:
    """R8 as a bounded fold over the table of patterns(): group, label, members (sorted), n, n_dom, n_suppressed.

    The state is the set of categories to be fused, as bits; it begins with those that can't be shown alone and is settled
    when empty, or when two members or more make a publishable union. Each step adds the category of least rank among
    the rest: next to a member in an ordinal list, else the partner of the smallest member that has one, else the
    smallest (ties by order). Categories without persons (structural zeros) take no part. If no set settles, no category
    is shown. `pooled`: the category of an open list that stands for two or more others; it is fused from the start, and the
    fused label is the list's complement, 'outros'.
    """
    least_n, least_h = limits(wave)
    partner = {1 << order.index(a): 1 << order.index(b) for a, b in (partners or {}).items()}
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in partner.items()]) if partner else F.array().cast("array<struct<a:bigint,b:bigint>>")
    facts = table.withColumns({"ln": least_n, "lh": least_h, "pairs": pairs, "members": F.expr("filter(members, e -> e.n > 0)")})
    rest = 1 << order.index(pooled) if pooled else 0
    facts = facts.where("ln is not null").withColumn("hidden", F.expr(f"aggregate(filter(members, m -> m.bit = {rest} or not {_publishable('m.bit')}), 0L, (a, m) -> a | m.bit)"))
    near = "false" if not ordinal else (
        "exists(sequence(0, size(members) - 1), i -> members[i].bit = c.bit and"
        " ((i > 0 and members[greatest(i - 1, 0)].bit & s <> 0) or (i + 1 < size(members) and members[least(i + 1, size(members) - 1)].bit & s <> 0)))"
    )
    allied = "array_min(transform(filter(members, e -> e.bit & s <> 0 and exists(pairs, p -> p.a = e.bit and p.b = c.bit)), e -> e.n))"
    rank = f"named_struct('r', case when {near} then 0 when {allied} is not null then 1 else 2 end, 'by', case when {near} or {allied} is null then c.n else {allied} end, 'bit', c.bit)"
    settled = f"(s = 0 or ((bit_count(s) >= 2 or s & {rest} <> 0) and {_publishable('s')}))"
    free = "filter(members, c -> c.bit & s = 0)"
    step = f"case when {settled} or size({free}) = 0 then s else s | array_min(transform({free}, c -> {rank})).bit end"
    folded = facts.withColumn("s", F.expr(f"aggregate(sequence(1, {len(order)}), hidden, (s, k) -> {step})"))
    done = folded.withColumn("s", F.expr(f"case when {settled} then s else aggregate(members, 0L, (a, m) -> a | m.bit) end"))
    shown = F.expr(
        "filter(concat(transform(filter(members, m -> m.bit & s = 0), m -> m.bit), array(s)), x -> x <> 0 and aggregate(members, false, (a, m) -> a or m.bit & s = 0))"
    )
    cells = done.withColumn("mask", F.explode(shown))
    names = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(c).alias("name")) for i, c in enumerate(order)])
    cells = cells.withColumn("names", names).withColumn("own", F.expr("array_sort(transform(filter(names, e -> e.bit & mask <> 0 and exists(members, m -> m.bit = e.bit)), e -> e.name))"))
    fused = F.lit(FUSED) if pooled else F.concat(F.lit(f"{FUSED}:"), F.array_join("own", "+"))
    return cells.select(
        *group, F.when(F.size("own") > 1, fused).otherwise(F.col("own")[0]).alias("label"), F.col("own").alias("members"),
        F.expr(_total("members", "e.bit & mask <> 0", "n")).alias("n"), F.expr(_total("sets", "e.bits & mask <> 0", "h")).alias("n_dom"),
        F.expr("bit_count(s)").cast("long").alias("n_suppressed"),
    )


def suppression_audit(published: DataFrame, table: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """By `by`: groups, groups of which nothing is shown, cells shown, fused cells, categories suppressed."""
    own = published.groupBy(*group).agg(F.count("*").alias("cells"), F.count_if(F.size("members") > 1).alias("fused"), F.max("n_suppressed").alias("hidden"))
    all_ = table.select(*group, F.expr("size(filter(members, e -> e.n > 0))").alias("present")).join(own, group, "left")
    return all_.groupBy(*by).agg(
        F.count("*").alias("groups"), F.count_if(F.col("cells").isNull()).alias("withheld"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"),
        F.coalesce(F.sum("fused"), F.lit(0)).alias("fused"), F.sum(F.coalesce("hidden", "present")).cast("long").alias("suppressed"),
    )


def expand_labels(published: DataFrame, label: str = "label") -> DataFrame:
    """A row per member category of each published cell: a fused label names its members."""
    named = F.col(label).startswith(f"{FUSED}:")
    inner = F.when(named, F.split(F.expr(f"substring(`{label}`, {len(FUSED) + 2})"), r"\+")).otherwise(F.array(label))
    return published.withColumn("member", F.explode(inner))


def with_complement(published: DataFrame, micro: DataFrame, group: list[str], cat: str, label: str = "label") -> DataFrame:
    """expand_labels() where a bare 'outros' stands for all categories of the microdata that its group doesn't show."""
    shown = expand_labels(published.where(F.col(label) != FUSED), label)
    open_ = published.where(F.col(label) == FUSED)
    present = micro.where(F.col(cat).isNotNull()).select(*group, F.col(cat).alias("member")).distinct()
    others = open_.join(present.join(shown.select(*group, "member"), [*group, "member"], "left_anti"), group)
    return shown.unionByName(others.select(shown.columns))


def recount(published: DataFrame, micro: DataFrame, group: list[str], cat: str, household: str) -> DataFrame:
    """published with persons and households counted afresh from the microdata (again_n, again_dom), members present, agrees."""
    members = with_complement(published, micro, group, cat).select(*group, "label", "member")
    again = members.join(micro.withColumnRenamed(cat, "member"), [*group, "member"]).groupBy(*group, "label").agg(
        F.count("*").alias("again_n"), F.countDistinct(household).alias("again_dom"), F.countDistinct("member").alias("present")
    )
    zero = F.lit(0).cast("long")
    out = published.join(again, [*group, "label"], "left").withColumns({c: F.coalesce(c, zero) for c in ("again_n", "again_dom", "present")})
    return out.withColumn("agrees", (F.col("again_n") == F.col("n")) & (F.col("again_dom") == F.col("n_dom")))


def differencing(cells: DataFrame, wave: Column, rest_n: str = "rest_n", rest_dom: str = "rest_dom") -> DataFrame:
    """R7: cells with `safe`: persons and households of the complement (whole - own), counted on their own, are none or enough."""
    return cells.withColumn("safe", (F.col(rest_n) == 0) | meets(wave, F.col(rest_n), F.col(rest_dom)))


def forbidden_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """R5: (table, column) of identifiers and weights in published tables; only names are looked at."""
    return [(name, c) for name, df in tables.items() for c in df.columns if c.lower() in FORBIDDEN]


def registry_table(spark: SparkSession, dimensions: dict[str, list[str] | None]) -> DataFrame:
    """(dim, member) of every registered category; an open dimension has one row without a member."""
    rows = [(d, c) for d, cats in dimensions.items() for c in (cats if cats is not None else [None])]
    return spark.createDataFrame(rows, "dim string, member string")


def violations(cube: DataFrame, dimensions: dict[str, list[str] | None]) -> DataFrame:
    """(rule, detail, and the row's key columns) of every row that breaks R1-R4, R6, R7 or R8 as far as the row itself shows it.

    cube: censo, estatistica, dim1, cat1, dim2, cat2, valor, n_faixa, n_dom_faixa, cv, classe_precisao, and, where
    recounted, n, n_dom (R1, R3), rest_n, rest_dom (R7) and present1, present2 (members present of fused cells, R8).
    """
    key = ["censo", "geografia", "universo", "estatistica", "dim1", "cat1", "dim2", "cat2"]
    have = set(cube.columns)
    tests = [
        ("R2", (F.col("estatistica") == "contagem") & (F.abs(F.pmod(F.col("valor"), F.lit(10))) > 1e-6), F.col("valor").cast("string")),
        ("R3", ~F.coalesce(F.col("n_faixa").isin(BANDS) & F.col("n_dom_faixa").isin(BANDS), F.lit(False)), F.concat_ws("/", "n_faixa", "n_dom_faixa")),
        ("R6", F.col("cv").isNull() | F.coalesce(F.col("classe_precisao") == "sem_estimativa", F.lit(True)), F.coalesce("classe_precisao", F.lit(""))),
    ]
    if {"n", "n_dom"} <= have:
        tests.append(("R1", ~meets(F.col("censo"), F.col("n"), F.col("n_dom")), F.concat_ws("/", "n", "n_dom")))
        tests.append(("R3", (R.sample_band(F.col("n")) != F.col("n_faixa")) | (R.sample_band(F.col("n_dom")) != F.col("n_dom_faixa")), F.lit("recount")))
    if {"rest_n", "rest_dom"} <= have:
        tests.append(("R7", (F.col("rest_n") > 0) & ~meets(F.col("censo"), F.col("rest_n"), F.col("rest_dom")), F.concat_ws("/", "rest_n", "rest_dom")))
    if {"present1", "present2"} <= have:
        first = F.col("cat1").startswith(FUSED) & F.col("cat2").isNull() & (F.col("present1") < 2)
        second = F.col("cat2").startswith(FUSED) & (F.col("present2") < 2)
        tests.append(("R8", F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False)), F.coalesce("cat2", "cat1")))
    broken = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, test, detail in tests]), lambda x: x.isNotNull()
    )
    rows = cube.select(*key, F.explode(broken).alias("b")).select("b.rule", "b.detail", *key)
    # R4: both dimensions registered, every member of a label registered for its dimension.
    known = F.broadcast(registry_table(cube.sparkSession, dimensions))  # a row per registered category
    places = reduce(DataFrame.unionByName, [cube.where(F.col(f"dim{i}").isNotNull()).select(*key, F.col(f"dim{i}").alias("dim"), F.col(f"cat{i}").alias("label")) for i in (1, 2)])
    members = expand_labels(places.withColumn("label", F.coalesce("label", F.lit(FUSED)))).withColumn("member", F.when(F.col("member") != FUSED, F.col("member")))
    fits = (F.col("m.dim") == F.col("k.dim")) & (F.col("m.member").isNull() | F.col("k.member").isNull() | (F.col("m.member") == F.col("k.member")))
    strange = members.alias("m").join(known.alias("k"), fits, "left_anti").select(F.lit("R4").alias("rule"), F.concat_ws("=", "dim", "member").alias("detail"), *key)
    return rows.unionByName(strange)


def gate(found: DataFrame) -> DataFrame:
    """rule, n_violations, passed for each of R1-R8: what the report prints and what an export asks."""
    rules = found.sparkSession.createDataFrame([(f"R{i}",) for i in range(1, 9)], "rule string")
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    out = rules.join(F.broadcast(counts), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"))
    return out.withColumn("passed", F.col("n_violations") == 0)


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of every file under a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1].lstrip("/").removeprefix("file:")
    name = F.regexp_replace("path", rf"^.*{root}/", "")
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))


def verify_stamps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem) of files that changed, are missing or are new since the stamp."""
    e, f = expected.select("file", F.col("sha256").alias("was")), found.select("file", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return e.join(f, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def export(df: DataFrame, path: str, report: DataFrame, version: str) -> DataFrame:
    """Write a table if its gate passes, and refuse otherwise; the manifest's row: path, version, rows."""
    failed = [r["rule"] for r in report.where("not passed").select("rule").collect()]  # eight rules at most
    if failed:
        raise PermissionError(f"disclosure rules broken: {', '.join(sorted(failed))}")
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    return spark.read.parquet(path).agg(F.lit(path).alias("path"), F.lit(version).alias("version"), F.count("*").alias("rows"))


def suppress_wide(df: DataFrame, n: str, values: list[str], least: int = 20) -> DataFrame:
    """Values of rows with fewer than `least` records (or an unknown count) become null."""
    small = F.coalesce(F.col(n) < least, F.lit(True))
    return df.withColumns({c: F.when(~small, F.col(c)) for c in values} | {"suppressed": small})


# What a text must not hold before it is published.
AUDIT_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "cpf": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "phone": r"\(\d{2,3}\) ?\d{3,5}-\d{4}",
    "local_path": r"/(?:Users|Volumes|home)/[A-Za-z0-9._-]+|[A-Za-z]:\\{1,2}Users\\{1,2}[A-Za-z0-9._-]+",
    "signed_url": r"(?i)[?&](?:sig|skoid|sktid|x-amz-signature|x-amz-credential|token|access_token|api_key|apikey)=[^&\"'\x00-\x20]{6,}",
    "key": (
        r"AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|AIza[0-9A-Za-z_-]{35}"
        r"|xox[abpr]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    ),
}
ALLOWED_DOMAINS = ("example.org", "example.com", "users.noreply.github.com")
SNIPPET = 20


def audit_text(df: DataFrame, key: str, text: str, rules: dict[str, str] = AUDIT_RULES, allowed: tuple[str, ...] = ALLOWED_DOMAINS) -> DataFrame:
    """(key, rule, match, snippet): every distinct match of a rule in a text, with its first place's surroundings; allowed e-mail domains pass."""
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), 1)).alias("hits")) for r, p in rules.items()])
    rows = df.select(key, F.col(text).alias("_t"), F.explode(found).alias("f")).select(key, "_t", "f.rule", F.explode("f.hits").alias("match"))
    rows = rows.where(~((F.col("rule") == "email") & F.lower(F.substring_index("match", "@", -1)).isin(*allowed)))
    start = F.greatest(F.expr("instr(_t, match)") - SNIPPET, F.lit(1))
    return rows.select(key, "rule", "match", F.expr("_t").substr(start, F.expr("instr(_t, match)") - start + F.length("match") + SNIPPET).alias("snippet"))


def forbidden_paths(files: DataFrame, path: str, patterns: list[str], exempt: list[str]) -> DataFrame:
    """Rows of a file listing whose path a pattern forbids and no exemption allows."""
    hit = reduce(lambda a, b: a | b, [F.col(path).rlike(p) for p in patterns])
    free = reduce(lambda a, b: a | b, [F.col(path).rlike(p) for p in exempt], F.lit(False))
    return files.where(hit & ~free)
