"""Pixel rules over the pixel table seen in `lineitem`."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import classify as C
from ..operators import measures as M
from ..operators import pixels as P
from ..operators import raster
from ..sources.storage import stored
from .fixtures import COLS, WITH, pixels, rows_of
from .registry import query

_GRID = WITH + ", grid as (select year, row, col, median(red) red, median(nir) nir, median(swir) swir, median(green) green, count(red) n_obs from pixels group by all) "
_FLAG = _GRID + ", f as (select year, row, col, red > 26 flag from grid) "
_MASK = _GRID + ", m as (select distinct year, row, col from grid where red > 30) "


def grid(spark, d, *bands):
    return P.composite(pixels(spark, d), list(bands) or ["red", "nir", "swir", "green"])


def flags(spark, d):
    return grid(spark, d, "red").select("year", "row", "col", (F.col("red") > 26).alias("flag"))


def mask(spark, d):
    return grid(spark, d, "red").where("red > 30").select("year", "row", "col")


@query("r01_quality_mask", WITH + "select year, count(*) n, count(*) filter ((qa & 3) = 0) clear, round(avg(case when (qa & 3) = 0 and red between 1 and 40 then red * 0.02 - 0.1 end), 6) refl from pixels group by year")
def r01(spark, d):
    clear = F.col("qa").bitwiseAND(3) == 0
    refl = F.when(clear & F.col("red").between(1, 40), F.col("red") * 0.02 - 0.1)
    return pixels(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.count_if(clear).alias("clear"), F.round(F.avg(refl), 6).alias("refl"))


@query("r03_composite", _GRID + "select year, row, col, round(red, 6) red, round(nir, 6) nir, n_obs from grid")
def r03(spark, d):
    return grid(spark, d).select("year", "row", "col", F.round("red", 6).alias("red"), F.round("nir", 6).alias("nir"), "n_obs")


@query("r06_gap_fill", _GRID + """, t as (select g.year + s * o as year, row, col, o, red from grid g, (values (-1), (1)) a(s), range(1, 4) b(o) where n_obs >= 4),
 n as (select year, row, col, coalesce(avg(red) filter (o = 1), avg(red) filter (o = 2), avg(red) filter (o = 3)) v from t group by all)
 select g.year, g.row, g.col, round(case when n_obs >= 4 then red else v end, 6) red, n_obs < 4 and v is not null filled from grid g left join n on g.year = n.year and g.row = n.row and g.col = n.col""")
def r06(spark, d):
    return P.gap_fill(grid(spark, d), "red", 4).withColumn("red", F.round("red", 6))


_ND = "case when {0} + {1} = 0 then 0 else ({0} - {1}) / ({0} + {1}) end"
_BUILT = "case when swir + nir = 0 then 0 else 2 * swir / (swir + nir) end {} (case when nir + red = 0 then 0 else nir / (nir + red) end + case when green + swir = 0 then 0 else green / (green + swir) end)"
_INDICES = {
    "ndvi": _ND.format("nir", "red"), "ndbi": _ND.format("swir", "nir"), "mndwi": _ND.format("green", "swir"), "bui": f"({_ND.format('swir', 'nir')}) - ({_ND.format('nir', 'red')})",
    "bsi": "case when swir + red + nir = 0 then 0 else (swir + red - nir) / (swir + red + nir) end", "savi": "1.5 * (nir - red) / (nir + red + 0.5)",
    "ibi": f"case when {_BUILT.format('+')} = 0 then 0 else ({_BUILT.format('-')}) / ({_BUILT.format('+')}) end", "nbr2": _ND.format("swir", "green"),
}


@query("r07_indices", _GRID + "select year, row, col, " + ", ".join(f"round({x}, 5) + 0.0 {k}" for k, x in _INDICES.items()) + " from grid")
def r07(spark, d):
    found = P.spectral_indices(None, "green", "red", "nir", "swir", "green")
    return grid(spark, d).select("year", "row", "col", *[(F.round(v, 5) + 0.0).alias(k) for k, v in found.items()])


@query("r08_local_std", _GRID + """, w as (select g.year, g.row r0, g.col c0, case when g.row + i < 0 then -g.row - i - 1 when g.row + i >= (select max(row) + 1 from grid) then 2 * (select max(row) + 1 from grid) - 1 - g.row - i else g.row + i end row, case when g.col + j < 0 then -g.col - j - 1 when g.col + j >= 40 then 79 - g.col - j else g.col + j end col from grid g, range(-1, 2) a(i), range(-1, 2) b(j))
 select w.year, r0 row, c0 col, round(sqrt(greatest(avg(red * red) - avg(red) * avg(red), 0)), 4) std from w join grid g on g.year = w.year and g.row = w.row and g.col = w.col group by all""")
def r08(spark, d):
    g = stored(grid(spark, d))
    return P.local_std(g, "red", 3, rows_of(g), COLS).withColumn("std", F.round("std", 4))


@query("r11_blocks", _GRID + "select year, row // 3 as row, col // 3 as col, round(avg(red), 6) red, count(red) n from grid group by all")
def r11(spark, d):
    return P.block_aggregate(grid(spark, d), "red").withColumn("red", F.round("red", 6))


_DILATED = ", dl as (select distinct year, row + i as row, col + j as col from m, range(-1, 2) a(i), range(-1, 2) b(j)) "


@query("r12_dilate", _MASK + _DILATED + "select * from dl")
def r12(spark, d):
    return P.dilate(mask(spark, d)).select("year", F.col("row").cast("long"), F.col("col").cast("long"))


@query("r12_erode", _MASK + _DILATED + "select year, row + i as row, col + j as col from dl, range(-1, 2) a(i), range(-1, 2) b(j) group by all having count(*) = 9")
def r12b(spark, d):
    return P.erode(P.dilate(mask(spark, d))).select("year", F.col("row").cast("long"), F.col("col").cast("long"))


_DISC = "(values (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) o(i, j)"


@query("r12_disc_opening", _MASK + f"""{_DILATED}, di as (select distinct year, row + i as row, col + j as col from m, {_DISC}),
 er as (select year, row + i as row, col + j as col from di, {_DISC} group by all having count(*) = 5), op as (select distinct year, row + i as row, col + j as col from er, {_DISC}),
 e as (select max(row) last from m) select * from (select * from op where row between 0 and (from e) and col between 0 and 39 union select year, row, col from di where row < 1 or row >= (from e) or col < 1 or col >= 39)""")
def r12c(spark, d):
    """Opening with a disc of the mask widened by it; the border put back."""
    m = stored(mask(spark, d))
    out = P.opening(P.dilate(m, 1, disc=True), rows_of(m), COLS, 1, disc=True)
    return out.select("year", F.col("row").cast("long"), F.col("col").cast("long"))


@query("r11_replicate", _GRID + "select b.year, br * 3 + i as row, bc * 3 + j as col, round(red, 6) red from (select year, row // 3 br, col // 3 bc, avg(red) red from grid group by all) b, range(0, 3) a(i), range(0, 3) c(j)")
def r11b(spark, d):
    return P.replicate(P.block_aggregate(grid(spark, d), "red"), "red").select("year", F.col("row").cast("long"), F.col("col").cast("long"), F.round("red", 6).alias("red"))


@query("r04_fuller_composite", WITH + """, o as (select year, row, col, count(red) n from pixels group by all), poor as (select year from o group by year having median(n) < 6 and year <= 1995),
 b as (select year, row, col, red from pixels union all select p.year, row, col, red from pixels x join poor p on abs(p.year - x.year) = 1)
 select year, row, col, round(median(red), 6) red, count(red) n_obs from b group by all""")
def r04(spark, d):
    return P.fuller_composite(pixels(spark, d), ["red"], 6, 1995).withColumn("red", F.round("red", 6))


@query("r15_block_folds", _GRID + "select year, row // 10 as br, col // 10 as bc, (('0x' || substr(md5((row // 10) || '|' || (col // 10)), 1, 8))::bigint % 5) fold, count(*) n from grid group by all")
def r15(spark, d):
    g = grid(spark, d).select("year", F.floor(F.col("row") / 10).cast("int").alias("br"), F.floor(F.col("col") / 10).cast("int").alias("bc"))
    fold = F.conv(F.substring(F.md5(F.concat_ws("|", "br", "bc")), 1, 8), 16, 10).cast("long") % 5
    return g.withColumn("fold", fold).groupBy("year", "br", "bc", "fold").agg(F.count("*").alias("n"))


@query("r18_majority", _FLAG + "select year, row, col, case when lead(flag) over w is null then flag when lag(flag) over w is null then flag and lead(flag) over w else lag(flag) over w::int + flag::int + lead(flag) over w::int >= 2 end smooth from f window w as (partition by row, col order by year)".replace("lag(flag) over w::int", "(lag(flag) over w)::int").replace("lead(flag) over w::int", "(lead(flag) over w)::int"))
def r18(spark, d):
    return P.majority3(flags(spark, d), "flag").drop("flag")


@query("r19_seal", _FLAG + ", p as (select *, coalesce(flag and lead(flag) over (partition by row, col order by year), false) pair from f) select year, row, col, bool_or(pair) over (partition by row, col order by year) or flag sealed from p")
def r19(spark, d):
    return P.seal(flags(spark, d), "flag").drop("flag")


@query("r24_first_year", _FLAG + "select row, col, min(year) first from f where flag group by all")
def r24(spark, d):
    return P.first_year(flags(spark, d), "flag")


_COMPONENTS = _MASK.replace("with persons", "with recursive persons") + """, e as (select a.year, a.row * 40 + a.col u, b.row * 40 + b.col v from m a join m b on a.year = b.year and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
 t as (select year, u node, u reach from e union select t.year, t.node, e.v from t join e on e.year = t.year and e.u = t.reach),
 k as (select year, (node // 40)::int as row, (node % 40)::int as col, min(reach)::bigint patch from t group by year, node) """


@query("r20_patches", _COMPONENTS + "select * from k")
def r20(spark, d):
    return P.patches(mask(spark, d), COLS)


@query("r20_least_size", _COMPONENTS + "select year, row, col from (select *, count(*) over (partition by year, patch) n from k) where n >= 5")
def r20b(spark, d):
    return P.drop_small(mask(spark, d), COLS, 5)


@query("r21_fill_holes")
def r21(spark, d):
    m = stored(mask(spark, d))
    return P.fill_holes(m, rows_of(m), COLS, 6)


_PATCHED = _COMPONENTS.rstrip() + """, reach as (select year, patch, min(sqrt(pow(row - 10, 2) + pow(col - 20, 2))) far, count(*) size from k group by all),
 core as (select year, arg_min(patch, (far, patch)) core from reach where far <= 6 group by year),
 ne as (select k.* from k join reach r on r.year = k.year and r.patch = k.patch where far <= 15),
 pe as (select distinct a.year, a.patch u, b.patch v from ne a join ne b on a.year = b.year and a.patch <> b.patch and pow(a.row - b.row, 2) + pow(a.col - b.col, 2) <= 4),
 ch as (select year, core patch from core union select pe.year, pe.v from ch join pe on pe.year = ch.year and pe.u = ch.patch) """


@query("r22_core_chain", _PATCHED + "select k.year, row, col, k.patch from k join ch on ch.year = k.year and ch.patch = k.patch")
def r22(spark, d):
    return P.core_chain(stored(P.patches(mask(spark, d), COLS)), 10, 20, 2, 15, 6)


@query("r37_small_and_near", _PATCHED + """, cp as (select k.* from k join ch on ch.year = k.year and ch.patch = k.patch),
 ds as (select k.year, k.patch, min(sqrt(pow(k.row - c.row, 2) + pow(k.col - c.col, 2))) distance from k join cp c on c.year = k.year and pow(k.row - c.row, 2) + pow(k.col - c.col, 2) <= 16 group by all)
 select r.year, r.patch, size, round(distance, 6) distance, distance is not null and size <= 6 near from reach r left join ds using (year, patch) where not exists (from ch where ch.year = r.year and ch.patch = r.patch)""")
def r37(spark, d):
    patched = stored(P.patches(mask(spark, d), COLS))
    core = stored(P.core_chain(patched, 10, 20, 2, 15, 6))
    return P.small_and_near(patched, core, 4, 6).withColumn("distance", F.round("distance", 6))


@query("r26_mining_mask", _GRID + """, s as (select distinct row, col from grid where red > 46), wide as (select distinct row + i r, col + j c from s, range(-1, 2) a(i), range(-1, 2) b(j) where i * i + j * j <= 1),
 far as (select distinct row + i r, col + j c from s, range(-2, 3) a(i), range(-2, 3) b(j) where i * i + j * j <= 4),
 k as (select distinct row, col from grid where nir > 60), u as (select distinct row, col from grid where red < 10),
 z as (select r, c from wide union select row, col from k join far on r = row and c = col) select r as row, c as col from z where not exists (from u where u.row = r and u.col = c)""")
def r26(spark, d):
    g = grid(spark, d)
    out = P.mining_mask(g.where("red > 46"), g.where("nir > 60"), g.where("red < 10"), 1, 2)
    return out.select(F.col("row").cast("long"), F.col("col").cast("long"))


#: The grid's pixels stand 30 places apart, so that radii of 33 and 100 places (1 and 3 km) and a reach of 333 (10 km) matter.
APART = 30
_WIDE = _GRID + """, disc as (select i, j from range(-33, 34) a(i), range(-33, 34) b(j) where i * i + j * j <= 1089),
 s as (select distinct row * 30 r, col * 30 c from grid where red > 48) """


def spread(df, right=0):
    return df.select("year", (F.col("row") * APART).alias("row"), (F.col("col") * APART + right).alias("col"))


@query("r26_mining_mask_km", _WIDE + """, k as (select distinct row * 30 r, col * 30 + 7 c from grid where nir > 60), u as (select distinct row * 30 r, col * 30 + 2 c from grid where red < 10),
 z as (select r + i r, c + j c from s, disc union select k.r, k.c from k where exists (from s where pow(s.r - k.r, 2) + pow(s.c - k.c, 2) <= 10000))
 select floor(r / 30)::int as br, floor(c / 30)::int as bc, count(*) n from z anti join u using (r, c) group by all""")
def r26b(spark, d):
    """Mining widened by 1 km, concessions within 3 km of it, without urban places; places of each block."""
    g = stored(grid(spark, d))
    out = P.mining_mask(spread(g.where("red > 48")), spread(g.where("nir > 60"), 7), spread(g.where("red < 10"), 2), 33, 100)
    return out.groupBy(F.floor(F.col("row") / APART).cast("int").alias("br"), F.floor(F.col("col") / APART).cast("int").alias("bc")).agg(F.count("*").alias("n"))


@query("r12_wide_opening", _WIDE + """, h as (select distinct row * 30 + 11 r, col * 30 + 4 c from grid where nir > 85), d40 as (select i, j from range(-40, 41) a(i), range(-40, 41) b(j) where i * i + j * j <= 1600),
 m as (select r + i r, c + j c from s, d40 except select r + i, c + j from h, disc where i * i + j * j <= 25),
 b as (select distinct r + i r, c + j c from m, (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(i, j) where (r + i, c + j) not in (select (r, c) from m)),
 bb as (select floor(r / 33) + i tr, floor(c / 33) + j tc, r, c from b, range(-1, 2) x(i), range(-1, 2) y(j)),
 bad as (select distinct m.r, m.c from m join bb on floor(m.r / 33) = tr and floor(m.c / 33) = tc and pow(m.r - bb.r, 2) + pow(m.c - bb.c, 2) <= 1089),
 op as (select distinct r + i r, c + j c from (select * from m except select * from bad), disc)
 select floor(r / 30)::int as br, floor(c / 30)::int as bc, count(*) n from op group by all""")
def r12d(spark, d):
    """Opening with a disc of 1 km of blobs with holes; places of each block."""
    g = stored(grid(spark, d).withColumn("year", F.lit(0)))
    seeds, holes = spread(g.where("red > 48")), spread(g.where("nir > 85"), 4).withColumn("row", F.col("row") + 11)
    out = raster.combined([seeds, holes], 40 + 33 + 33, lambda s, h: raster.near(raster.deep(raster.near(s, 40) & ~raster.near(h, 5), 33), 33))
    return out.groupBy(F.floor(F.col("row") / APART).cast("int").alias("br"), F.floor(F.col("col") / APART).cast("int").alias("bc")).agg(F.count("*").alias("n"))


@query("r22_chain_km", _GRID.replace("with persons", "with recursive persons") + """, c as (select (max(row) + 1) * 15 r from grid), g as (select year, row * 30 r, col * 30 c from grid where red > 24),
 near as (select g.year, g.r, g.c from g, c where sqrt(pow(g.r - c.r, 2) + pow(least(abs(g.c - 600), abs(g.c + 1 - 600)), 2)) <= 333),
 core as (select n.year, arg_min((n.r, n.c), (sqrt(pow(n.r - c.r, 2) + pow(least(abs(n.c - 600), abs(n.c + 1 - 600)), 2)), n.r * 1200 + n.c)) k,
   min(sqrt(pow(n.r - c.r, 2) + pow(least(abs(n.c - 600), abs(n.c + 1 - 600)), 2))) far from near n, c group by n.year),
 ch as (select year, k[1] r, k[2] c from core where far <= 100 union select n.year, n.r, n.c from ch join near n on n.year = ch.year and pow(n.r - ch.r, 2) + pow(greatest(abs(n.c - ch.c) - 1, 0), 2) <= 1089)
 select year, r::int as row, (c + i)::int as col, (r * 1200 + c)::bigint patch from ch, range(0, 2) x(i)""")
def r22b(spark, d):
    """Patches chained to the core in steps of 1 km, up to 10 km from it; patches of two places each, 30 apart."""
    g = stored(grid(spark, d))
    m = spread(g.where("red > 24")).unionByName(spread(g.where("red > 24"), 1))
    return P.core_chain(stored(P.patches(m, COLS * APART)), rows_of(g) * APART / 2, 600, 33, 333, 100)


@query("r25_otsu", _GRID + ", b as (select least(63, greatest(0, floor(red / (50.0 / 64))))::int bin, count(*) n from grid group by 1), c as (select bin, sum(n) over (order by bin) w0, sum(n * bin) over (order by bin) s0, sum(n) over () w, sum(n * bin) over () s from b), v as (select bin, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) v from c where w0 < w) select round((bin + 1) * (50.0 / 64)::double, 6) threshold from v order by v desc, bin limit 1")
def r25(spark, d):
    return P.otsu(grid(spark, d), "red", 64, 0.0, 50.0).withColumn("threshold", F.round("threshold", 6))


@query("r29_iou", _GRID + "select year, count(*) filter (red > 26) a, count(*) filter (nir > 36) b, round(count(*) filter (red > 26 and nir > 36) / count(*) filter (red > 26 or nir > 36), 6) iou from grid group by year")
def r29(spark, d):
    a, b = F.col("red") > 26, F.col("nir") > 36
    return grid(spark, d).groupBy("year").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.round(P.iou(a, b), 6).alias("iou"))


_STRATA = "with s as (select lang, count(*) n_h from documents group by lang), q as (select lang, count(*) n, sum(quality) hits from labels join documents using (doc_id) group by lang), st as (select n_h, lang = 'en' map, n, hits, hits / n::double p, n_h / sum(n_h) over ()::double w from s join q using (lang)) "


@query("r28_accuracy", _STRATA.replace("over ()::double", "over ()") + "select round(sum(w * case when map then p else 1 - p end), 6) overall, round(sum(w * p) filter (map) / sum(w) filter (map), 6) users, round(sum(w * p) filter (map) / sum(w * p), 6) producers, round(sum(w * p) * sum(n_h) * 0.09, 4) area_ha, round(1.96 * sqrt(sum(w * w * p * (1 - p) / (n - 1))) * sum(n_h) * 0.09, 4) half_ha from st")
def r28(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    area = docs.groupBy("lang").agg(F.count("*").alias("n_h"))
    sample = labels.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"))
    out = P.accuracy(area.join(sample, "lang").withColumn("map", F.col("lang") == "en"), 0.09)
    return out.select(*[F.round(c, 6).alias(c) for c in ("overall", "users", "producers")], *[F.round(c, 4).alias(c) for c in ("area_ha", "half_ha")])


_POINTS = """with a as (select lang, count(*) n_h, lang = 'en' map from documents group by lang), q as (select lang, count(*) seen, count(r) n, count(*) filter (r = 1) hits from (select lang, case when toxic = 1 then null else quality end r from labels join documents using (doc_id)) group by lang),
 st as (select lang, n_h, map, coalesce(seen, 0) seen, coalesce(n, 0) n, coalesce(hits, 0) hits, n_h / sum(n_h) over () w, hits / nullif(n, 0) p from a left join q using (lang)) """


def sampled_strata(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{d}/labels.parquet")
    points = labels.join(docs, "doc_id").withColumn("r", F.when(F.col("toxic") == 1, None).otherwise(F.col("quality")))
    area = docs.groupBy("lang").agg(F.count("*").alias("n_h"), F.first(F.col("lang") == "en").alias("map"))
    return P.strata_accuracy(points, area, "lang", "r")


@query("r28_strata", _POINTS + "select lang, n_h, map, seen::bigint seen, n::bigint n, hits::bigint hits, (seen - n)::bigint uncertain, round(w, 6) w, round(p, 6) p, round(sqrt(p * (1 - p) / nullif(n - 1, 0)), 6) se, round(w * p, 6) positive, round(w * (1 - p), 6) negative from st")
def r28b(spark, d):
    """The sample by stratum: points seen, uncertain ones counted and left out, and what the rest says."""
    return sampled_strata(spark, d).select("lang", "n_h", "map", "seen", "n", "hits", "uncertain", *[F.round(c, 6).alias(c) for c in ("w", "p", "se", "positive", "negative")])


@query("r28_confusion", _POINTS + "select map, true reference, round(sum(w * p), 6) share, sum(hits)::bigint points from st group by map union all select map, false, round(sum(w * (1 - p)), 6), sum(n - hits)::bigint from st group by map")
def r28c(spark, d):
    return P.confusion_shares(sampled_strata(spark, d)).withColumn("share", F.round("share", 6))


_LABELS = _GRID + """, pos as (select year, row + i as row, col + j as col from grid, range(-1, 2) a(i), range(-1, 2) b(j) where red > 15 group by all having count(*) = 9),
 near as (select distinct year, row + i as row, col + j as col from grid, range(-1, 2) a(i), range(-1, 2) b(j) where red > 38),
 lab as (select year, row, col, 1 label from grid where exists (from pos p where p.year = grid.year and p.row = grid.row and p.col = grid.col)
  union all select year, row, col, 0 from grid where not coalesce(nir > 60, false) and not exists (from near p where p.year = grid.year and p.row = grid.row and p.col = grid.col)) """


def labels(g):
    return C.reference_labels(g, F.col("red") > 15, F.col("red") > 38, F.col("nir") > 60, 1)


@query("r13_reference_labels", _LABELS + "select * from lab")
def r13(spark, d):
    return labels(stored(grid(spark, d, "red", "nir")))  # read four times


@query("r13_stable", _GRID + "select row, col, min(red > 20) as class from grid group by row, col having min(red > 20) = max(red > 20) and count(distinct year) = 7")
def r13b(spark, d):
    return C.stable(grid(spark, d).withColumn("c", F.col("red") > 20), "c", 7)


@query("r14_quota_sample", _GRID + """, z as (select year, row, col, case when red > 40 then 'a' when red > 25 then 'b' else 'c' end s from grid), n as (select s, count(*) n from z group by s),
 q as (select s, n, least(case s when 'a' then 2000 else 500 end + 0, n) t from n where s = 'a'), q2 as (select n.s, least(500 + 2000 - (select t from q), n.n) t from n where s = 'b'),
 q3 as (select n.s, least(500 + (500 + 2000 - (select t from q)) - (select t from q2), n.n) t from n where s = 'c'), k as (select s, t from q union all select * from q2 union all select * from q3)
 select year, row, col, z.s from z join k using (s) qualify row_number() over (partition by z.s order by md5(year || '|' || row || '|' || col)) <= t""")
def r14(spark, d):
    """2000, 500 and 500 pixels of three strata; what the first can't fill goes on to the next."""
    z = grid(spark, d).select("year", "row", "col", F.when(F.col("red") > 40, "a").when(F.col("red") > 25, "b").otherwise("c").alias("s"))
    return C.quota_sample(z, "s", F.concat_ws("|", "year", "row", "col"), {"a": 2000, "b": 500, "c": 500}, ["a", "b", "c"])


FEATURES = ["nir", "swir", "green"]


def _forest(spark, d):
    g = stored(grid(spark, d))
    return g, stored(labels(g).join(g, ["year", "row", "col"]))


@query("r16_forest_metrics")
def r16(spark, d):
    """Accuracy of forests over folds of spatial blocks."""
    _, rows = _forest(spark, d)
    folded = rows.withColumn("fold", F.pmod(F.xxhash64(F.floor(F.col("row") / 10), F.floor(F.col("col") / 10)), F.lit(3)).cast("int"))
    return C.block_metrics(folded, FEATURES, "label", "fold", 3)


@query("r17_probability")
def r17(spark, d):
    g, rows = _forest(spark, d)
    return C.probabilities(C.train(rows, FEATURES, "label", 20), g.select("year", "row", "col", *FEATURES), FEATURES).select("year", "row", "col", "p", "flag")


@query("r25_thresholded", _COMPONENTS.replace("where red > 30", "where red > (select t from th)").replace(", m as", """, b as (select least(63, greatest(0, floor(red / (50.0 / 64))))::int bin, count(*) n from grid group by 1), c as (select bin, sum(n) over (order by bin) w0, sum(n * bin) over (order by bin) s0, sum(n) over () w, sum(n * bin) over () s from b),
 v as (select bin, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) v from c where w0 < w), th as (select (bin + 1) * (50.0 / 64)::double + 6 t from v order by v desc, bin limit 1), m as""", 1)
 + "select year, count(*) filter (pow(row - 10, 2) + pow(col - 20, 2) <= 100) perto, count(*) n from (select *, count(*) over (partition by year, patch) z from k) where z >= 3 group by year")
def r25b(spark, d):
    """The mask above a threshold found by the histogram (and a margin), without small patches; its pixels within a radius."""
    g = stored(grid(spark, d, "red"))
    at = P.otsu(g, "red", 64, 0.0, 50.0)  # one row
    over = g.crossJoin(F.broadcast(at)).where(F.col("red") > F.col("threshold") + 6).select("year", "row", "col")
    near = F.pow(F.col("row") - 10, 2) + F.pow(F.col("col") - 20, 2) <= 100
    return P.drop_small(over, COLS, 3).groupBy("year").agg(F.count_if(near).alias("perto"), F.count("*").alias("n"))


@query("r27_ring_strata", _MASK + """, ring as (select distinct year, row + i as row, col + j as col from m, range(-1, 2) a(i), range(-1, 2) b(j)),
 s as (select g.year, g.row, g.col, case when g.red > 30 then 'classe' when r.row is not null then 'anel' else 'resto' end estrato from grid g left join ring r on r.year = g.year and r.row = g.row and r.col = g.col)
 select estrato, count(*) n_h, least(count(*), 50) n from s group by estrato""")
def r27b(spark, d):
    """Strata by map class and the ring around it, and how many pixels a sample of 50 each takes."""
    g = grid(spark, d)
    ring = P.dilate(mask(spark, d), 1).withColumn("ring", F.lit(True))
    name = F.when(F.col("red") > 30, "classe").when(F.col("ring"), "anel").otherwise("resto")
    rows = g.join(ring, ["year", "row", "col"], "left").select("year", "row", "col", name.alias("estrato"), F.concat_ws("|", "year", "row", "col").alias("k"))
    return M.stratified_sample(rows, "estrato", "k", 50).groupBy("estrato").agg(F.max("size").alias("n_h"), F.count("*").alias("n"))


@query("r32_shape", _MASK + """, o as (select (max(row) + 1) / 2.0::double r0 from m), c as (select year, avg(row) r, avg(col) c, count(*) n from m group by year),
 f as (select m.year, n, r, c, r0, sqrt(pow(row - r0, 2) + pow(col - 20, 2)) far, sqrt(pow(row - r, 2) + pow(col - c, 2)) own from m join c on c.year = m.year, o)
 select year, n, round(sqrt(n / pi()), 6) radius, round(avg(far), 6) mean_distance, round(quantile_cont(far, 0.95), 6) p95, round(2.0::double / 3 * sqrt(n / pi()) / avg(own), 6) proximity,
 round(max(sqrt(pow(r - r0, 2) + pow(c - 20, 2))), 6) shift, round(max((degrees(atan2(c - 20, r0 - r)) + 360) % 360), 4) azimuth from f group by year, n""")
def r32(spark, d):
    """Distances to a given origin, the middle of the grid."""
    m = stored(mask(spark, d))
    out = P.shape_metrics(m, rows_of(m) / 2, 20)
    return out.select("year", "n", *[F.round(k, 6).alias(k) for k in ("radius", "mean_distance", "p95", "proximity", "shift")], F.round("azimuth", 4).alias("azimuth"))


@query("r33_octant_shares", _MASK + """, o as (select (floor(((degrees(atan2(col - 20.25, row - 20.25)) + 360 + 22.5) % 360) / 45))::int octant, case when year <= 1994 then 'ate_1994' when year <= 1997 then '1995_1997' else '1998_mais' end periodo from m),
 k as (select periodo, octant, count(*) n from o group by all) select periodo, octant, n, round(100 * n / sum(n) over (partition by periodo), 6) pct from k""")
def r33b(spark, d):
    azimuth = F.degrees(F.atan2(F.col("col") - 20.25, F.col("row") - 20.25))
    period = F.when(F.col("year") <= 1994, "ate_1994").when(F.col("year") <= 1997, "1995_1997").otherwise("1998_mais")
    counts = mask(spark, d).groupBy(period.alias("periodo"), F.floor(F.pmod(azimuth + 22.5, F.lit(360.0)) / 45).cast("int").alias("octant")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("periodo")), 6))


@query("r33_octants", _MASK + "select year, (floor(((degrees(atan2(col - 20.25, row - 20.25)) + 360 + 22.5) % 360) / 45))::int octant, count(*) n from m group by all")
def r33(spark, d):
    azimuth = F.degrees(F.atan2(F.col("col") - 20.25, F.col("row") - 20.25))
    return mask(spark, d).withColumn("octant", F.floor(F.pmod(azimuth + 22.5, F.lit(360.0)) / 45).cast("int")).groupBy("year", "octant").agg(F.count("*").alias("n"))
