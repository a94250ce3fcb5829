"""Joins with more than equality: nearest in group, knots, zones, reconciliation, precedence, neighbours in time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored


FEW, STEP, DEEPEST = 64, 2, 40  # points of a last cell; halvings from level to level; halvings at most
PASS = 8  # halvings of which the points are counted at once
BLOCKS, CELLS = (512, 16), 512  # places that are sought together, at first and for those left; last cells that such a block meets at most
PLACE, CELL, BLOCK = ["_g", "_x", "_y"], ["_g", "_l", "_i", "_j"], ["_g", "_bl", "_bi", "_bj"]


def _leaves(points: DataFrame, few: int) -> DataFrame:
    """Distinct points with their last square cell, of `few` points at most unless it's at DEEPEST: level _l (halvings), _i, _j.

    Points are shuffled once for PASS halvings: cells of the finest of these levels are counted, and their counts added up.
    """
    columns = points.columns
    spread = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"))
    frame = points.groupBy("_g").agg(F.min("_x").alias("_fx"), F.min("_y").alias("_fy"), spread.alias("_side"))
    at, done, depth, first = points.join(frame, "_g"), [], PASS, 0
    while True:
        cell = lambda v, start: F.coalesce(F.floor((F.col(v) - F.col(start)) / F.nullif(F.col("_side") / 2.0**depth, F.lit(0.0))), F.lit(0)).cast("long")  # noqa: B023, E731
        here = at.withColumns({"_i": cell("_x", "_fx"), "_j": cell("_y", "_fy")})
        fine, levels = here.groupBy("_g", "_i", "_j").agg(F.count("*").alias("_n")), range(first, depth + 1, STEP)
        for d in levels:  # a window holds the cells of one that was split, 4^PASS at most
            own = Window.partitionBy("_g", F.shiftright("_i", depth - d), F.shiftright("_j", depth - d))
            fine = fine.withColumn(f"_n{d}", F.sum("_n").over(own))
        level = F.coalesce(*[F.when(F.col(f"_n{d}") <= few, F.lit(d)) for d in levels], F.lit(depth if depth >= DEEPEST else None).cast("int"))
        told = stored(here.join(fine.select("_g", "_i", "_j", level.alias("_l")), ["_g", "_i", "_j"]))
        done.append(told.where("_l is not null").select(*columns, "_l", *[F.expr(f"shiftright({c}, {depth} - _l)").alias(c) for c in ("_i", "_j")]))
        if depth >= DEEPEST or told.where("_l is null").isEmpty():
            return reduce(DataFrame.unionByName, done)
        at, first, depth = told.where("_l is null").drop("_i", "_j", "_l"), depth + STEP, depth + PASS


def _boxes(points: DataFrame, *cell: str) -> DataFrame:
    return points.groupBy(*cell).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))


def _levels(boxes: DataFrame) -> list[DataFrame]:
    """Levels of the tree over last cells: _g, _pi, _pj (the parent), _i, _j, the box of its points and whether it's a last one."""
    deepest, out = boxes.agg(F.max("_l")).first()[0], []
    for d in range(0, -1 if deepest is None else deepest + 1, STEP):
        up = boxes.where(F.col("_l") >= d).withColumns({c: F.expr(f"shiftright({c}, _l - {d})") for c in ("_i", "_j")})
        cells = up.groupBy("_g", "_i", "_j").agg(*[f(c).alias(c) for f, c in ((F.min, "_x0"), (F.max, "_x1"), (F.min, "_y0"), (F.max, "_y1"))], (F.max("_l") == d).alias("_leaf"))
        out.append(cells.withColumns({"_pi": F.shiftright("_i", STEP), "_pj": F.shiftright("_j", STEP)}))
    return out


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a, 2) + F.pow(b, 2))


def _descend(blocks: DataFrame, levels: list[DataFrame], most: int | None) -> tuple[DataFrame, DataFrame]:
    """(BLOCK, _l, _i, _j): the last cells that may hold the nearest point of some place in a block's box; and blocks with more than `most` cells.

    A block keeps the cells that begin no farther away than the far end of the nearest one.
    """
    boxed = blocks.withColumnsRenamed({f"_{v}{i}": f"_b{v}{i}" for v in "xy" for i in (0, 1)})
    away = [F.greatest(F.col(f"_{v}0") - F.col(f"_b{v}1"), F.col(f"_b{v}0") - F.col(f"_{v}1"), F.lit(0.0)) for v in "xy"]
    across = [F.greatest(F.col(f"_b{v}1") - F.col(f"_{v}0"), F.col(f"_{v}1") - F.col(f"_b{v}0")) for v in "xy"]
    own = Window.partitionBy(*BLOCK)
    kept, crowded = None, []
    for i, level in enumerate(levels):
        if kept is None:
            met, waiting = boxed.join(level, "_g"), None
        else:
            waiting = kept.where("_leaf")
            met = kept.where("not _leaf").select(*boxed.columns, F.col("_i").alias("_pi"), F.col("_j").alias("_pj")).join(level, ["_g", "_pi", "_pj"])
        met = met.withColumns({"_l": F.lit(i * STEP), "_near": _length(*away), "_far": _length(*across)}).select(*boxed.columns, "_l", "_i", "_j", "_leaf", "_near", "_far")
        both = met if waiting is None else waiting.unionByName(met)
        pruned = both.withColumn("_reach", F.min("_far").over(own)).where(F.col("_near") <= F.col("_reach") * (1 + 1e-12)).drop("_reach")
        if most is not None:
            pruned = pruned.withColumn("_many", F.count("*").over(own) > most)
        kept = stored(pruned)
        if most is not None:
            crowded.append(kept.where("_many").select(*BLOCK).distinct())
            kept = kept.where("not _many").drop("_many")
    return kept.select(*BLOCK, "_l", "_i", "_j"), reduce(DataFrame.unionByName, crowded) if crowded else kept.select(*BLOCK).limit(0)


def _nearest(places: pa.Table, points: pa.Table) -> pa.Table:
    """Each place of a block with the nearest of the points; of equally near ones with the smallest _o."""
    points = points.take(pc.sort_indices(points, sort_keys=[("_o", "ascending")], null_placement="at_start"))
    places = places.select(PLACE) if len(points) else places.select(PLACE).slice(0, 0)
    (x, y), (u, v) = (places.column(c).to_numpy() for c in PLACE[1:]), (points.column(c).to_numpy() for c in ("_rx", "_ry"))
    best, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 32):
        some = np.s_[i : i + 32]
        d = np.sqrt((x[some, None] - u) ** 2 + (y[some, None] - v) ** 2)
        best[some] = d.argmin(1)  # the first of equals
        far[some] = d[np.arange(len(d)), best[some]]
    return places.append_column("_o", points.column("_o").take(pa.array(best))).append_column("_d", pa.array(far))


def nearest_in_group(left: DataFrame, right: DataFrame, group: str, key: str, other: str, x: str, y: str) -> DataFrame:
    """Each left row's closest right row of the same group (ties by key): group, key, other, distance. Exact.

    Both sides are cut into square cells. Left places are sought by the block: a block goes down the tree of the right side's cells, and
    its places are compared with the points of the few last cells that are left. Blocks that would meet too many, as left places
    stand wider apart than right points, are cut finer, at last into places. Equal places are sought and held once. Left rows
    without a right row in their group, and rows with a null or NaN in group or place, are left out.
    """

    def placed(df: DataFrame, name: str, own: str) -> DataFrame:
        rows = df.select(F.col(group).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(own).alias(name))
        return rows.where(F.col("_g").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))

    rows, found = placed(left, "_k", key), []
    points = _leaves(stored(placed(right, "_o", other).groupBy(*PLACE).agg(F.min("_o").alias("_o"))), FEW)
    points = points.withColumnsRenamed({"_x": "_rx", "_y": "_ry"})
    boxes = stored(_boxes(points.withColumnsRenamed({"_rx": "_x", "_ry": "_y"}), *CELL))
    levels, rest = _levels(boxes), stored(rows.select(*PLACE).distinct().join(boxes.select("_g").distinct(), "_g", "left_semi"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {t}" for c, t in [("_g", rows.schema["_g"].dataType.simpleString()), ("_x", "double"), ("_y", "double"), ("_o", points.schema["_o"].dataType.simpleString()), ("_d", "double")])
    for few in BLOCKS:
        places = _leaves(rest, few).withColumnsRenamed(dict(zip(CELL, BLOCK)))
        cells, crowded = _descend(_boxes(places, *BLOCK), levels, CELLS) if levels else (None, None)
        if cells is None:
            break
        # Partitions by number aren't put together by their size: few bytes are much work.
        sent = cells.join(points, CELL).select(*BLOCK, "_rx", "_ry", "_o").repartition(parts, *BLOCK)
        asked = places.join(crowded, BLOCK, "left_anti").select(*BLOCK, "_x", "_y").repartition(parts, *BLOCK)
        found.append(asked.groupBy(*BLOCK).cogroup(sent.groupBy(*BLOCK)).applyInArrow(_nearest, schema))
        rest = stored(places.join(crowded, BLOCK, "left_semi").select(*PLACE))
        if rest.isEmpty():
            break
    else:
        places = _leaves(rest, 1).withColumnsRenamed(dict(zip(CELL, BLOCK)))
        cells, _ = _descend(_boxes(places, *BLOCK), levels, None)
        met = places.join(cells, BLOCK).join(points, CELL)
        distance = _length(F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry"))
        one = met.groupBy(*PLACE).agg(F.min(F.struct(distance.alias("d"), F.col("_o").alias("o"))).alias("_b"))
        found.append(one.select(*PLACE, F.col("_b.o").alias("_o"), F.col("_b.d").alias("_d")))
    best = reduce(DataFrame.unionByName, found) if found else rest.withColumns({"_o": F.lit(None).cast(points.schema["_o"].dataType), "_d": F.lit(0.0)})
    # A key may stand at several places.
    nearest = rows.join(best, PLACE).groupBy("_g", "_k").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_o").alias("o"))).alias("_b"))
    return nearest.select(F.col("_g").alias(group), F.col("_k").alias(key), F.col("_b.o").alias(other), F.col("_b.d").alias("distance"))


def interpolate_lookup(df: DataFrame, x: str, knots: list[tuple[float, float]]) -> DataFrame:
    """Piecewise-linear value at x, flat beyond the ends, with its origin (exact, between, outside). Knots are a short list."""
    ordered = sorted(knots)
    value, origin = F.lit(float(ordered[-1][1])), F.lit("outside")
    for (a, u), (b, v) in reversed(list(zip(ordered, ordered[1:]))):
        value = F.when(F.col(x) <= b, F.lit(float(u)) + (F.col(x) - a) * F.lit((v - u) / (b - a))).otherwise(value)
    value = F.when(F.col(x) <= ordered[0][0], F.lit(float(ordered[0][1]))).otherwise(value)
    inside = (F.col(x) > ordered[0][0]) & (F.col(x) < ordered[-1][0])
    origin = F.when(F.col(x).isin([k for k, _ in ordered]), "exact").when(inside, "between").when(F.col(x).isNotNull(), "outside")
    return df.withColumns({"value": F.when(F.col(x).isNotNull(), value), "origin": origin})


def _crossings(x: str, y: str, edges: str) -> str:
    """SQL for the number of edges (x0, y0, x1, y1) that the ray from a point to the right crosses."""
    return (
        f"aggregate({edges}, 0, (n, e) -> n + case when (e.y0 > {y}) <> (e.y1 > {y})"
        f" and {x} < (e.x1 - e.x0) * ({y} - e.y0) / (e.y1 - e.y0) + e.x0 then 1 else 0 end)"
    )


def zone_cover(zones: DataFrame, zone: str, ring: str, depth: int = 6) -> DataFrame:
    """Square cells that cover each zone: zone, level, cx, cy, edges. A cell of level k has side 2^k.

    Cells start at the size of the zone's box. Those that an edge touches are split `depth` times; those that none touches are
    inner cells at once, without edges, or dropped. So rows grow with the border, 2^depth times a few, and not with the area. Cells
    that are still touched keep the whole ring as edges. Rings of fewer than three corners or without area on either axis have none.
    """
    xs, ys = F.col(f"{ring}.x"), F.col(f"{ring}.y")
    reach = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    flat = F.least(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    edges = F.expr(f"transform(sequence(1, size({ring})), i -> named_struct('x0', {ring}[i - 1].x, 'y0', {ring}[i - 1].y, 'x1', {ring}[i % size({ring})].x, 'y1', {ring}[i % size({ring})].y))")
    whole = zones.where((F.size(ring) >= 3) & (flat > 0)).select(F.col(zone), edges.alias("_all"), F.ceil(F.log2(reach)).cast("int").alias("level"), *[
        f(v).alias(n) for n, f, v in (("_x0", F.array_min, xs), ("_x1", F.array_max, xs), ("_y0", F.array_min, ys), ("_y1", F.array_max, ys))
    ])
    start = lambda v: F.explode(F.sequence(F.floor(F.col(f"_{v}0") / F.pow(F.lit(2.0), "level")), F.floor(F.col(f"_{v}1") / F.pow(F.lit(2.0), "level"))))
    cells = whole.withColumn("cx", start("x")).withColumn("cy", start("y")).select(zone, "_all", F.col("_all").alias("_near"), "level", "cx", "cy", F.lit(False).alias("_in"))
    for _ in range(depth):
        parts = [F.struct((F.col("level") - 1).alias("level"), (F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)]
        own = F.array(F.struct("level", "cx", "cy"))
        cells = cells.select(zone, "_all", "_near", "_in", F.explode(F.when(F.col("_in"), own).otherwise(F.array(*parts))).alias("_c")).select(zone, "_all", "_near", "_in", "_c.*")
        side = F.pow(F.lit(2.0), "level")
        boxed = cells.withColumns({"_bx": (F.col("cx") - 1e-6) * side, "_by": (F.col("cy") - 1e-6) * side, "_ex": (F.col("cx") + 1 + 1e-6) * side, "_ey": (F.col("cy") + 1 + 1e-6) * side})
        sides = ", ".join(f"(e.x1 - e.x0) * ({v} - e.y0) - (e.y1 - e.y0) * ({u} - e.x0)" for u in ("_bx", "_ex") for v in ("_by", "_ey"))
        touched = F.expr(
            "filter(_near, e -> least(e.x0, e.x1) <= _ex and greatest(e.x0, e.x1) >= _bx and least(e.y0, e.y1) <= _ey and greatest(e.y0, e.y1) >= _by"
            f" and least({sides}) <= 0 and greatest({sides}) >= 0)"
        )
        middle = F.expr(_crossings("((_bx + _ex) / 2)", "((_by + _ey) / 2)", "_all")) % 2 == 1
        cells = boxed.withColumn("_near", touched).withColumn("_in", F.col("_in") | ((F.size("_near") == 0) & middle)).where((F.size("_near") > 0) | F.col("_in"))
        cells = cells.select(zone, "_all", "_near", "level", "cx", "cy", "_in")
    return cells.select(zone, "level", "cx", "cy", F.when(~F.col("_in"), F.col("_all")).alias("edges"))


def point_in_zone(points: DataFrame, zones: DataFrame, x: str, y: str, zone: str, ring: str, depth: int = 6) -> DataFrame:
    """Points with the zones that hold them. ring: array of (x, y) structs without the closing vertex; edges count by crossing number.

    Points meet the cells of `zone_cover` by an equi-join; crossings are counted only for points in cells on a border. Points with a
    null or NaN place are in no zone.
    """
    cover = stored(zone_cover(zones.select(F.col(zone).alias("_zone"), ring), "_zone", ring, depth))
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())  # a few sizes of cells
    cells = [F.struct(F.lit(k).alias("_k"), F.floor(F.col(x) / 2.0**k).alias("_cx"), F.floor(F.col(y) / 2.0**k).alias("_cy")) for k in levels]
    if not levels:
        return points.limit(0).crossJoin(zones.select(zone).limit(0))
    known = points.where(~F.isnan(x) & ~F.isnan(y))
    here = known.withColumn("_c", F.explode(F.array(*cells))).select(*[F.col(c) for c in points.columns], "_c.*")
    found = here.join(cover, (F.col("_k") == F.col("level")) & (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")))
    inside = F.col("edges").isNull() | (F.expr(_crossings(x, y, "edges")) % 2 == 1)
    return found.where(inside).select(*[F.col(c) for c in points.columns], F.col("_zone").alias(zone))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys and status: missing (only in a), extra (only in b), different, equal."""
    l, r = a.select(*keys, F.col(digest).alias("_a"), F.lit(True).alias("_l")), b.select(*keys, F.col(digest).alias("_b"), F.lit(True).alias("_r"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return l.join(r, keys, "full_outer").select(*keys, status.alias("status"))


def precedence_union(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources with one row a key: the first source that has it."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(i)) for i, df in enumerate(tables)])
    return tagged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("source"))).where("_r = 1").drop("_r")


def neighbour_offsets(df: DataFrame, keys: list[str], axis: str, value: str, offsets: list[int]) -> DataFrame:
    """Per key and axis place: the mean of the value at the given offsets, by sending each row to its neighbours."""
    sent = df.where(F.col(value).isNotNull()).select(*keys, F.explode(F.array(*[F.col(axis) + o for o in offsets])).alias(axis), value)
    return sent.groupBy(*keys, axis).agg(F.avg(value).alias("near"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose keys it doesn't have."""
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))
