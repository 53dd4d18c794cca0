"""Joins between rounds, tables, folders and objects."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import match_key
from ..sources.shared import discard, materialize
from .neighbours import knn_edges


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def dimension_lookup(objects: DataFrame, layout: DataFrame) -> DataFrame:
    """Layout columns by (plate, well); wells without a layout get NULL.  A layout has one row per well of a screen."""
    return objects.join(layout, ["plate", "well"], "left")


def only_layout_wells(objects: DataFrame, layout: DataFrame) -> DataFrame:
    return objects.join(layout.select("plate", "well"), ["plate", "well"], "left_semi")


def merge_rounds(rounds: dict[int, DataFrame], how: str = "outer", key: str = "object_id", shared: Sequence[str] = ()) -> DataFrame:
    """One row per object over imaging rounds; features get ``R{n}__``, shared columns are coalesced."""
    if how not in ("outer", "inner"):
        raise ValueError("how is 'outer' or 'inner'")
    out: DataFrame | None = None
    for n, df in sorted(rounds.items()):
        part = prefixed(df, f"R{n}__", keep=[key, *shared])
        if out is None:
            out = part
            continue
        part = part.withColumnsRenamed({c: f"__{c}" for c in shared})
        out = out.join(part, key, "full_outer" if how == "outer" else "inner")
        out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in shared}).drop(*[f"__{c}" for c in shared])
    return out


def zip_tables(tables: Sequence[DataFrame], key: str = "label", where: Sequence[str] = ("plate", "well")) -> DataFrame:
    """Tables of the same objects side by side; an object that misses in one of them is an error when rows are read."""
    out = tables[0].withColumn("__n", F.lit(1))
    for n, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumn(f"__{n}", F.lit(1)), [*where, key], "full_outer").withColumn("__n", F.coalesce("__n", F.lit(0)) + F.coalesce(f"__{n}", F.lit(0))).drop(f"__{n}")
    whole = F.col("__n") == len(tables)
    return out.where(F.when(whole, True).otherwise(F.raise_error(F.lit("tables of a well do not hold the same objects")).cast("boolean"))).drop("__n")


def candidate_folders(plates: DataFrame, folders: DataFrame) -> DataFrame:
    """plate, folder, tier: 1 where the plate's key (hint, else its id) is part of the folder's name, 2 of its whole path.

    Both sides are lists of plates (hundreds), so the planner broadcasts one for the substring join; it decides by size.
    """
    key = match_key(F.coalesce(F.col("hint"), F.col("plate")))
    p = plates.select("plate", key.alias("__key"))
    f = folders.select("folder", match_key(F.element_at(F.split("folder", "/"), -1)).alias("__name"), match_key(F.col("folder")).alias("__path"))
    both = p.join(f, F.col("__path").contains(F.col("__key")) & (F.col("__key") != ""))
    tier = F.when(F.col("__name").contains(F.col("__key")), 1).otherwise(2)
    ranked = both.select("plate", "folder", tier.alias("tier"))
    best = F.min("tier").over(Window.partitionBy("plate"))
    return ranked.withColumn("__best", best).where("tier = __best").drop("__best")


def resolve_folders(plates: DataFrame, folders: DataFrame) -> DataFrame:
    """plate, folder, problem: NULL if the plate has one folder of its own, else what is wrong."""
    found = candidate_folders(plates, folders)
    per = found.groupBy("plate").agg(F.count("*").alias("n"), F.min("folder").alias("folder"))
    out = plates.select("plate").distinct().join(per, "plate", "left")
    out = out.withColumn("__claims", F.count("*").over(Window.partitionBy("folder", F.col("n") == 1)))
    problem = F.when(F.col("n").isNull(), "no folder").when(F.col("n") > 1, "several folders").when((F.col("n") == 1) & (F.col("__claims") > 1), "folder claimed twice")
    return out.select("plate", F.when(problem.isNull(), F.col("folder")).alias("folder"), problem.alias("problem"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that the planner must not broadcast: it goes by the size of files, which for points is some hundredth of their size as rows."""
    return df.hint("merge")


def range_pairs(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str] = ("plate", "well"), a_cols: Sequence[str] = ("id", "x", "y"), b_cols: Sequence[str] = ("id", "x", "y"), a_keep: Sequence[str] = (), b_keep: Sequence[str] = (), broadcast: bool = True) -> DataFrame:
    """keys, id1, id2, distance of all pairs within ``radius`` (inclusive), with the columns to keep as <name>1 and <name>2.

    Points are binned to a grid of the radius; each point of ``a`` looks into its nine cells, so the join is
    on (keys, cell) and a crowded well is spread over its cells.  Points of ``a`` are dealt over all tasks first:
    where the planner broadcasts ``b``, tasks are those of ``a``, which may be one small file with many pairs.
    Without ``broadcast`` both sides are shuffled, whatever the size of their files.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius) or 1.0))
    a = a.select(*keys, F.col(a_cols[0]).alias("id1"), F.col(a_cols[1]).cast("double").alias("x1"), F.col(a_cols[2]).cast("double").alias("y1"), *[F.col(c).alias(f"{c}1") for c in a_keep]).dropna(subset=["x1", "y1"])
    b = b.select(*keys, F.col(b_cols[0]).alias("id2"), F.col(b_cols[1]).cast("double").alias("x2"), F.col(b_cols[2]).cast("double").alias("y2"), *[F.col(c).alias(f"{c}2") for c in b_keep]).dropna(subset=["x2", "y2"])
    a = a.repartition(4 * a.sparkSession.sparkContext.defaultParallelism, "id1")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = a.withColumn("n", F.explode(near)).withColumn("cx", cell("x1") + F.col("n.i")).withColumn("cy", cell("y1") + F.col("n.j")).drop("n")
    b = b.withColumn("cx", cell("x2")).withColumn("cy", cell("y2"))
    d = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    both = a.join(b if broadcast else shuffled(b), [*keys, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return both.select(*keys, "id1", "id2", "distance", *[f"{c}1" for c in a_keep], *[f"{c}2" for c in b_keep])


def greedy_match(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """One-to-one pairs as taking them by (distance, id1, id2) would give, in rounds of locally dominant edges.

    An edge that is the least at both its ends is taken; edges that touch a taken end go; repeat.  Each round
    is a table in the shared folder, so lost executors cost one round at most.  Rounds go on until no edge is
    left; a stated ``max_rounds`` that does not suffice is an error.
    """
    keys = [c for c in pairs.columns if c not in ("id1", "id2", "distance")]
    order = F.struct("distance", "id1", "id2")
    left = materialize(pairs, "pairs")
    taken: DataFrame | None = None
    rounds = 0
    while not left.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        rounds += 1
        ends = left.withColumn("e", order)
        ends = ends.withColumn("m1", F.min("e").over(Window.partitionBy(*keys, "id1"))).withColumn("m2", F.min("e").over(Window.partitionBy(*keys, "id2")))
        won = materialize(ends.where((F.col("e") == F.col("m1")) & (F.col("e") == F.col("m2"))).select(*pairs.columns), "won")
        taken = won if taken is None else taken.unionByName(won)
        before, left = left, materialize(left.join(won.select(*keys, "id1"), [*keys, "id1"], "left_anti").join(won.select(*keys, "id2"), [*keys, "id2"], "left_anti"), "pairs")
        discard(before)
    return taken if taken is not None else left


#: Halvings of the radius that ``greedy_points`` may begin with, and pairs of places that a step may look at: so many a place, in any case so many.
HALVINGS = 24
PER_PLACE = 16
PAIRS = 4_000_000


def _placed_points(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """keys, id, x, y, at (least id of the points of this place), r (1, 2, ... by id within the place)."""
    p = df.select(*keys, F.col(cols[0]).alias("id"), *[(F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(cols[1:], "xy")]).dropna(subset=["x", "y"])
    place = Window.partitionBy(*keys, "x", "y")
    return materialize(p.withColumn("at", F.min("id").over(place)).withColumn("r", F.row_number().over(place.orderBy("id")).cast("long")), "points")


def _met_cells(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str], levels: int) -> dict[int, int]:
    """Pairs of places in neighbouring cells, for the radius halved 0 to ``levels`` - 1 times; a cell of ``b`` is nine rows a level."""
    level = F.explode(F.array(*[F.lit(i) for i in range(levels)]))
    cell = lambda c: F.floor(F.col(c) / (F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("level"))))
    held = [s.withColumn("level", level).groupBy(*keys, "level", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n")) for s in (a, b)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = held[1].withColumn("d", F.explode(near)).select(*keys, "level", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), F.col("n").alias("m"))
    return {r["level"]: r["n"] for r in held[0].join(shuffled(around), [*keys, "level", "cx", "cy"]).groupBy("level").agg(F.sum(F.col("n") * F.col("m")).alias("n")).collect()}


def _tied_places(tied: DataFrame, keys: Sequence[str], points: Sequence[DataFrame]) -> DataFrame:
    """Matches (n = 1) among places that have several others at one least distance, by (id1, id2); those that wait for a nearer pair get none."""
    for i, p in zip("12", points):
        at = tied.select(*keys, f"id{i}", f"f{i}").distinct().join(shuffled(p.select(*keys, F.col("at").alias(f"id{i}"), "id", "r")), [*keys, f"id{i}"]).where(f"r > f{i}")
        tied = tied.join(shuffled(at.groupBy(*keys, f"id{i}").agg(F.array_sort(F.collect_list("id")).alias(f"h{i}"))), [*keys, f"id{i}"])
    kinds = {f.name: f.dataType for f in tied.schema}
    cols = [*keys, "id1", "id2", "distance", "f1", "f2", "n"]
    want = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in cols])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second, near, root = {}, {}, {}, {}

        def top(node):
            while root.setdefault(node, node) != node:
                node = root[node] = root[root[node]]
            return node

        for e in pdf.itertuples():
            root[top((1, e.id1))] = top((2, e.id2))
            first[e.id1], second[e.id2] = (e.f1, e.h1), (e.f2, e.h2)
            near.setdefault(e.id1, []).append(e.id2)
        waits = {top((1, e.id1)) for e in pdf.itertuples() if not e.mutual}
        used, out = dict.fromkeys(second, 0), []
        for _, place, rank in sorted((p, a, f + i) for a, (f, h) in first.items() if top((1, a)) not in waits for i, p in enumerate(h)):
            if free := [(second[b][1][used[b]], b) for b in near[place] if used[b] < len(second[b][1])]:
                b = min(free)[1]
                out.append((place, b, rank, second[b][0] + used[b]))
                used[b] += 1
        found = pd.DataFrame(out, columns=["id1", "id2", "f1", "f2"])
        return found.assign(n=1, **{c: pdf[c].iloc[0] for c in [*keys, "distance"]})[cols]

    return tied.groupBy(*keys, "distance").applyInPandas(run, want)


def _greedy_places(edges: DataFrame, keys: Sequence[str], points: Sequence[DataFrame]) -> list[DataFrame]:
    """Runs of matches (id1, id2: places; from their points after f1 and f2 on, n pairs) until no pair of places is left."""
    cols = edges.columns
    w = [Window.partitionBy(*keys, f"id{i}") for i in "12"]
    left, won = materialize(edges, "pairs"), []
    while not left.isEmpty():
        least = left.withColumns({"m1": F.min("distance").over(w[0]), "m2": F.min("distance").over(w[1])})
        is1, is2 = F.col("distance") == F.col("m1"), F.col("distance") == F.col("m2")
        least = least.where(is1 | is2).withColumns({"t1": F.sum(is1.cast("int")).over(w[0]), "t2": F.sum(is2.cast("int")).over(w[1])})
        tie = (is1 & (F.col("t1") > 1)) | (is2 & (F.col("t2") > 1))
        least = materialize(least.where(tie | (is1 & is2)).select(*cols, (is1 & is2).alias("mutual"), tie.alias("tie")), "least")
        runs = least.where("NOT tie").select(*keys, "id1", "id2", "distance", "f1", "f2", F.least(F.col("c1") - F.col("f1"), F.col("c2") - F.col("f2")).alias("n"))
        if not (tied := least.where("tie")).isEmpty():
            runs = runs.unionByName(_tied_places(tied, keys, points))
        won.append(materialize(runs, "won"))
        before = left
        for i in "12":
            left = left.join(won[-1].groupBy(*keys, f"id{i}").agg(F.sum("n").alias(f"n{i}")).hint("shuffle_hash"), [*keys, f"id{i}"], "left").withColumn(f"f{i}", F.col(f"f{i}") + F.coalesce(f"n{i}", F.lit(0)))
        left = materialize(left.where("f1 < c1 AND f2 < c2").select(*cols), "pairs")
        discard(before)
        discard(least)
    discard(left)
    return won


def greedy_points(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str] = ("plate", "well"), a_cols: Sequence[str] = ("id", "x", "y"), b_cols: Sequence[str] = ("id", "x", "y")) -> DataFrame:
    """keys, id1, id2, distance: ``greedy_match`` of ``range_pairs`` without a table of all pairs.

    Points of one place are one: two places that are nearest to each other match their points in the order of ids.
    Near pairs come before far ones, so a radius at which pairs of places are few is worked off first, then a
    larger one with the points that are left, up to the whole.  Ids that stand for several points go the plain way.
    No side of a join is broadcast, so the driver's memory does not grow with the points.
    """
    points = [_placed_points(a, keys, a_cols), _placed_points(b, keys, b_cols)]
    if any(not p.groupBy(*keys, "id").count().where("count > 1").isEmpty() for p in points):
        return greedy_match(range_pairs(a, b, radius, keys, a_cols, b_cols))
    places = [materialize(p.groupBy(*keys, F.col("at").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count("*").alias("c"), F.lit(0).cast("long").alias("f")), "places") for p in points]
    won: list[DataFrame] = []
    level = HALVINGS + 1 if radius > 0 else 1
    while level:
        sizes = [p.count() for p in places]
        many, few = (1, 0) if sizes[1] > sizes[0] else (0, 1)
        met = _met_cells(places[many], places[few], radius, keys, level) if radius > 0 else {}
        room = max(PAIRS, PER_PLACE * sum(sizes))
        level = next((i for i in range(level) if met.get(i, 0) <= room), level - 1)
        # the smaller side looks into its nine cells
        edges = range_pairs(places[few], places[many], radius / 2**level, keys, a_keep="cf", b_keep="cf", broadcast=False)
        side = (1, 2) if few == 0 else (2, 1)
        edges = edges.select(*keys, *[F.col(f"{c}{s}").alias(f"{c}{i}") for c in ("id", "c", "f") for i, s in zip("12", side)], "distance")
        found = _greedy_places(edges, keys, points)
        won += found
        if level and found:
            runs = functools.reduce(DataFrame.unionByName, found)
            for at, i in enumerate("12"):
                used = runs.groupBy(*keys, F.col(f"id{i}").alias("id")).agg(F.sum("n").alias("n"))
                before, places[at] = places[at], materialize(places[at].join(used.hint("shuffle_hash"), [*keys, "id"], "left").withColumn("f", F.col("f") + F.coalesce("n", F.lit(0))).where("f < c").drop("n"), "places")
                discard(before)
        if any(p.isEmpty() for p in places):
            break
    if not won:
        return range_pairs(a, b, radius, keys, a_cols, b_cols).limit(0)
    each = functools.reduce(DataFrame.unionByName, won).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    for i, p in zip("12", points):
        ranked = p.select(*keys, F.col("at").alias(f"id{i}"), F.col("r").alias(f"r{i}"), F.col("id").alias(f"p{i}"))
        each = each.withColumn(f"r{i}", F.col(f"f{i}") + F.col("i")).join(shuffled(ranked), [*keys, f"id{i}", f"r{i}"])
    return each.select(*keys, F.col("p1").alias("id1"), F.col("p2").alias("id2"), "distance")


def match_one_to_one(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str] = ("plate", "well"), a_cols: Sequence[str] = ("id", "x", "y"), b_cols: Sequence[str] = ("id", "x", "y")) -> tuple[DataFrame, DataFrame]:
    """Matches, and the rows of ``a`` without one.  No match at all is an error."""
    matched = greedy_points(a, b, radius, keys, a_cols, b_cols)
    if matched.isEmpty():
        raise ValueError("no pair lies within the radius")
    lost = a.join(shuffled(matched.select(*keys, F.col("id1").alias(a_cols[0]))), [*keys, a_cols[0]], "left_anti")
    return matched, lost


def merge_matched(a: DataFrame, b: DataFrame, matches: DataFrame, a_id: str = "id", b_id: str = "id", prefix_a: str = "A_", prefix_b: str = "B_") -> DataFrame:
    """Matched rows side by side under prefixes; equal names after prefixing are an error."""
    left, right = prefixed(a, prefix_a), prefixed(b, prefix_b)
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"columns clash after prefixing: {sorted(clash)}")
    m = matches.select("id1", "id2", "distance")
    return m.join(shuffled(left), m["id1"] == left[prefix_a + a_id]).join(shuffled(right), m["id2"] == right[prefix_b + b_id])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def knn_label_transfer(reference: DataFrame, target: DataFrame, label: str, k: int = 15, ref_id: str = "id", target_id: str = "id", vec: str = "vec") -> DataFrame:
    """target id, label, share: majority label of the k nearest reference rows, ties to the smaller label."""
    edges = knn_edges(target, reference.where(F.col(label).isNotNull()), k, target_id, ref_id, vec)
    labels = reference.select(F.col(ref_id).alias("dst"), F.col(label).alias("label"))
    votes = edges.join(labels, "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src")
    best = votes.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "label"))).where("r = 1")
    return best.select(F.col("src").alias(target_id), "label", "share")


def cosine_neighbours(wells: DataFrame, k: int, keys: Sequence[str] = ("plate",), id_col: str = "well", vec: str = "vec") -> DataFrame:
    """keys, a, b, cosine: the k most similar other wells of each, ties to the smaller id; wells without a length take no part."""
    v = F.col(vec).cast("array<double>")
    norm = wells.select(*keys, F.col(id_col).alias("id"), v.alias("v"), F.sqrt(dot(v, v)).alias("n")).where("n > 0")
    unit = norm.select(*keys, "id", F.transform("v", lambda x: x / F.col("n")).alias("vec"))
    near = knn_edges(unit, unit, k, keys=keys, same=True)
    # between unit vectors the squared distance is 2 - 2 cos
    return near.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"), (1.0 - F.col("distance") * F.col("distance") / 2.0).alias("cosine"))


def pair_correlations(vectors: DataFrame, keys: Sequence[str] = ("object_id",), pixel: Sequence[str] = ("y", "x")) -> DataFrame:
    """Pearson correlation of each unordered pair of channels over an object's pixels; NULL if one is constant."""
    # a pixel's channels meet in one group, not in a join of the pixels with themselves, one side of which may be broadcast
    at = vectors.dropna(subset=[*keys, *pixel]).groupBy(*keys, *pixel).agg(F.collect_list(F.struct("channel", "value")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda p: F.transform(F.filter("c", lambda q: p["channel"] < q["channel"]), lambda q: F.struct(p["channel"].alias("a"), q["channel"].alias("b"), p["value"].alias("va"), q["value"].alias("vb")))))
    both = at.select(*keys, F.inline(pairs))
    r = F.try_divide(F.covar_pop("va", "vb"), F.stddev_pop("va") * F.stddev_pop("vb"))
    return both.groupBy(*keys, "a", "b").agg(r.alias("r")).withColumn("feature", F.concat("a", F.lit("--"), "b", F.lit("_PearsonR")))
