"""Matching, merging and aligning label maps.

A label map is ``(unit, label)``; label 0 is background. All operators work on the contingency of two maps, which
has at most as many rows as there are pairs of labels that meet, however many units there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.staging import staged


def _rank(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(u, v, n, nu, nv): units with label u in left and v in right, and the labels' full sizes. Cells with label 0 are out."""
    both = left.select("unit", F.col("label").alias("u")).join(right.select("unit", F.col("label").alias("v")), "unit")
    return _with_sizes(both.groupBy("u", "v").agg(F.count("*").alias("n")), _sizes(left, "u"), _sizes(right, "v"))


def _sizes(labels: DataFrame, name: str) -> DataFrame:
    return labels.groupBy(F.col("label").alias(name)).agg(F.count("*").alias(f"n{name}"))


def _with_sizes(cells: DataFrame, nu: DataFrame, nv: DataFrame) -> DataFrame:
    return cells.where("u <> 0 and v <> 0").join(nu, "u").join(nv, "v").select("u", "v", "n", "nu", "nv")


def relabel(labels: DataFrame) -> DataFrame:
    """(unit, label) with labels other than 0 numbered 1, 2, ... in ascending order."""
    dense = labels.where("label <> 0").select("label").distinct().withColumn("new", F.row_number().over(Window.orderBy("label")))  # one row per label
    return labels.join(dense, "label", "left").select("unit", F.coalesce("new", F.lit(0)).alias("label"))


def label_counts(labels: DataFrame) -> DataFrame:
    """(label, n, place): labels by falling count, then label."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def best_jaccard(cells: DataFrame, left: DataFrame) -> DataFrame:
    """(u, v, jaccard): the label v of greatest Jaccard index for each u, the least of equals; -1 and 0 if u meets none."""
    scored = cells.withColumn("jaccard", F.col("n") / (F.col("nu") + F.col("nv") - F.col("n")))
    best = scored.withColumn("k", _rank("u", F.desc("jaccard"), F.col("v"))).where("k = 1")
    every = left.where("label <> 0").select(F.col("label").alias("u")).distinct()
    return every.join(best.select("u", "v", "jaccard"), "u", "left").select("u", F.coalesce("v", F.lit(-1)).alias("v"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def matched_pairs(cells: DataFrame) -> DataFrame:
    """(u, v, n, dice): mutual best overlaps; then a v left over takes its best u if that is free, then a u its best v.

    Each label has one target, so of those with the same target the least label wins, as if they came in order. Cells are
    read once: whether a label is taken already is a window over its own cells.
    """
    taken = lambda flag, by: F.max(flag).over(Window.partitionBy(by))
    own = cells.withColumns({"best_v": _rank("u", F.desc("n"), F.col("v")) == 1, "best_u": _rank("v", F.desc("n"), F.col("u")) == 1}).where("best_v or best_u")
    own = own.withColumn("found", F.col("best_v") & F.col("best_u"))
    own = own.withColumn("open", F.col("best_u") & ~taken("found", "u") & ~taken("found", "v"))
    own = own.withColumn("found", F.col("found") | F.col("open") & (_rank("u", F.desc("open"), F.col("v")) == 1))
    own = own.withColumn("open", F.col("best_v") & ~taken("found", "u") & ~taken("found", "v"))
    own = own.withColumn("found", F.col("found") | F.col("open") & (_rank("v", F.desc("open"), F.col("u")) == 1))
    return own.where("found").select("u", "v", "n", (2 * F.col("n") / (F.col("nu") + F.col("nv"))).alias("dice"))


def numbered_pairs(cells: DataFrame, nu: DataFrame, nv: DataFrame) -> DataFrame:
    """(id, u, v, dice, matched): matched pairs by falling Dice, then the labels left over side by side, with their own Dice if they meet.

    cells, nu and nv are staged: they are tables of labels.
    """
    pairs = staged(matched_pairs(cells))
    first = pairs.select(F.row_number().over(Window.orderBy(F.desc("dice"), "u")).alias("id"), "u", "v", "dice", F.lit(True).alias("matched"))
    count = pairs.count()
    left = nu.where("u <> 0").select("u").join(pairs.select("u"), "u", "left_anti").select(F.row_number().over(Window.orderBy("u")).alias("k"), "u")
    right = nv.where("v <> 0").select("v").join(pairs.select("v"), "v", "left_anti").select(F.row_number().over(Window.orderBy("v")).alias("k"), "v")
    rest = left.join(right, "k", "full").join(cells, ["u", "v"], "left")
    rest = rest.select((F.col("k") + count).alias("id"), "u", "v", F.coalesce(2 * F.col("n") / (F.col("nu") + F.col("nv")), F.lit(0.0)).alias("dice"), F.lit(False).alias("matched"))
    return first.unionByName(rest)


def _measured(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged (u, v, n) of all labels that meet, 0 too, and both maps' sizes (u, nu) and (v, nv): the units are read once, all else works on labels."""
    both = left.select("unit", F.col("label").alias("u")).join(right.select("unit", F.col("label").alias("v")), "unit")
    return staged(both.groupBy("u", "v").agg(F.count("*").alias("n"))), staged(_sizes(left, "u")), staged(_sizes(right, "v"))


def dice_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, u, v, dice) of two maps without merging; the result of the match is the mean of the positive Dice values."""
    cells, nu, nv = _measured(left, right)
    return numbered_pairs(staged(_with_sizes(cells, nu, nv)), nu, nv).drop("matched")


def dice_score(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(F.when(F.col("dice") > 0, F.col("dice"))), F.lit(0.0)).alias("result"))


def renamed(labels: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """(unit, label): labels replaced by the ids of their pairs."""
    ids = pairs.where(F.col(side).isNotNull()).select(F.col(side).alias("label"), "id")
    return labels.join(ids, "label", "left").select("unit", F.coalesce("id", F.lit(0)).alias("label"))


def _fold(cells: list[tuple[int, int, int]], size: dict[int, int]) -> dict[int, int]:
    """Merges of pieces one target after the other: for cells (target, piece, n), piece -> piece it is merged into.

    Only for maps in which a piece lies half in two targets: there the order matters. cells has a row for each pair of labels.
    """
    held: dict[int, dict[int, int]] = {}
    for target, piece, n in cells:
        held.setdefault(target, {})[piece] = n
    into: dict[int, int] = {}
    for target in sorted(held):
        own = held[target]
        inside = sorted((p for p in own if 2 * own[p] >= size[p]), key=lambda p: (-own[p], p))
        for piece in inside[1:]:
            into[piece] = inside[0]
            size[inside[0]] += size[piece]
            for row in held.values():
                if piece in row:
                    row[inside[0]] = row.get(inside[0], 0) + row.pop(piece)
    for piece in list(into):
        while into[piece] in into:
            into[piece] = into[into[piece]]
    return into


def merge_map(cells: DataFrame, target: str, piece: str) -> DataFrame:
    """(piece, into): pieces of which at least half lies in one target become the one of them with the largest overlap.

    A window does it unless a piece lies exactly half in a target: then order matters, and the cells, at most one for each
    pair of labels, are folded in order on the driver.
    """
    size = f"n{piece}"
    if cells.where(2 * F.col("n") == F.col(size)).limit(1).count():
        rows = [(r[target], r[piece], r["n"]) for r in cells.select(target, piece, "n").collect()]
        sizes = {r[piece]: r[size] for r in cells.select(piece, size).distinct().collect()}
        into = _fold(rows, sizes)
        return cells.sparkSession.createDataFrame([(int(a), int(b)) for a, b in into.items()], "piece int, into int")
    first = F.first(piece).over(Window.partitionBy(target).orderBy(F.desc("n"), piece))
    return cells.where(2 * F.col("n") >= F.col(size)).select(F.col(piece).alias("piece"), first.alias("into")).where("piece <> into")


def merged(labels: DataFrame, merges: DataFrame) -> DataFrame:
    return labels.join(merges, F.col("label") == F.col("piece"), "left").select("unit", F.coalesce("into", "label").alias("label"))


def _merge(cells: DataFrame, nu: DataFrame, nv: DataFrame, piece: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The merges of one side's pieces, and cells and sizes after them."""
    merges = staged(merge_map(staged(_with_sizes(cells, nu, nv)), "u" if piece == "v" else "v", piece))
    now = lambda df: df.join(merges, F.col(piece) == F.col("piece"), "left").withColumn(piece, F.coalesce("into", piece)).drop("piece", "into")
    cells = staged(now(cells).groupBy("u", "v").agg(F.sum("n").alias("n")))
    sizes = staged(now(nv if piece == "v" else nu).groupBy(piece).agg(F.sum(f"n{piece}").alias(f"n{piece}")))
    return (merges, cells, nu, sizes) if piece == "v" else (merges, cells, sizes, nv)


def joined_maps(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both maps after merging: pieces of right into regions of left, then the other way round."""
    into_v, *measured = _merge(*_measured(left, right), "v")
    into_u, *_ = _merge(*measured, "u")
    return staged(merged(left, into_u)), staged(merged(right, into_v))


def dice_joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, u, v, dice) after merging pieces on both sides; labels are those after merging. The result is the mean of all Dice values."""
    _, *measured = _merge(*_measured(left, right), "v")
    _, *measured = _merge(*measured, "u")
    return _scored(*measured)


def joined_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    return _scored(*_measured(left, right))


def _scored(cells: DataFrame, nu: DataFrame, nv: DataFrame) -> DataFrame:
    pairs = numbered_pairs(staged(_with_sizes(cells, nu, nv)), nu, nv)
    # a slot of labels left over counts as 0
    return pairs.select("id", "u", "v", F.when(F.col("matched"), F.col("dice")).otherwise(0.0).alias("dice"))


def dice_atlas_align(parcels: DataFrame, atlas: DataFrame) -> DataFrame:
    """(atlas, parcel, dice): parcels merged into the atlas regions that hold at least half of them, matched by largest shares both ways.

    Parcels wholly outside the atlas vanish; others keep their units outside it. A region won by background is unmatched.
    Labels are those before renumbering; a merged parcel has the label of its largest overlap. Sizes are of units in both maps.
    """
    both = parcels.select("unit", F.col("label").alias("v")).join(atlas.select("unit", F.col("label").alias("u")), "unit")
    cells = both.groupBy("u", "v").agg(F.count("*").alias("n"))
    known = F.max((F.col("u") != 0) & (F.col("v") != 0)).over(Window.partitionBy("v"))
    cells = cells.withColumn("v", F.when(known, F.col("v")).otherwise(0)).groupBy("u", "v").agg(F.sum("n").alias("n"))
    sized = lambda df: df.withColumns({"nu": F.sum("n").over(Window.partitionBy("u")), "nv": F.sum("n").over(Window.partitionBy("v"))})
    cells = staged(sized(cells))
    merges = staged(merge_map(cells.where("u <> 0 and v <> 0"), "u", "v"))
    moved = cells.join(merges, F.col("v") == F.col("piece"), "left").groupBy("u", F.coalesce("into", "v").alias("v")).agg(F.sum("n").alias("n"))
    share = lambda of: F.desc(F.col("n") / F.col(of))
    cells = sized(moved).withColumns({"first": _rank("u", share("nv"), F.desc("n"), F.col("v")), "back": _rank("v", share("nu"), F.desc("n"), F.col("u"))})
    best = cells.where("u <> 0 and v <> 0 and first = 1 and back = 1")
    return best.select(F.col("u").alias("atlas"), F.col("v").alias("parcel"), (2 * F.col("n") / (F.col("nu") + F.col("nv"))).alias("dice"))


def transfer_percent(mine: DataFrame, mine_there: DataFrame, atlas: DataFrame, atlas_there: DataFrame) -> DataFrame:
    """(share): of the units here, those whose pair (own label, atlas label) also occurs there."""
    here = mine.select("unit", F.col("label").alias("m")).join(atlas.select("unit", F.col("label").alias("a")), "unit")
    there = mine_there.select("unit", F.col("label").alias("m")).join(atlas_there.select("unit", F.col("label").alias("a")), "unit").select("m", "a").distinct()
    return here.join(there.withColumn("hit", F.lit(1)), ["m", "a"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"))


def expand_labels(super_map: DataFrame, rows: DataFrame) -> DataFrame:
    """(unit, label): row labels given to the units of their super id; row 0 is the least super id other than 0."""
    offset = super_map.where("super_id <> 0").agg(F.min("super_id").alias("o"))
    shifted = rows.crossJoin(F.broadcast(offset)).select((F.col("row") + F.col("o")).alias("super_id"), "label")  # offset has one row
    return super_map.join(shifted, "super_id", "left").select("unit", F.when(F.col("super_id") == 0, 0).otherwise(F.coalesce("label", F.lit(0))).alias("label"))


def mask_background(labels: DataFrame, original: DataFrame) -> DataFrame:
    """(unit, label): label 0 wherever the original label is 0."""
    return labels.join(original.select("unit", F.col("label").alias("o")), "unit").select("unit", F.when(F.col("o") == 0, 0).otherwise(F.col("label")).alias("label"))
