"""Detections in space: poses, sectors, duplicates in the plane, streaks of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scores import SECTORS, rotate, sector_index


def label_key(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("_"))


def qualifies(targets: list[str] | None, least: float) -> Column:
    """Detections with a position, a wanted label and enough confidence."""
    ok = F.col("cam_x").isNotNull() & F.col("cam_y").isNotNull() & F.col("cam_z").isNotNull() & (F.col("confidence") >= least)
    return ok & F.col("label").isin(targets) if targets else ok


def to_map(points: DataFrame, places: int = 3) -> DataFrame:
    """Camera points moved into the map's frame by each row's pose; the height is forced to 0."""
    q = tuple(F.col(c) for c in ("qx", "qy", "qz", "qw"))
    x, y, _ = rotate(q, (F.col("cam_x"), F.col("cam_y"), F.col("cam_z")))
    return points.withColumns({"px": F.round(x + F.col("tx"), places), "py": F.round(y + F.col("ty"), places), "pz": F.lit(0.0)})


def new_objects(found: DataFrame, stored: DataFrame, radius: float = 0.5) -> DataFrame:
    """Detections (label, px, py) with no stored object of their label within `radius`.

    Labels and grid cells of the radius are the join's keys, so a common label is spread over its cells.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = stored.select(label_key(F.col("label")).alias("k"), F.col("px").alias("sx"), F.col("py").alias("sy"), cell("px").alias("cx"), cell("py").alias("cy"))
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    spread = near.withColumn("cx", F.explode(F.transform(around, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(around, lambda d: F.col("cy") + d)))
    here = found.withColumns({"fk": label_key(F.col("label")), "fx": cell("px"), "fy": cell("py")})
    close = (F.col("fk") == F.col("k")) & (F.col("fx") == F.col("cx")) & (F.col("fy") == F.col("cy")) & (F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")) < radius)
    return here.join(spread, close, "left_anti").drop("fk", "fx", "fy")


def name_objects(found: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Names detected_<label>_<n>: new objects of a label take, in order, the numbers that none of the stored names has.

    The j-th number in use, u, has u - j free ones before it; so the i-th new object (from 0) takes i plus the count of
    those in use with u - j <= i, a running count over both in one order.
    """
    name = r"^detected_(.*)_(0|[1-9]\d*)$"
    used = stored.select(F.regexp_extract("name", name, 1).alias("k"), F.regexp_extract("name", name, 2).try_cast("long").alias("u")).where("u IS NOT NULL").distinct()
    by = Window.partitionBy("k")
    taken = used.select("k", (F.col("u") - F.row_number().over(by.orderBy("u")) + 1).alias("at"), F.lit(1).alias("used"))
    new = found.withColumn("k", label_key(F.col("label"))).withColumn("at", F.row_number().over(by.orderBy(order)) - 1).withColumn("used", F.lit(0))
    both = new.join(taken.select("k").distinct(), "k", "left_semi").select("k", "at", "used").unionByName(taken)
    counts = both.withColumn("before", F.sum("used").over(by.orderBy("at", F.desc("used")).rowsBetween(Window.unboundedPreceding, 0))).where("used = 0")
    rows = new.join(counts.select("k", "at", "before"), ["k", "at"], "left")
    n = (F.col("at") + F.coalesce("before", F.lit(0))).cast("string")
    return rows.withColumn("name", F.concat(F.lit("detected_"), "k", F.lit("_"), n)).drop("k", "at", "used", "before")


def register(found: DataFrame, stored: DataFrame, order: str, radius: float = 0.5) -> DataFrame:
    """The stored objects and the new ones (name, label, px, py); new ones are compared with stored ones only."""
    new = name_objects(new_objects(found, stored, radius), stored, order)
    return stored.select("name", "label", "px", "py").unionByName(new.select("name", "label", "px", "py"))


def label_means(found: DataFrame, least_hits: int = 1, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return found.groupBy(*by).agg(F.avg("px").alias("px"), F.avg("py").alias("py"), F.count("*").alias("hits")).where(F.col("hits") >= least_hits)


def sector_distances(points: DataFrame, nearest: float = 0.15, farthest: float = 10.0, by: str = "scan_id") -> DataFrame:
    """The least distance in each of eight sectors of each scan; the farthest distance where nothing was seen."""
    d = F.hypot("x", "y")
    seen = points.where(~F.isnan("x") & ~F.isnan("y") & (d >= nearest) & (d <= farthest))
    least = seen.groupBy(by, sector_index(F.col("x"), F.col("y")).alias("i")).agg(F.min(d).alias("d"))
    every = points.select(by).distinct().select(by, F.posexplode(F.array(*map(F.lit, SECTORS))).alias("i", "sector"))
    return every.join(least, [by, "i"], "left").select(by, "sector", F.round(F.coalesce("d", F.lit(farthest)), 3).alias("distance"))


def scan_summary(distances: DataFrame, safe: float = 1.0, by: str = "scan_id") -> DataFrame:
    """Nearest distance and sector, and the sectors at least `safe` away."""
    least = F.min(F.struct("distance", "sector"))
    return distances.groupBy(by).agg(
        least["distance"].alias("min_dist"), least["sector"].alias("min_sector"),
        F.sort_array(F.collect_list(F.when(F.col("distance") >= safe, F.col("sector")))).alias("safe")
    )


def stable_labels(detections: DataFrame, frames: DataFrame, n: int = 8) -> DataFrame:
    """Batch form of the stability gate: one row each time a label has been seen in a run of frames without a gap n times.

    detections: stream_id, frame_seq, label, cam_x, cam_y, cam_z (qualified).  frames: stream_id, frame_seq (all frames).
    Every detection counts, so two in a frame add two; the mean is over the run up to the frame in which n was reached.
    """
    numbered = frames.select("stream_id", "frame_seq").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_seq")))
    per = detections.groupBy("stream_id", "label", "frame_seq").agg(F.count("*").alias("k"), *(F.sum(c).alias(c) for c in ("cam_x", "cam_y", "cam_z")))
    order = Window.partitionBy("stream_id", "label").orderBy("pos")
    rows = per.join(numbered, ["stream_id", "frame_seq"]).withColumn("island", F.col("pos") - F.row_number().over(order))
    so_far = Window.partitionBy("stream_id", "label", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"streak": F.sum("k").over(so_far), **{f"s_{c}": F.sum(c).over(so_far) for c in ("cam_x", "cam_y", "cam_z")}})
    reached = rows.where(F.col("streak") >= n).groupBy("stream_id", "label", "island").agg(
        F.min_by(F.struct("frame_seq", "streak", "s_cam_x", "s_cam_y", "s_cam_z"), "pos").alias("r")
    )
    return reached.select(
        "stream_id", "label", "r.frame_seq", F.col("r.streak").cast("long").alias("streak"),
        *((F.col(f"r.s_{c}") / F.col("r.streak")).alias(c) for c in ("cam_x", "cam_y", "cam_z"))
    )


def latest_pair(events: DataFrame, by: str, ts: str, kind: str, left: str, right: str, value: str, tie: str) -> DataFrame:
    """At each event of kind `left` the last value of kind `right` so far; events of one time go by `tie`."""
    w = Window.partitionBy(by).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(kind) == right, F.col(value)), ignorenulls=True).over(w)
    return events.withColumn("paired", last).where(F.col(kind) == left)


def scan_means(found: DataFrame, by: str = "navigation_id") -> DataFrame:
    """What was seen while moving: per navigation and label the number of detections and their mean position.

    Works on a stream too (update or complete mode): counts and sums are all the state there is.
    """
    return found.groupBy(by, label_key(F.col("label")).alias("label")).agg(F.count("*").alias("hits"), F.avg("px").alias("px"), F.avg("py").alias("py"))


def objects_named(stored: DataFrame, label: str) -> DataFrame:
    """All stored objects of a label."""
    return stored.where(label_key(F.col("label")) == label_key(F.lit(label)))


def object_named(stored: DataFrame, name: str) -> DataFrame:
    """One stored object by name, else the first of that label by name; no row if there is neither."""
    exact = (F.col("name") != name).cast("int")
    return stored.where((F.col("name") == name) | (label_key(F.col("label")) == label_key(F.lit(name)))).orderBy(exact, "name").limit(1)


def resolve_names(asked: DataFrame, landmarks: DataFrame, stored: DataFrame) -> DataFrame:
    """Places by name, whatever its case: landmarks first, then stored objects."""
    a = landmarks.select(F.lower("name").alias("k"), F.struct("x", "y").alias("landmark"))
    b = stored.select(F.lower("name").alias("k"), F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("object"))
    rows = asked.withColumn("k", F.lower(F.trim("name"))).join(a, "k", "left").join(b, "k", "left")
    place = F.coalesce("landmark", "object")
    return rows.select(
        "name", place["x"].alias("x"), place["y"].alias("y"),
        F.when(F.col("landmark").isNotNull(), "landmark").when(F.col("object").isNotNull(), "object").alias("source")
    )


def enrich(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live detections by name with the stored label, or their name."""
    return live.join(stored.select("name", F.col("label").alias("stored_label")), "name", "left").withColumn("label", F.coalesce("stored_label", "name")).drop("stored_label")


def stalls(track: DataFrame, by: str = "goal_id", near: float = 0.5, step: float = 0.05, patience_s: float = 15.0, limit_s: float = 120.0) -> DataFrame:
    """How each drive ended: success within `near`; failed without `step` of progress for `patience_s`; timeout; else running.

    track: by, t (seconds from the start), distance.
    """
    before = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("distance").over(before)
    rows = track.withColumn("progress", best.isNull() | (F.col("distance") <= best - step))
    last = F.max(F.when(F.col("progress"), F.col("t"))).over(Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("state", F.when(F.col("distance") <= near, "success").when(F.col("t") - last >= patience_s, "failed").when(F.col("t") >= limit_s, "timeout"))
    return rows.groupBy(by).agg(F.coalesce(F.min_by("state", F.when(F.col("state").isNotNull(), F.col("t"))), F.lit("running")).alias("state"))
