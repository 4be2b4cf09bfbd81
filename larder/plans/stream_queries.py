"""Detections, scans and event-time windows over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import recommend, spatial
from larder.plans import recommend_queries
from larder.plans.registry import Tables, query
from larder.session import shared_folder
from larder.sources import store
from larder.streaming import keyed, stateful, windows

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _events(t: Tables) -> DataFrame:
    return windows.event_time(t.events)


def _event_stream(t: Tables) -> DataFrame:
    """The event table as a stream of its files (a pattern, so that a single file will do)."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.root}/events[.]parquet")


def _to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    at = shared_folder(stream.sparkSession, "stream")
    return windows.run_to_end(stream, f"{name}_{at.rsplit('-', 1)[1]}", f"{at}/state", mode)


def _found(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("label"), "event_type", (F.col("value") / 20).alias("px"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("py"))


_WINDOW = "SELECT {start} AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS peak FROM {src} GROUP BY 1, 2"


@query(_WINDOW.format(start="time_bucket(INTERVAL '6 hours', ts)", src="events"))
def tumbling_windows(t):
    return windows.tumbling(_events(t), "6 hours", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_WINDOW.format(start="time_bucket(INTERVAL '6 hours', ts)", src="events"))
def stream_tumbling(t):
    """The same windows from a real stream, with a watermark, run to its end."""
    events = windows.event_time(_event_stream(t), late="1 day")
    out = _to_end(windows.tumbling(events, "6 hours", ["event_type"], "value"), "tumbling", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_latest(t):
    """What was seen last of every user, kept up to date by a stream."""
    return _to_end(windows.latest(_event_stream(t), ["user_id"], "ts", ["event_id"]), "latest", "complete")


@query(f"SELECT user_id, food_fdc_id, CAST(sum(CAST(offered AS INT)) AS BIGINT) AS offered, CAST(sum(CAST(chosen AS INT)) AS BIGINT) AS chosen, round(coalesce(sum(CAST(chosen AS INT))::DOUBLE / nullif(sum(CAST(offered AS INT)), 0), 0.5), 6) AS score FROM ({recommend_queries._LOG}) GROUP BY 1, 2")
def stream_preferences(t):
    """Preference scores kept up to date by a stream of offers."""
    out = _to_end(recommend.preference_scores(recommend_queries.log_of(_event_stream(t))), "preferences", "complete")
    return out.withColumn("score", F.round("score", 6))


_SEEN = f"SELECT user_id AS navigation_id, replace(event_type, ' ', '_') AS label, count(*) AS hits, round(avg(value / 20), 6) AS px, round(avg({_K} / 10.0), 6) AS py FROM events GROUP BY 1, 2"


def _means(found: DataFrame) -> DataFrame:
    rows = found.select(F.col("user_id").alias("navigation_id"), F.col("event_type").alias("label"), (F.col("value") / 20).alias("px"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("py"))
    return spatial.scan_means(rows)


@query(_SEEN)
def scan_while_moving(t):
    return _means(t.events).withColumns({"px": F.round("px", 6), "py": F.round("py", 6)})


@query(_SEEN)
def stream_scan_while_moving(t):
    """The same accumulation as a stream of detections."""
    return _to_end(_means(_event_stream(t)), "scan", "complete").withColumns({"px": F.round("px", 6), "py": F.round("py", 6)})


@query(_WINDOW.format(start="s", src="(SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s FROM events)"))
def sliding_windows(t):
    return windows.sliding(_events(t), "12 hours", "6 hours", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", user_id, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS peak FROM b GROUP BY user_id, s""")
def session_windows(t):
    out = windows.sessions(_events(t), "2 hours", ["user_id"], "value")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_values(t):
    return windows.latest(t.events, ["user_id"], "ts", ["event_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    return windows.deduplicated(t.events.select("user_id", "event_type"), ["user_id", "event_type"])


_STREAKS = """WITH p AS (SELECT user_id, event_type, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS BIGINT) AS d, count(*) AS k, sum(value) AS v FROM events GROUP BY 1, 2, 3),
f AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS pos FROM (SELECT DISTINCT user_id, d FROM p)),
i AS (SELECT p.*, pos, pos - row_number() OVER (PARTITION BY p.user_id, event_type ORDER BY pos) AS island FROM p JOIN f ON p.user_id = f.user_id AND p.d = f.d),
s AS (SELECT *, sum(k) OVER w AS streak, sum(v) OVER w AS sv FROM i WINDOW w AS (PARTITION BY user_id, event_type, island ORDER BY pos))
SELECT CAST(user_id AS VARCHAR) AS stream_id, event_type AS label, d AS frame_seq, CAST(streak AS BIGINT) AS streak, round(sv / streak, 6) AS cam_x FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY pos) AS n FROM s WHERE streak >= 8) WHERE n = 1"""


@query(_STREAKS)
def stability_streaks(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("stream_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame_seq"), F.col("event_type").alias("label"), F.col("value").alias("cam_x"), F.lit(0.0).alias("cam_y"), F.lit(0.0).alias("cam_z"))
    return spatial.stable_labels(rows, rows.select("stream_id", "frame_seq")).select("stream_id", "label", "frame_seq", "streak", F.round("cam_x", 6).alias("cam_x"))


@query(_STREAKS)
def stream_stability(t):
    """The same gate as a stateful stream of frames, run to its end."""
    seen = F.struct(F.col("event_type").alias("label"), F.lit(1.0).alias("confidence"), F.col("value").alias("cam_x"), F.lit(0.0).alias("cam_y"), F.lit(0.0).alias("cam_z"))
    frames = t.events.groupBy(F.col("user_id").cast("string").alias("stream_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame_seq")).agg(F.collect_list(seen).alias("detections"))
    at = shared_folder(t.spark, "frames")
    frames.write.parquet(f"{at}/in")
    with keyed.with_rocksdb(t.spark):
        out = _to_end(stateful.stable(t.spark.readStream.schema(frames.schema).parquet(f"{at}/in")), "stable")
    return out.select("stream_id", "label", "frame_seq", "streak", F.round("cam_x", 6).alias("cam_x"))


@query(f"""WITH RECURSIVE r AS (SELECT user_id AS m, date_trunc('day', ts) AS d, event_type AS label, value / 20 AS x, {_K} / 10.0 AS y, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), event_id) AS n FROM events),
s AS (SELECT DISTINCT m, 0::BIGINT AS n, CAST([] AS STRUCT(label VARCHAR, i BIGINT, x DOUBLE, y DOUBLE, d TIMESTAMP)[]) AS stored, CAST(NULL AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM r
UNION ALL SELECT m, n, CASE WHEN label = 'signup' THEN stored[1:0] WHEN label = 'error' THEN list_filter(stored, lambda o: o.label <> 'view') WHEN near THEN stored ELSE list_append(stored, struct_pack(label := label, i := free, x := x, y := y, d := d)) END,
  CASE WHEN label NOT IN ('signup', 'error') AND NOT near THEN free END, label, x, y
FROM (SELECT r.*, s.stored, len(list_filter(s.stored, lambda o: o.label = r.label AND o.d <> r.d AND sqrt((o.x - r.x) ** 2 + (o.y - r.y) ** 2) < 1)) > 0 AS near,
  list_min(list_filter(range(len(s.stored) + 1), lambda k: NOT list_contains(list_transform(list_filter(s.stored, lambda o: o.label = r.label), lambda o: o.i), k))) AS free FROM s JOIN r ON r.m = s.m AND r.n = s.n + 1))
SELECT CAST(m AS VARCHAR) AS map_id, 'detected_' || label || '_' || i AS name, label, round(x, 6) AS px, round(y, 6) AS py FROM s WHERE i IS NOT NULL""")
def stream_registry(t):
    """Objects as a stream of daily requests registers them: an error forgets the views, a sign-up clears the map."""
    op = F.when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "error", "forget").otherwise("put")
    requests = _event_stream(t).select(
        F.col("user_id").cast("string").alias("map_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("request_id"), F.when(op == "forget", "view").otherwise(F.col("event_type")).alias("label"),
        (F.col("value") / 20).alias("px"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("py"), op.alias("op"), "event_id",
    )
    with keyed.with_rocksdb(t.spark):
        out = _to_end(stateful.registry(requests, 1.0, ["event_id"]), "registry")
    return out.select("map_id", "name", "label", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS g, epoch(ts) / 3600 AS t, value / 20 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n FROM events),
s AS (SELECT g, n, t AS start, t, d AS best, t AS last, CASE WHEN d <= 0.02 THEN 'success' END AS state FROM r WHERE n = 1
UNION ALL SELECT g, n, start, t, best, last, CASE WHEN d <= 0.02 THEN 'success' WHEN t - last >= 300 THEN 'failed' WHEN t - start >= 400 THEN 'timeout' END
FROM (SELECT r.g, r.n, s.start, r.t, r.d, CASE WHEN r.d <= s.best - 0.05 THEN r.d ELSE s.best END AS best, CASE WHEN r.d <= s.best - 0.05 THEN r.t ELSE s.last END AS last FROM s JOIN r ON r.g = s.g AND r.n = s.n + 1 WHERE s.state IS NULL))
SELECT CAST(g AS VARCHAR) AS goal_id, state, round(t, 6) AS t FROM s WHERE state IS NOT NULL""")
def stream_watchdog(t):
    """How each user's approach ended (hours stand for seconds, values for distances)."""
    track = _event_stream(t).select(F.col("user_id").cast("string").alias("goal_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), (F.col("value") / 20).alias("distance"))
    with keyed.with_rocksdb(t.spark):
        out = _to_end(stateful.watchdog(track, near=0.02, patience_s=300, limit_s=400), "watchdog")
    return out.select("goal_id", "state", F.round("t", 6).alias("t"))


@query(f"""SELECT event_id FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id
  AND sqrt((a.value / 20 - b.value / 20) ** 2 + ({_K.replace("props", "a.props")} / 10.0 - {_K.replace("props", "b.props")} / 10.0) ** 2) < 0.5)""")
def spatial_dedup_anti(t):
    found = _found(t)
    return spatial.new_objects(found.where("event_type = 'view'"), found.where("event_type = 'purchase'")).select("event_id")


@query(f"""WITH u AS (SELECT DISTINCT 'user_' || user_id AS k, {_K} % 50 AS u FROM events WHERE event_type = 'purchase'),
n AS (SELECT event_id, 'user_' || user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'view'),
s AS (SELECT k, unnest(range(m + 50)) AS x FROM (SELECT k, max(i) AS m FROM n GROUP BY 1)),
f AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = s.k AND u.u = s.x))
SELECT event_id, 'detected_' || k || '_' || x AS name FROM n JOIN f USING (k, i)""")
def object_numbers(t):
    """New objects take the first numbers that no stored name has, gaps included."""
    found = _found(t)
    number = (F.get_json_object("e.props", "$.k").cast("long") % 50).cast("string")
    bought = t.events.where("event_type = 'purchase'").alias("e")
    stored = bought.select(F.concat(F.lit("detected_user_"), F.col("e.user_id").cast("string"), F.lit("_"), number).alias("name"))
    return spatial.name_objects(found.where("event_type = 'view'"), stored, "event_id").select("event_id", "name")


@query(f"SELECT 'user ' || user_id AS label, round(avg(value / 20), 6) AS px, round(avg({_K} / 10.0), 6) AS py, count(*) AS hits FROM events GROUP BY 1 HAVING count(*) >= 5")
def label_mean_positions(t):
    return spatial.label_means(_found(t), 5).select("label", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "hits")


_SECTORS = "['front', 'front_left', 'left', 'back_left', 'back', 'back_right', 'right', 'front_right']"
_SCAN = f"""WITH p AS (SELECT user_id AS scan_id, (value - 10) / 10 AS x, ({_K} - 50) / 10.0 AS y FROM events), d AS (SELECT *, sqrt(x * x + y * y) AS d, degrees(atan2(y, x)) + 22.5 + 720 AS a FROM p),
m AS (SELECT scan_id, CAST(floor((a - 360 * floor(a / 360)) / 45) AS INT) AS i, min(d) AS d FROM d WHERE d BETWEEN 0.15 AND 10 GROUP BY 1, 2),
e AS (SELECT scan_id, unnest(range(8)) AS i, unnest({_SECTORS}) AS sector FROM (SELECT DISTINCT scan_id FROM p))
SELECT e.scan_id, sector, round(coalesce(m.d, 10.0), 3) AS distance FROM e LEFT JOIN m ON e.scan_id = m.scan_id AND e.i = m.i"""


def _scan(t: Tables) -> DataFrame:
    points = t.events.select(F.col("user_id").alias("scan_id"), ((F.col("value") - 10) / 10).alias("x"), ((F.get_json_object("props", "$.k").cast("double") - 50) / 10).alias("y"))
    return spatial.sector_distances(points)


@query(_SCAN)
def sector_min(t):
    return _scan(t)


@query(f"SELECT scan_id, min(distance) AS min_dist, string_agg(sector, ',' ORDER BY sector) FILTER (WHERE distance >= 1) AS safe FROM ({_SCAN}) GROUP BY 1")
def scan_summary(t):
    return spatial.scan_summary(_scan(t)).select("scan_id", "min_dist", F.when(F.size("safe") > 0, F.array_join("safe", ",")).alias("safe"))


@query("""SELECT o_orderkey AS id, round(x * cos(h) - y * sin(h) + 1, 3) AS px, round(x * sin(h) + y * cos(h) - 2, 3) AS py FROM (SELECT o_orderkey, o_totalprice / 100000 AS x, (o_custkey % 100) / 10.0 AS y, (o_orderkey % 628) / 100.0 AS h FROM orders)""")
def pose_transform(t):
    h = (F.col("o_orderkey") % 628) / 200.0
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("cam_x"), ((F.col("o_custkey") % 100) / 10.0).alias("cam_y"), F.lit(0.0).alias("cam_z"), F.lit(1.0).alias("tx"), F.lit(-2.0).alias("ty"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(h).alias("qz"), F.cos(h).alias("qw"))
    return spatial.to_map(rows).select("id", "px", "py")


@query("""SELECT event_id, paired FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paired FROM events) WHERE event_type = 'click'""")
def latest_pair(t):
    return spatial.latest_pair(t.events, "user_id", "ts", "event_type", "click", "view", "value", "event_id").select("event_id", "paired")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'landmark' WHEN c_custkey % 3 = 0 THEN 'object' END AS source, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::DOUBLE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS x FROM customer""")
def places_by_name(t):
    c = t.customer
    landmarks = c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("name"), F.col("c_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    stored = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("px"), F.lit(0.0).alias("py"))
    asked = c.select(F.concat(F.lit(" "), F.lower("c_name")).alias("name"))
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    return spatial.resolve_names(asked, landmarks, stored).select(number.alias("id"), "source", "x")


@query("SELECT s_suppkey AS id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_name END, s_name) AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def enriched_labels(t):
    stored = t.supplier.where("s_suppkey % 2 = 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("label"))
    return spatial.enrich(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), stored).select("id", "label")


@query("""SELECT event_id, paired FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paired FROM events) WHERE event_type = 'click'""")
def stream_latest_pair(t):
    """The last view before each click, as a stream with a value in state."""
    with keyed.with_rocksdb(t.spark):
        out = _to_end(keyed.latest_pair(_event_stream(t), "user_id", ["ts", "event_id"], "event_type", "click", "view", "value", "event_id"), "pairs")
    return out.select(F.col("id").alias("event_id"), "paired")


@query("""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_type AS label, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS BIGINT) AS d, value FROM events),
f AS (SELECT stream_id, d, (row_number() OVER (PARTITION BY stream_id ORDER BY d) - 1) // 5 AS win, count(*) OVER (PARTITION BY stream_id) AS n FROM (SELECT DISTINCT stream_id, d FROM p))
SELECT p.stream_id, win AS "window", label, count(*) AS hits, round(avg(value), 6) AS cam_x FROM p JOIN f ON p.stream_id = f.stream_id AND p.d = f.d WHERE (win + 1) * 5 <= n GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def stream_count_windows(t):
    """Every five frames (days with events) of a stream, what was seen three times or more."""
    seen = F.struct(F.col("event_type").alias("label"), F.col("value").alias("cam_x"), F.lit(0.0).alias("cam_y"), F.lit(0.0).alias("cam_z"))
    frames = t.events.groupBy(F.col("user_id").cast("string").alias("stream_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame_seq")).agg(F.collect_list(seen).alias("detections"))
    at = shared_folder(t.spark, "frames")
    frames.write.parquet(f"{at}/in")
    with keyed.with_rocksdb(t.spark):
        out = _to_end(keyed.count_windows(t.spark.readStream.schema(frames.schema).parquet(f"{at}/in"), 5, 3), "windows")
    return out.select("stream_id", "window", "label", "hits", F.round("cam_x", 6).alias("cam_x"))


@query("""SELECT 'user ' || user_id AS name, value / 20 AS px FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'purchase'""")
def object_store(t):
    """Objects put and forgotten by a stream of changes, through a log of whole batches."""
    at = shared_folder(t.spark, "objects")
    op = F.when(F.col("event_type") == "purchase", "forget").otherwise("put")
    changes = _event_stream(t).select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("label"), (F.col("value") / 20).alias("px"), F.lit(0.0).alias("py"), op.alias("op"), F.col("event_id").cast("long").alias("seq"))
    store.append_stream(changes, f"{at}/log", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return store.objects(t.spark, f"{at}/log").select("name", "px")
