"""Registered trajectory queries and their oracle SQL, side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import shared
from trajspark.functions import scalars
from trajspark.operators import bounds, clean, distribution, ecdf, encodings, kinematics, losses, raster, recurrence, sampling, scoring, sequence, spectral, strokes
from trajspark.plans import streams
from trajspark.plans.tables import GAP, KEY, SIZE, SQL_EVENTS, SQL_SCORES, scores, table, trajectories
from trajspark.sources import runs, sessions, tensors
from trajspark.streaming.sessions import gap_sessions
from trajspark.workers import with_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = with_workers(function)
        if sql:
            ORACLES[function.__name__] = re.sub(r", (\d+)\) AS (vx|vy|v|a|ax|ay|x|y|signed_log|diff|mean|weighed)\b", r", \1) + 0.0 AS \2", sql).replace("$EV", SQL_EVENTS).replace("$SC", SQL_SCORES).replace("$SIZE", str(SIZE)).replace("$GAP", str(GAP))
        return function

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


_LAG = "lag({0}) OVER w"
_DT = "greatest(t - lag(t) OVER w, 1e-5)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY seq)"
_SPEED = f"sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / {_DT}"

# ---------------------------------------------------------------- cleaning


@query("WITH $EV, m AS (SELECT user_id, t, x, y, min(seq) AS seq FROM ev WHERE kind = 'click' AND x < 60 AND y < 60 GROUP BY ALL) SELECT user_id, seq, round(x, 6) AS x, y, round(t * 1000, 3) AS time FROM m WHERE x IS NOT NULL AND y IS NOT NULL")
def clean_events(spark, sf_dir):
    kind = F.when(F.col("kind") == "click", "Move").otherwise(F.col("kind"))
    log = trajectories(spark, sf_dir).select("user_id", "seq", F.col("time").alias("client timestamp"), "x", "y", kind.alias("state"))
    return r6(clean.clean(log, "balabit", KEY, max_coord=60, milliseconds=True).select("user_id", "seq", "x", "y", F.round("time", 3).alias("time")), "x")


@query("SELECT user_id, event_type AS kind, k, min(seq) AS seq FROM (SELECT user_id, event_type, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) GROUP BY ALL")
def dedup_first_occurrence(spark, sf_dir):
    t = trajectories(spark, sf_dir).select("user_id", "kind", F.col("y").cast("long").alias("k"), "seq")
    return clean.first_occurrences(t, KEY, ["kind", "k"])


@query("SELECT c_name AS name, dense_rank() OVER (ORDER BY CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT)) AS place FROM customer")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return c.withColumn("place", F.dense_rank().over(Window.orderBy(scalars.natural_key(F.col("name")))).cast("long"))


@query("SELECT n_name AS name, n_nationkey % 5 AS idx, [CAST(n_nationkey % 5 = 0 AS INT), CAST(n_nationkey % 5 = 1 AS INT), CAST(n_nationkey % 5 = 2 AS INT), CAST(n_nationkey % 5 = 3 AS INT), CAST(n_nationkey % 5 = 4 AS INT)]::VARCHAR AS one_hot FROM nation")
def one_hot_labels(spark, sf_dir):
    idx = F.col("n_nationkey") % 5
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), idx.alias("idx"), F.concat(F.lit("["), F.array_join(scalars.one_hot(idx, 5).cast("array<string>"), ", "), F.lit("]")).alias("one_hot"))


@query("SELECT event_id, round(CASE WHEN value = 0 THEN 0 ELSE sign(value) * ln(1 + abs(value)) END, 6) AS signed_log, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, CAST(least(greatest(trunc(value / 200 * 255), 0), 255) AS INT) AS pixel FROM events")
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    return r6(table(spark, sf_dir, "events").select("event_id", scalars.signed_log(v).alias("signed_log"), scalars.sigmoid(v / 100).alias("sigmoid"), scalars.to_byte(v / 200).alias("pixel")), "signed_log", "sigmoid")


# ---------------------------------------------------------------- kinematics


@query(f"WITH $EV SELECT user_id, event_id, round(coalesce({_SPEED}, 0), 6) AS v FROM ev {_W}")
def velocity_zero_first(spark, sf_dir):
    return r6(kinematics.speed(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", "v"), "v")


@query(f"WITH $EV, s AS (SELECT *, {_SPEED} AS v FROM ev {_W}) SELECT user_id, event_id, round(coalesce(v, lead(v) OVER w, 0), 6) AS v FROM s {_W}")
def velocity_copy_first(spark, sf_dir):
    return r6(kinematics.speed(trajectories(spark, sf_dir), KEY, "copy").select("user_id", "event_id", "v"), "v")


@query(f"WITH $EV SELECT user_id, event_id, round(coalesce((x - lag(x) OVER w) / {_DT}, 0), 6) AS vx, round(coalesce((y - lag(y) OVER w) / {_DT}, 0), 6) AS vy FROM ev {_W}")
def vxvy_signed(spark, sf_dir):
    return r6(kinematics.velocity(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", "vx", "vy"), "vx", "vy")


@query(f"WITH $EV, s AS (SELECT *, coalesce({_SPEED}, 0) AS v FROM ev {_W}) SELECT user_id, event_id, round(CASE WHEN n >= 3 THEN coalesce((v - lag(v) OVER w) / {_DT}, 0) ELSE 0 END, 9) AS a FROM s {_W}")
def acceleration(spark, sf_dir):
    return kinematics.acceleration(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", (F.round("a", 9) + F.lit(0.0)).alias("a"))


@query(
    f"WITH $EV, s AS (SELECT *, (x - lag(x) OVER w) / {_DT} AS p, (y - lag(y) OVER w) / {_DT} AS q FROM ev {_W}), c AS (SELECT *, coalesce(p, lead(p) OVER w, 0) AS vx, coalesce(q, lead(q) OVER w, 0) AS vy FROM s {_W}) "
    f"SELECT user_id, event_id, round(coalesce((vx - lag(vx) OVER w) / {_DT}, 0), 9) AS ax, round(coalesce((vy - lag(vy) OVER w) / {_DT}, 0), 9) AS ay FROM c {_W}"
)
def axay(spark, sf_dir):
    return kinematics.component_acceleration(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", (F.round("ax", 9) + F.lit(0.0)).alias("ax"), (F.round("ay", 9) + F.lit(0.0)).alias("ay"))


@query(
    f"""WITH $EV, e AS (SELECT user_id, event_id, seq, n, t * 0.001 AS t, x, y FROM ev),
    p AS (SELECT *, (x - lag(x) OVER w) / greatest(t - lag(t) OVER w, 1e-8) AS px, (y - lag(y) OVER w) / greatest(t - lag(t) OVER w, 1e-8) AS py FROM e {_W}),
    c AS (SELECT *, 0.5 * (px + lead(px) OVER w) AS vx, 0.5 * (py + lead(py) OVER w) AS vy, (lead(px) OVER w - px) / greatest(lead(t) OVER w - lag(t) OVER w, 1e-8) AS ax, (lead(py) OVER w - py) / greatest(lead(t) OVER w - lag(t) OVER w, 1e-8) AS ay FROM p {_W}),
    k AS (SELECT *, CASE WHEN vx * vx + vy * vy < 1e-8 THEN 0 WHEN vx IS NOT NULL THEN abs(vx * ay - vy * ax) / (power(vx * vx + vy * vy, 1.5) + 1e-8) END AS kappa FROM c)
    SELECT user_id, event_id, round(coalesce(kappa, CASE WHEN seq = 0 THEN lead(kappa) OVER w END, CASE WHEN seq = n - 1 THEN lag(kappa) OVER w END, 0), 5) AS kappa FROM k {_W}"""
)
def curvature(spark, sf_dir):
    t = trajectories(spark, sf_dir).withColumn("time", F.col("time") * 0.001)
    return kinematics.curvature(t, KEY).select("user_id", "event_id", F.round("kappa", 5).alias("kappa"))


@query(
    f"""WITH $EV, v AS (SELECT *, coalesce((x - lag(x) OVER w) / {_DT}, 0) AS vx, coalesce((y - lag(y) OVER w) / {_DT}, 0) AS vy FROM ev {_W}),
    h AS (SELECT *, vx * vx + vy * vy AS s, CASE WHEN seq > 0 THEN atan2(vy, vx) WHEN lead(vx) OVER w * lead(vx) OVER w + lead(vy) OVER w * lead(vy) OVER w >= 1e-8 THEN atan2(lead(vy) OVER w, lead(vx) OVER w) ELSE 0 END AS h FROM v {_W}),
    d AS (SELECT *, lead(h) OVER w - h AS dh, greatest(lead(t) OVER w - t, 1e-8) AS dt FROM h {_W}),
    o AS (SELECT *, abs(dh - 2 * pi() * round(dh / (2 * pi()))) / dt AS o FROM d)
    SELECT user_id, event_id, round(CASE WHEN s < 1e-8 THEN 0 ELSE coalesce(o, lag(o) OVER w, 0) END, 6) AS omega FROM o {_W}"""
)
def angular_velocity(spark, sf_dir):
    return r6(kinematics.angular_velocity(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", "omega"), "omega")


@query(f"WITH $EV, d AS (SELECT *, lead(t) OVER w - t AS d FROM ev {_W}) SELECT user_id, event_id, round(coalesce(d, lag(d) OVER w, 0), 3) AS dt_next FROM d {_W}")
def timediff_node(spark, sf_dir):
    return kinematics.node_interval(trajectories(spark, sf_dir), KEY).select("user_id", "event_id", F.round("dt_next", 3).alias("dt_next"))


_CHUNK = "c AS (SELECT *, seq // $SIZE AS window_id, seq % $SIZE AS pos FROM ev WHERE (seq // $SIZE + 1) * $SIZE <= n)"


def chunks(spark, sf_dir, size: int = SIZE) -> DataFrame:
    return sequence.tumbling(trajectories(spark, sf_dir), KEY, size)


@query(f"WITH $EV, {_CHUNK} SELECT user_id, window_id, count(*) AS pairs, round(avg(abs(b.t - a.t)), 3) AS mean_dt, round(max(abs(b.t - a.t)), 3) AS max_dt FROM c a JOIN c b USING (user_id, window_id) WHERE a.pos < b.pos GROUP BY ALL")
def timediff_pair(spark, sf_dir):
    d = kinematics.pair_differences(chunks(spark, sf_dir), KEY, "time")
    return d.groupBy("user_id", "window_id").agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 3).alias("mean_dt"), F.round(F.max("d"), 3).alias("max_dt"))


_STEP = "sg AS (SELECT user_id, event_id, seq, t - lag(t) OVER w AS raw, greatest(t - lag(t) OVER w, 1e-5) AS h, (x - lag(x) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS vx, (y - lag(y) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS vy FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq)), ss AS (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM sg WHERE h IS NOT NULL)"


@query(f"WITH $EV, {_STEP} SELECT user_id, seq, round(vx, 6) AS vx, round(vy, 6) AS vy, round(v, 6) AS v FROM ss")
def velocity_segments(spark, sf_dir):
    return r6(kinematics.segments(trajectories(spark, sf_dir), KEY).select("user_id", "seq", "vx", "vy", "v"), "vx", "vy", "v")


@query(f"WITH $EV, {_STEP} SELECT user_id, seq, round(coalesce((v - lag(v) OVER w) / h, 0), 9) AS a, round(coalesce((vx - lag(vx) OVER w) / h, 0), 9) AS ax, round(coalesce((vy - lag(vy) OVER w) / h, 0), 9) AS ay FROM ss WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
def acceleration_segments(spark, sf_dir):
    s = kinematics.segment_acceleration(trajectories(spark, sf_dir), KEY)
    return s.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("a", "ax", "ay")})


@query(f"WITH $EV, {_STEP}, d AS (SELECT count(*) AS n_dt, round(sum(raw), 1) AS sum_dt FROM ss WHERE raw > 0), e AS (SELECT (v - lag(v) OVER w) / h AS a FROM ss WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT n_dt, sum_dt, (SELECT count(*) FROM e WHERE abs(a) > 1e-8) AS n_a FROM d")
def filtered_features(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    dt = kinematics.positive_intervals(t, KEY).agg(F.count("*").alias("n_dt"), F.round(F.sum("dt"), 1).alias("sum_dt"))
    a = kinematics.beyond_zero(kinematics.segment_acceleration(t, KEY), "a").agg(F.count("*").alias("n_a"))
    return dt.crossJoin(F.broadcast(a))


# ---------------------------------------------------------------- segmentation

_SPLIT = f"g AS (SELECT *, coalesce(sum(CAST(d > $GAP AS INT)) OVER w, 0) AS sid FROM (SELECT *, t - lag(t) OVER w AS d FROM ev {_W}) {_W})"
_ARC = f"r AS (SELECT *, coalesce(sum(step) OVER w, 0) AS arc FROM (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM g {_W}) {_W})"
_SPANS = "sp AS (SELECT user_id, sid, min(arc) AS a, max(arc) AS b FROM r GROUP BY ALL), lim AS (SELECT user_id, max(x) AS least FROM ev GROUP BY 1)"
_MERGE = """m AS (
    SELECT user_id, sid, 0 AS grp, CASE WHEN b - a >= least THEN NULL ELSE a END AS start FROM sp JOIN lim USING (user_id) WHERE sid = 0
    UNION ALL
    SELECT s.user_id, s.sid, CASE WHEN m.start IS NULL THEN m.grp + 1 ELSE m.grp END, CASE WHEN s.b - coalesce(m.start, s.a) >= least THEN NULL ELSE coalesce(m.start, s.a) END
    FROM m JOIN sp s ON s.user_id = m.user_id AND s.sid = m.sid + 1 JOIN lim ON lim.user_id = s.user_id)"""


@query(f"WITH $EV, {_SPLIT} SELECT user_id, event_id, CAST(sid AS BIGINT) AS sequence_id FROM g")
def gap_split(spark, sf_dir):
    return sequence.gap_split(trajectories(spark, sf_dir), KEY, GAP).select("user_id", "event_id", "sequence_id")


@query(f"WITH $EV, {_SPLIT}, {_ARC} SELECT user_id, CAST(sid AS BIGINT) AS sequence_id, count(*) AS n, round(max(arc) - min(arc), 6) AS length FROM r GROUP BY ALL")
def arc_length_by_sequence(spark, sf_dir):
    t = sequence.arc_length(sequence.gap_split(trajectories(spark, sf_dir), KEY, GAP), KEY)
    return r6(t.groupBy("user_id", "sequence_id").agg(F.count("*").alias("n"), (F.max("arc") - F.min("arc")).alias("length")), "length")


def merged(spark, sf_dir) -> DataFrame:
    return sequence.greedy_merge(sequence.gap_split(trajectories(spark, sf_dir), KEY, GAP), KEY, F.max("x"))


@query(f"WITH RECURSIVE $EV, {_SPLIT}, {_ARC}, {_SPANS}, {_MERGE} SELECT g.user_id, g.event_id, CAST(grp AS BIGINT) AS group_id FROM g JOIN m ON m.user_id = g.user_id AND m.sid = g.sid")
def greedy_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("user_id", "event_id", "group_id")


@query(
    f"WITH RECURSIVE $EV, {_SPLIT}, {_ARC}, {_SPANS}, {_MERGE}, l AS (SELECT user_id, grp, count(*) AS len FROM g JOIN m USING (user_id, sid) GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT user_id, count(*) AS n, min(len) AS min, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3, max(len) AS max, round(avg(len), 6) AS mean, round(stddev_pop(len), 6) AS std FROM l GROUP BY 1"
)
def length_summary(spark, sf_dir):
    lengths = merged(spark, sf_dir).groupBy("user_id", "group_id").agg(F.count("*").alias("len")).where("len >= 2")
    return r6(distribution.summary(lengths, "len", KEY), "mean", "std")


@query(f"WITH $EV, {_CHUNK} SELECT user_id, event_id, window_id, pos FROM c")
def tumbling_strict(spark, sf_dir):
    return chunks(spark, sf_dir).select("user_id", "event_id", "window_id", "pos")


@query("WITH $EV SELECT user_id, event_id, seq // $SIZE AS window_id, seq % $SIZE AS pos FROM ev WHERE least($SIZE, n - seq // $SIZE * $SIZE) >= 2")
def tumbling_ragged(spark, sf_dir):
    return sequence.tumbling(trajectories(spark, sf_dir), KEY, SIZE, ragged=True).select("user_id", "event_id", "window_id", "pos")


@query("WITH $EV, s AS (SELECT user_id, n, unnest(range(0, greatest(n - 16, -1) + 1, 4)) AS start FROM (SELECT DISTINCT user_id, n FROM ev)) SELECT s.user_id, start // 4 AS window_id, count(*) AS n, round(sum(x), 4) AS sum_x FROM s JOIN ev ON ev.user_id = s.user_id AND seq >= start AND seq < start + 16 GROUP BY ALL")
def sliding_quarter(spark, sf_dir):
    w = sequence.sliding(trajectories(spark, sf_dir), KEY, 16, 4)
    return w.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))


@query("WITH $EV SELECT user_id, event_id, ((seq + 1) * 5 - 1) // n AS fold, least(seq // (n // 4), 3) AS part, CAST(seq >= n // 2 AS BIGINT) AS half FROM ev")
def contiguous_folds(spark, sf_dir):
    return sequence.halves(sequence.subsequences(sequence.folds(trajectories(spark, sf_dir), KEY), KEY, 4), KEY).select("user_id", "event_id", "fold", "part", "half")


@query("WITH $EV SELECT user_id, CASE WHEN n >= $SIZE THEN (n - $SIZE) // 2 + 1 ELSE 0 END AS windows FROM (SELECT DISTINCT user_id, n FROM ev)")
def window_counts(spark, sf_dir):
    return trajectories(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", sequence.window_count(F.col("n"), SIZE, 2).alias("windows"))


# ---------------------------------------------------------------- bounds

_BOUNDS = "b AS (SELECT user_id, min(x) AS min_x, min(y) AS min_y, greatest(max(x), 0) AS max_x, greatest(max(y), 0) AS max_y FROM ev GROUP BY 1)"


@query(f"WITH $EV, {_BOUNDS} SELECT user_id, round(min_x, 6) AS min_x, min_y, round(max_x, 6) AS max_x, max_y, round(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 6) AS diag FROM b")
def user_bounds(spark, sf_dir):
    return r6(bounds.user_bounds(trajectories(spark, sf_dir), KEY), "min_x", "max_x", "diag")


@query(f"WITH $EV, {_BOUNDS} SELECT event_id, round(x - coalesce(min_x, 0), 6) AS x, round(y - coalesce(min_y, 0), 6) AS y, round(coalesce(max_x, 1919), 6) AS max_x, coalesce(max_y, 1079) AS max_y FROM ev LEFT JOIN b USING (user_id)".replace("FROM ev GROUP BY 1", "FROM ev WHERE kind = 'signup' AND x > 200 GROUP BY 1"))
def bounds_join_default(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    b = bounds.user_bounds(t.where("kind = 'signup' and x > 200"), KEY)  # many users have no such row
    return r6(bounds.shifted(bounds.with_bounds(t, b, KEY)).select("event_id", "x", "y", "max_x", "max_y"), "x", "y", "max_x")


@query("WITH $EV, e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM ev) SELECT event_id, round((x - lx) / greatest(hx - lx, 1e-8), 6) AS x, round((y - ly) / greatest(hy - ly, 1e-8), 6) AS y FROM ev, e")
def normalised_coordinates(spark, sf_dir):
    return r6(bounds.normalised(trajectories(spark, sf_dir)).select("event_id", "x", "y"), "x", "y")


@query(
    """WITH s(w, h) AS (VALUES (3840, 2160), (2560, 1440), (1920, 1200), (1920, 1080), (1680, 1050), (1600, 900), (1440, 900), (1366, 768), (1280, 1024), (1280, 800), (1280, 720), (1024, 768)),
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice % 4500 AS mx, l_quantity * 45 AS my FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, l_partkey, mx, my, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, mx, my ORDER BY NOT (w - 1 >= mx AND h - 1 >= my), CASE WHEN w - 1 >= mx AND h - 1 >= my THEN w * h ELSE power(greatest(mx - w + 1, 0), 2) + power(greatest(my - h + 1, 0), 2) END, w DESC, h DESC) AS k, w, h FROM (SELECT DISTINCT * FROM p), s)
    SELECT w - 1.0::DOUBLE AS norm_width, h - 1.0::DOUBLE AS norm_height, count(*) AS n FROM f WHERE k = 1 GROUP BY ALL"""
)
def standard_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") % 4500).alias("max_x"), (F.col("l_quantity") * 45).alias("max_y")).distinct()
    return bounds.standard_resolution(p).groupBy("norm_width", "norm_height").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- distributions


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def feature_stats(spark, sf_dir):
    return r6(distribution.summary(table(spark, sf_dir, "events"), "value", ["event_type"]), "min", "q1", "median", "q3", "max", "mean", "std")


@query("WITH p AS (SELECT quantile_cont(value, 0.95) AS u, quantile_cont(value, 0.05) AS l, quantile_cont(value, 0.025) AS cl, quantile_cont(value, 0.975) AS cu FROM events) SELECT 'upper' AS how, count(*) AS n, round(avg(value), 6) AS mean FROM events, p WHERE value <= u UNION ALL SELECT 'central', count(*), round(avg(value), 6) FROM events, p WHERE value BETWEEN cl AND cu UNION ALL SELECT 'signed', count(*), round(avg(value), 6) FROM events, p WHERE value BETWEEN l AND u")
def percentile_cap(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("value")
    parts = [distribution.percentile_cap(ev, "value", 95, how).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.lit(how).alias("how"), "n", "mean") for how in ("upper", "central", "signed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT event_id, round(value, 6) AS value FROM events, q WHERE q3 <= q1 OR (value >= greatest(q1 - 0.5 * (q3 - q1), 0) AND value <= q3 + 0.5 * (q3 - q1))")
def iqr_cap(spark, sf_dir):
    return r6(distribution.iqr_cap(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.5, non_negative=True), "value")


_ECDF = "e AS (SELECT v, count(*) AS n, (rank() OVER (ORDER BY v)) AS dummy FROM (SELECT round(value, 1) AS v FROM events) GROUP BY v), c AS (SELECT v, n, (sum(n) OVER (ORDER BY v) - n + (n + 1) / 2 - 1) / (sum(n) OVER () - 1 + 1e-8) AS cdf FROM e)"


@query(f"WITH {_ECDF} SELECT v AS value, CAST(n AS BIGINT) AS n, round(cdf, 9) AS cdf FROM c")
def ecdf_average_rank(spark, sf_dir):
    e = distribution.global_ecdf(table(spark, sf_dir, "events").select(F.round("value", 1).alias("v")), "v")
    return e.withColumn("cdf", F.round("cdf", 9))


@query(
    f"""WITH {_ECDF}, k AS (SELECT v, cdf FROM c), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 7.37 - 20 AS x FROM lineitem),
    lo AS (SELECT l.*, k.v AS v0, k.cdf AS c0 FROM l ASOF LEFT JOIN k ON l.x >= k.v), hi AS (SELECT lo.*, k.v AS v1, k.cdf AS c1 FROM lo ASOF LEFT JOIN k ON lo.x <= k.v)
    SELECT round(x, 4) AS x, count(*) AS n, round(any_value(CASE WHEN v1 IS NULL THEN 1 WHEN v1 = x THEN c1 WHEN v0 IS NULL THEN 0 ELSE c0 + (c1 - c0) * (x - v0) / (v1 - v0) END), 9) AS cdf FROM hi GROUP BY round(x, 4)"""
)
def ecdf_lookup_interp(spark, sf_dir):
    e = distribution.global_ecdf(table(spark, sf_dir, "events").select(F.round("value", 1).alias("v")), "v")
    x = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 7.37 - 20).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    return distribution.ecdf_lookup(x, "q", e).select(F.round("q", 4).alias("x"), "n", F.round("cdf", 9).alias("cdf"))


@query("WITH p AS (SELECT quantile_cont(value, 0.99) AS u FROM events), k AS (SELECT value FROM events, p WHERE value <= u), e AS (SELECT min(value) AS lo, max(value) AS hi FROM k) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM k, e GROUP BY 1")
def histogram_clip(spark, sf_dir):
    return distribution.histogram(table(spark, sf_dir, "events"), "value", 20, clip_percent=99).select("bin", "n")


@query(
    """WITH s AS (SELECT min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*), -0.2) AS h FROM (SELECT l_quantity AS v FROM lineitem)), g AS (SELECT lo + k * (hi - lo) / 31 AS grid, h FROM s, range(32) r(k)),
    c AS (SELECT l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1), d AS (SELECT grid, sum(w * exp(-0.5 * power((grid - v) / h, 2))) AS d FROM g, c GROUP BY 1) SELECT round(grid, 6) AS grid, round(d / (SELECT max(d) FROM d), 6) AS density FROM d"""
)
def kde_grid(spark, sf_dir):
    return r6(distribution.density(table(spark, sf_dir, "lineitem"), "l_quantity", 32), "grid", "density")


@query("SELECT round(min(value) - 0.03 * (max(value) - min(value)), 6) AS low, round(max(value) + 0.03 * (max(value) - min(value)), 6) AS high FROM events")
def plot_limits(spark, sf_dir):
    return r6(distribution.padded_limits(table(spark, sf_dir, "events"), "value"), "low", "high")


# ---------------------------------------------------------------- recurrence

_LOCAL = "n1 AS (SELECT user_id, window_id, pos, (x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, 1e-8) AS x, (y - min(y) OVER w) / greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, 1e-8) AS y FROM c WINDOW w AS (PARTITION BY user_id, window_id))"
_AXIS = "n2 AS (SELECT user_id, window_id, pos, (x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, 1e-8) AS x, (y - min(y) OVER w) / greatest(max(y) OVER w - min(y) OVER w, 1e-8) AS y FROM c WINDOW w AS (PARTITION BY user_id, window_id))"


def _pairs_sql(source: str, name: str = "p") -> str:
    return f"{name} AS (SELECT a.user_id, a.window_id, a.pos AS i, b.pos AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM {source} a JOIN {source} b USING (user_id, window_id))"


_PER_WINDOW = "SELECT user_id, window_id, count(*) AS n, round(avg({0}), 6) AS mean, round(max({0}), 6) AS max, round(sum({0} * (i * $SIZE + j)), 4) AS weighed FROM {1} GROUP BY ALL"


def per_window(p: DataFrame, value: str = "d") -> DataFrame:
    """A few numbers a window that pin down its matrix."""
    v = F.col(value)
    return p.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), (F.round(F.avg(v), 6) + F.lit(0.0)).alias("mean"), F.round(F.max(v), 6).alias("max"), (F.round(F.sum(v * (F.col("i") * SIZE + F.col("j"))), 4) + F.lit(0.0)).alias("weighed"))


@query(f"WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')} SELECT user_id, window_id, i, j, round(least(d, 1.0), 6) AS d FROM p")
def pairwise_srp(spark, sf_dir):
    return r6(recurrence.clipped(chunks(spark, sf_dir), KEY).select("user_id", "window_id", "i", "j", "d"), "d")


@query(f"WITH $EV, {_CHUNK}, {_pairs_sql('c')}, e AS (SELECT user_id, window_id, quantile_cont(d, 0.95) AS eps FROM p GROUP BY ALL), k AS (SELECT user_id, window_id, i, j, least(d, eps) AS d FROM p JOIN e USING (user_id, window_id)), s AS (SELECT user_id, window_id, i, j, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS d FROM k WINDOW w AS (PARTITION BY user_id, window_id)) " + _PER_WINDOW.format("d", "s"))
def srp_percentile(spark, sf_dir):
    return per_window(recurrence.percentile_plot(chunks(spark, sf_dir), KEY))


_GATE = "m AS (SELECT *, sum(d) FILTER (i <> j) OVER (PARTITION BY user_id, window_id, i) / ($SIZE - 1) AS mi, sum(d) FILTER (i <> j) OVER (PARTITION BY user_id, window_id, j) / ($SIZE - 1) AS mj FROM {0}), s AS (SELECT user_id, window_id, i, j, CASE WHEN mi {1} {2} AND mj {1} {2} THEN d ELSE {3} END AS d FROM m)"
_GATE_CLIPPED = _GATE.replace("THEN d ELSE", "THEN least(d, {2}) ELSE")


@query(f"WITH $EV, {_CHUNK}, {_AXIS}, {_pairs_sql('n2')}, {_GATE.format('p', '<', 0.5, 0.5)} " + _PER_WINDOW.format("d", "s"))
def srp_gated(spark, sf_dir):
    return per_window(recurrence.gated(chunks(spark, sf_dir), KEY, 0.5))


@query(f"WITH $EV, {_CHUNK}, {_AXIS}, {_pairs_sql('n2')}, {_GATE.format('p', '<', 0.5, 0.0)}, t AS (SELECT user_id, window_id, i, j, CASE WHEN i <> j THEN d / 0.5 ELSE 0 END AS d FROM s) " + _PER_WINDOW.format("d", "t"))
def srp_gated_share(spark, sf_dir):
    return per_window(recurrence.gated_share(chunks(spark, sf_dir), KEY, 0.5))


def _bounded(scope: str, test: str = "<=") -> str:
    by = "PARTITION BY user_id" if scope else ""
    return f"{_pairs_sql('c')}, z AS (SELECT user_id, window_id, i, j, (d - min(d) FILTER (i <> j) OVER ({by})) / (max(d) FILTER (i <> j) OVER ({by}) - min(d) FILTER (i <> j) OVER ({by}) + 1e-8) AS d FROM p), {_GATE_CLIPPED.format('z', test, 0.3137, 0.3137)}"


@query(f"WITH $EV, {_CHUNK}, {_bounded('')} " + _PER_WINDOW.format("d", "s"))
def srp_global_two_phase(spark, sf_dir):
    return per_window(recurrence.bounded_gate(chunks(spark, sf_dir), KEY, 0.3137))


@query(f"WITH $EV, {_CHUNK}, {_bounded('user_id')} " + _PER_WINDOW.format("d", "s"))
def srp_session_two_phase(spark, sf_dir):
    return per_window(recurrence.bounded_gate(chunks(spark, sf_dir), KEY, 0.3137, KEY))


@query(f"WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')}, s AS (SELECT user_id, window_id, i, j, least(d, 1.0) - lag(least(d, 1.0)) OVER (PARTITION BY user_id, i, j ORDER BY window_id) AS diff FROM p) " + _PER_WINDOW.format("diff", "s"))
def srp_prev_difference(spark, sf_dir):
    return per_window(recurrence.previous_difference(recurrence.clipped(chunks(spark, sf_dir), KEY), KEY), "diff")


_MEAN_CUT = "me AS (SELECT user_id, window_id, i, j, d / (max(d) OVER (PARTITION BY user_id, window_id) + 1e-8) AS d FROM {0}), mc AS (SELECT user_id, window_id, i, j, CASE WHEN d > avg(d) OVER (PARTITION BY user_id, window_id) THEN 0.3 ELSE d END AS d FROM me)"
_STRETCHED = "st AS (SELECT user_id, window_id, i, j, (least(d, 1.0) - min(least(d, 1.0)) OVER w) / greatest(max(least(d, 1.0)) OVER w - min(least(d, 1.0)) OVER w, 1e-8) AS d FROM p WINDOW w AS (PARTITION BY user_id, window_id))"


@query(f"WITH $EV, {_CHUNK}, {_pairs_sql('c')}, {_MEAN_CUT.format('p')}, s AS (SELECT user_id, window_id, i % 4 AS i, j % 4 AS j, CASE WHEN i = j THEN 0 ELSE d END AS value FROM mc WHERE i // 4 = j // 4 AND CASE WHEN i < 4 THEN i <= j ELSE i > j END) " + _PER_WINDOW.format("value", "s"))
def arp_triangle(spark, sf_dir):
    return per_window(recurrence.half_triangles(chunks(spark, sf_dir), KEY, SIZE), "value")


@query(
    f"""WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED}, q AS (SELECT user_id, window_id, i // 2 AS part, i % 2 AS i, j % 2 AS j, CAST(trunc(d * 255) AS INT) AS d FROM st WHERE i // 2 = j // 2)
    SELECT user_id, window_id, count(*) AS n, CAST(sum((a.part * 7 + b.part * 3 + i * 2 + j) * CASE WHEN i < j THEN b.d WHEN i > j OR a.part = b.part THEN a.d ELSE 0 END) AS BIGINT) AS total FROM q a JOIN q b USING (user_id, window_id, i, j) GROUP BY ALL"""
)
def ap_grid(spark, sf_dir):
    g = recurrence.grid_of_pairs(chunks(spark, sf_dir), KEY, SIZE, 4)
    return g.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.sum((F.col("a") * 7 + F.col("b") * 3 + F.col("i") * 2 + F.col("j")) * F.col("value")).cast("long").alias("total"))


_SHARES = "xs AS (SELECT c.user_id, window_id, pos, (x - min_x) / greatest(max_x - min_x, 1e-8) AS x_share, (y - min_y) / greatest(max_y - min_y, 1e-8) AS y_share FROM c JOIN b USING (user_id))"


def _split_sql(low: str, high: str) -> str:
    return f"CASE WHEN i > j THEN {low} WHEN i < j THEN {high} ELSE ({low} + {high}) / 2 END"


@query(f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_SHARES}, s AS (SELECT user_id, window_id, i, j, {_split_sql('x_share', 'y_share')} AS stripe FROM (SELECT b.user_id, b.window_id, a.pos AS i, b.pos AS j, b.x_share, b.y_share FROM xs a JOIN xs b USING (user_id, window_id))) " + _PER_WINDOW.format("stripe", "s"))
def xy_triangle_stripes(spark, sf_dir):
    e = encodings.shares(_scaled(spark, sf_dir))
    return per_window(recurrence.stripes(recurrence.pairs(e, KEY), "x_share", "y_share"), "stripe")


_DIAG = f"WITH $EV, {_BOUNDS}, {_CHUNK}, e AS (SELECT c.user_id, window_id, pos, x / g AS x, y / g AS y, (sqrt(power(max_x - x, 2) + power(max_y - y, 2)) / g) AS br FROM c JOIN (SELECT *, greatest(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 1e-8) AS g FROM b) USING (user_id)), "


def _scaled(spark, sf_dir) -> DataFrame:
    t = trajectories(spark, sf_dir)
    return sequence.tumbling(bounds.with_bounds(t, bounds.user_bounds(t, KEY), KEY), KEY, SIZE)


@query(_DIAG + f"{_pairs_sql('e')}, s AS (SELECT user_id, window_id, i, j, least(d, 0.4) AS d FROM p) " + _PER_WINDOW.format("d", "s"))
def diag_srp(spark, sf_dir):
    return per_window(recurrence.diagonal_scaled(_scaled(spark, sf_dir), KEY, 0.4))


@query(f"WITH $EV, {_BOUNDS}, {_CHUNK}, q AS (SELECT c.user_id, window_id, pos, CAST(least(greatest(floor((y - min_y) / greatest(max_y - min_y, 1e-8) * 4), 0), 3) * 4 + least(greatest(floor((x - min_x) / greatest(max_x - min_x, 1e-8) * 4), 0), 3) AS BIGINT) AS patch FROM c JOIN b USING (user_id)) SELECT greatest(l.patch, r.patch) * (greatest(l.patch, r.patch) + 1) // 2 + least(l.patch, r.patch) AS comb, count(*) AS n FROM q l JOIN q r USING (user_id, window_id) GROUP BY 1")
def patch_pairs(spark, sf_dir):
    e = recurrence.patch_pair(_scaled(spark, sf_dir), 4)
    p = recurrence.pairs(e, KEY)
    return p.groupBy(recurrence.unordered_index(F.col("i_patch"), F.col("j_patch")).alias("comb")).agg(F.count("*").alias("n"))


@query(f"WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')}, u AS (SELECT user_id, window_id, i, j, d / sqrt(2) AS d FROM p), {_GATE_CLIPPED.format('u', '<', 0.29, 0.29)} " + _PER_WINDOW.format("d", "s"))
def srp_unit_gated(spark, sf_dir):
    return per_window(recurrence.unit_gated(chunks(spark, sf_dir), KEY, 0.29))


_GLOBAL_XY = "gx AS (SELECT user_id, window_id, pos, (x - min(x) OVER ()) / greatest(max(x) OVER () - min(x) OVER (), 1e-8) AS x, (y - min(y) OVER ()) / greatest(max(y) OVER () - min(y) OVER (), 1e-8) AS y FROM c)"


@query(f"WITH $EV, {_CHUNK}, {_GLOBAL_XY}, {_pairs_sql('gx')}, {_GATE_CLIPPED.format('p', '<', 0.4, 0.4)} " + _PER_WINDOW.format("d", "s"))
def srp_global_coordinates(spark, sf_dir):
    return per_window(recurrence.global_gated(chunks(spark, sf_dir), KEY, 0.4))


@query(f"WITH $EV, {_CHUNK}, {_GLOBAL_XY}, {_pairs_sql('gx')}, {_GATE.format('p', '<', 0.4, 0.4)} " + _PER_WINDOW.format("d", "s"))
def srp_global_coordinates_unclipped(spark, sf_dir):
    return per_window(recurrence.global_gated(chunks(spark, sf_dir), KEY, 0.4, clip=False))


@query(f"WITH $EV, {_CHUNK}, {_bounded('user_id', '<')} " + _PER_WINDOW.format("d", "s"))
def srp_session_strict(spark, sf_dir):
    return per_window(recurrence.bounded_gate(chunks(spark, sf_dir), KEY, 0.3137, KEY, strict=True))


def _merged_sql(least: str) -> str:
    spans = _SPANS.replace("SELECT user_id, max(x) AS least FROM ev GROUP BY 1", least)
    return f"""WITH RECURSIVE $EV, {_SPLIT}, {_ARC}, {spans}, {_MERGE}, l AS (SELECT g.user_id, grp AS window_id, row_number() OVER (PARTITION BY g.user_id, grp ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY g.user_id, grp) AS len, x, y FROM g JOIN m ON m.user_id = g.user_id AND m.sid = g.sid),
    c AS (SELECT * FROM l WHERE len >= 2), {_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED} SELECT user_id, CAST(window_id AS BIGINT) AS window_id, count(*) AS n, round(avg(d), 6) AS mean, round(sum(d * (i + 2 * j)), 3) AS weighed FROM st GROUP BY ALL"""


def _srp_merged(spark, sf_dir, least, scope) -> DataFrame:
    """SRP over sequences split by time and merged up to a length: the largest x of the session, of its user group, or of all."""
    t = sequence.gap_split(trajectories(spark, sf_dir), KEY, GAP)
    if scope is not None:
        ends = t.groupBy(*scope).agg(F.max("x").alias("_bound")) if scope else t.agg(F.max("x").alias("_bound"))
        t = t.join(ends, scope) if scope else t.crossJoin(F.broadcast(ends))
    m = sequence.renumbered(sequence.greedy_merge(t, KEY, least), KEY, "group_id").where("_n >= 2").drop("_n")
    st = encodings.local(m, KEY)
    return st.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.sum(F.col("d") * (F.col("i") + 2 * F.col("j"))), 3).alias("weighed"))


@query(_merged_sql("SELECT user_id, max(x) AS least FROM ev GROUP BY 1"))
def srp_merged_session(spark, sf_dir):
    return _srp_merged(spark, sf_dir, F.max("x"), None)


@query(_merged_sql("SELECT user_id, (SELECT max(x) FROM ev) AS least FROM ev GROUP BY 1"))
def srp_merged_global(spark, sf_dir):
    return _srp_merged(spark, sf_dir, F.max("_bound"), [])


# ---------------------------------------------------------------- colour and temporal encodings

_FT_COLUMNS = ("v", "vx", "vy", "a", "ax", "ay", "dt_next")
_CDF = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 - 1) / (count(*) OVER () - 1 + 1e-8) AS c_{0}"
_FEATURES = (
    """fa AS (SELECT user_id, window_id, pos, t, greatest(t - lag(t) OVER w, 1e-5) AS h, lead(t) OVER w - t AS nx, (x - lag(x) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS p, (y - lag(y) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS q, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / greatest(t - lag(t) OVER w, 1e-5) AS s FROM c WINDOW w AS (PARTITION BY user_id, window_id ORDER BY pos)),
    fb AS (SELECT *, coalesce(s, lead(s) OVER w, 0) AS v, coalesce(p, lead(p) OVER w, 0) AS vx, coalesce(q, lead(q) OVER w, 0) AS vy, coalesce(nx, lag(nx) OVER w, 0) AS dt_next FROM fa WINDOW w AS (PARTITION BY user_id, window_id ORDER BY pos)),
    fc AS (SELECT user_id, window_id, pos, t, round(v, 6) + 0.0 AS v, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(dt_next, 6) AS dt_next, round(coalesce((v - lag(v) OVER w) / h, 0), 6) + 0.0 AS a, round(coalesce((vx - lag(vx) OVER w) / h, 0), 6) + 0.0 AS ax, round(coalesce((vy - lag(vy) OVER w) / h, 0), 6) + 0.0 AS ay FROM fb WINDOW w AS (PARTITION BY user_id, window_id ORDER BY pos)),
    ft AS (SELECT user_id, window_id, pos, t, """
    + ", ".join(_CDF.format(c) for c in _FT_COLUMNS)
    + " FROM fc)"
)
_RGB = " SELECT user_id, window_id, count(*) AS n, round(sum(r * (i * $SIZE + j + 1)), 4) AS r, round(sum(g * (i * $SIZE + j + 1)), 4) AS g, round(sum(b * (i * $SIZE + j + 1)), 4) AS b FROM o GROUP BY ALL"


def _kinematics(spark, sf_dir, size: int = SIZE) -> DataFrame:
    """Windows with the features that stripes are made of."""
    w = [*KEY, "window_id"]
    t = kinematics.node_interval(kinematics.component_acceleration(kinematics.acceleration(chunks(spark, sf_dir, size), w, "copy"), w), w)
    return r6(t, *_FT_COLUMNS)


def _features(spark, sf_dir, *names: str) -> DataFrame:
    """Windows with c_<name>: the ECDF values of the named features, all counted in one pass and looked up in one."""
    t = _kinematics(spark, sf_dir)
    return ecdf.looked_up(t, ecdf.counted(t, names), {n: n for n in names})


def _stored(spark, t: DataFrame, names, accuracy: float | None = None, use=lambda store: store):
    """What ``use`` makes of the counts of t, written as three splits and read back; gone afterwards."""
    base = shared.new_path(spark, "distribution")
    parts = shared.written(ecdf.counted(t.withColumn("split", F.col("user_id") % 3), names, accuracy=accuracy, by=["split"]), f"{base}/all")
    for k in range(3):
        ecdf.write_split(parts.where(F.col("split") == k), f"{base}/store", f"part{k}")
    made = use(ecdf.read_splits(spark, f"{base}/store"))
    shared.delete(spark, base)
    return made


def per_window_rgb(p: DataFrame) -> DataFrame:
    at = F.col("i") * SIZE + F.col("j") + 1
    return p.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c) * at), 4).alias(c) for c in "rgb"))


_PERCENT = "pe AS (SELECT user_id, window_id, quantile_cont(d, 0.95) AS eps FROM p GROUP BY ALL), pk AS (SELECT user_id, window_id, i, j, least(d, eps) AS d FROM p JOIN pe USING (user_id, window_id))"
#: Base matrices: SQL that ends in base (user_id, window_id, i, j, d), and the same of events.
_BASES = {
    "local": (f"{_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED}, base AS (SELECT * FROM st)", lambda e, by: encodings.local(e, by)),
    "rp": (f"{_pairs_sql('c')}, {_PERCENT}, base AS (SELECT user_id, window_id, i, j, 1 - (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS d FROM pk WINDOW w AS (PARTITION BY user_id, window_id))", lambda e, by: encodings.inverted_percentile(e, by)),
    "mean": (f"{_pairs_sql('c')}, {_MEAN_CUT.format('p')}, base AS (SELECT user_id, window_id, i, j, 1 - d AS d FROM mc)", lambda e, by: encodings.inverted_mean_cut(e, by)),
    "unit": (f"{_LOCAL}, {_pairs_sql('n1')}, u AS (SELECT user_id, window_id, i, j, d / sqrt(2) AS d FROM p), {_GATE_CLIPPED.format('u', '<', 0.3, 0.3)}, base AS (SELECT user_id, window_id, i, j, d / 0.3 AS d FROM s)", lambda e, by: recurrence.unit_gated(e, by, 0.3).withColumn("d", F.col("d") / 0.3)),
    "session": (f"{_bounded('user_id', '<')}, base AS (SELECT user_id, window_id, i, j, greatest(d / 0.3137, 0) AS d FROM s)", lambda e, by: recurrence.bounded_gate(e, by, 0.3137, KEY, strict=True).withColumn("d", F.col("d") / 0.3137)),
}


def _striped(name: str, base: str, g: str, b: str) -> None:
    """Register base matrix with stripes of the ECDF values of g and b."""
    sql, matrix = _BASES[base]

    def run(spark, sf_dir):
        e = _features(spark, sf_dir, *dict.fromkeys([g, b]))
        return per_window_rgb(encodings.striped(matrix(e, KEY), e, KEY, f"c_{g}", f"c_{b}"))

    run.__name__ = name
    query(f"WITH $EV, {_CHUNK}, {_FEATURES}, {sql}, o AS (SELECT base.user_id, base.window_id, i, j, base.d AS r, c_{g} AS g, c_{b} AS b FROM base JOIN ft ON ft.user_id = base.user_id AND ft.window_id = base.window_id AND ft.pos = base.j)" + _RGB)(run)


for _name, _base, _g, _b in (
    ("enc_speed", "local", "v", "v"),
    ("enc_velocity", "local", "vx", "vy"),
    ("enc_interval", "local", "dt_next", "dt_next"),
    ("enc_rp_speed", "rp", "v", "v"),
    ("enc_rp_velocity", "rp", "vx", "vy"),
    ("enc_rp_acceleration", "rp", "a", "a"),
    ("enc_rp_axay", "rp", "ax", "ay"),
    ("enc_rp_interval", "rp", "dt_next", "dt_next"),
    ("enc_mean_speed", "mean", "v", "v"),
    ("enc_mean_velocity", "mean", "vx", "vy"),
    ("enc_unit_speed", "unit", "v", "v"),
    ("enc_unit_velocity", "unit", "vx", "vy"),
    ("enc_session_velocity", "session", "vx", "vy"),
):
    _striped(_name, _base, _g, _b)

_CAP = 95.0
#: ECDF values of a distribution cut at its percentile, of signed features at the opposite one too.
_CUT = "CASE WHEN {0} > (SELECT quantile_cont({0}, 0.95) FROM fc) THEN 1.0 WHEN {0} < (SELECT {1} FROM fc) THEN 0.0 ELSE (rank() OVER (ORDER BY {0}) - (SELECT count(*) FROM fc WHERE {0} < (SELECT {1} FROM fc)) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 - 1) / ((SELECT count(*) FROM fc WHERE {0} BETWEEN (SELECT {1} FROM fc) AND (SELECT quantile_cont({0}, 0.95) FROM fc)) - 1 + 1e-8) END AS c_{0}"
_SIGNED = ("vx", "vy", "ax", "ay")
_FEATURES_CUT = _FEATURES[: _FEATURES.rindex("ft AS (")] + "ft AS (SELECT user_id, window_id, pos, t, " + ", ".join(_CUT.format(c, f"quantile_cont({c}, 0.05)" if c in _SIGNED else f"min({c})") for c in _FT_COLUMNS) + " FROM fc)"


def _capped(name: str, base: str, g: str, b: str) -> None:
    """As ``_striped``, the ECDFs read from a stored distribution that is cut at a percentile."""
    sql, matrix = _BASES[base]

    def run(spark, sf_dir):
        t, names = _kinematics(spark, sf_dir), dict.fromkeys([g, b])
        e = _stored(spark, t, names, use=lambda store: ecdf.looked_up(t, ecdf.capped(store, _CAP, _SIGNED), {n: n for n in names}))
        return per_window_rgb(encodings.striped(matrix(e, KEY), e, KEY, f"c_{g}", f"c_{b}"))

    run.__name__ = name
    query(f"WITH $EV, {_CHUNK}, {_FEATURES_CUT}, {sql}, o AS (SELECT base.user_id, base.window_id, i, j, base.d AS r, c_{g} AS g, c_{b} AS b FROM base JOIN ft ON ft.user_id = base.user_id AND ft.window_id = base.window_id AND ft.pos = base.j)" + _RGB)(run)


for _name, _base, _g, _b in (
    ("enc_speed_capped", "local", "v", "v"),
    ("enc_velocity_capped", "local", "vx", "vy"),
    ("enc_rp_velocity_capped", "rp", "vx", "vy"),
    ("enc_rp_acceleration_capped", "rp", "a", "a"),
    ("enc_rp_axay_capped", "rp", "ax", "ay"),
    ("enc_rp_interval_capped", "rp", "dt_next", "dt_next"),
):
    _capped(_name, _base, _g, _b)


@query(f"WITH $EV, {_CHUNK}, {_FEATURES}, l AS (SELECT 'v' AS feature, v AS x FROM fc UNION ALL SELECT 'vx', vx FROM fc) SELECT feature, CASE WHEN abs(x) <= 1e-12 THEN 0.0 ELSE sign(x) * floor(ln(abs(x)) / ln(1.02) + 1000000.37) END AS bucket, count(*) AS n, min(x) AS low, max(x) AS high FROM l GROUP BY ALL")
def distribution_store(spark, sf_dir):
    kept = _stored(spark, _kinematics(spark, sf_dir), ["v", "vx"], 0.02, lambda store: shared.written(store, shared.new_path(spark, "buckets")))
    return kept.select("feature", "bucket", "n", "low", "high")


_GAPS = "gp AS (SELECT user_id, window_id, a.pos AS i, b.pos AS j, round(abs(a.t - b.t), 6) AS gap FROM c a JOIN c b USING (user_id, window_id)), gr AS (SELECT gap, (rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2 - 1) / (count(*) OVER () - 1 + 1e-8) AS cdf FROM gp WHERE i < j), gc AS (SELECT user_id, window_id, i, j, coalesce(cdf, 0) AS c_gap FROM gp LEFT JOIN (SELECT gap, min(cdf) AS cdf FROM gr GROUP BY 1) USING (gap))"


def _rp_gaps(e: DataFrame, log: DataFrame) -> DataFrame:
    """Inverted percentile plot with c_gap, the ECDF value of the time between its events; ``log`` has the events that the distribution is of."""
    p = r6(encodings.time_pairs(encodings.inverted_percentile(e, KEY), e, KEY), "gap")
    gap = F.round(F.abs(F.col("i_time") - F.col("j_time")), 6)
    known = ecdf.counted(recurrence.pairs(log, KEY).where("i < j").select(gap.alias("gap")), ["gap"])
    return ecdf.looked_up(p, known, {"gap": "gap"})


@query(f"WITH $EV, {_CHUNK}, {_BASES['rp'][0]}, {_GAPS}, o AS (SELECT user_id, window_id, i, j, d AS r, c_gap AS g, c_gap AS b FROM base JOIN gc USING (user_id, window_id, i, j))" + _RGB)
def enc_rp_time(spark, sf_dir):
    gap = F.col("c_gap")
    return per_window_rgb(encodings.channels(_rp_gaps(chunks(spark, sf_dir), chunks(spark, sf_dir)), KEY, F.col("d"), gap, gap))


@query(f"WITH $EV, {_CHUNK}, {_FEATURES}, {_BASES['rp'][0]}, {_GAPS}, o AS (SELECT base.user_id, base.window_id, i, j, d AS r, c_v AS g, c_gap AS b FROM base JOIN gc USING (user_id, window_id, i, j) JOIN ft ON ft.user_id = base.user_id AND ft.window_id = base.window_id AND ft.pos = j)" + _RGB)
def enc_dvt(spark, sf_dir):
    e = _features(spark, sf_dir, "v")
    p = encodings.with_events(_rp_gaps(e, chunks(spark, sf_dir)), e, KEY, ["c_v"])
    return per_window_rgb(encodings.channels(p, KEY, F.col("d"), F.col("j_c_v"), F.col("c_gap")))


@query(f"WITH $EV, {_CHUNK}, {_FEATURES}, {_BASES['rp'][0]}, {_GAPS}, o AS (SELECT base.user_id, base.window_id, i, j, CASE WHEN i < j THEN d WHEN i > j THEN 1 - c_gap ELSE 0 END AS r, c_vx AS g, c_vy AS b FROM base JOIN gc USING (user_id, window_id, i, j) JOIN ft ON ft.user_id = base.user_id AND ft.window_id = base.window_id AND ft.pos = j)" + _RGB)
def arp_hybrid(spark, sf_dir):
    e = _features(spark, sf_dir, "vx", "vy")
    p = recurrence.triangle(_rp_gaps(e, chunks(spark, sf_dir)), F.col("d"), 1 - F.col("c_gap"), F.lit(0.0))
    return per_window_rgb(encodings.striped(p, e, KEY, "c_vx", "c_vy", F.col("value")))


@query(
    f"WITH $EV, {_CHUNK}, {_FEATURES}, {_BASES['rp'][0]}, vd AS (SELECT user_id, window_id, a.pos AS i, b.pos AS j, abs(a.c_v - b.c_v) AS d FROM ft a JOIN ft b USING (user_id, window_id)), vq AS (SELECT user_id, window_id, quantile_cont(d, 0.95) AS eps FROM vd GROUP BY ALL), vk AS (SELECT user_id, window_id, i, j, least(d, eps) AS d FROM vd JOIN vq USING (user_id, window_id)), "
    f"vs AS (SELECT user_id, window_id, i, j, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS g FROM vk WINDOW w AS (PARTITION BY user_id, window_id)), o AS (SELECT user_id, window_id, i, j, d AS r, g, g AS b FROM base JOIN vs USING (user_id, window_id, i, j))" + _RGB
)
def enc_rp_speed_difference(spark, sf_dir):
    e = _features(spark, sf_dir, "v")
    p = encodings.value_differences(encodings.inverted_percentile(e, KEY), e, KEY, "c_v")
    return per_window_rgb(encodings.channels(p, KEY, F.col("d"), F.col("diff"), F.col("diff")))


def _halved(name: str, base: str, g: str, b: str) -> None:
    """Register the split-triangle form: the base matrix of each half, stripes of g and b."""
    sql, matrix = _BASES[base]
    sql = re.sub(r"\bc\b(?= a JOIN| b USING)", "hc", sql).replace("user_id, window_id", "user_id, window_id, part").replace("a.user_id, a.window_id", "a.user_id, a.window_id, a.part")

    def run(spark, sf_dir):
        e = _features(spark, sf_dir, *dict.fromkeys([g, b]))
        return per_window_rgb(encodings.halves(e, KEY, SIZE, matrix, f"c_{g}", f"c_{b}"))

    run.__name__ = name
    query(
        f"WITH $EV, {_CHUNK}, {_FEATURES}, hc AS (SELECT user_id, window_id, pos // 4 AS part, pos % 4 AS pos, x, y FROM c), {sql}, hf AS (SELECT *, pos // 4 AS part, pos % 4 AS k FROM ft), "
        f"ho AS (SELECT base.*, c_{g} AS g, c_{b} AS b FROM base JOIN hf ON hf.user_id = base.user_id AND hf.window_id = base.window_id AND hf.part = base.part AND hf.k = base.j), "
        "o AS (SELECT user_id, window_id, i, j, least(greatest(sum(d), 0), 1) AS r, max(g) FILTER (part = 0 OR i < j) AS g, max(b) FILTER (part = 0 OR i < j) AS b FROM ho WHERE CASE WHEN part = 0 THEN i >= j ELSE i <= j END GROUP BY ALL)" + _RGB
    )(run)


for _name, _base, _g, _b in (
    ("arp_speed", "rp", "v", "v"),
    ("arp_velocity", "rp", "vx", "vy"),
    ("arp_acceleration", "rp", "a", "a"),
    ("arp_axay", "rp", "ax", "ay"),
    ("arp_mean_velocity", "mean", "vx", "vy"),
):
    _halved(_name, _base, _g, _b)


@query(f"WITH $EV, {_CHUNK}, {_FEATURES} SELECT user_id, window_id, pos, " + ", ".join(f"round(c_{c}, 6) AS c_{c}" for c in ("v", "vx", "a")) + " FROM ft")
def event_stripes(spark, sf_dir):
    names = ["v", "vx", "a"]
    return r6(_features(spark, sf_dir, *names).select("user_id", "window_id", "pos", *(f"c_{c}" for c in names)), *(f"c_{c}" for c in names))


_LOCAL_OF = "(x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, 1e-8) AS x, (y - min(y) OVER w) / greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, 1e-8) AS y"
_BYTE_OF = "CAST(trunc(least(greatest({0}, 0), 1) * 255) AS BIGINT)"
_CELL = ", ".join(f"CASE WHEN i < j THEN z.{c} WHEN i > j OR a.part = z.part THEN a.{c} ELSE 0 END AS {c}" for c in "rgb")


@query(
    f"""WITH $EV, c AS (SELECT *, seq // 16 AS window_id, seq % 16 AS pos FROM ev WHERE (seq // 16 + 1) * 16 <= n),
    wl AS (SELECT user_id, window_id, {_LOCAL_OF} FROM c WINDOW w AS (PARTITION BY user_id, window_id)),
    we AS (SELECT user_id, window_id, min(d) AS lo, max(d) AS hi FROM (SELECT user_id, window_id, least(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 1) AS d FROM wl a JOIN wl b USING (user_id, window_id)) GROUP BY ALL),
    pl AS (SELECT user_id, window_id, pos // 4 AS part, pos % 4 AS k, {_LOCAL_OF} FROM c WINDOW w AS (PARTITION BY user_id, window_id, pos // 4)),
    pa AS (SELECT user_id, window_id, pos // 4 AS part, pos % 4 AS k, (x - lag(x) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS p, (y - lag(y) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS q FROM c WINDOW w AS (PARTITION BY user_id, window_id, pos // 4 ORDER BY pos)),
    fc AS (SELECT user_id, window_id, part, k, round(coalesce(p, lead(p) OVER w, 0), 6) + 0.0 AS vx, round(coalesce(q, lead(q) OVER w, 0), 6) + 0.0 AS vy FROM pa WINDOW w AS (PARTITION BY user_id, window_id, part ORDER BY k)),
    ft AS (SELECT user_id, window_id, part, k, {_CDF.format('vx')}, {_CDF.format('vy')} FROM fc),
    pp AS (SELECT a.user_id, a.window_id, a.part, a.k AS i, b.k AS j, {_BYTE_OF.format('(least(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 1) - lo) / greatest(hi - lo, 1e-8)')} AS r, {_BYTE_OF.format('c_vx')} AS g, {_BYTE_OF.format('c_vy')} AS b
        FROM pl a JOIN pl b ON a.user_id = b.user_id AND a.window_id = b.window_id AND a.part = b.part JOIN we ON we.user_id = a.user_id AND we.window_id = a.window_id JOIN ft ON ft.user_id = b.user_id AND ft.window_id = b.window_id AND ft.part = b.part AND ft.k = b.k),
    ce AS (SELECT user_id, window_id, a.part AS "row", z.part AS col, i, j, {_CELL} FROM pp a JOIN pp z USING (user_id, window_id, i, j))
    SELECT user_id, window_id, "row", col, count(*) AS n, {', '.join(f'CAST(sum({c} * (4 * i + j + 1)) AS BIGINT) AS {c}' for c in 'rgb')} FROM ce GROUP BY ALL"""
)
def ap_colour(spark, sf_dir):
    part = [*KEY, "window_id", "_part"]
    t = r6(kinematics.velocity(chunks(spark, sf_dir, 16).withColumn("_part", F.expr("pos div 4")), part, "copy"), "vx", "vy")
    e = ecdf.looked_up(t, ecdf.counted(t, ["vx", "vy"]), {"vx": "vx", "vy": "vy"})
    cells = encodings.colour_grid(e, KEY, 16, 4, "c_vx", "c_vy")
    return cells.groupBy("user_id", "window_id", "row", "col").agg(F.count("*").alias("n"), *(F.sum(F.col(c) * (4 * F.col("i") + F.col("j") + 1)).alias(c) for c in "rgb"))


# ---------------------------------------------------------------- places within the user's bounds

_CORNERS = "co AS (SELECT c.user_id, window_id, pos, sqrt(power(max_x - x, 2) + power(max_y - y, 2)) / g AS br, sqrt(power(max_x - x, 2) + power(y - min_y, 2)) / g AS tr FROM c JOIN (SELECT *, greatest(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 1e-8) AS g FROM b) USING (user_id))"
_BIAS = {"mix": "0.7 * d + 0.3 * loc", "clip": "least(greatest(d + 0.3 * loc, 0), 1)", "scale": "(d + 0.3 * loc) / 1.3"}
_LOC = {
    "bias": "lo AS (SELECT user_id, window_id, avg(br) AS loc FROM co GROUP BY ALL), lp AS (SELECT * FROM st JOIN lo USING (user_id, window_id))",
    "bias_ab": "lo AS (SELECT user_id, window_id, avg(br) + avg(tr) AS loc FROM co GROUP BY ALL), lp AS (SELECT * FROM st JOIN lo USING (user_id, window_id))",
    "bias_pixel": "lo AS (SELECT user_id, window_id, a.pos AS i, b.pos AS j, (a.br + b.br) / 2 + (a.tr + b.tr) / 2 AS loc FROM co a JOIN co b USING (user_id, window_id)), lp AS (SELECT * FROM st JOIN lo USING (user_id, window_id, i, j))",
}
_PLACED = f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_CORNERS}, {_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED}"


def _biased(name: str, kind: str, how: str) -> None:
    """Register the stretched matrix pulled by a location term."""

    def run(spark, sf_dir):
        e = recurrence.corner_distances(_scaled(spark, sf_dir))
        p = encodings.local(e, KEY)
        if kind == "bias_pixel":
            p = encodings.pixel_location(p, e, KEY)
        else:
            p = p.join(encodings.location(e, KEY, ["d_br"] if kind == "bias" else ["d_br", "d_tr"]), [*KEY, "window_id"])
        return per_window(recurrence.location_bias(p, F.col("loc"), 0.3, how))

    run.__name__ = name
    query(f"{_PLACED}, {_LOC[kind]}, s AS (SELECT user_id, window_id, i, j, {_BIAS[how]} AS d FROM lp) " + _PER_WINDOW.format("d", "s"))(run)


for _kind in _LOC:
    for _how in _BIAS:
        _biased(f"location_{_kind}_{_how}", _kind, _how)


@query(f"{_PLACED}, s AS (SELECT st.user_id, st.window_id, i, j, CASE WHEN i > j THEN (br - tr + 1) / 2 ELSE d END AS value FROM st JOIN co ON co.user_id = st.user_id AND co.window_id = st.window_id AND co.pos = j) " + _PER_WINDOW.format("value", "s"))
def corner_triangle(spark, sf_dir):
    e = recurrence.corner_distances(_scaled(spark, sf_dir))
    return per_window(encodings.corner_triangle(encodings.local(e, KEY), e, KEY), "value")


@query(f"{_PLACED}, s AS (SELECT st.user_id, st.window_id, i, j, least({_split_sql('br', 'tr')}, 1) AS value FROM st JOIN co ON co.user_id = st.user_id AND co.window_id = st.window_id AND co.pos = j) " + _PER_WINDOW.format("value", "s"))
def corner_stripes(spark, sf_dir):
    e = recurrence.corner_distances(_scaled(spark, sf_dir))
    return per_window(encodings.corner_stripes(recurrence.pairs(e, KEY), e, KEY), "value")


def _positioned(name: str, base: str, low: str, high: str) -> None:
    """Register matrix, position stripes and stripes of two features (K48, K49 and their diagonal-scaled forms)."""
    cap = "SELECT user_id, window_id, i, j, least(d, 1.0) AS d FROM p"
    made = f"{_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED}" if base == "local" else f"dg AS (SELECT c.user_id, window_id, pos, x / g AS x, y / g AS y FROM c JOIN (SELECT *, greatest(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 1e-8) AS g FROM b) USING (user_id)), {_pairs_sql('dg')}, st AS ({cap})"

    def run(spark, sf_dir):
        e = _features(spark, sf_dir, *dict.fromkeys([low, high]))
        e = encodings.shares(bounds.with_bounds(e, bounds.user_bounds(trajectories(spark, sf_dir), KEY), KEY))
        p = encodings.local(e, KEY) if base == "local" else recurrence.diagonal_scaled(e, KEY)
        return per_window_rgb(encodings.position_and(p, e, KEY, f"c_{low}", f"c_{high}"))

    run.__name__ = name
    query(
        f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_SHARES}, {_FEATURES}, {made}, o AS (SELECT st.user_id, st.window_id, i, j, d AS r, {_split_sql('x_share', 'y_share')} AS g, {_split_sql(f'c_{low}', f'c_{high}')} AS b FROM st JOIN xs ON xs.user_id = st.user_id AND xs.window_id = st.window_id AND xs.pos = j JOIN ft ON ft.user_id = st.user_id AND ft.window_id = st.window_id AND ft.pos = j)" + _RGB
    )(run)


for _base in ("local", "diagonal"):
    _positioned(f"enc_position_speed_{_base}", _base, "v", "v")
    _positioned(f"enc_position_velocity_{_base}", _base, "vx", "vy")


def _half_sql(low: str, high: str) -> str:
    return f"CASE WHEN i < $SIZE // 2 THEN {high} ELSE {low} END"


def _position_halved(name: str, how: str, low: str | None = None, high: str | None = None) -> None:
    """Register diagonal-scaled distances with position stripes in halves or triangles, and a further channel of two features or the distances again."""
    b = _half_sql(f"c_{low}", f"c_{high}") if low else "d"
    g = _half_sql("x_share", "y_share") if how == "halves" else _split_sql("x_share", "y_share")
    of_features = " JOIN ft ON ft.user_id = st.user_id AND ft.window_id = st.window_id AND ft.pos = j" if low else ""

    def run(spark, sf_dir):
        if low:
            t = _features(spark, sf_dir, *dict.fromkeys([low, high]))
            t = bounds.with_bounds(t, bounds.user_bounds(trajectories(spark, sf_dir), KEY), KEY)
        else:
            t = _scaled(spark, sf_dir)
        e = encodings.shares(t)
        p = recurrence.diagonal_scaled(e, KEY)
        return per_window_rgb(encodings.position_triangles(p, e, KEY) if how == "triangles" else encodings.position_halves(p, e, KEY, SIZE, *((f"c_{low}", f"c_{high}") if low else ())))

    run.__name__ = name
    query(
        f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_SHARES}, {_FEATURES + ', ' if low else ''}dg AS (SELECT c.user_id, window_id, pos, x / g AS x, y / g AS y FROM c JOIN (SELECT *, greatest(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 1e-8) AS g FROM b) USING (user_id)), "
        f"{_pairs_sql('dg')}, st AS (SELECT user_id, window_id, i, j, least(d, 1.0) AS d FROM p), o AS (SELECT st.user_id, st.window_id, i, j, d AS r, {g} AS g, {b} AS b FROM st JOIN xs ON xs.user_id = st.user_id AND xs.window_id = st.window_id AND xs.pos = j{of_features})" + _RGB
    )(run)


_position_halved("enc_position_triangles", "triangles")
_position_halved("enc_position_halves", "halves")
_position_halved("enc_position_speed_halves", "halves", "v", "v")
_position_halved("enc_position_velocity_halves", "halves", "vx", "vy")


_PATCHES = "q AS (SELECT c.user_id, window_id, pos, CAST(least(greatest(floor((y - min_y) / greatest(max_y - min_y, 1e-8) * 4), 0), 3) * 4 + least(greatest(floor((x - min_x) / greatest(max_x - min_x, 1e-8) * 4), 0), 3) AS BIGINT) AS patch FROM c JOIN b USING (user_id))"
_OF_PATCHES = "(greatest(l.patch, r.patch) * (greatest(l.patch, r.patch) + 1) // 2 + least(l.patch, r.patch)) / 135"


@query(f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')}, {_STRETCHED}, {_PATCHES}, s AS (SELECT st.user_id, st.window_id, i, j, CASE WHEN i > j THEN {_OF_PATCHES} ELSE d END AS value FROM st JOIN q l ON l.user_id = st.user_id AND l.window_id = st.window_id AND l.pos = i JOIN q r ON r.user_id = st.user_id AND r.window_id = st.window_id AND r.pos = j) " + _PER_WINDOW.format("value", "s"))
def patch_triangle(spark, sf_dir):
    return per_window(encodings.patch_triangle(recurrence.patch_pair(_scaled(spark, sf_dir), 4), KEY, 4), "value")


@query(f"WITH $EV, {_BOUNDS}, {_CHUNK}, {_PATCHES}, s AS (SELECT user_id, window_id, l.pos AS i, r.pos AS j, {_OF_PATCHES} AS value FROM q l JOIN q r USING (user_id, window_id)) " + _PER_WINDOW.format("value", "s"))
def patch_matrix(spark, sf_dir):
    p = recurrence.pairs(recurrence.patch_pair(_scaled(spark, sf_dir), 4), KEY)
    return per_window(p.withColumn("value", encodings.pair_share(4)), "value")


@query(f"WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')}, s AS (SELECT user_id, window_id, i, j, least(d, 1.0) - lag(least(d, 1.0)) OVER (PARTITION BY user_id, i, j ORDER BY window_id) AS diff FROM p), z AS (SELECT user_id, window_id, i, j, CAST(trunc((diff - min(diff) OVER w) / greatest(max(diff) OVER w - min(diff) OVER w, 1e-8) * 255) AS BIGINT) AS pixel FROM s WHERE diff IS NOT NULL WINDOW w AS (PARTITION BY user_id, window_id)) SELECT user_id, window_id, count(*) AS n, CAST(sum(pixel * (i * $SIZE + j + 1)) AS BIGINT) AS weighed FROM z GROUP BY ALL")
def srp_difference_bytes(spark, sf_dir):
    p = recurrence.difference_bytes(recurrence.clipped(chunks(spark, sf_dir), KEY), KEY)
    return p.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.sum(F.col("pixel").cast("long") * (F.col("i") * SIZE + F.col("j") + 1)).alias("weighed"))


@query(f"WITH $EV, {_CHUNK}, {_AXIS}, {_pairs_sql('n2')}, mi AS (SELECT user_id, window_id, i, sum(d) FILTER (i <> j) / (count(*) - 1) < 0.45 AS near FROM p GROUP BY ALL), w AS (SELECT user_id, window_id, count(*) FILTER (near) AS points FROM mi GROUP BY ALL) SELECT user_id, window_id, points, points * points AS recurrent, $SIZE * $SIZE AS n FROM w")
def srp_recurrent_points(spark, sf_dir):
    p = recurrence.gated(chunks(spark, sf_dir), KEY, 0.45)
    return p.groupBy("user_id", "window_id").agg(F.count_if(F.col("recurrent") & (F.col("i") == F.col("j"))).alias("points"), F.count_if("recurrent").alias("recurrent"), F.count("*").alias("n"))


@query(f"WITH k AS ({ORACLES['curvature']}), o AS ({ORACLES['angular_velocity']}), f AS (SELECT user_id, event_id, kappa, omega FROM k JOIN o USING (user_id, event_id)), z AS (SELECT user_id, event_id, {_CDF.format('kappa')}, {_CDF.format('omega')} FROM f) SELECT user_id, event_id, round(c_kappa, 6) AS c_kappa, round(c_omega, 6) AS c_omega FROM z")
def turning_stripes(spark, sf_dir):
    t = kinematics.angular_velocity(trajectories(spark, sf_dir), KEY)
    t = kinematics.curvature(t.withColumn("time", F.col("time") * 0.001), KEY).select("user_id", "event_id", F.round("kappa", 5).alias("kappa"), F.round("omega", 6).alias("omega"))
    return r6(ecdf.looked_up(t, ecdf.counted(t, ["kappa", "omega"]), {"kappa": "kappa", "omega": "omega"}), "c_kappa", "c_omega").select("user_id", "event_id", "c_kappa", "c_omega")


@query(f"WITH $EV, {_CHUNK}, {_LOCAL}, {_pairs_sql('n1')} SELECT count(*) FILTER (d <= 0.5) AS below, count(*) FILTER (d > 0.5) AS above, round(count(*) FILTER (d <= 0.5) / count(*), 6) AS ratio FROM p WHERE i <> j")
def recurrence_ratio(spark, sf_dir):
    return r6(recurrence.recurrence_counts(recurrence.pairs(recurrence.local_scale(chunks(spark, sf_dir), KEY), KEY), 0.5), "ratio")


@query("WITH $EV SELECT kind, CAST(least(greatest(round_even(x / 200 * 63, 0), 0), 63) AS BIGINT) AS px, CAST(least(greatest(round_even(y / 100 * 63, 0), 0), 63) AS BIGINT) AS py, count(*) AS n FROM ev GROUP BY ALL")
def pixel_occupancy(spark, sf_dir):
    return raster.occupancy(trajectories(spark, sf_dir), ["kind"], 200.0, 100.0, 64)


# ---------------------------------------------------------------- verification


@query("WITH $SC SELECT target, round(greatest(avg(label), 1e-6), 6) AS positive, round(greatest(1 - avg(label), 1e-6), 6) AS negative FROM sc GROUP BY 1")
def class_priors(spark, sf_dir):
    return r6(losses.class_priors(scores(spark, sf_dir), ["target"]), "positive", "negative")


@query("WITH $SC, p AS (SELECT target, greatest(avg(label), 1e-6) AS f1, greatest(1 - avg(label), 1e-6) AS f2 FROM sc GROUP BY 1), q AS (SELECT target, label, 1 / (1 + exp(-4 * score)) AS s FROM sc) SELECT target, round(avg(-(label / f1 * ln(s + 1e-6) + (1 - label) / f2 * ln(1 - s + 1e-6))), 6) AS loss FROM q JOIN p USING (target) GROUP BY 1")
def weighted_bce_value(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("score", scalars.sigmoid(4 * F.col("score")))
    return r6(losses.weighted_bce(s, ["target"]), "loss")


@query("WITH $SC, q AS (SELECT session, label, 60 * score AS z FROM sc), g AS (SELECT *, abs(1 / (1 + exp(-z)) - label) AS g, greatest(z, 0) - z * label + ln(1 + exp(-abs(z))) AS l, count(*) OVER (PARTITION BY session) AS n FROM q), b AS (SELECT *, n / (count(*) OVER (PARTITION BY session ORDER BY g RANGE BETWEEN 0.10005 PRECEDING AND 0.10005 FOLLOWING) / 0.10005 + 1e-12) AS beta FROM g) SELECT session, round(avg(beta * l), 5) AS loss, round(avg(l), 6) AS plain FROM b GROUP BY 1")
def ghm_density(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("logit", 60 * F.col("score"))
    out = losses.harmonised_bce(s, ["session"], 0.10005)
    return out.select("session", F.round("loss", 5).alias("loss"), F.round("plain", 6).alias("plain"))


_FUSE = "f AS (SELECT {0}, block, CAST(CAST(avg(score) AS FLOAT) AS DOUBLE) AS score, CAST(round_even(avg(label), 0) AS BIGINT) AS label FROM (SELECT *, (row_number() OVER (PARTITION BY {0} ORDER BY event_id) - 1) // {1} AS block FROM sc) GROUP BY ALL HAVING count(*) = {1})"


@query(f"WITH $SC, {_FUSE.format('target, session', 5)} SELECT target, session, block, round(score, 6) AS score, label FROM f")
def score_fusion_session(spark, sf_dir):
    return r6(scoring.fuse(scores(spark, sf_dir), ["target", "session"], 5, ["event_id"]), "score")


@query(f"WITH $SC, {_FUSE.format('target, label', 4).replace(', CAST(round_even(avg(label), 0) AS BIGINT) AS label', '')} SELECT target, label, block, round(score, 6) AS score FROM f")
def score_fusion_label(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("group", F.col("label"))
    return r6(scoring.fuse(s, ["target", "group"], 4, ["event_id"]).select("target", F.col("group").alias("label"), "block", "score"), "score")


_ROC = """k AS (SELECT target, score, sum(label) AS p, count(*) - sum(label) AS q FROM sc GROUP BY ALL), c AS (SELECT target, score, row_number() OVER w AS k, sum(q) OVER w / sum(q) OVER (PARTITION BY target) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY target) AS tpr FROM k WINDOW w AS (PARTITION BY target ORDER BY score DESC))"""


@query(f"WITH $SC, {_ROC} SELECT target, k, round(score, 3) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM c UNION ALL SELECT DISTINCT target, 0, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM c")
def roc_curve(spark, sf_dir):
    return scoring.roc(scores(spark, sf_dir), ["target"]).select("target", "k", F.round("threshold", 3).alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_AUC = "a AS (SELECT target, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2 AS r FROM sc) GROUP BY 1)"


@query(f"WITH $SC, {_AUC} SELECT target, round(auc, 9) AS auc FROM a")
def auc(spark, sf_dir):
    return scoring.auc(scores(spark, sf_dir), ["target"]).select("target", F.round("auc", 9).alias("auc"))


_EER = f"""{_ROC}, z AS (SELECT target, 0 AS k, 0.0 AS fpr, 0.0 AS tpr FROM k GROUP BY 1 UNION ALL SELECT target, k, fpr, tpr FROM c), l AS (SELECT *, 1 - fpr - tpr AS g, lead(fpr) OVER w AS f2, lead(1 - fpr - tpr) OVER w AS g2 FROM z WINDOW w AS (PARTITION BY target ORDER BY k)),
  e AS (SELECT target, arg_min(CASE WHEN f2 = fpr THEN fpr ELSE fpr + (f2 - fpr) * g / (g - g2) END, k) AS e FROM l WHERE g >= 0 AND g2 <= 0 AND (g > 0 OR g2 < 0) GROUP BY 1)"""


_THRESHOLD = """z2 AS (SELECT target, 0 AS k, NULL AS score, 0.0 AS fpr, 0.0 AS tpr FROM k GROUP BY 1 UNION ALL SELECT target, k, score, fpr, tpr FROM c), bd AS (SELECT *, (lead(fpr) OVER w - fpr) * (tpr - lag(tpr) OVER w) <> (lead(tpr) OVER w - tpr) * (fpr - lag(fpr) OVER w) AS bend FROM z2 WINDOW w AS (PARTITION BY target ORDER BY k)),
  th AS (SELECT target, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(1 - fpr - tpr), 12), k) AS r FROM bd WHERE k > 0 AND coalesce(bend, true)) WHERE r = 1)"""


@query(f"WITH $SC, {_EER}, {_AUC}, {_THRESHOLD} SELECT target, round(least(e, 1 - e), 9) AS eer, round(greatest(auc, 1 - auc), 9) AS auc, round(threshold, 3) AS threshold FROM e JOIN a USING (target) JOIN th USING (target)")
def eer(spark, sf_dir):
    return scoring.equal_error(scores(spark, sf_dir), ["target"]).select("target", F.round("eer", 9).alias("eer"), F.round("auc", 9).alias("auc"), F.round("threshold", 3).alias("threshold"))


@query("WITH $SC, m AS (SELECT target, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM sc GROUP BY 1), p AS (SELECT *, tp / (tp + fp + 1e-6) AS p, tp / (tp + fn + 1e-6) AS r FROM m) SELECT target, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-6), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM p")
def prf_at_threshold(spark, sf_dir):
    out = scoring.at_threshold(scores(spark, sf_dir), F.lit(0.5), ["target"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


def _curve_sql() -> str:
    parts = []
    for n in range(1, 16):
        fused = _FUSE.format("target, session", n)
        body = fused[fused.index("(") + 1 : -1]
        parts.append(f"SELECT {n} AS n, target, score, label FROM ({body})")
    every = " UNION ALL ".join(parts)
    tail = (_EER + ", " + _AUC).replace("target", "tn")
    return f"WITH $SC0, sc AS (SELECT target * 100 + n AS tn, score, label FROM ({every})), {tail} SELECT CAST(tn % 100 AS BIGINT) AS n, round(avg(CASE WHEN p > 0 AND p < m THEN least(coalesce(e, 0.5), 1 - coalesce(e, 0.5)) ELSE 0 END), 6) AS avg_eer, round(avg(CASE WHEN p > 0 AND p < m THEN greatest(auc, 1 - auc) ELSE 1 END), 6) AS avg_auc FROM (SELECT tn, sum(label) AS p, count(*) AS m FROM sc GROUP BY 1) LEFT JOIN e USING (tn) LEFT JOIN a USING (tn) GROUP BY 1".replace("$SC0", SQL_SCORES.replace("sc AS", "sc0 AS")).replace("FROM sc)", "FROM sc0)", 15)


@query(_curve_sql())
def fusion_curve_macro(spark, sf_dir):
    return r6(scoring.macro(scoring.fusion_curve(scores(spark, sf_dir), ["target"], ["session"], ["event_id"], range(1, 16))), "avg_eer", "avg_auc")


@query("WITH i AS (SELECT l_suppkey, l_partkey AS l, l_partkey + CAST(l_quantity AS BIGINT) AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY l_suppkey ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i), g AS (SELECT *, sum(CAST(before IS NULL OR l > before + 1 AS INT)) OVER (PARTITION BY l_suppkey ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS covered FROM (SELECT l_suppkey, island, max(r) - min(l) + 1 AS n FROM g GROUP BY ALL) GROUP BY 1")
def interval_coverage(spark, sf_dir):
    # DuckDB casts to the nearest whole number, halves to even; Spark cuts
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("l"), (F.col("l_partkey") + F.rint("l_quantity").cast("long")).alias("r"))
    return scoring.interval_cover(i, ["l_suppkey"], "l", "r")


@query("WITH i AS (SELECT l_suppkey, l_partkey AS l, l_partkey + CAST(l_quantity AS BIGINT) AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY l_suppkey ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i), g AS (SELECT *, sum(CAST(before IS NULL OR l > before + 1 AS INT)) OVER (PARTITION BY l_suppkey ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS island FROM m), c AS (SELECT l_suppkey, sum(n) AS covered FROM (SELECT l_suppkey, island, max(r) - min(l) + 1 AS n FROM g GROUP BY ALL) GROUP BY 1) SELECT round(avg(covered), 6) AS mean, median(covered) AS median FROM c")
def covered_summary(spark, sf_dir):
    return r6(scoring.cover_summary(interval_coverage(spark, sf_dir)), "mean")


_FOUR = "sc0 AS (SELECT u AS target, user_id, user_id AS session, event_id, event_id % 5 AS fold, round(value / (abs(value) + 50) - 0.1 * ((user_id + u) % 4), 3) AS score, CAST(user_id % 4 = u AS BIGINT) AS label FROM events, (SELECT unnest(range(0, 4)) AS u) {0})"


def _protocol_sql(source: str, fold: str, sizes) -> str:
    parts = " UNION ALL ".join(f"SELECT {n} AS n, target, fold, score, label FROM ({_FUSE.format(f'target, {fold} AS fold, session', n).split('(', 1)[1].rsplit(')', 1)[0].replace(f'PARTITION BY target, {fold} AS fold, session', f'PARTITION BY target, {fold}, session').replace('FROM sc)', 'FROM sc0)')})" for n in sizes)
    tail = (_EER + ", " + _AUC).replace("target", "tn")
    return f"WITH {source}, sc AS (SELECT (fold * 10 + target) * 100 + n AS tn, score, label FROM ({parts})), {tail}, each AS (SELECT tn % 100 AS n, tn // 1000 AS fold, CASE WHEN p > 0 AND p < m THEN least(coalesce(e, 0.5), 1 - coalesce(e, 0.5)) ELSE 0 END AS x, CASE WHEN p > 0 AND p < m THEN greatest(auc, 1 - auc) ELSE 1 END AS y FROM (SELECT tn, sum(label) AS p, count(*) AS m FROM sc GROUP BY 1) LEFT JOIN e USING (tn) LEFT JOIN a USING (tn)) SELECT CAST(n AS BIGINT) AS n, round(avg(x), 6) AS avg_eer, round(avg(y), 6) AS avg_auc FROM (SELECT n, fold, avg(x) AS x, avg(y) AS y FROM each GROUP BY ALL) GROUP BY 1"


def _four(spark, sf_dir, claimed: bool = False, contiguous: bool = False) -> DataFrame:
    """Scores of every event for four targets; or only for the target that it claims. contiguous: folds are ranges of a user's events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("user_id") % 4).alias("user"), (F.col("event_id") % 4).alias("claim"), (F.col("event_id") % 5).alias("fold"))
    if contiguous:
        from pyspark.sql import Window

        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
        e = sequence.folds(e.drop("fold").withColumn("seq", seq), KEY, 5).drop("seq")
    rows = scoring.one_vs_rest(e, "user", range(4), "claim" if claimed else None)
    return rows.withColumn("score", F.round(F.col("value") / (F.abs("value") + 50) - 0.1 * ((F.col("user_id") + F.col("target")) % 4), 3)).withColumn("session", F.col("user_id"))


@query(_protocol_sql(_FOUR.format(""), "0", range(1, 16)))
def protocol_multi_user(spark, sf_dir):
    return r6(scoring.macro(scoring.fusion_curve(_four(spark, sf_dir), ["target"], ["session"], ["event_id"], range(1, 16))), "avg_eer", "avg_auc")


@query(_protocol_sql(_FOUR.format("WHERE event_id % 4 = u"), "0", range(1, 16)))
def protocol_claimed_user(spark, sf_dir):
    return r6(scoring.macro(scoring.fusion_curve(_four(spark, sf_dir, claimed=True), ["target"], ["session"], ["event_id"], range(1, 16))), "avg_eer", "avg_auc")


_CONTIGUOUS = "(row_number() OVER (PARTITION BY u, user_id ORDER BY event_id) * 5 - 1) // count(*) OVER (PARTITION BY u, user_id) AS fold"


@query(_protocol_sql(_FOUR.format("").replace("event_id % 5 AS fold", _CONTIGUOUS), "fold", range(1, 16)))
def protocol_five_folds(spark, sf_dir):
    return r6(scoring.fold_means(_four(spark, sf_dir, contiguous=True), ["target"], ["session"], ["event_id"], range(1, 16)), "avg_eer", "avg_auc")


_FIVE_FOLDS = _protocol_sql(_FOUR.format("").replace("event_id % 5 AS fold", _CONTIGUOUS), "fold", range(1, 16))
_PER_FOLD = _FIVE_FOLDS.replace("SELECT CAST(n AS BIGINT) AS n, round(avg(x)", "SELECT CAST(fold AS BIGINT) AS fold, CAST(n AS BIGINT) AS n, round(avg(x)").removesuffix("GROUP BY 1") + "GROUP BY fold, n"


def _run_of_folds(spark, sf_dir, sizes) -> str:
    """The folder of a run over five contiguous folds that was stopped after two and continued."""
    path = shared.new_path(spark, "run")
    rows = shared.written(_four(spark, sf_dir, contiguous=True).select("fold", "target", "session", "event_id", "score", "label"), f"{path}-rows")
    for at_most in (2, None):
        runs.run_folds(spark, path, lambda k: rows.where(F.col("fold") == k), source=sf_dir, folds=5, sizes=sizes, order=["event_id"], at_most=at_most)
    shared.delete(spark, f"{path}-rows")
    return path


@query(_PER_FOLD)
def run_continued(spark, sf_dir):
    return r6(runs.summary(runs.per_target(spark, _run_of_folds(spark, sf_dir, range(1, 16)))), "avg_eer", "avg_auc")


@query(_PER_FOLD)
def run_reevaluated(spark, sf_dir):
    return r6(runs.summary(runs.reevaluated(spark, _run_of_folds(spark, sf_dir, [1]), range(1, 16))), "avg_eer", "avg_auc")


_HASH = "CAST('0x' || substr(md5('42|' || CAST({0} AS VARCHAR)), 1, 15) AS BIGINT)"
_SPLIT_SQL = f"al AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('event_id')}, event_id) <= floor(0.8 * count(*) OVER (PARTITION BY label)) AS is_train FROM sc1)"
_SC1 = SQL_SCORES.replace("sc AS", "sc1 AS")


def _split_scores(spark, sf_dir) -> DataFrame:
    """Scores of all users as one binary task, four fifths of each class for training."""
    return sampling.stratified(scores(spark, sf_dir), ["event_id"])


@query(_protocol_sql(f"{_SC1}, {_SPLIT_SQL}, sc0 AS (SELECT 0 AS target, 0 AS fold, label AS session, event_id, score, label FROM al WHERE NOT is_train)", "0", range(1, 50)))
def protocol_all_users(spark, sf_dir):
    test = _split_scores(spark, sf_dir).where("not is_train").withColumns({"target": F.lit(0).cast("long"), "group": F.col("label")})
    return r6(scoring.macro(scoring.fusion_curve(test, ["target"], ["group"], ["event_id"], range(1, 50))), "avg_eer", "avg_auc")


@query(f"WITH {_SC1}, {_SPLIT_SQL}, c AS (SELECT label, count(*) AS n FROM al WHERE is_train GROUP BY 1), m AS (SELECT max(n) AS most FROM c) SELECT label, most AS n, n AS n_keys, most // n AS fewest, CAST(ceil(most / n) AS BIGINT) AS mostly FROM c, m")
def balanced_training_rows(spark, sf_dir):
    train = _split_scores(spark, sf_dir).where("is_train").select("event_id", "label")
    copies = losses.balance(train, "label").groupBy("label", "event_id").agg(F.count("*").alias("m"))
    return copies.groupBy("label").agg(F.sum("m").alias("n"), F.count("*").alias("n_keys"), F.min("m").alias("fewest"), F.max("m").alias("mostly"))


@query(f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_HASH.format('o_orderkey')} LIMIT 500")
def exact_subsample(spark, sf_dir):
    return sampling.subsample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), 500, ["o_orderkey"])


@query("WITH $SC, m AS (SELECT count(*) AS n, count(*) FILTER ((score >= 0.5) = (label = 1)) AS good FROM sc) SELECT n, good, round(good / n, 9) AS accuracy FROM m")
def pooled_accuracy(spark, sf_dir):
    out = scoring.at_threshold(scores(spark, sf_dir), F.lit(0.5))
    return out.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), (F.col("tp") + F.col("tn")).alias("good"), F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_FOUR.format('')}, sc AS (SELECT * FROM sc0 WHERE fold > 0), {_ROC}, {_THRESHOLD}, m AS (SELECT sc0.target, count(*) FILTER (sc0.score >= threshold AND label = 1) AS tp, count(*) FILTER (sc0.score >= threshold AND label = 0) AS fp, count(*) FILTER (sc0.score < threshold AND label = 1) AS fn, count(*) FILTER (sc0.score < threshold AND label = 0) AS tn FROM sc0 JOIN th USING (target) WHERE fold = 0 GROUP BY 1) SELECT target, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM m")
def protocol_held_out_threshold(spark, sf_dir):
    s = _four(spark, sf_dir)
    known = scoring.equal_error(s.where("fold > 0"), ["target"])
    return scoring.at_own_threshold(s.where("fold = 0"), known, ["target"]).select("target", "tp", "fp", "fn", "tn", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT l.event_id, l.user_id AS session, l.event_type AS label, round(value, 6) AS score FROM events s JOIN events l USING (event_id) WHERE s.user_id % 2 = 0".replace("round(value", "round(s.value"))
def scores_with_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("user_id % 2 = 0").select("event_id", F.col("value").alias("score"))
    return r6(scoring.zipped(s, e.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("label")), ["event_id"]), "score").select("event_id", "session", "label", "score")


@query("SELECT o_orderkey, o_custkey, CAST(1 AS BIGINT) AS label, false AS is_imposter FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, CAST(0 AS BIGINT), true FROM orders WHERE o_orderstatus <> 'F'")
def union_genuine_imposter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    both = sessions.claimed(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))
    return both.select("o_orderkey", "o_custkey", "label", "is_imposter")


@query("WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(n) AS most FROM c) SELECT o_orderpriority, most AS n, n AS n_keys, most // n AS fewest, CAST(ceil(most / n) AS BIGINT) AS mostly FROM c, m")
def oversampled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    copies = losses.balance(o, "o_orderpriority").groupBy("o_orderpriority", "o_orderkey").agg(F.count("*").alias("m"))
    return copies.groupBy("o_orderpriority").agg(F.sum("m").alias("n"), F.count("*").alias("n_keys"), F.min("m").alias("fewest"), F.max("m").alias("mostly"))


@query(f"WITH $EV, d AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 8 HOUR AS new FROM (SELECT user_id, event_id, ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CAST(coalesce(new, false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM d) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 28800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    g = gap_sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "8 hours", "1 hour")
    return g.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH $EV, {_CHUNK}, v AS (SELECT user_id, window_id, CAST(sum(CAST(least(greatest(round_even(x / 200 * 63, 0), 0), 63) AS BIGINT) * (pos + 1)) AS BIGINT) AS weighed FROM c GROUP BY ALL) SELECT row_number() OVER (ORDER BY user_id, window_id) - 1 AS row, 'user' || user_id AS user, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, weighed FROM v")
def tensor_store(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("v", raster.pixel(F.col("x"), 200.0, 64))
    own = raster.gather(c, [*KEY, "window_id"], ["v"])
    samples = own.select(F.concat(F.lit("user"), "user_id").alias("user"), F.concat(F.lit("session_"), F.expr("window_id div 4")).alias("session"), F.col("window_id").alias("idx"), F.col("points.v").alias("values"))
    path = shared.new_path(spark, "tensors")
    tensors.write_tensors(shared.written(samples, f"{path}-samples"), path, [SIZE])
    shared.delete(spark, f"{path}-samples")
    weighed = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return tensors.read_tensors(spark, path).select("row", "user", "user_idx", weighed.alias("weighed"))


# ---------------------------------------------------------------- streams


@query(f"WITH RECURSIVE $EV, {_SPLIT}, {_ARC}, {_SPANS.replace('max(x) AS least', f'{streams.LEAST} AS least')}, {_MERGE} SELECT r.user_id, CAST(grp AS BIGINT) AS group_id, count(*) AS n, epoch_us(make_timestamp(CAST(min(t) * 1e6 AS BIGINT))) AS start_us, round(max(arc) - min(arc), 6) AS length, max(arc) - min(arc) >= {streams.LEAST} AS whole FROM r JOIN m ON m.user_id = r.user_id AND m.sid = r.sid GROUP BY ALL")
def stream_merge(spark, sf_dir):
    return r6(streams.merged(spark, sf_dir), "length").select("user_id", "group_id", "n", F.unix_micros("start").alias("start_us"), "length", "whole")


@query("WITH $EV, w AS (SELECT user_id, seq, n, avg(x) OVER k AS mean, max(t) OVER k AS last FROM ev WINDOW k AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT user_id, seq // 2 AS window_id, round(mean, 6) AS mean, round(last, 3) AS last FROM w WHERE seq % 2 = 0 AND seq + 8 <= n")
def stream_sliding(spark, sf_dir):
    return r6(streams.windows(spark, sf_dir, 8, 2), "mean").select("user_id", "window_id", "mean", F.round(F.unix_micros("end") / 1e6, 3).alias("last"))


@query("SELECT event_id, user_id, round(value, 6) AS x FROM events")
def stream_once(spark, sf_dir):
    return r6(streams.once(spark, sf_dir), "x").select("event_id", "user_id", "x")


# ---------------------------------------------------------------- images (rows only)


def _points(spark, sf_dir) -> DataFrame:
    t = kinematics.speed(kinematics.velocity(chunks(spark, sf_dir, 16), ["user_id", "window_id"], "copy"), ["user_id", "window_id"], "copy")
    return raster.gather(t, ["user_id", "window_id"], ["x", "y", "v", "vx", "vy"])


@query()
def raster_polyline(spark, sf_dir):
    return raster.render(_points(spark, sf_dir), lambda p: raster.polyline(raster.centred(p, 64), 64, thickness=2), ["x", "y"])


@query()
def raster_velocity(spark, sf_dir):
    """PNG files of strokes coloured (0, vx, vy) by their ECDF values."""
    import numpy as np

    def draw(m, lengths):
        path = np.repeat(np.arange(len(lengths)), lengths)
        own = m[1:, 2:][path[1:] == path[:-1]]
        colours = np.concatenate([np.zeros((len(own), 1)), own], 1).astype(np.float32)
        return raster.polylines(raster.centred_all(m[:, :2], lengths, 64), lengths, 64, np.clip(colours * 255, 0, 255).astype(np.uint8), 2)

    points = raster.gather(_features(spark, sf_dir, "vx", "vy"), ["user_id", "window_id"], ["x", "y", "c_vx", "c_vy"])
    return raster.render_png(points, draw, ["x", "y", "c_vx", "c_vy"])


_PLACES = {
    "raster_screen": ("x * (64 / greatest(200.0, 100.0)) + (64 - 200.0 * (64 / greatest(200.0, 100.0))) / 2", "y * (64 / greatest(200.0, 100.0)) + (64 - 100.0 * (64 / greatest(200.0, 100.0))) / 2", lambda t: raster.screen_place(t, 200.0, 100.0, 64)),
    "raster_width": ("x * (64 / 200.0)", "y * (64 / 200.0)", lambda t: raster.screen_place(t, 200.0, 100.0, 64, how="width")),
    "raster_boxed": ("(x - (min(x) OVER k + max(x) OVER k) / 2) * (64 * 0.9 / greatest(max(x) OVER k - min(x) OVER k, max(y) OVER k - min(y) OVER k, 1e-8)) + 32", "(y - (min(y) OVER k + max(y) OVER k) / 2) * (64 * 0.9 / greatest(max(x) OVER k - min(x) OVER k, max(y) OVER k - min(y) OVER k, 1e-8)) + 32", lambda t: raster.boxed_place(t, [*KEY, "window_id"], 64)),
    "raster_recentred": ("(x - (min(x) OVER k + max(x) OVER k) / 2 + 100) * (64 / 200.0)", "(y - (min(y) OVER k + max(y) OVER k) / 2 + 50) * (64 / 200.0) + 16", lambda t: raster.recentred_place(t, [*KEY, "window_id"], 200.0, 100.0, 64)),
}


def _placed_query(name: str) -> None:
    x, y, place = _PLACES[name]

    def run(spark, sf_dir):
        return r6(place(chunks(spark, sf_dir)).select("user_id", "event_id", "px", "py"), "px", "py")

    run.__name__ = name
    query(f"WITH $EV, {_CHUNK} SELECT user_id, event_id, round({x}, 6) + 0.0 AS px, round({y}, 6) + 0.0 AS py FROM c WINDOW k AS (PARTITION BY user_id, window_id)")(run)


for _name in _PLACES:
    _placed_query(_name)


@query(f"WITH $EV, {_BOUNDS}, {_CHUNK}, u AS (SELECT c.user_id, event_id, x - min_x AS x, y - min_y AS y, max_x - min_x AS w, max_y - min_y AS h FROM c JOIN b USING (user_id)) SELECT user_id, event_id, round(x * (64 / greatest(w, h)) + (64 - w * (64 / greatest(w, h))) / 2, 6) + 0.0 AS px, round(y * (64 / greatest(w, h)) + (64 - h * (64 / greatest(w, h))) / 2, 6) + 0.0 AS py FROM u")
def raster_user_screen(spark, sf_dir):
    t = _scaled(spark, sf_dir)
    moved = t.withColumns({"w": F.col("max_x") - F.col("min_x"), "h": F.col("max_y") - F.col("min_y"), "x": F.col("x") - F.col("min_x"), "y": F.col("y") - F.col("min_y")})
    return r6(raster.screen_place(moved, F.col("w"), F.col("h"), 64).select("user_id", "event_id", "px", "py"), "px", "py")


@query()
def heatmap(spark, sf_dir):
    return raster.render(_points(spark, sf_dir), lambda p: raster.heat(raster.centred(p, 48), 48), ["x", "y"])


# ---------------------------------------------------------------- strokes as pixel rows

_DRAWN = """sg AS (SELECT *, lag(px) OVER w AS ax, lag(py) OVER w AS ay FROM pt WINDOW w AS (PARTITION BY user_id, window_id ORDER BY seq)),
    ln AS (SELECT *, unnest(range(0, CAST(greatest(abs(px - ax), abs(py - ay)) AS BIGINT) + 1)) AS k, greatest(abs(px - ax), abs(py - ay), 1) AS len FROM sg WHERE ax IS NOT NULL),
    pl AS (SELECT *, CAST(round_even(ax + (px - ax) * k / len, 0) AS BIGINT) AS qx, CAST(round_even(ay + (py - ay) * k / len, 0) AS BIGINT) AS qy FROM ln),
    o AS (SELECT user_id, window_id, qx, qy, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b FROM pl WHERE qx BETWEEN 0 AND 63 AND qy BETWEEN 0 AND 63 GROUP BY ALL)
    SELECT user_id, CAST(window_id AS BIGINT) AS window_id, count(*) AS n, CAST(sum(qx + 64 * qy) AS BIGINT) AS places, """ + ", ".join(f"CAST(sum({c} * (qx + 64 * qy + 1)) AS BIGINT) AS {c}" for c in "rgb") + " FROM o GROUP BY ALL"


def per_window_pixels(p: DataFrame) -> DataFrame:
    at = F.col("qx") + 64 * F.col("qy")
    return p.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.sum(at).alias("places"), *(F.sum(F.col(c) * (at + 1)).alias(c) for c in "rgb"))


def _dt_prev(t: DataFrame, by) -> DataFrame:
    return t.withColumn("dt", F.round(F.greatest(F.col("time") - F.lag("time").over(sequence.ordered(by)), F.lit(1e-5)), 6))


_NEAR = "CAST(least(greatest(round_even({0} * 255, 0), 0), 255) AS BIGINT)"
_CUT_BYTE = "CAST(least(greatest(trunc({0} * 255), 0), 255) AS BIGINT)"


def _plasma_sql(k: int) -> str:
    table = "[" + ", ".join(f"{c[k]}.0" for c in strokes.PLASMA) + "]"
    at, i = f"(least(greatest(c_v, 0.0), 1.0) * {len(strokes.PLASMA) - 1})", f"CAST(least(floor(least(greatest(c_v, 0.0), 1.0) * {len(strokes.PLASMA) - 1}), {len(strokes.PLASMA) - 2}) AS BIGINT)"
    return f"CAST(trunc({table}[{i} + 1] + ({table}[{i} + 2] - {table}[{i} + 1]) * ({at} - {i})) AS BIGINT)"


_COLOURS = {
    "plain": ("0", "0", "0"),
    "speed": ("0", _NEAR.format("c_v"), _NEAR.format("c_v")),
    "velocity": ("0", _NEAR.format("c_vx"), _NEAR.format("c_vy")),
    "plasma": tuple(_plasma_sql(k) for k in range(3)),
    "grey": (_CUT_BYTE.format("(0.8 * c_v)"),) * 3,
    "interval": (_CUT_BYTE.format("(0.8 * c_dt)"),) * 3,
    "two": (_CUT_BYTE.format("c_vx"), _CUT_BYTE.format("c_vy"), "0"),
    "three": (_CUT_BYTE.format("c_vx"), _CUT_BYTE.format("c_vy"), _CUT_BYTE.format("c_dt")),
}
_NEEDED = {"plain": (), "speed": ("v",), "velocity": ("vx", "vy"), "plasma": ("v",), "grey": ("v",), "interval": ("dt",), "two": ("vx", "vy"), "three": ("vx", "vy", "dt")}
_RGB_OF = lambda kind: ", ".join(f"{e} AS {c}" for e, c in zip(_COLOURS[kind], "rgb", strict=True))

#: Sequences that strokes are drawn over: SQL up to e0 (user_id, window_id, seq, t, x, y), and the same of the events.
_OVER = {
    "chunk": (f"WITH $EV, {_CHUNK}, e0 AS (SELECT * FROM c)", lambda spark, sf_dir: chunks(spark, sf_dir)),
    "merged": (
        f"WITH RECURSIVE $EV, {_SPLIT}, {_ARC}, {_SPANS}, {_MERGE}, e0 AS (SELECT * FROM (SELECT g.user_id, grp AS window_id, g.seq, g.t, g.x, g.y, count(*) OVER (PARTITION BY g.user_id, grp) AS len FROM g JOIN m ON m.user_id = g.user_id AND m.sid = g.sid) WHERE len >= 2)",
        lambda spark, sf_dir: sequence.renumbered(merged(spark, sf_dir), KEY, "group_id").where("_n >= 2").drop("_n"),
    ),
}
_EACH = "(PARTITION BY user_id, window_id ORDER BY seq)"
_STROKE_FEATURES = (
    f"""f1 AS (SELECT *, greatest(t - lag(t) OVER w, 1e-5) AS h, (x - lag(x) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS p, (y - lag(y) OVER w) / greatest(t - lag(t) OVER w, 1e-5) AS q, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / greatest(t - lag(t) OVER w, 1e-5) AS s FROM e0 WINDOW w AS {_EACH}),
    fc AS (SELECT user_id, window_id, seq, x, y, round(coalesce(s, lead(s) OVER w, 0), 6) + 0.0 AS v, round(coalesce(p, lead(p) OVER w, 0), 6) + 0.0 AS vx, round(coalesce(q, lead(q) OVER w, 0), 6) + 0.0 AS vy, round(h, 6) AS dt FROM f1 WINDOW w AS {_EACH}),
    cd AS (SELECT dt, min(cdf) AS c_dt FROM (SELECT dt, (rank() OVER (ORDER BY dt) + (count(*) OVER (PARTITION BY dt) - 1) / 2 - 1) / (count(*) OVER () - 1 + 1e-8) AS cdf FROM fc WHERE dt IS NOT NULL) GROUP BY 1),
    ft AS (SELECT user_id, window_id, seq, x, y, c_dt, """
    + ", ".join(_CDF.format(c) for c in ("v", "vx", "vy"))
    + " FROM fc LEFT JOIN cd USING (dt))"
)
_BOX = """bx AS (SELECT *, min(x) OVER k AS lx, min(y) OVER k AS ly, greatest(max(x) OVER k - min(x) OVER k, 1.0) AS sx, greatest(max(y) OVER k - min(y) OVER k, 1.0) AS sy, max(x) OVER k - min(x) OVER k AS rx, max(y) OVER k - min(y) OVER k AS ry FROM ft WINDOW k AS (PARTITION BY user_id, window_id)),
    sc AS (SELECT *, rx + 0.1 * sx AS wx, ry + 0.1 * sy AS wy, least(64 / (rx + 0.1 * sx), 64 / (ry + 0.1 * sy)) AS scale FROM bx)"""
#: Where they are drawn: SQL of px and py over ft, and the same of the events.
_AT = {
    "screen": ("", "round_even(x * (64 / 200.0), 0)", "round_even(y * (64 / 200.0) + 16, 0)", "ft", lambda t, own: raster.screen_place(t, 200.0, 100.0, 64), False),
    "user": (
        f", {_BOUNDS}, us AS (SELECT ft.*, min_x, min_y, max_x - min_x AS w, max_y - min_y AS h FROM ft JOIN b USING (user_id))",
        "round_even((x - min_x) * (64 / greatest(w, h)) + (64 - w * (64 / greatest(w, h))) / 2, 0)",
        "round_even((y - min_y) * (64 / greatest(w, h)) + (64 - h * (64 / greatest(w, h))) / 2, 0)",
        "us",
        lambda t, own: _user_place(t, own),
        False,
    ),
    "boxed": (f", {_BOX}", "trunc((x - lx + 0.05 * sx) * scale + (64 - wx * scale) / 2)", "trunc((y - ly + 0.05 * sy) * scale + (64 - wy * scale) / 2)", "sc", lambda t, own: strokes.padded_place(t, [*KEY, "window_id"], 64), True),
}


def _user_place(t: DataFrame, own: DataFrame) -> DataFrame:
    t = bounds.with_bounds(t, own, KEY)
    moved = t.withColumns({"w": F.col("max_x") - F.col("min_x"), "h": F.col("max_y") - F.col("min_y"), "x": F.col("x") - F.col("min_x"), "y": F.col("y") - F.col("min_y")})
    return raster.screen_place(moved, F.col("w"), F.col("h"), 64)


def _stroked(name: str, over: str, where: str, kind: str) -> None:
    """Register the pixels of strokes over ``over``, placed as ``where``, coloured by ``kind``."""
    by = [*KEY, "window_id"]
    head, of = _OVER[over]
    more, x, y, source, place, cut = _AT[where]

    def run(spark, sf_dir):
        t = _dt_prev(of(spark, sf_dir), by)
        t = r6(kinematics.velocity(kinematics.speed(t, by, "copy"), by, "copy"), "v", "vx", "vy") if _NEEDED[kind] else t
        names = _NEEDED[kind]
        t = ecdf.looked_up(t, ecdf.counted(t, names), {n: n for n in names}) if names else t
        t = place(t, bounds.user_bounds(trajectories(spark, sf_dir), KEY)).withColumns(strokes.colours(kind))
        return per_window_pixels(strokes.pixels(t, by, 64, "rgb", cut=cut))

    run.__name__ = name
    query(f"{head}, {_STROKE_FEATURES}{more}, pt AS (SELECT user_id, window_id, seq, {x} AS px, {y} AS py, {_RGB_OF(kind)} FROM {source}), {_DRAWN}")(run)


for _over, _where, _kind in (
    ("chunk", "user", "speed"),
    ("chunk", "user", "velocity"),
    *(("chunk", "boxed", k) for k in ("plain", "plasma", "grey", "interval", "two", "three")),
    ("merged", "user", "plain"),
    ("merged", "screen", "plain"),
    ("merged", "boxed", "plain"),
    ("merged", "user", "speed"),
    ("merged", "user", "velocity"),
    ("merged", "boxed", "speed"),
    ("merged", "boxed", "velocity"),
):
    _stroked(f"strokes_{_over}_{_where}_{_kind}", _over, _where, _kind)


# ---------------------------------------------------------------- spectra


def _spectra(spark, sf_dir, columns, scaling: str) -> DataFrame:
    w = [*KEY, "window_id"]
    t = kinematics.component_acceleration(kinematics.acceleration(chunks(spark, sf_dir, 16), w, "copy"), w)
    made = spectral.stacked(raster.gather(t, w, columns), lambda x: spectral.log_spectrogram(x, scaling=scaling), columns)
    cells = F.arrays_zip(*(f"cells_{c}" for c in columns))
    out = made.select(*w, "cols", F.posexplode(cells).alias("at", "z"))
    return r6(out.select(*w, F.expr("at div cols").alias("k"), (F.col("at") % F.col("cols")).cast("long").alias("part"), *(F.col(f"z.cells_{c}").alias(c) for c in columns)), *columns)


#: Tapers of segments of ten points, their norms, and the transform: SQL from fe (user_id, window_id, pos, columns).
_TAPER = "tp AS (SELECT i, CASE WHEN least(i / 10, 1 - i / 10) * 8 < 1 THEN 0.5 * (1 - cos(pi() * least(i / 10, 1 - i / 10) * 8)) ELSE 1.0 END AS w FROM (SELECT unnest(range(0, 10)) AS i)), tn AS (SELECT sum(w) AS spectrum, sqrt(sum(w * w)) AS density FROM tp)"


def _spectra_sql(columns, scaling: str) -> str:
    wide = _FEATURES[: _FEATURES.index("fc AS (")].replace("FROM c WINDOW", "FROM c16 WINDOW")
    acc = "fe AS (SELECT user_id, window_id, pos, v, vx, vy, coalesce((v - lag(v) OVER w) / h, 0) AS a, coalesce((vx - lag(vx) OVER w) / h, 0) AS ax, coalesce((vy - lag(vy) OVER w) / h, 0) AS ay FROM fb WINDOW w AS (PARTITION BY user_id, window_id ORDER BY pos))"
    one = lambda c: f"CASE WHEN {c} = 0 THEN 0 ELSE sign({c}) * ln(1 + abs({c})) END AS {c}"
    parts = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY user_id, window_id, part) AS {c}" for c in columns)
    sums = ", ".join(f"round(ln(1 + sqrt(power(sum({c} * w * cos(2 * pi() * k * i / 10)), 2) + power(sum({c} * w * sin(2 * pi() * k * i / 10)), 2)) / max({scaling})), 6) + 0.0 AS {c}" for c in columns)
    return f"""WITH $EV, c16 AS (SELECT *, seq // 16 AS window_id, seq % 16 AS pos FROM ev WHERE (seq // 16 + 1) * 16 <= n), {wide} {acc}, {_TAPER},
    lg AS (SELECT user_id, window_id, pos, {', '.join(map(one, columns))} FROM fe),
    sg AS (SELECT *, pos - 5 * part AS i FROM lg, (SELECT unnest([0, 1]) AS part) WHERE pos - 5 * part BETWEEN 0 AND 9),
    mf AS (SELECT user_id, window_id, part, i, {parts} FROM sg)
    SELECT user_id, window_id, CAST(k AS BIGINT) AS k, CAST(part AS BIGINT) AS part, {sums} FROM mf JOIN tp USING (i), tn, (SELECT unnest(range(0, 6)) AS k) GROUP BY ALL"""


def _spectrogram(name: str, columns, scaling: str) -> None:
    def run(spark, sf_dir):
        return _spectra(spark, sf_dir, columns, scaling)

    run.__name__ = name
    query(_spectra_sql(columns, scaling))(run)


_spectrogram("spectrogram_speed", ["v"], "spectrum")
_spectrogram("spectrogram_velocity", ["v", "vx", "vy"], "density")
_spectrogram("spectrogram_acceleration", ["a", "ax", "ay"], "spectrum")


@query(f"SELECT min(v) AS global_min, max(v) AS global_max, count(*) AS n FROM ({_spectra_sql(['v'], 'spectrum')})")
def spectrogram_bounds(spark, sf_dir):
    return r6(spectral.global_bounds(spectral.matrices(_points(spark, sf_dir), spectral.log_spectrogram, "v")), "global_min", "global_max")


_SIDE = 16


def _traces(spark, sf_dir) -> DataFrame:
    """Windows with their pixels on a square of _SIDE, and the split that they are of."""
    by = [*KEY, "window_id"]
    t = strokes.padded_place(chunks(spark, sf_dir), by, _SIDE).withColumn("ink", F.lit(1))
    p = strokes.pixels(t, by, _SIDE, ["ink"], cut=True)
    return p.groupBy(*by).agg(F.collect_list(F.struct("qx", "qy")).alias("pixels")).withColumn("split", F.col("user_id") % 2)


def _log_fourier(batch):
    return map(spectral.fourier, spectral.pixel_images(_SIDE)(batch))


_TRACE_SQL = (
    f"WITH $EV, {_CHUNK}, ft AS (SELECT * FROM c), {_BOX}, pt AS (SELECT user_id, window_id, seq, {_AT['boxed'][1]} AS px, {_AT['boxed'][2]} AS py, 0 AS r, 0 AS g, 0 AS b FROM sc), {_DRAWN[: _DRAWN.index('SELECT user_id, CAST(window_id')]}".replace("64", str(_SIDE)).replace("BETWEEN 0 AND 63", f"BETWEEN 0 AND {_SIDE - 1}")
    + f""", fq AS (SELECT i, j FROM (SELECT unnest(range(0, {_SIDE})) AS i), (SELECT unnest(range(0, {_SIDE})) AS j)),
    dm AS (SELECT user_id, window_id, i, j, CASE WHEN i = 0 AND j = 0 THEN 0 ELSE ln(1 + sqrt(power(sum(cos(2 * pi() * (i * qy + j * qx) / {_SIDE})), 2) + power(sum(sin(2 * pi() * (i * qy + j * qx) / {_SIDE})), 2))) END AS m FROM o, fq GROUP BY user_id, window_id, i, j),
    gb AS (SELECT user_id % 2 AS split, min(m) AS lo, max(m) AS hi, count(DISTINCT (user_id, window_id)) AS n FROM dm GROUP BY 1)"""
)


@query(_TRACE_SQL + " SELECT split, round(lo, 6) AS global_min, round(hi, 6) AS global_max, n FROM gb")
def fft_bounds(spark, sf_dir):
    return r6(spectral.image_bounds(_traces(spark, sf_dir), _log_fourier, ["split"]), "global_min", "global_max")


@query(_TRACE_SQL + f", pl2 AS (SELECT user_id, window_id, (i + {_SIDE // 2}) % {_SIDE} AS y, (j + {_SIDE // 2}) % {_SIDE} AS x, least(greatest((m - lo) / greatest(hi - lo, 1e-8), 0), 1) AS z FROM dm JOIN gb ON gb.split = user_id % 2) SELECT user_id, window_id, count(*) AS n, round(sum(z * (({_SIDE} - 1 - y) * {_SIDE} + x + 1)), 3) AS weighed FROM pl2 GROUP BY ALL")
def fft_logmag(spark, sf_dir):
    t = _traces(spark, sf_dir)
    made = spectral.scaled_images(t.join(F.broadcast(spectral.image_bounds(t, _log_fourier, ["split"]).drop("n")), "split"), _log_fourier)
    cells = made.select("user_id", "window_id", F.posexplode("cells").alias("at", "z"))
    return cells.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("z") * (F.col("at") + 1)), 3).alias("weighed"))
