"""The library's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import pareto, paths, pools, regret, splits, stats
from ..session import table
from ..sources.runs import REFERENCE, runs_view
from . import coverage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_view(table(spark, d, "lineitem"))


def _configs(spark: SparkSession) -> DataFrame:
    return spark.range(1, 8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("config_id"))


def _applicable(spark: SparkSession) -> DataFrame:
    rows = [(f"c{k}", v) for k in range(1, 8) for v in (0, 1) if (k, v) != (7, 0)]
    return spark.createDataFrame(rows, "config_id string, vehicle_index long")


def _regrets(spark: SparkSession, d: str) -> DataFrame:
    return regret.regrets(_runs(spark, d), _applicable(spark))


_RUNS = f"""WITH raw AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber AS ln, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS v,
 count(*) AS n, min(l_extendedprice) AS a, min(l_quantity) + 1.0 AS c FROM lineitem GROUP BY ALL),
runs0 AS (SELECT CAST(l_suppkey AS VARCHAR) AS field_id, concat_ws(':', l_suppkey, l_returnflag, l_linestatus) AS instance_id, 'c' || ln AS config_id, CAST(v AS BIGINT) AS vehicle_index,
 CASE WHEN (ln = 7 AND v = 0) OR n % 5 = 3 OR n % 13 = 5 THEN 'not_applicable' WHEN n % 7 = 4 THEN 'timeout' WHEN n % 11 = 6 THEN 'collision' ELSE 'ok' END AS runstatus,
 CASE WHEN ln = 7 AND v = 0 THEN 'needs a reverse gear' WHEN n % 5 = 3 THEN 'validator_rejected:outside_area' WHEN n % 13 = 5 THEN 'the headland leaves nothing' END AS failure_reason, a, n, c FROM raw),
runs AS (SELECT field_id, instance_id, config_id, vehicle_index, runstatus, failure_reason, CASE WHEN starts_with(failure_reason, 'validator_rejected:') THEN substr(failure_reason, 20) ELSE runstatus END AS status,
 CASE WHEN runstatus = 'ok' THEN CAST(a AS DOUBLE) END AS path_length, CASE WHEN runstatus = 'ok' THEN CAST(n AS DOUBLE) END AS headland_turns, CASE WHEN runstatus = 'ok' THEN CAST(c AS DOUBLE) END AS row_crossings,
 {REFERENCE["path_length"]}::DOUBLE AS ref_path_length, {REFERENCE["headland_turns"]}::DOUBLE AS ref_headland_turns, {REFERENCE["row_crossings"]}::DOUBLE AS ref_row_crossings FROM runs0),
ok AS (SELECT * FROM runs WHERE status = 'ok'),
front AS (SELECT * FROM ok x WHERE NOT EXISTS (SELECT 1 FROM ok y WHERE y.instance_id = x.instance_id AND y.path_length <= x.path_length AND y.headland_turns <= x.headland_turns AND y.row_crossings <= x.row_crossings
 AND (y.path_length < x.path_length OR y.headland_turns < x.headland_turns OR y.row_crossings < x.row_crossings))),
sizes AS (SELECT field_id, instance_id, vehicle_index, count(*) FILTER (status = 'ok') AS effective_pool, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM front f WHERE f.instance_id = r.instance_id) AS front_size FROM runs r GROUP BY ALL)
"""
_BOX = """, pts AS (SELECT * FROM {source} WHERE path_length < ref_path_length AND headland_turns < ref_headland_turns AND row_crossings < ref_row_crossings),
xs AS (SELECT instance_id, x, lead(x) OVER (PARTITION BY instance_id ORDER BY x) AS x2 FROM (SELECT DISTINCT instance_id, path_length AS x FROM pts UNION SELECT DISTINCT instance_id, ref_path_length FROM pts)),
ys AS (SELECT instance_id, y, lead(y) OVER (PARTITION BY instance_id ORDER BY y) AS y2 FROM (SELECT DISTINCT instance_id, headland_turns AS y FROM pts UNION SELECT DISTINCT instance_id, ref_headland_turns FROM pts)),
zs AS (SELECT instance_id, z, lead(z) OVER (PARTITION BY instance_id ORDER BY z) AS z2 FROM (SELECT DISTINCT instance_id, row_crossings AS z FROM pts UNION SELECT DISTINCT instance_id, ref_row_crossings FROM pts)),
vol AS (SELECT xs.instance_id, sum((x2 - x) * (y2 - y) * (z2 - z)) AS hv FROM xs JOIN ys USING (instance_id) JOIN zs USING (instance_id) WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND z2 IS NOT NULL
 AND EXISTS (SELECT 1 FROM pts p WHERE p.instance_id = xs.instance_id AND p.path_length <= x AND p.headland_turns <= y AND p.row_crossings <= z) GROUP BY ALL)
"""
_VOLUME = _BOX.format(source="front")
_INNER = """, inner0 AS (SELECT *, path_length >= ref_path_length OR headland_turns >= ref_headland_turns OR row_crossings >= ref_row_crossings AS beyond FROM ok),
inner_front AS (SELECT * FROM inner0 x WHERE NOT beyond AND NOT EXISTS (SELECT 1 FROM inner0 y WHERE NOT y.beyond AND y.instance_id = x.instance_id AND y.path_length <= x.path_length AND y.headland_turns <= x.headland_turns AND y.row_crossings <= x.row_crossings
 AND (y.path_length < x.path_length OR y.headland_turns < x.headland_turns OR y.row_crossings < x.row_crossings)))
""" + _BOX.format(source="inner_front")  # fmt: skip
_GRID = ", prefs(preference, w1, w2, w3) AS (VALUES " + ", ".join(f"({k}::BIGINT, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, (a, b, c) in enumerate(regret.grid())) + ")"
_REGRET = _GRID + """, scored AS (SELECT field_id, instance_id, config_id, vehicle_index, preference, status, CASE WHEN status = 'ok' THEN greatest(w1 * (path_length / ref_path_length), w2 * (headland_turns / ref_headland_turns), w3 * (row_crossings / ref_row_crossings)) END AS score FROM runs CROSS JOIN prefs),
reg AS (SELECT *, coalesce(score - min(score) OVER w, max(score) OVER w - min(score) OVER w + 1) AS regret, NOT (config_id = 'c7' AND vehicle_index = 0) AS applicable FROM scored WINDOW w AS (PARTITION BY instance_id, preference)),
losses AS (SELECT field_id, config_id, avg(loss) AS loss, count(*) AS n_instances FROM (SELECT field_id, instance_id, config_id, avg(regret) AS loss FROM reg WHERE regret IS NOT NULL GROUP BY ALL) GROUP BY ALL)
"""  # fmt: skip
_FOLDS = """, folds AS (SELECT field_id, (row_number() OVER (ORDER BY sha256('20260822' || chr(31) || field_id), field_id) - 1) % 10 + 1 AS fold FROM (SELECT DISTINCT field_id FROM runs))
"""


@query(_RUNS + "SELECT * EXCLUDE (status) FROM runs")
def runs_matrix(spark, d):
    return _runs(spark, d)


@query(_RUNS + "SELECT instance_id, config_id, status FROM runs")
def derived_status(spark, d):
    return pareto.with_status(_runs(spark, d)).select("instance_id", "config_id", "status")


@query(_RUNS + "SELECT runstatus, status, count(*) AS n FROM runs GROUP BY ALL")
def status_counts(spark, d):
    return pools.status_counts(_runs(spark, d))


@query(_RUNS + "SELECT runstatus || '->' || status AS change, count(*) AS n FROM runs WHERE runstatus <> status GROUP BY ALL")
def status_differences(spark, d):
    return pools.status_differences(_runs(spark, d))


@query(_RUNS + "SELECT instance_id, config_id, CASE WHEN status IN ('ok', 'timeout', 'memout', 'not_applicable', 'crash') THEN status ELSE 'other' END AS exchange_status FROM runs")
def exchange_status(spark, d):
    from ..functions.status import exchange_status as of

    return pareto.with_status(_runs(spark, d)).select("instance_id", "config_id", of(F.col("status")).alias("exchange_status"))


@query(_RUNS + """SELECT instance_id, count(*) AS n_rows, count(DISTINCT config_id) AS n_configs, 0::BIGINT AS n_foreign, 7 - count(DISTINCT config_id) AS n_missing, count(*) = 7 AND count(DISTINCT config_id) = 7 AS complete FROM runs GROUP BY ALL""")
def completeness(spark, d):
    return pareto.completeness(_runs(spark, d), _configs(spark))


@query(_RUNS + "SELECT instance_id, config_id, path_length, headland_turns, row_crossings FROM front")
def pareto_front(spark, d):
    return pareto.front(pareto.points(_runs(spark, d))).select("instance_id", "config_id", "path_length", "headland_turns", "row_crossings")


@query(_RUNS + "SELECT * FROM sizes")
def front_sizes(spark, d):
    return pareto.front_sizes(_runs(spark, d))


@query(_RUNS + "SELECT field_id, count(*) AS n_instances, count(front_size) AS n_front_instances, median(front_size)::DOUBLE AS median_front_size, median(coalesce(front_size, 0))::DOUBLE AS median_zero_as_zero FROM sizes GROUP BY ALL")
def field_estimates(spark, d):
    return pareto.field_estimates(pareto.front_sizes(_runs(spark, d)))


@query(_RUNS + _VOLUME + "SELECT f.instance_id, round(coalesce(hv, 0.0), 4) AS hypervolume, round(coalesce(hv, 0.0) / (120000.0 * 60 * 60), 12) AS normalized FROM (SELECT DISTINCT instance_id FROM front) f LEFT JOIN vol USING (instance_id)")
def hypervolume(spark, d):
    h = pareto.hypervolumes(pareto.front(pareto.points(_runs(spark, d))))
    return h.select("instance_id", F.round("hypervolume", 4).alias("hypervolume"), F.round("normalized", 12).alias("normalized"))


@query(_RUNS + _INNER + """SELECT instance_id, n_beyond, n_points, front_size, round(hv, 4) AS hypervolume FROM (SELECT instance_id, count(*) FILTER (beyond) AS n_beyond, count(*) AS n_points FROM inner0 GROUP BY ALL)
 JOIN (SELECT instance_id, count(*) AS front_size FROM inner_front GROUP BY ALL) USING (instance_id) JOIN vol USING (instance_id)""")
def front_evaluation(spark, d):
    return pareto.front_evaluation(_runs(spark, d)).select("instance_id", "n_beyond", "n_points", "front_size", F.round("hypervolume", 4).alias("hypervolume"))


@query(_RUNS + _VOLUME + """SELECT count(front_size) AS n_instances, count(*) AS n_instances_in_corpus, count(*) FILTER (effective_pool = 0) AS n_zero_ok, count(*) FILTER (effective_pool <= 1) AS n_degenerate,
 count(*) FILTER (effective_pool >= 2 AND front_size = 1) AS n_singleton, count(*) FILTER (effective_pool <= 1 AND front_size = 1) AS n_singleton_excluded, median(front_size)::DOUBLE AS front_size_median,
 round(avg(front_size / effective_pool) FILTER (front_size IS NOT NULL), 6) AS mean_ratio, round(avg(CASE WHEN front_size IS NOT NULL THEN coalesce(hv, 0.0) END) / 1e6, 6) AS mean_hypervolume_m,
 round(avg(CASE WHEN front_size IS NOT NULL THEN coalesce(hv, 0.0) / (120000.0 * 60 * 60) END), 9) AS mean_normalized FROM sizes LEFT JOIN vol USING (instance_id)""")
def pareto_summary(spark, d):
    return pareto.pareto_summary(_runs(spark, d))


@query(_RUNS + "SELECT front_size AS value, row_number() OVER (ORDER BY front_size) / count(*) OVER () AS share FROM sizes WHERE front_size IS NOT NULL")
def front_size_ecdf(spark, d):
    return pareto.ecdf(pareto.front_sizes(_runs(spark, d)), "front_size")


_CENSUS = """, census AS (SELECT field_id, instance_id, vehicle_index, count(DISTINCT config_id) AS nominal, count(*) FILTER (NOT (config_id = 'c7' AND vehicle_index = 0)) AS applicable, count(*) FILTER (status = 'ok') AS observed,
 bool_or(status = 'ok' AND config_id = 'c7' AND vehicle_index = 0) AS violated FROM runs GROUP BY ALL)
"""


@query(_RUNS + _CENSUS + "SELECT * FROM census")
def pool_census(spark, d):
    return pools.census(_runs(spark, d), _applicable(spark))


@query(_RUNS + _CENSUS + "SELECT field_id, count(*) AS n_instances, round(avg(observed), 4) AS mean_ok, round(avg(applicable - observed), 4) AS mean_lost, count(*) FILTER (observed = 0) AS zero_ok FROM census GROUP BY ALL")
def field_census(spark, d):
    return pools.field_census(pools.census(_runs(spark, d), _applicable(spark)))


@query(_RUNS + """SELECT *, round(ok / n_rows, 4) AS ok_share, round(named_rejections / n_rows, 4) AS named_rejection_share, named_rejections / n_rows >= 0.8 AS factually_out_of_pool FROM (SELECT config_id, vehicle_index, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'not_applicable') AS not_applicable,
 count(*) FILTER (status = 'outside_area') AS outside_area, count(*) FILTER (status = 'collision') AS collision, count(*) FILTER (status NOT IN ('ok', 'not_applicable')) AS named_rejections FROM runs GROUP BY ALL)""")
def status_crosstab(spark, d):
    return pools.crosstab(_runs(spark, d))


@query(_RUNS + """, ranked AS (SELECT effective_pool AS size, row_number() OVER (ORDER BY effective_pool) - 1 AS i, count(*) OVER () AS n FROM sizes)
SELECT count(*) AS n_instances, count(*) FILTER (size = 0) AS zero_ok, count(*) FILTER (size <= 1) AS degenerate, min(size) AS least, min(size) FILTER (i = floor(0.25 * (n - 1))) AS q1, median(size)::DOUBLE AS median, min(size) FILTER (i = floor(0.75 * (n - 1))) AS q3, max(size) AS most, round(avg(size), 4) AS mean FROM ranked""")
def pool_sizes(spark, d):
    return pools.pool_sizes(_runs(spark, d))


@query("WITH one AS (SELECT 1)" + _GRID + " SELECT * FROM prefs")
def preference_grid(spark, d):
    return regret.preferences(spark)


@query(_RUNS + _REGRET + "SELECT instance_id, config_id, preference, round(score, 12) AS score, round(regret, 12) AS regret FROM reg")
def regret_table(spark, d):
    return _regrets(spark, d).select("instance_id", "config_id", "preference", F.round("score", 12).alias("score"), F.round("regret", 12).alias("regret"))


@query(_RUNS + _REGRET + "SELECT instance_id, preference, round(avg(regret) FILTER (applicable), 12) AS random_applicable, round(avg(regret), 12) AS random_nominal FROM reg GROUP BY ALL")
def random_baselines(spark, d):
    b = regret.random_baselines(_regrets(spark, d))
    return b.select("instance_id", "preference", F.round("random_applicable", 12).alias("random_applicable"), F.round("random_nominal", 12).alias("random_nominal"))


@query(_RUNS + _REGRET + "SELECT field_id, config_id, round(loss, 6) AS loss, n_instances FROM losses")
def field_losses(spark, d):
    return regret.field_losses(_regrets(spark, d)).select("field_id", "config_id", F.round("loss", 6).alias("loss"), "n_instances")


@query(_RUNS + _REGRET + "SELECT config_id, round(loss, 6) AS loss, n_fields FROM (SELECT config_id, round(avg(loss), 9) AS loss, count(*) AS n_fields FROM losses GROUP BY ALL) ORDER BY 2, 1 LIMIT 1")
def single_best_solver(spark, d):
    return regret.single_best(regret.field_losses(_regrets(spark, d))).select("config_id", F.round("loss", 6).alias("loss"), "n_fields")


@query(_RUNS + _FOLDS + "SELECT * FROM folds")
def grouped_folds(spark, d):
    return splits.grouped_folds(_runs(spark, d))


@query("SELECT p_name, CAST(CAST('0x' || substr(sha256(p_name), 1, 16) AS UBIGINT) % 10 + 1 AS BIGINT) AS fold FROM part")
def hash_folds(spark, d):
    return table(spark, d, "part").select("p_name", splits.hash_fold(F.col("p_name")).alias("fold"))


@query(_RUNS + _REGRET + _FOLDS + """, held AS (SELECT DISTINCT fold FROM folds), train AS (SELECT h.fold, config_id, round(avg(loss), 9) AS loss FROM held h JOIN folds f ON f.fold <> h.fold JOIN losses l ON l.field_id = f.field_id GROUP BY ALL),
best AS (SELECT fold, config_id FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY loss, config_id) AS k FROM train) WHERE k = 1),
chosen AS (SELECT b.fold, b.config_id, round(avg(loss), 6) AS sbs_loss, count(*) AS n_fields FROM best b JOIN folds f USING (fold) JOIN losses l ON l.field_id = f.field_id AND l.config_id = b.config_id GROUP BY ALL),
rnd AS (SELECT fold, round(avg(a), 6) AS random_applicable_loss, round(avg(n), 6) AS random_nominal_loss FROM (SELECT field_id, avg(a) AS a, avg(n) AS n FROM (SELECT field_id, instance_id, preference, avg(regret) FILTER (applicable) AS a, avg(regret) AS n FROM reg WHERE regret IS NOT NULL GROUP BY ALL) GROUP BY ALL) JOIN folds USING (field_id) GROUP BY ALL)
SELECT * FROM chosen JOIN rnd USING (fold)""")
def cross_validation(spark, d):
    runs = _runs(spark, d)
    return regret.cross_validate(_regrets(spark, d), splits.grouped_folds(runs))


@query("SELECT count(v) AS n, min(v) AS least, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS most, round(avg(v), 6) AS mean, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT value::DOUBLE AS v FROM events)")
def distribution_summary(spark, d):
    return stats.distribution(table(spark, d, "events"), "value")


def _signed_rank(values: str, null_value: str, pratt: bool) -> str:
    """SQL of the signed-rank statistic of the column x of ``values``."""
    keep = "" if pratt else "WHERE d <> 0"
    return f"""diff AS (SELECT x::DOUBLE - {null_value} AS d FROM ({values})), rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM diff {keep}),
one AS (SELECT (SELECT count(*) FROM diff) AS n, (SELECT count(*) FROM diff WHERE d = 0) AS n_zero, coalesce(sum(r) FILTER (d > 0), 0.0) AS statistic, coalesce(sum(t * t - 1) FILTER (d <> 0), 0) AS ties FROM rk),
two AS (SELECT *, {'n' if pratt else 'n - n_zero'} AS m, {'n_zero' if pratt else '0'} AS z0 FROM one)
SELECT n, n_zero, statistic, round((statistic - (m * (m + 1) - z0 * (z0 + 1)) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - ties / 48), 9) AS z FROM two"""


@query("WITH " + _signed_rank("SELECT round(o_totalprice / 1000) AS x FROM orders", "250.0", False))
def wilcoxon(spark, d):
    v = table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 1000).alias("x"))
    return stats.wilcoxon_greater(v, "x", 250.0)


@query("WITH " + _signed_rank("SELECT round(o_totalprice / 1000) AS x FROM orders", "250.0", True))
def wilcoxon_pratt(spark, d):
    v = table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 1000).alias("x"))
    return stats.wilcoxon_greater(v, "x", 250.0, pratt=True)


@query("SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS evaluations, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def anytime_curve(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("evaluations"), F.col("value").alias("score"))
    return splits.anytime_curve(e)


_POLY = """WITH pts AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch(ts) / 3600 AS x, value AS y FROM events),
st AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
mv AS (SELECT *, atan2(dy, dx) AS h FROM st WHERE dx <> 0 OR dy <> 0), tn AS (SELECT path_id, lead(h) OVER (PARTITION BY path_id ORDER BY seq) - h AS dh FROM mv),
ch AS (SELECT path_id, sum(abs((dh + pi()) - 2 * pi() * floor((dh + pi()) / (2 * pi())) - pi())) AS change FROM tn GROUP BY ALL),
en AS (SELECT path_id, count(*) AS n_points, coalesce(sum(sqrt(dx * dx + dy * dy)), 0.0) AS length, arg_min(x, seq) AS x1, arg_max(x, seq) AS x2, arg_min(y, seq) AS y1, arg_max(y, seq) AS y2 FROM st GROUP BY ALL)
"""


def _polylines(spark, d) -> DataFrame:
    """Each user's events in order are a path; x is hours since the epoch."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(F.col("user_id").alias("path_id"), F.row_number().over(w).cast("long").alias("seq"), (seconds / 3600).alias("x"), F.col("value").alias("y"))


@query(_POLY + """SELECT path_id, n_points, round(length, 4) AS length, round(coalesce(change, 0.0), 4) AS heading_change, round(CASE WHEN length > 0 THEN coalesce(change, 0.0) / length ELSE 0.0 END, 6) AS aol,
 round(CASE WHEN n_points < 2 THEN 1.0 ELSE length / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) END, 4) AS tortuosity, 0::BIGINT AS cusps FROM en LEFT JOIN ch USING (path_id)""")
def path_metrics(spark, d):
    m = paths.polyline_metrics(_polylines(spark, d))
    return m.select("path_id", "n_points", F.round("length", 4).alias("length"), F.round("heading_change", 4).alias("heading_change"), F.round("aol", 6).alias("aol"), F.round("tortuosity", 4).alias("tortuosity"), F.col("cusps").cast("long").alias("cusps"))


_SEG = """WITH sg AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 3 = 0 OR event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'WORK' ELSE 'TURN' END AS kind, value AS length, event_id % 2 AS cell FROM events),
w AS (SELECT *, count(*) FILTER (kind = 'WORK') OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - CASE WHEN kind = 'WORK' THEN 1 ELSE 0 END AS done, count(*) FILTER (kind = 'WORK') OVER (PARTITION BY path_id) AS total, lag(kind) OVER (PARTITION BY path_id ORDER BY seq) AS previous,
 CASE WHEN kind = 'WORK' THEN cell END AS wc FROM sg),
c AS (SELECT path_id, done AS k, wc, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i FROM w WHERE kind = 'WORK'),
x AS (SELECT w.*, cb.wc AS cell_before, ca.wc AS cell_after FROM w LEFT JOIN c cb ON cb.path_id = w.path_id AND cb.i = w.done LEFT JOIN c ca ON ca.path_id = w.path_id AND ca.i = w.done + 1)
"""


@query(_SEG + """SELECT path_id, count(*) FILTER (kind = 'WORK') AS n_work, count(*) FILTER (kind = 'WORK' AND previous <> 'WORK') AS headland_turns, round(coalesce(sum(length) FILTER (kind <> 'WORK' AND done = 0), 0), 4) AS entry_m,
 round(coalesce(sum(length) FILTER (kind <> 'WORK' AND done > 0 AND done < total AND cell_before = cell_after), 0), 4) AS turn_m, round(coalesce(sum(length) FILTER (kind <> 'WORK' AND done > 0 AND done < total AND cell_before <> cell_after), 0), 4) AS inter_cell_m,
 round(coalesce(sum(length) FILTER (kind <> 'WORK' AND done > 0 AND done = total), 0), 4) AS exit_m, count(*) FILTER (kind = 'WORK' AND done > 0 AND cell_before = wc) AS n_turns, count(*) FILTER (kind = 'WORK' AND done > 0 AND cell_before <> wc) AS n_inter_cell FROM x GROUP BY ALL""")
def transfer_breakdown(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id")
    work = (F.col("event_id") % 3 == 0) | (F.col("event_id") == F.min("event_id").over(w))
    s = table(spark, d, "events").select(F.col("user_id").alias("path_id"), F.row_number().over(w.orderBy("ts", "event_id")).alias("seq"), F.when(work, "WORK").otherwise("TURN").alias("kind"), F.col("value").alias("length"), (F.col("event_id") % 2).alias("cell"))
    m = paths.segment_metrics(s)
    return m.select("path_id", "n_work", "headland_turns", *(F.round(c, 4).alias(c) for c in ("entry_m", "turn_m", "inter_cell_m", "exit_m")), "n_turns", "n_inter_cell")


@query(_POLY + "SELECT path_id, round(sum(abs(-sin(0.5) * dx + cos(0.5) * dy) / 0.75), 4) AS crossings FROM st WHERE dx IS NOT NULL GROUP BY ALL")
def row_crossings(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("path_id").orderBy("seq")
    s = _polylines(spark, d).select("path_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    return paths.crossings(s, 0.5, 0.75).select("path_id", F.round("crossings", 4).alias("crossings"))


def _m2p(x: str) -> str:
    return f"(({x}) - 2 * pi() * floor(({x}) / (2 * pi())))"


_DUBINS = f"""WITH poses AS (SELECT p_partkey, p_retailprice / 100.0 AS dx, p_size - 25.0 AS dy, p_size / 8.0 AS s0, p_partkey % 63 / 10.0 AS s1 FROM part),
n AS (SELECT *, sqrt(dx * dx + dy * dy) / 2.5 AS d, {_m2p('s0 - atan2(dy, dx)')} AS a, {_m2p('s1 - atan2(dy, dx)')} AS b FROM poses),
k AS (SELECT *, 2 + d*d - 2*cos(a-b) + 2*d*(sin(a)-sin(b)) AS p1, 2 + d*d - 2*cos(a-b) + 2*d*(sin(b)-sin(a)) AS p2, -2 + d*d + 2*cos(a-b) + 2*d*(sin(a)+sin(b)) AS p3, -2 + d*d + 2*cos(a-b) - 2*d*(sin(a)+sin(b)) AS p4,
 atan2(cos(b)-cos(a), d+sin(a)-sin(b)) AS t1, atan2(cos(a)-cos(b), d-sin(a)+sin(b)) AS t2, (6 - d*d + 2*cos(a-b) + 2*d*(sin(a)-sin(b))) / 8 AS c5, (6 - d*d + 2*cos(a-b) + 2*d*(sin(b)-sin(a))) / 8 AS c6 FROM n),
q AS (SELECT *, CASE WHEN p3 >= 0 THEN atan2(-cos(a)-cos(b), d+sin(a)+sin(b)) - atan2(-2.0, sqrt(p3)) END AS t3, CASE WHEN p4 >= 0 THEN atan2(cos(a)+cos(b), d-sin(a)-sin(b)) - atan2(2.0, sqrt(p4)) END AS t4,
 CASE WHEN c5 BETWEEN -1 AND 1 THEN 2*pi() - acos(c5) END AS q5, CASE WHEN c6 BETWEEN -1 AND 1 THEN 2*pi() - acos(c6) END AS q6 FROM k),
r AS (SELECT *, {_m2p('a - t2 + q5 / 2')} AS u5, {_m2p('-a + t1 + q6 / 2')} AS u6 FROM q)
SELECT p_partkey, round(2.5 * least(CASE WHEN p1 >= 0 THEN {_m2p('t1 - a')} + sqrt(p1) + {_m2p('b - t1')} END, CASE WHEN p2 >= 0 THEN {_m2p('a - t2')} + sqrt(p2) + {_m2p('t2 - b')} END, {_m2p('t3 - a')} + sqrt(greatest(p3, 0)) + {_m2p('t3 - b')}, {_m2p('a - t4')} + sqrt(greatest(p4, 0)) + {_m2p('b - t4')},
 u5 + q5 + {_m2p('a - b - u5 + q5')}, u6 + q6 + {_m2p('b - a - u6 + q6')}), 6) AS length FROM r"""


@query(_DUBINS)
def dubins_lengths(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(scalars.dubins_length(F.col("p_retailprice") / 100.0, F.col("p_size") - 25.0, F.col("p_size") / 8.0, F.col("p_partkey") % 63 / 10.0, F.lit(2.5)), 6).alias("length"))


_TOUR = """WITH nodes AS (SELECT c_custkey AS node_id, c_nationkey AS tour_id, c_acctbal / 10.0 AS x, (c_custkey * 37 % 1000)::DOUBLE AS y FROM customer), t AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM nodes WINDOW w AS (PARTITION BY tour_id ORDER BY node_id)),
legs AS (SELECT tour_id, sqrt((coalesce(nx, fx) - x) ** 2 + (coalesce(ny, fy) - y) ** 2) AS d FROM t)
"""


@query(_TOUR + "SELECT tour_id, sum(floor(d + 0.5))::BIGINT AS nint_length, sum(ceil(d))::BIGINT AS ceil_length, round(sum(d), 4) AS exact_length, count(*) AS n_nodes FROM legs GROUP BY ALL")
def tour_lengths(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("tour_id"), (F.col("c_acctbal") / 10.0).alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"))
    tours, at = nodes.select("tour_id", F.col("node_id").alias("seq"), "node_id"), nodes.select("node_id", "x", "y")
    kinds = {"nint_length": lambda x, y: scalars.tsplib_distance(x, y, "EUC_2D"), "ceil_length": lambda x, y: scalars.tsplib_distance(x, y, "CEIL_2D"), "exact_length": F.hypot}
    out = None
    for name, kind in kinds.items():
        one = paths.tour_lengths(tours, at, kind).withColumnRenamed("length", name)
        out = one if out is None else out.join(one.drop("n_nodes"), "tour_id")
    return out.select("tour_id", "nint_length", "ceil_length", F.round("exact_length", 4).alias("exact_length"), "n_nodes")


_NODES = "SELECT c_nationkey AS problem_id, 'n' || lpad(c_custkey::VARCHAR, 9, '0') AS node_id, c_acctbal AS x, (c_custkey * 37 % 1000)::DOUBLE AS y, (c_custkey % 7 + 1)::DOUBLE AS demand FROM customer"


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("problem_id"), F.concat(F.lit("n"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("node_id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"), (F.col("c_custkey") % 7 + 1).cast("double").alias("demand"))


_NEAREST = "WITH RECURSIVE nodes AS (" + _NODES + """), first AS (SELECT problem_id, min(node_id) AS node_id, count(*) AS n FROM nodes GROUP BY ALL),
walk AS (SELECT f.problem_id, 0::BIGINT AS seq, n.node_id, n.x, n.y, [n.node_id] AS seen FROM first f JOIN nodes n USING (problem_id, node_id) UNION ALL
 SELECT problem_id, seq, node_id, x, y, seen FROM (SELECT w.problem_id, w.seq + 1 AS seq, n.node_id, n.x, n.y, list_append(w.seen, n.node_id) AS seen, row_number() OVER (PARTITION BY w.problem_id ORDER BY sqrt((n.x - w.x) ** 2 + (n.y - w.y) ** 2), n.node_id) AS place
  FROM walk w JOIN nodes n ON n.problem_id = w.problem_id AND NOT list_contains(w.seen, n.node_id)) WHERE place = 1)
"""


@query(_NEAREST + """SELECT problem_id, seq, node_id, round(sqrt((coalesce(lead(x) OVER w, first_value(x) OVER w) - x) ** 2 + (coalesce(lead(y) OVER w, first_value(y) OVER w) - y) ** 2), 6) AS leg FROM walk WINDOW w AS (PARTITION BY problem_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def nearest_neighbour_tours(spark, d):
    from ..operators import routing

    return routing.nearest_neighbour_tours(_nodes(spark, d)).withColumn("leg", F.round("leg", 6))


_ROUTES = "WITH RECURSIVE nodes AS (" + _NODES + """), depots AS (SELECT n.problem_id, n.node_id AS depot, n.x AS dx, n.y AS dy, f.n FROM nodes n JOIN (SELECT problem_id, min(node_id) AS node_id, count(*) AS n FROM nodes GROUP BY ALL) f USING (problem_id, node_id)),
walk AS (SELECT problem_id, 0::BIGINT AS seq, 0::BIGINT AS route, depot, dx, dy, n, dx AS x, dy AS y, 0.0::DOUBLE AS load, [depot] AS seen, 0.0::DOUBLE AS leg, 0::BIGINT AS ended, 0.0::DOUBLE AS need FROM depots UNION ALL
 SELECT problem_id, seq, route, depot, dx, dy, n, x, y, load, seen, leg, ended, need FROM (SELECT w.problem_id, w.seq + 1 AS seq, CASE WHEN m.node_id IS NULL THEN w.route + 1 ELSE w.route END AS route, w.depot, w.dx, w.dy, w.n, coalesce(m.x, w.dx) AS x, coalesce(m.y, w.dy) AS y,
   CASE WHEN m.node_id IS NULL THEN 0.0 ELSE w.load + m.demand END AS load, CASE WHEN m.node_id IS NULL THEN w.seen ELSE list_append(w.seen, m.node_id) END AS seen, sqrt((coalesce(m.x, w.dx) - w.x) ** 2 + (coalesce(m.y, w.dy) - w.y) ** 2) AS leg,
   CASE WHEN m.node_id IS NULL THEN w.route ELSE -1 END AS ended, coalesce(m.demand, 0.0) AS need, row_number() OVER (PARTITION BY w.problem_id ORDER BY sqrt((m.x - w.x) ** 2 + (m.y - w.y) ** 2), m.node_id) AS place
  FROM walk w LEFT JOIN nodes m ON m.problem_id = w.problem_id AND NOT list_contains(w.seen, m.node_id) AND w.load + m.demand <= 20 WHERE len(w.seen) < w.n) WHERE place = 1),
legs AS (SELECT problem_id, CASE WHEN ended >= 0 THEN ended ELSE route END AS route, leg, need, ended < 0 AS customer FROM walk WHERE seq > 0 UNION ALL
 SELECT problem_id, route, sqrt((dx - x) ** 2 + (dy - y) ** 2), 0.0, false FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY seq DESC) AS back FROM walk) WHERE back = 1)
"""


@query(_ROUTES + "SELECT problem_id, route, count(*) FILTER (customer) AS n_customers, sum(need) AS load, round(sum(leg), 4) AS length FROM legs GROUP BY ALL HAVING count(*) FILTER (customer) > 0")
def capacitated_routes(spark, d):
    from ..operators import routing

    return routing.capacitated_routes(_nodes(spark, d), capacity=20.0).withColumn("length", F.round("length", 4))


_RECT = f"""WITH fields AS (SELECT p_partkey AS field_id, p_retailprice / 10.0 AS w, p_size + 30.0 AS h FROM part), main AS (SELECT *, w - 16.0 AS mw, h - 16.0 AS mh FROM fields WHERE w > 16 AND h > 16),
sw AS (SELECT field_id, w, h, greatest(mw, mh) AS len, greatest(1, ceil(least(mw, mh) / 5.0))::BIGINT AS n, least(mw, mh) AS span FROM main)
"""


@query(_RECT + "SELECT field_id, w * h AS area_m2, round(2 * (w + h) / sqrt(w * h), 9) AS perimeter_area_ratio, 0.0::DOUBLE AS convexity_deficiency, round(greatest(w, h) / least(w, h), 9) AS elongation, 0::BIGINT AS reflex_vertex_count FROM fields")
def rectangle_features(spark, d):
    return coverage.features(coverage.rectangles(table(spark, d, "part")))


@query(_RECT + """SELECT field_id, n AS n_swaths, round(len, 6) AS swath_length, round(n * len, 6) AS work_m, n - 1 AS n_turns, round(CASE WHEN n < 2 THEN 0.0 ELSE (n - 2) * (pi() * 2 + 1) + CASE WHEN span - 5.0 * (n - 1) < 0 THEN 0 ELSE 1 END * 0 END, 6) AS full_turns_m FROM sw""")
def rectangle_plan(spark, d):
    return coverage.rectangle_plan(table(spark, d, "part"))


@query(_RUNS + """SELECT instance_id, 1::BIGINT AS repetition, config_id AS algorithm, path_length, CASE WHEN status IN ('ok', 'timeout', 'memout', 'not_applicable', 'crash') THEN status ELSE 'other' END AS runstatus FROM runs""")
def exchange_runs(spark, d):
    from ..sources.sinks import exchange_runs as of

    return of(_runs(spark, d), "path_length")



@query()
def reeds_shepp_lengths(spark, d):
    """Shortest lengths with reverse gear between the poses of :func:`dubins_lengths`, which they never exceed."""
    from ..functions import kinematics

    @F.pandas_udf("double")
    def length(x: pd.Series, y: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2.5 * kinematics.reeds_shepp((0.0, 0.0, s), (dx, dy, e), 2.5)[0].length for dx, dy, s, e in zip(x, y, a, b)])

    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(length(F.col("p_retailprice") / 100.0, F.col("p_size") - 25.0, F.col("p_size") / 8.0, F.col("p_partkey") % 63 / 10.0), 6).alias("length"))


def _notched(spark: SparkSession, d: str) -> DataFrame:
    """``(field_id, wkt)``: a square with a notch for each supplier."""
    size = 60.0 + F.col("s_acctbal") % 40.0
    corner = F.round(F.abs(size), 3).cast("string")
    half = F.round(F.abs(size) / 2, 3).cast("string")
    wkt = F.concat(F.lit("POLYGON ((0 0, "), corner, F.lit(" 0, "), corner, F.lit(" "), half, F.lit(", "), half, F.lit(" "), half, F.lit(", "), half, F.lit(" "), corner, F.lit(", 0 "), corner, F.lit(", 0 0))"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("field_id"), wkt.alias("wkt"))


@query()
def coverage_runs(spark, d):
    """The thirteen configurations on a field with a notch for each supplier, with either vehicle."""
    vehicle = F.explode(F.array(F.lit(0), F.lit(1)))
    fields = _notched(spark, d).select(F.col("field_id").cast("string").alias("field_id"), "wkt", vehicle.alias("vehicle_index"))
    instances = fields.select(F.concat_ws(":", "field_id", F.col("vehicle_index").cast("string")).alias("instance_id"), "wkt", "vehicle_index", F.lit(0.3).alias("row_direction"), F.lit(0.75).alias("row_spacing"))
    vehicles = [coverage.Vehicle(5.0, 2.0, 2.0), coverage.Vehicle(5.0, 2.0, 2.5, can_reverse=True)]
    return coverage.run_matrix(instances, coverage.standard_configs(), vehicles).drop("planning_s")
