"""SQL of the engine's queries, for the comparison with a second engine."""

from __future__ import annotations

from ..sources.history import EVENTS_VIEW, ORDERS_VIEW

AS_OF = "2001-09-01"
AS_OF_EVENTS = "2024-03-15"


def base(view: str = "orders") -> str:
    exprs = ORDERS_VIEW if view == "orders" else EVENTS_VIEW
    return f"base AS (SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {view})"


def facts(view: str = "orders") -> str:
    return base(view) + """,
facts AS (SELECT ord, path, date, size, committer, lines_added, lines_deleted, line_change
          FROM (SELECT *, count(*) OVER (PARTITION BY path) AS c FROM base) WHERE c >= 5)"""


def days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def r(x: str, n: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {n}) + 0.0)"  # no negative zero


W = "PARTITION BY path ORDER BY date, ord"
RUN = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def history(view: str = "orders") -> str:
    back = lambda n: f"count(*) OVER (PARTITION BY path ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {n} DAYS PRECEDING)"
    return facts(view) + f""",
h1 AS (SELECT *, row_number() OVER ({W}) AS commit_num,
         coalesce({days(f'lag(date) OVER ({W})', 'date')}, 0) AS commit_interval_days,
         {days('min(date) OVER (PARTITION BY path)', 'date')} AS age_in_days,
         {back(30)} AS b30, {back(90)} AS b90 FROM facts),
hist AS (SELECT *, commit_num - b30 AS commits_last_30d, commit_num - b90 AS commits_last_90d,
         max(commit_interval_days) OVER ({RUN}) AS max_commit_interval_to_date,
         CASE WHEN commit_interval_days = 0 THEN 1 ELSE 0 END AS is_first_commit,
         coalesce(stddev_samp(commit_interval_days) OVER ({RUN}), 0) AS std_commit_interval,
         avg(commit_interval_days) OVER ({RUN}) AS avg_commit_interval,
         (isodow(date) - 1) AS weekday, month(date) AS month FROM h1)"""


HISTORY_COLUMNS = f"""ord, path, epoch_us(date) AS date_us, commit_num, commits_last_30d, commits_last_90d,
  {r('commits_last_30d / commit_num')} AS commits_ratio_30d, {r('commits_last_90d / commit_num')} AS commits_ratio_90d,
  {r('commits_last_30d / commit_num - commits_last_90d / commit_num')} AS recent_commit_activity_surge,
  commit_interval_days, max_commit_interval_to_date, is_first_commit, {r('std_commit_interval', 5)} AS std_commit_interval,
  {r('avg_commit_interval')} AS avg_commit_interval, age_in_days, {r('commit_num / (age_in_days + 1)')} AS commits_per_day_so_far,
  CAST(weekday AS INTEGER) AS weekday, CAST(month AS INTEGER) AS month"""


def labels(view: str = "orders", as_of: str = AS_OF) -> str:
    return history(view) + f""",
cutoff AS (SELECT CAST(floor(least(365.0, greatest(30.0, coalesce(quantile_cont(CASE WHEN commit_interval_days <> 0 THEN commit_interval_days END, 0.95), 30.0)))) AS BIGINT) AS cutoff FROM hist),
l1 AS (SELECT *, greatest(3.0, 0.15 * median(line_change) OVER (PARTITION BY path)) AS thr, count(*) OVER (PARTITION BY path) AS n,
         max(date) OVER (PARTITION BY path) AS last_date, last_value(size) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_size FROM hist),
l2 AS (SELECT *, coalesce(max(CASE WHEN line_change > thr THEN commit_num END) OVER (PARTITION BY path), 0) AS bad FROM l1),
l3 AS (SELECT *, min(CASE WHEN commit_num > bad THEN date END) OVER (PARTITION BY path) AS run_from FROM l2),
l4 AS (SELECT l3.*, cutoff, {days('last_date', f"TIMESTAMP '{as_of}'")} AS idle FROM l3, cutoff),
l5 AS (SELECT *, CASE WHEN n - bad >= 3 AND {days('run_from', 'last_date')} >= 14 AND idle >= 30 AND last_size <> 0 THEN 'stable_line_change'
         WHEN last_size = 0 THEN 'deleted' WHEN idle > cutoff THEN 'idle_timeout' END AS completion_reason FROM l4),
lab AS (SELECT *, CASE WHEN completion_reason IS NOT NULL THEN last_date END AS completion_date,
         CASE WHEN completion_reason IS NOT NULL THEN greatest(0, {days('date', 'last_date')}) END AS days_until_completion FROM l5)"""


def by_history() -> str:
    return labels() + f""",
s1 AS (SELECT *, row_number() OVER ({W}) AS s_rn, count(*) OVER (PARTITION BY path) AS s_n FROM lab WHERE days_until_completion IS NOT NULL),
split AS (SELECT *, CASE WHEN s_rn <= least(floor(s_n * 0.8), s_n - 1) THEN 'train' ELSE 'test' END AS split FROM s1 WHERE s_n >= 5)"""


def by_file() -> str:
    return labels() + """,
p1 AS (SELECT path, row_number() OVER (ORDER BY md5(concat(path, '42')), path) AS rk, count(*) OVER () AS total FROM (SELECT DISTINCT path FROM lab WHERE days_until_completion IS NOT NULL)),
fsplit AS (SELECT lab.*, CASE WHEN rk <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS split FROM lab JOIN p1 USING (path) WHERE days_until_completion IS NOT NULL)"""


def by_file_split() -> str:
    return by_file() + ",\nsplit AS (SELECT * FROM fsplit)"


def errors(split: str | None = None) -> str:
    return (split or by_history()) + """,
mid AS (SELECT median(ln(1 + days_until_completion)) AS m FROM split WHERE split = 'train'),
e1 AS (SELECT split.*, CAST(days_until_completion AS DOUBLE) AS actual, greatest(exp(least(m, 15)) - 1, 0) AS pred FROM split, mid WHERE split = 'test'),
e2 AS (SELECT *, actual - pred AS residual, abs(actual - pred) AS abs_error, (actual - pred) / (actual + 1e-6) AS relative_error FROM e1),
sig AS (SELECT committer, regexp_replace(committer, '[^0-9A-Za-z_]', '_', 'g') AS name FROM facts GROUP BY committer HAVING count(*) / (SELECT count(*) FROM facts) >= 0.01),
err AS (SELECT e2.*, coalesce(nullif(regexp_extract(path, '\\.([a-zA-Z0-9]+)$', 1), ''), 'no_ext') AS extension, split_part(path, '/', 1) AS top_dir,
  CASE WHEN relative_error > 0.2 THEN 'underestimated' WHEN relative_error < -0.2 THEN 'overestimated' ELSE 'ok' END AS error_type,
  CASE WHEN actual > 0 AND actual <= 30 THEN '<30' WHEN actual > 30 AND actual <= 90 THEN '30–90' WHEN actual > 90 AND actual <= 180 THEN '90–180'
       WHEN actual > 180 AND actual <= 365 THEN '180–365' WHEN actual > 365 AND actual <= 1000 THEN '365+' END AS true_bin,
  CASE WHEN age_in_days < 0 THEN NULL WHEN age_in_days < 30 THEN '0-30' WHEN age_in_days < 90 THEN '31-90' WHEN age_in_days < 180 THEN '91-180' WHEN age_in_days < 365 THEN '181-365' ELSE '365+' END AS age_bin,
  coalesce(sig.name, 'other') AS committer_grouped FROM e2 LEFT JOIN sig USING (committer))"""


def slice_sql(c: str) -> str:
    return f"WITH {errors()} SELECT {c}, {r('avg(abs_error)')} AS mean_error, {r('stddev_samp(abs_error)')} AS std_error FROM err WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY avg(abs_error) DESC, {c} LIMIT 15"


EXT = "coalesce(nullif(regexp_extract(path, '\\.([a-zA-Z0-9]+)$', 1), ''), 'no_ext')"
LAST7 = f"{W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"


def sizes() -> str:
    x = "CAST(size AS DOUBLE)"
    lag = lambda k: f"lag({x}, {k}) OVER ({W})"
    return facts() + f""",
z1 AS (SELECT *, coalesce({x} - {lag(1)}, 0) AS size_diff FROM facts WHERE size IS NOT NULL),
z2 AS (SELECT *, sum(size_diff) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, sum(size_diff) OVER ({RUN}) AS total FROM z1),
siz AS (SELECT ord, path, {x} AS size, size_diff, {r(f'sum({x}) OVER ({RUN})')} AS cumulative_size, {r(f'avg({x}) OVER ({RUN})', 4)} AS cumulative_mean_size,
  {r(f'coalesce(stddev_samp({x}) OVER ({RUN}), 0)', 3)} AS cumulative_std_size, {r(f'avg({x}) OVER ({LAST7})', 4)} AS rolling_7_mean_size,
  {r(f'coalesce(stddev_samp({x}) OVER ({LAST7}), 0)', 3)} AS rolling_7_std_size, max({x}) OVER ({LAST7}) AS rolling_7_max_size, min({x}) OVER ({LAST7}) AS rolling_7_min_size,
  median({x}) OVER ({LAST7}) AS rolling_7_median_size, {', '.join(f'coalesce({lag(k)}, 0) AS lag_{k}_size' for k in range(1, 6))},
  {r(f'coalesce(CASE WHEN {lag(1)} <> 0 THEN {x} / {lag(1)} - 1 END, 0)')} AS percentage_change_size,
  {r('recent / CASE WHEN total = 0 THEN 1e-9 ELSE total END', 3)} AS recent_growth_ratio FROM z2)"""
