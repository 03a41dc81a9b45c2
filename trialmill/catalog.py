"""The registered queries over the driver's tables and their DuckDB equivalents.

Trial table: `events` with user_id as subject, event_type as condition and value as response time; `lineitem` has few
large cells. Floating results are rounded alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import TrialData
from .functions.stats import name, register
from .operators import cdf, filters, summary
from .plans.rules import SummaryPlan
from .shared import folder
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
#: Decimals of what a search for a maximum has found.
FIT_DIGITS = 4


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trials(spark: SparkSession, sf_dir: str, table: str = "events") -> TrialData:
    return TrialData(spark, _table(spark, sf_dir, table))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(name(c), DIGITS) for c in columns})


# --- scans -----------------------------------------------------------------------------------------------------------
@query("scan_project", "SELECT event_id, user_id, event_type, value FROM events")
def scan_project(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("distinct_values", "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def distinct_values(spark, sf_dir):
    return filters.distinct_values(_table(spark, sf_dir, "events"), "event_type")


@query("preview_limit", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10")
def preview_limit(spark, sf_dir):
    return tables.preview(_table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id"))


@query("union_by_name", "SELECT event_id, value, CAST(NULL AS VARCHAR) AS event_type FROM events UNION ALL SELECT event_id, CAST(NULL AS DOUBLE), event_type FROM events")
def union_by_name(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return tables.union([e.select("event_id", "value"), e.select("event_id", "event_type")])


@query("null_key_guard", "SELECT count(*) AS n, count(*) FILTER (value < 20) > 0 AS refused FROM events")
def null_key_guard(spark, sf_dir):
    """Keys of all events pass; keys that small values have lost are refused."""
    e = _table(spark, sf_dir, "events")
    filters.check_keys(e, ["user_id", "event_type"])
    try:
        filters.check_keys(_without_keys(e), ["user_id", "event_type"])
        refused = False
    except ValueError:
        refused = True
    return e.agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


def _without_keys(e: DataFrame) -> DataFrame:
    """The events, of which small values have no user and some others no type."""
    return e.withColumns({"user_id": F.when(F.col("value") >= 20, F.col("user_id")), "event_type": F.when(F.col("event_id") % 7 != 0, F.col("event_type"))})


@query(
    "null_keys_dropped",
    f"SELECT user_id, event_type, 'value' AS variable, 'Mean' AS operation, '' AS parameter, round(avg(value), {DIGITS}) AS value FROM events WHERE value >= 20 AND event_id % 7 <> 0 AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type",
)
def null_keys_dropped(spark, sf_dir):
    """Rows without a key belong to no cell."""
    data = TrialData(spark, _without_keys(_table(spark, sf_dir, "events")))
    return _rounded(data.summarize(["user_id"], ["event_type"], [], ["value@Mean"]), "value")


# --- files -----------------------------------------------------------------------------------------------------------
def _written(spark: SparkSession) -> str:
    return f"{folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "files_piped",
    "SELECT event_id, user_id, value, event_type FROM (SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value, CAST(NULL AS VARCHAR) AS event_type FROM events WHERE event_id % 2 = 0 "
    "UNION ALL SELECT CAST(event_id AS DOUBLE), NULL, value, event_type FROM events WHERE event_id % 2 = 1)",
)
def files_piped(spark, sf_dir):
    """Every event written to one of two folders with different headers, and both read back in one scan."""
    e, (a, b) = _table(spark, sf_dir, "events"), (_written(spark), _written(spark))
    tables.write_piped(e.filter("event_id % 2 = 0").select("event_id", "user_id", "value"), a)
    tables.write_piped(e.filter("event_id % 2 = 1").select("value", "event_type", "event_id"), b)
    return TrialData(spark).read_piped([a, b]).data.select("event_id", "user_id", "value", "event_type")


@query("files_delimited", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'more' END AS untitled0 FROM events")
def files_delimited(spark, sf_dir):
    """Every event as a line of text, some with a field beyond the header, read back as text."""
    e, path = _table(spark, sf_dir, "events"), _written(spark)
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_id") % 3 == 0, "more"))
    e.select(line.alias("id kind")).write.csv(path, sep="\x01", header=True, quote="")
    return TrialData(spark).read_text([path]).data.select("id", "kind", "untitled0")


@query("files_appended", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(user_id) AS BIGINT) AS users FROM (SELECT event_type, user_id FROM events UNION ALL SELECT event_type, NULL FROM events WHERE value > 50) GROUP BY event_type")
def files_appended(spark, sf_dir):
    """What survives a rule is saved, read back and appended to the whole table."""
    path = _written(spark)
    data = _trials(spark, sf_dir)
    TrialData(spark, data.data.select("event_type", "value")).save_piped(path, rules=["value:> 50"])
    return data.read_piped([path], append=True).data.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("users"))


# --- descriptive aggregates ------------------------------------------------------------------------------------------
_SQL_AGG = {
    "Mean": "avg({x})",
    "Median": "median({x})",
    "Count": "CAST(count({x}) AS DOUBLE)",
    "Standard Deviation": "stddev_samp({x})",
    "Max": "max({x})",
    "Min": "min({x})",
    "Variance": "var_samp({x})",
}
_SHORT = {"Mean": "mean", "Median": "median", "Mode": "mode", "Count": "count", "Standard Deviation": "std", "Max": "max", "Min": "min", "Variance": "var", "Standard Error": "sem"}


def _agg_sql(op: str, keys: list[str], x: str = "value", table: str = "events") -> str:
    head = "".join(f"{k}, " for k in keys)
    names = f"'{x}' AS variable, '{op}' AS operation, '' AS parameter"
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    if op == "Mode":
        inner = f"SELECT {head}{x} AS v, count(*) AS n FROM {table} WHERE {x} IS NOT NULL GROUP BY {head}{x}"
        part = f"PARTITION BY {', '.join(keys)} " if keys else ""
        return f"SELECT {head}{names}, round(v, {DIGITS}) AS value FROM (SELECT *, row_number() OVER ({part}ORDER BY n DESC, v) AS r FROM ({inner})) WHERE r = 1"
    made = _SQL_AGG.get(op) or ("stddev_samp({x}) / sqrt(count(*))" if keys else "stddev_samp({x}) / sqrt(count({x}))")
    made = made.format(x=x)
    return f"SELECT * FROM (SELECT {head}{names}, round({made}, {DIGITS}) AS value FROM {table}{group}) WHERE value IS NOT NULL"


def _agg(op: str, keys: list[str]) -> Query:
    return lambda spark, sf_dir: _rounded(_trials(spark, sf_dir).summarize(keys[:1], keys[1:], [], [f"value@{op}"]), "value")


for _op, _short in _SHORT.items():
    QUERIES[f"agg_{_short}"] = _agg(_op, ["user_id", "event_type"])
    ORACLE[f"agg_{_short}"] = _agg_sql(_op, ["user_id", "event_type"])
    QUERIES[f"agg_global_{_short}"] = _agg(_op, [])
    ORACLE[f"agg_global_{_short}"] = _agg_sql(_op, [])

_MULTI = [("l_quantity", "Mean"), ("l_extendedprice", "Median"), ("l_discount", "Standard Deviation"), ("l_tax", "Max"), ("l_quantity", "Count"), ("l_extendedprice", "Standard Error")]


@query("agg_multi_target", " UNION ALL ".join(_agg_sql(op, ["l_returnflag", "l_linestatus"], x, "lineitem") for x, op in _MULTI))
def agg_multi_target(spark, sf_dir):
    return _rounded(_trials(spark, sf_dir, "lineitem").summarize(["l_returnflag"], ["l_linestatus"], [], [f"{x}@{op}" for x, op in _MULTI]), "value")


@query(
    "agg_registered",
    " UNION ALL ".join(
        f"SELECT event_type, 'value' AS variable, '{op}' AS operation, '' AS parameter, round({sql}, {DIGITS}) AS value FROM events GROUP BY event_type"
        for op, sql in (("Range", "max(value) - min(value)"), ("Root Mean Square", "sqrt(avg(value * value))"), ("Mean", "avg(value)"))
    ),
)
def agg_registered(spark, sf_dir):
    """Operations of a program's own beside a built-in one, in one exchange."""
    register("Range", lambda x: F.max(x) - F.min(x))
    register("Root Mean Square", lambda x: F.sqrt(F.avg(x * x)))
    return _rounded(_trials(spark, sf_dir).summarize(["event_type"], [], [], ["value@Range", "value@Root Mean Square", "value@Mean"]), "value")


@query(
    "text_lines",
    "SELECT event_type || chr(9) || (CASE WHEN n IS NULL THEN '' ELSE CAST(n AS VARCHAR) END) || chr(9) || printf('%.2f', m) || chr(9) AS value FROM (SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.000001 AS m FROM events GROUP BY event_type)",
)
def text_lines(spark, sf_dir):
    """A wide result as lines of text, made where the rows lie."""
    wide = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), (F.round(F.avg("value"), 6) + 0.000001).alias("m"))
    return summary.lines_of(wide, decimals=2)


# --- medians, modes and deviations of cells that no task could hold -----------------------------------------------------------------------------------------
def _large(targets: list[str], keys: list[str]) -> Query:
    return lambda spark, sf_dir: _rounded(_trials(spark, sf_dir, "lineitem").summarize(keys, [], [], targets, skewed=True), "value")


QUERIES["agg_median_large_cells"] = _large(["l_extendedprice@Median", "l_quantity@Median", "l_discount@Mean"], ["l_returnflag"])
ORACLE["agg_median_large_cells"] = " UNION ALL ".join(_agg_sql(op, ["l_returnflag"], x, "lineitem") for x, op in (("l_extendedprice", "Median"), ("l_quantity", "Median"), ("l_discount", "Mean")))
QUERIES["agg_mode_large_cells"] = _large(["l_extendedprice@Mode", "l_quantity@Mode"], ["l_linestatus"])
ORACLE["agg_mode_large_cells"] = f"{_agg_sql('Mode', ['l_linestatus'], 'l_extendedprice', 'lineitem')} UNION ALL {_agg_sql('Mode', ['l_linestatus'], 'l_quantity', 'lineitem')}"
QUERIES["agg_median_one_cell"] = _large(["l_extendedprice@Median", "l_extendedprice@Mode", "l_extendedprice@Variance"], [])
ORACLE["agg_median_one_cell"] = " UNION ALL ".join(_agg_sql(op, [], "l_extendedprice", "lineitem") for op in ("Median", "Mode", "Variance"))


# --- filters ---------------------------------------------------------------------------------------------------------
def _kept(rules: list[str], keys: list[str], **options) -> Query:
    return lambda spark, sf_dir: _trials(spark, sf_dir).filter(keys, [], rules, **options).select("event_id", "value")


def _z_sql(n: str) -> str:
    """z by sample size, written out by hand so that a wrong knot in the library shows."""
    small = f"CASE {n} WHEN 4 THEN 1.458 WHEN 5 THEN 1.68 WHEN 6 THEN 1.841 WHEN 7 THEN 1.961 WHEN 8 THEN 2.05 WHEN 9 THEN 2.12 WHEN 10 THEN 2.173 WHEN 11 THEN 2.22 WHEN 12 THEN 2.246 WHEN 13 THEN 2.274 WHEN 14 THEN 2.31 ELSE 1.0 END"
    return f"""CASE WHEN {n} < 15 THEN {small}
  WHEN {n} < 20 THEN 2.326 + ({n} - 15) * 0.065 / 5.0 WHEN {n} < 25 THEN 2.391 + ({n} - 20) * 0.019 / 5.0 WHEN {n} < 30 THEN 2.41 + ({n} - 25) * 0.021 / 5.0
  WHEN {n} < 35 THEN 2.431 + ({n} - 30) * 0.019 / 5.0 WHEN {n} < 50 THEN 2.45 + ({n} - 35) * 0.03 / 15.0 WHEN {n} < 100 THEN 2.48 + ({n} - 50) * 0.02 / 50.0 ELSE 2.5 END"""


def _stat_sql(kind: str, keys: str, source: str = "events") -> str:
    over = f"OVER ({'PARTITION BY ' + keys if keys else ''})"
    if kind == "mad":
        inner = f"SELECT *, median(value) {over} AS m FROM {source}"
        return f"SELECT * EXCLUDE (m, d) FROM (SELECT *, median(abs(value - m)) {over} AS d FROM ({inner})) WHERE value <= m + 3 * 1.4826 * d"
    z = _z_sql("n") if kind == "shiftz" else "1.5"
    return f"SELECT * EXCLUDE (m, s, n) FROM (SELECT *, avg(value) {over} AS m, stddev_samp(value) {over} AS s, count(value) {over} AS n FROM {source}) WHERE value < m + {z} * s"


QUERIES["filter_mad_one_cell"] = _kept(["value:<= median + 3 * MAD"], [], skewed=True)
ORACLE["filter_mad_one_cell"] = f"SELECT event_id, value FROM ({_stat_sql('mad', '')})"
_RULE = {"sd": "value:< mean + 1.5 * SD", "mad": "value:<= median + 3 * MAD", "shiftz": "value:< mean + Shifting Z * SD"}
for _kind, _rule in _RULE.items():
    QUERIES[f"filter_{_kind}_global"] = _kept([_rule], [])
    ORACLE[f"filter_{_kind}_global"] = f"SELECT event_id, value FROM ({_stat_sql(_kind, '')})"
    QUERIES[f"filter_{_kind}_grouped"] = _kept([_rule], ["user_id", "event_type"])
    ORACLE[f"filter_{_kind}_grouped"] = f"SELECT event_id, value FROM ({_stat_sql(_kind, 'user_id, event_type')})"
    QUERIES[f"filter_{_kind}_grouped_skewed"] = _kept([_rule], ["event_type"], skewed=True)
    ORACLE[f"filter_{_kind}_grouped_skewed"] = f"SELECT event_id, value FROM ({_stat_sql(_kind, 'event_type')})"

_BOTH_SIDES = "l_extendedprice:> median - 1 * MAD and < median + 1.5 * MAD"


@query(
    "filter_mad_large_cells",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, median(abs(l_extendedprice - m)) OVER (PARTITION BY l_returnflag) AS d FROM "
    "(SELECT *, median(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)) WHERE l_extendedprice > m - 1.4826 * d AND l_extendedprice < m + 1.5 * 1.4826 * d",
)
def filter_mad_large_cells(spark, sf_dir):
    return _trials(spark, sf_dir, "lineitem").filter(["l_returnflag"], [], [_BOTH_SIDES], skewed=True).select("l_orderkey", "l_linenumber", "l_extendedprice")


for _key, _rule, _where in (
    ("filter_raw", "value:>= 20", "value >= 20"),
    ("filter_and", "value:> 10 and < 80.5", "value > 10 AND value < 80.5"),
    ("filter_or", "value:< 5 or >= 90", "value < 5 OR value >= 90"),
    ("filter_fraction", "value:>= .5e1 and < 8.05E+1", "value >= 5 AND value < 80.5"),
    ("filter_checklist_num", "user_id: = 1 = 2 = 5", "user_id IN (1, 2, 5)"),
    ("filter_checklist_str", "event_type: = 'click' = 'view'", "event_type IN ('click', 'view')"),
):
    QUERIES[_key] = _kept([_rule], ["user_id"])
    ORACLE[_key] = f"SELECT event_id, value FROM events WHERE {_where}"

_CHAIN = ["event_type: = 'click' = 'view'", "value:< mean + 2.5 * SD", "value:> median - 3 * MAD and < median + 3 * MAD", "value:> 1"]
_CHAIN_SQL = """
WITH a AS (SELECT * FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT * EXCLUDE (m, s) FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM a WINDOW w AS (PARTITION BY user_id, event_type)) WHERE value < m + 2.5 * s),
c AS (SELECT *, median(value) OVER (PARTITION BY user_id, event_type) AS m FROM b),
d AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY user_id, event_type) AS d FROM c),
e AS (SELECT * FROM d WHERE value > m - 3 * 1.4826 * d AND value < m + 3 * 1.4826 * d AND value > 1)
"""


@query("filter_chain", _CHAIN_SQL + "SELECT event_id, value FROM e")
def filter_chain(spark, sf_dir):
    return _kept(_CHAIN, ["user_id", "event_type"])(spark, sf_dir)


@query("summary_chain", _CHAIN_SQL + f"SELECT user_id, event_type, 'value' AS variable, 'Mean' AS operation, '' AS parameter, round(avg(value), {DIGITS}) AS value FROM e GROUP BY user_id, event_type")
def flagship_at(spark, sf_dir):
    """Rules, then the mean of each subject and condition: one exchange and one sort for everything."""
    return _rounded(_trials(spark, sf_dir).summarize(["user_id"], ["event_type"], _CHAIN, ["value@Mean"]), "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_at(spark, sf_dir)


@query("plan_config_run", _CHAIN_SQL + f"SELECT user_id, event_type, 'value' AS variable, 'Mean' AS operation, '' AS parameter, round(avg(value), {DIGITS}) AS value FROM e GROUP BY user_id, event_type")
def plan_config_run(spark, sf_dir):
    """A plan written as a configuration, read back and run."""
    plan = SummaryPlan.from_config(SummaryPlan(["user_id"], ["event_type"], _CHAIN, ["value@Mean"]).to_config())
    return _rounded(_trials(spark, sf_dir).run(plan, strict=True), "value")


# --- reshape ---------------------------------------------------------------------------------------------------------
def _pivot(rows: list[str], cols: list[str], target: str) -> Query:
    def run(spark, sf_dir):
        long = _rounded(_trials(spark, sf_dir, "lineitem").summarize(rows, cols, [], [target]), "value")
        return summary.pivot(long, rows, cols, target, separator="_")

    return run


def _case(condition: str, label: str) -> str:
    return f"round(avg(l_quantity) FILTER ({condition}), {DIGITS}) AS \"{label}\""


QUERIES["pivot_rows_cols"] = _pivot(["l_returnflag"], ["l_linestatus"], "l_quantity@Mean")
ORACLE["pivot_rows_cols"] = f"SELECT l_returnflag, {_case("l_linestatus = 'F'", 'F')}, {_case("l_linestatus = 'O'", 'O')} FROM lineitem GROUP BY l_returnflag"
QUERIES["pivot_rows_only"] = _pivot(["l_returnflag"], [], "l_quantity@Mean")
ORACLE["pivot_rows_only"] = f"SELECT l_returnflag, round(avg(l_quantity), {DIGITS}) AS l_quantity FROM lineitem GROUP BY l_returnflag"
QUERIES["pivot_cols_only"] = _pivot([], ["l_linestatus"], "l_quantity@Mean")
ORACLE["pivot_cols_only"] = f"SELECT 'l_quantity' AS variable, {_case("l_linestatus = 'F'", 'F')}, {_case("l_linestatus = 'O'", 'O')} FROM lineitem"


@query("pivot_multilevel", None)
def pivot_multilevel(spark, sf_dir):
    return _pivot(["l_linenumber"], ["l_returnflag", "l_linestatus"], "l_quantity@Mean")(spark, sf_dir)


ORACLE["pivot_multilevel"] = "SELECT l_linenumber, " + ", ".join(_case(f"l_returnflag = '{a}' AND l_linestatus = '{b}'", f"{a}_{b}") for a, b in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM lineitem GROUP BY l_linenumber"


# --- expressions -----------------------------------------------------------------------------------------------------
def _expressions(given: dict[str, str], table: str = "lineitem", keys: tuple[str, ...] = ("l_orderkey", "l_linenumber"), order: tuple[str, ...] = ()) -> Query:
    def run(spark, sf_dir):
        data = _trials(spark, sf_dir, table)
        if order:
            data.sort(list(order))
        for target, text in given.items():
            data.compute(target, text)
        out = data.data.select(*keys, *given)
        # Quotients of cents by small whole numbers end before the ninth decimal, so none is rounded at a tie.
        return out.withColumns({c: F.round(c, 9) for c, k in out.dtypes if c in given and k == "double"})

    return run


_Q, _P, _D = "self.data['l_quantity']", "self.data['l_extendedprice']", "self.data['l_discount']"
for _key, _given, _sql in (
    ("expr_arith", {"a": f"{_Q} + 2 * {_P}", "b": f"-({_P} - {_Q}) / {_Q}", "c": f"{_Q} ** 2", "d": f"1 / {_Q}"}, "round(l_quantity + 2 * l_extendedprice, 9) AS a, round(-(l_extendedprice - l_quantity) / l_quantity, 9) AS b, round(l_quantity ** 2, 9) AS c, round(1 / l_quantity, 9) AS d"),
    ("expr_log_exp", {"a": f"np.log({_P})", "b": f"np.exp({_D})"}, "round(ln(l_extendedprice), 9) AS a, round(exp(l_discount), 9) AS b"),
    ("expr_logical", {"a": f"np.logical_and({_Q} > 10, {_D} > 0.05)", "b": f"({_Q} > 40) | ({_D} < 0.01)", "c": f"~({_Q} > 10)", "d": f"np.logical_or({_D}, {_Q} < 3)"}, "l_quantity > 10 AND l_discount > 0.05 AS a, l_quantity > 40 OR l_discount < 0.01 AS b, NOT (l_quantity > 10) AS c, l_discount <> 0 OR l_quantity < 3 AS d"),
    ("expr_bits", {"a": "self.data['l_linenumber'] & 3", "b": "self.data['l_linenumber'] | 4", "c": "~self.data['l_linenumber']", "d": f"+{_Q} - -{_D}"}, "CAST(l_linenumber & 3 AS DOUBLE) AS a, CAST(l_linenumber | 4 AS DOUBLE) AS b, CAST(~l_linenumber AS DOUBLE) AS c, round(l_quantity + l_discount, 9) AS d"),
    ("expr_bool_and", {"a": f"({_Q} > 10) & ({_D} > 0.05)", "b": f"({_Q} > 10) & ~({_D} > 0.05)"}, "l_quantity > 10 AND l_discount > 0.05 AS a, l_quantity > 10 AND NOT l_discount > 0.05 AS b"),
    ("expr_compare", {"a": f"{_Q} == 10", "b": f"{_Q} != 10", "c": f"{_Q} <= 10", "d": f"{_Q} >= 10"}, "l_quantity = 10 AS a, l_quantity <> 10 AS b, l_quantity <= 10 AS c, l_quantity >= 10 AS d"),
):
    QUERIES[_key] = _expressions(_given)
    ORACLE[_key] = f"SELECT l_orderkey, l_linenumber, {_sql} FROM lineitem"


def expr_boxcox(spark, sf_dir):
    out = _expressions({"boxcox": "runBoxcox(self.data['value'] + 1)"}, "events", ("event_id",))(spark, sf_dir)
    return out.withColumn("boxcox", F.round("boxcox", FIT_DIGITS))


QUERIES["expr_boxcox"] = expr_boxcox
QUERIES["expr_slice"] = _expressions({"part": "self.data['value'][100:5000:3]", "rest": "self.data['value'][7:] + 1"}, "events", ("event_id",), order=("event_id",))
ORACLE["expr_slice"] = "SELECT event_id, CASE WHEN r >= 100 AND r < 5000 AND (r - 100) % 3 = 0 THEN value END AS part, CASE WHEN r >= 7 THEN round(value + 1, 9) END AS rest FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events)"
QUERIES["expr_divide_zero"] = _expressions({"a": f"{_Q} / ({_D} - {_D})"})
ORACLE["expr_divide_zero"] = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN CAST('inf' AS DOUBLE) WHEN l_quantity < 0 THEN CAST('-inf' AS DOUBLE) END AS a FROM lineitem"


# --- fits ------------------------------------------------------------------------------------------------------------
_FITS = {
    "fit_gamma": "Gamma (k, θ)",
    "fit_weibull": "Weibull (k, θ)",
    "fit_lognormal": "LogNormal (k, θ)",
    "fit_wald": "Wald (m, a)",
    "fit_exwald": "Ex-Wald (m, a, τ)",
    "fit_shifted_wald": "Shifted Wald (m, a, shift)",
    "fit_exgauss": "Ex-Gaussian (μ, σ, τ)",
    "fit_invgauss": "Inv-Gaussian (μ, λ)",
    "fit_shifted_ig": "Shifted Inv-Gaussian (μ, λ, shift)",
}


def _fit(op: str, rules: tuple[str, ...] = ()) -> Query:
    def run(spark, sf_dir):
        out = _trials(spark, sf_dir).summarize(["event_type"], [], list(rules), [f"value@{op}"])
        return out.withColumn("value", F.round("value", FIT_DIGITS))

    return run


for _key, _op in _FITS.items():
    QUERIES[_key] = _fit(_op)

#: Fits of trials that were only kept between bounds.
for _key, _op in (("fit_bounded_gamma", "Gamma (k, θ)"), ("fit_bounded_weibull", "Weibull (k, θ)"), ("fit_bounded_exgauss", "Ex-Gaussian (μ, σ, τ)")):
    QUERIES[_key] = _fit(f"{_op} [2, 200]", ("value:>= 2 and <= 200",))


@query("fit_large_cells")
def fit_large_cells(spark, sf_dir):
    """Fits of a few cells with a share of all rows each; also what is fitted by means alone."""
    out = _trials(spark, sf_dir, "lineitem").summarize(["l_linestatus"], [], [], [f"l_extendedprice@{op}" for op in (_FITS["fit_weibull"], _FITS["fit_lognormal"])])
    return out.withColumn("value", F.round("value", FIT_DIGITS))


def _fit_sql(op: str, parts: dict[str, str], source: str = "events", head: str = "") -> str:
    return head + " UNION ALL ".join(f"SELECT event_type, 'value' AS variable, '{op}' AS operation, '{p}' AS parameter, round({sql}, {FIT_DIGITS}) AS value FROM {source} GROUP BY event_type" for p, sql in parts.items())


def _root(first: str, slope: str, source: str = "x", turns: int = 60, keys: str = "event_type") -> str:
    """CTEs that halve the interval (a, b) of each cell around the zero of a rising function, `slope` over the rows of source at `m`, the interval's middle."""
    ctes = [f"r0 AS MATERIALIZED ({first})"]
    for i in range(turns):
        at = f"(SELECT *, (a + b) / 2 AS m FROM r{i})"
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT {keys}, any_value(CASE WHEN s > 0 THEN a ELSE m END) AS a, any_value(CASE WHEN s > 0 THEN m ELSE b END) AS b FROM (SELECT {keys}, r.a, r.b, r.m, {slope} AS s FROM {source} JOIN {at} r USING ({keys}) GROUP BY ALL) GROUP BY {keys})")
    return ", ".join(ctes)


_POSITIVE = "x AS MATERIALIZED (SELECT event_type, value AS v FROM events WHERE value > 0)"
_LAMBDA = "(1 / (avg(1 / value) - 1 / avg(value)))"
ORACLE["fit_lognormal"] = _fit_sql(_FITS["fit_lognormal"], {"k": "stddev_pop(ln(value))", "θ": "exp(avg(ln(value)))"}, "(SELECT * FROM events WHERE value > 0)")
ORACLE["fit_wald"] = _fit_sql(_FITS["fit_wald"], {"m": f"sqrt({_LAMBDA}) / avg(value)", "a": f"sqrt({_LAMBDA})"}, "(SELECT * FROM events WHERE value > 0)")
ORACLE["fit_invgauss"] = _fit_sql(_FITS["fit_invgauss"], {"μ": _LAMBDA, "λ": "avg(value)"}, "(SELECT * FROM events WHERE value > 0)")

# The profile equation of a Weibull's shape: mean of v^k ln v over mean of v^k, less 1 / k, less the mean of ln v.
_WEIBULL = f"WITH {_POSITIVE}, {_root('SELECT event_type, 0.01 AS a, 100.0 AS b FROM x GROUP BY event_type', 'sum(exp(m * ln(v)) * ln(v)) / sum(exp(m * ln(v))) - 1 / any_value(m) - avg(ln(v))')} "
ORACLE["fit_weibull"] = _fit_sql(_FITS["fit_weibull"], {"k": "any_value((a + b) / 2)", "θ": "pow(avg(pow(v, (a + b) / 2)), 1 / any_value((a + b) / 2))"}, "x JOIN r60 USING (event_type)", _WEIBULL)
# The likelihood equation of a gamma's shape: digamma(k) - ln k + s, with digamma by recurrence and its asymptotic series.
_DIGAMMA = "ln(m + 8) - 0.5 / (m + 8) - 1 / (12 * pow(m + 8, 2)) + 1 / (120 * pow(m + 8, 4)) - 1 / (252 * pow(m + 8, 6)) + 1 / (240 * pow(m + 8, 8))" + "".join(f" - 1 / (m + {i})" for i in range(8))
_GAMMA = f"WITH {_POSITIVE}, g AS MATERIALIZED (SELECT event_type, avg(v) AS mean, ln(avg(v)) - avg(ln(v)) AS s FROM x GROUP BY event_type), {_root('SELECT event_type, 0.001 AS a, 1000.0 AS b FROM g', f'any_value({_DIGAMMA} - ln(m) + g.s)', 'g')} "
ORACLE["fit_gamma"] = _fit_sql(_FITS["fit_gamma"], {"k": "any_value((a + b) / 2)", "θ": "any_value(mean / ((a + b) / 2))"}, "g JOIN r60 USING (event_type)", _GAMMA)
# The profile equation of the shift of an inverse Gaussian, falling in the shift, so with its sign turned round.
_ALL = "x AS MATERIALIZED (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL)"
_MOVED = "0.5 * (avg(pow(v - m, -2)) - pow(avg(v - m), -2)) / (avg(1 / (v - m)) - 1 / avg(v - m)) - 1.5 * avg(1 / (v - m))"


def _shifted_sql(op: str, lowest: str, parts: dict[str, str]) -> str:
    y, shape = "(v - (a + b) / 2)", "(1 / (avg(1 / (v - (a + b) / 2)) - 1 / avg(v - (a + b) / 2)))"
    found = f"WITH {_ALL}, {_root(f'SELECT event_type, {lowest} AS a, min(v) AS b FROM x GROUP BY event_type', _MOVED)} "
    return _fit_sql(op, {k: v.format(shape=shape, mean=f"avg({y})", shift="any_value((a + b) / 2)") for k, v in parts.items()}, "x JOIN r60 USING (event_type)", found)


# The slope of the variance of (e^(m y) - 1) / m by m, with y the logarithms less their mean.
_SLOPE = "covar_pop((exp(m * y) - 1) / m, (y * exp(m * y) - (exp(m * y) - 1) / m) / m)"
_LOGS = "x AS MATERIALIZED (SELECT 1 AS one, event_id, ln(value + 1) AS l, ln(value + 1) - avg(ln(value + 1)) OVER () AS y FROM events)"
ORACLE["expr_boxcox"] = f"WITH {_LOGS}, {_root('SELECT 1 AS one, -2.9 AS a, 3.1 AS b', _SLOPE, keys='one')} SELECT event_id, round((exp((a + b) / 2 * l) - 1) / ((a + b) / 2), {FIT_DIGITS}) AS boxcox FROM x JOIN r60 USING (one)"
ORACLE["fit_shifted_wald"] = _shifted_sql(_FITS["fit_shifted_wald"], "min(v) - 2 * (max(v) - min(v))", {"m": "sqrt({shape}) / {mean}", "a": "sqrt({shape})", "shift": "{shift}"})
ORACLE["fit_shifted_ig"] = _shifted_sql(_FITS["fit_shifted_ig"], "0.0", {"μ": "{shape}", "λ": "{mean}", "shift": "{shift}"})


# --- pooled probabilities --------------------------------------------------------------------------------------------
@query("cdf_pooling")
def cdf_pooling(spark, sf_dir):
    marked = cdf.pooled(_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return _rounded(marked, "value_cdf")


@query("cdf_rule")
def cdf_rule(spark, sf_dir):
    return _rounded(_trials(spark, sf_dir).filter(["event_type"], [], ["value:Pooling CDF"], [0.9]).select("event_id", "value", "value_cdf"), "value_cdf")


@query("cdf_omega_fit")
def cdf_omega_fit(spark, sf_dir):
    p, omega = _trials(spark, sf_dir).omega("value", ["event_type"])
    return spark.createDataFrame([(round(float(p), DIGITS), round(float(omega), DIGITS))], "p double, omega double")


@query("cdf_histogram")
def cdf_histogram(spark, sf_dir):
    return cdf.histogram(cdf_pooling(spark, sf_dir), "value_cdf")
