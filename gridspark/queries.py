"""The registered queries: formulas and operators over the tables, each with SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.model import RunClock
from gridspark.operators import arrays, components, frames, lookups
from gridspark.operators.frames import ROW
from gridspark.plans.compile import Grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CLOCK = RunClock(dt.datetime(2024, 3, 15, 12, 0, 0, tzinfo=dt.UTC))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str, **more) -> Grid:
    cols = {"A": "o_orderkey", "B": "o_totalprice", "C": "o_orderpriority", "D": "o_orderdate", "E": "o_orderstatus", "F": "o_custkey"}
    return Grid(table(spark, d, "orders"), cols, ["o_orderkey"], dense=True, decimals=2, clock=CLOCK, **more)


def events(spark: SparkSession, d: str, **more) -> Grid:
    df = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return Grid(df, {"A": "event_id", "B": "value", "C": "event_type", "D": "user_id"}, ["event_id"], dense=True, decimals=2, **more)


def part(spark: SparkSession, d: str, **more) -> Grid:
    return Grid(table(spark, d, "part"), {"A": "p_partkey", "B": "p_retailprice", "C": "p_name", "D": "p_brand", "E": "p_type", "F": "p_size"}, ["p_partkey"], dense=True, decimals=2, **more)


def lineitem(spark: SparkSession, d: str) -> Grid:
    cols = {"A": "l_orderkey", "B": "l_linenumber", "C": "l_quantity", "D": "l_extendedprice", "E": "l_discount", "F": "l_tax", "G": "l_returnflag"}
    return Grid(table(spark, d, "lineitem"), cols, [], decimals=2)


def region(spark: SparkSession, d: str, **sheets: Grid) -> Grid:
    """A short sheet whose formulas look at long ones."""
    return Grid(table(spark, d, "region").select("r_regionkey", "r_name"), {"A": "r_regionkey", "B": "r_name"}, ["r_regionkey"], dense=True, decimals=2, others=sheets)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def formula(name: str, grid: Callable[..., Grid], key: list[str], formulas: dict[str, str | tuple[str, int]], sql: str, errs: tuple[str, ...] = (), **more) -> None:
    """A query of formula columns: the key columns, the results and the kinds of error of those in errs."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = grid(spark, d, **more)
        for i, (out, f) in enumerate(formulas.items()):
            text, at = f if isinstance(f, tuple) else (f, 1)
            g.fill("TUVWXYZ"[i], text, at=at, name=out)
        return g.run().select(*key, *formulas, *(f"{e}_err" for e in errs))


OK, EK, PK, LK = ["o_orderkey"], ["event_id"], ["p_partkey"], ["l_orderkey", "l_linenumber"]

# projections

formula("P1_template", lineitem, LK, {"v": "=C1*2"}, "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS v FROM lineitem")
formula("P3_absolute", orders, OK, {"v": "=B1-$B$1"}, "SELECT o_orderkey, o_totalprice - (SELECT arg_min(o_totalprice, o_orderkey) FROM orders) AS v FROM orders")
formula("P5P6_offset", events, EK, {"v": ("=B1+B3", 2)}, "SELECT event_id, CASE WHEN row_number() OVER w > 1 THEN coalesce(lag(value) OVER w, 0) + coalesce(lead(value) OVER w, 0) END AS v FROM events WINDOW w AS (ORDER BY event_id)")
formula("P9_arith", lineitem, LK, {"v": "=D1*(1-E1)"}, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem")
formula("P9_div_error", lineitem, LK, {"v": "=C1/F1"}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END AS v, CASE WHEN l_tax = 0 THEN 'Div' END AS v_err FROM lineitem", ("v",))
formula("P10_power", part, PK, {"v": "=F1^2", "w": "=(-F1)^2", "u": "=-F1^2"}, "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS v, CAST(p_size * p_size AS DOUBLE) AS w, CAST(-p_size * p_size AS DOUBLE) AS u FROM part")
formula("P11_unary", orders, OK, {"v": "=-B1", "w": "=B1%", "u": "=+B1"}, "SELECT o_orderkey, -o_totalprice AS v, o_totalprice / 100 AS w, o_totalprice AS u FROM orders")
formula("P12_concat", orders, OK, {"v": '=A1&"-"&C1'}, "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority AS v FROM orders")
formula("P13_compare", orders, OK, {"v": "=B1>=250000", "w": '=E1="f"', "u": "=C1>B1"}, "SELECT o_orderkey, o_totalprice >= 250000 AS v, lower(o_orderstatus) = 'f' AS w, true AS u FROM orders")
formula("P15_omitted", orders, OK, {"v": "=IF(B1>250000,1,)"}, "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM orders")
formula("P16_lambda", orders, OK, {"v": "=LAMBDA(x,y,x*2+y)(A1,1)"}, "SELECT o_orderkey, CAST(o_orderkey * 2 + 1 AS DOUBLE) AS v FROM orders")
formula("P17_error_literal", orders, OK, {"v": "=IFERROR(#REF!,7)", "w": "=#N/A"}, "SELECT o_orderkey, 7.0::DOUBLE AS v, NULL::DOUBLE AS w, 'Na' AS w_err FROM orders", ("w",))

# scalar functions

formula("F1_if", orders, OK, {"v": '=IF(B1>250000,"hi","lo")'}, "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'hi' ELSE 'lo' END AS v FROM orders")
formula("F1_ifs", orders, OK, {"v": '=IFS(B1>400000,"a",B1>200000,"b",TRUE,"c")'}, "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'a' WHEN o_totalprice > 200000 THEN 'b' ELSE 'c' END AS v FROM orders")
formula("F2_choose", orders, OK, {"v": '=CHOOSE(MOD(A1,3)+1,"x","y","z")'}, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS v FROM orders")
formula("F3_logic", orders, OK, {"v": '=AND(B1>100000,E1="O")', "w": '=OR(B1>400000,NOT(E1="O"))'}, "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'O' AS v, o_totalprice > 400000 OR NOT o_orderstatus = 'O' AS w FROM orders")
formula("F4_iferror", lineitem, LK, {"v": "=IFERROR(C1/F1,0)"}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_quantity / l_tax ELSE 0 END AS v FROM lineitem")
formula("F5_isnumber", orders, OK, {"v": "=ISNUMBER(B1)", "w": "=ISNUMBER(C1)", "u": "=ISNUMBER(1/A1)"}, "SELECT o_orderkey, true AS v, false AS w, o_orderkey <> 0 AS u FROM orders")
formula("F6_type", orders, OK, {"v": "=TYPE(B1)", "w": "=TYPE(C1)", "u": "=TYPE(1/A1)"}, "SELECT o_orderkey, 1.0::DOUBLE AS v, 2.0::DOUBLE AS w, CASE WHEN o_orderkey = 0 THEN 16.0::DOUBLE ELSE 1.0::DOUBLE END AS u FROM orders")
formula("F7_value", orders, OK, {"v": "=VALUE(LEFT(C1,1))", "w": "=VALUE(C1)"}, "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS DOUBLE) AS v, NULL::DOUBLE AS w, 'Value' AS w_err FROM orders", ("w",))
formula("F8_text", part, PK, {"v": "=LEFT(C1,3)", "w": "=RIGHT(C1,2)", "u": "=MID(C1,2,4)", "n": "=LEN(C1)"}, "SELECT p_partkey, left(p_name, 3) AS v, right(p_name, 2) AS w, substr(p_name, 2, 4) AS u, CAST(length(p_name) AS DOUBLE) AS n FROM part")
formula("F9_upper", part, PK, {"v": "=UPPER(C1)"}, "SELECT p_partkey, upper(p_name) AS v FROM part")
formula("F10_concat", part, PK, {"v": '=CONCAT(C1," ",F1)'}, "SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) AS v FROM part")
formula("F11_text_format", orders, OK, {"v": '=TEXT(A1,"0.00")', "w": '=TEXT(D1,"yyyy-mm-dd")'}, "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.00' AS v, strftime(o_orderdate, '%Y-%m-%d') AS w FROM orders")
formula("F12_abs", orders, OK, {"v": "=ABS(B1-250000)", "w": "=ABS(C1)"}, "SELECT o_orderkey, abs(o_totalprice - 250000) AS v, NULL::DOUBLE AS w, 'Value' AS w_err FROM orders", ("w",))
formula("F13_int_sqrt", orders, OK, {"v": "=INT(B1)", "w": "=SQRT(A1-10)"}, "SELECT o_orderkey, floor(o_totalprice) AS v, CASE WHEN o_orderkey >= 10 THEN sqrt(o_orderkey - 10) END AS w, CASE WHEN o_orderkey < 10 THEN 'Num' END AS w_err FROM orders", ("w",))
formula("F14_mod", events, EK, {"v": "=MOD(A1,7)", "w": "=MOD(A1,-3)", "u": "=MOD(A1,0)"}, "SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS v, event_id + 3 * floor(event_id / -3.0::DOUBLE) AS w, NULL::DOUBLE AS u, 'Div' AS u_err FROM events", ("u",))
formula("F15_round", orders, OK, {"v": "=ROUND(B1/2,0)", "w": "=ROUND(A1/8,1)"}, "SELECT o_orderkey, round(o_totalprice / 2) AS v, round(CAST(o_orderkey AS DECIMAL(18,3)) / 8, 1)::DOUBLE AS w FROM orders")
formula("F16_year_edate", orders, OK, {"v": "=YEAR(D1)", "w": "=EDATE(D1,1)"}, "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS v, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS w FROM orders")
formula("F17_today", orders, OK, {"v": "=TODAY()", "w": "=YEAR(TODAY())"}, "SELECT o_orderkey, DATE '2024-03-15' AS v, 2024.0::DOUBLE AS w FROM orders")
formula("F18_date_plus", orders, OK, {"v": "=EDATE(D1,0)+A1"}, "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey AS INTEGER) AS DATE) AS v FROM orders")
formula("F19_position", orders, OK, {"v": "=ROW()", "w": "=ROWS(B$1:B1)", "u": "=ADDRESS(ROW(),2)", "n": "=COLUMNS(A1:C1)"}, "SELECT o_orderkey, CAST(row_number() OVER w AS DOUBLE) AS v, CAST(row_number() OVER w AS DOUBLE) AS w, '$B$' || row_number() OVER w AS u, 3.0::DOUBLE AS n FROM orders WINDOW w AS (ORDER BY o_orderkey)")
formula("F20_dynamic", orders, OK, {"v": '=INDIRECT("B"&(A1+1))', "w": "=OFFSET($B$1,A1,0)"}, "SELECT o_orderkey, o_totalprice AS v, o_totalprice AS w FROM orders")

# aggregates

ALL = "FROM orders"
formula("A1_share", orders, OK, {"v": "=B1/SUM(B:B)*100"}, "SELECT o_orderkey, o_totalprice / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER () AS DOUBLE) * 100 AS v FROM orders")


def aggregate(name: str, cells: dict[str, str], sql: dict[str, str], source: str = "orders", errs: tuple[str, ...] = ()) -> None:
    """Formulas on a short sheet over whole columns of a long one."""
    makers = {"orders": orders, "events": events, "part": part, "lineitem": lineitem}

    @query(name, "SELECT r_regionkey, " + ", ".join(f"(SELECT {x} FROM {source}) AS {k}" for k, x in sql.items()) + " FROM region")
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = region(spark, d, S=makers[source](spark, d))
        for i, (out, f) in enumerate(cells.items()):
            g.fill("TUVWXYZ"[i], f, name=out)
        return g.run().select("r_regionkey", *cells, *(f"{e}_err" for e in errs))


DEC = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
aggregate("A1_sum", {"v": "=SUM(S!B:B)", "w": "=SUM(S!B$2:B$11)"}, {"v": DEC.format("o_totalprice"), "w": DEC.format("o_totalprice") + " FILTER (WHERE o_orderkey BETWEEN 1 AND 10)"})
SQL["A1_sum"] = f"SELECT r_regionkey, (SELECT {DEC.format('o_totalprice')} FROM orders) AS v, (SELECT {DEC.format('o_totalprice')} FROM orders WHERE o_orderkey BETWEEN 1 AND 10) AS w FROM region"
aggregate("A2_count", {"v": "=COUNT(S!B:B)", "w": "=COUNT(S!C:C)"}, {"v": "CAST(count(o_totalprice) AS DOUBLE)", "w": "0.0::DOUBLE"})
SQL["A2_count"] = "SELECT r_regionkey, (SELECT CAST(count(o_totalprice) AS DOUBLE) FROM orders) AS v, 0.0::DOUBLE AS w FROM region"
aggregate("A3_counta", {"v": "=COUNTA(S!B:C)"}, {"v": "CAST(count(o_totalprice) + count(o_orderpriority) AS DOUBLE)"})
aggregate("A4_min", {"v": "=MIN(S!B:B)"}, {"v": "min(o_totalprice)"})
aggregate("A5_max", {"v": "=MAX(S!B:B)"}, {"v": "max(o_totalprice)"})
aggregate("A6_average", {"v": "=AVERAGE(S!B:B)"}, {"v": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice)"})
aggregate("A7_sumif", {"v": '=SUMIF(S!E:E,"o",S!B:B)', "w": '=SUMIF(S!B:B,">250000")'}, {"v": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE lower(o_orderstatus) = 'o') AS DOUBLE)", "w": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 250000) AS DOUBLE)"})
aggregate("A8_countif", {"v": '=COUNTIF(S!B:B,">250000")', "w": '=COUNTIF(S!E:E,"F")', "u": '=COUNTIF(S!A:A,"7")'}, {"v": "CAST(count(*) FILTER (WHERE o_totalprice > 250000) AS DOUBLE)", "w": "CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)", "u": "CAST(count(*) FILTER (WHERE o_orderkey = 7) AS DOUBLE)"})
aggregate("A8_wildcard", {"v": '=COUNTIF(S!C:C,"*a*")', "w": '=COUNTIF(S!D:D,"Brand#?3")'}, {"v": "CAST(count(*) FILTER (WHERE p_name ILIKE '%a%') AS DOUBLE)", "w": "CAST(count(*) FILTER (WHERE p_brand ILIKE 'Brand#_3') AS DOUBLE)"}, "part")
aggregate("A11_countblank", {"v": "=COUNTBLANK(S!B:B)"}, {"v": "CAST(count(*) - count(value) AS DOUBLE)"}, "events")
aggregate("A12_countifs", {"v": '=COUNTIFS(S!C:C,"click",S!B:B,">50")', "w": '=SUMIFS(S!B:B,S!C:C,"<>click",S!B:B,"<=50")'}, {"v": "CAST(count(*) FILTER (WHERE lower(event_type) = 'click' AND value > 50) AS DOUBLE)", "w": "CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE lower(event_type) <> 'click' AND value <= 50), 0) AS DOUBLE)"}, "events")
aggregate("A12_averageif", {"v": '=AVERAGEIF(S!C:C,"1*",S!B:B)', "w": '=AVERAGEIF(S!C:C,"none",S!B:B)'}, {"v": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority ILIKE '1%') AS DOUBLE) / count(*) FILTER (WHERE o_orderpriority ILIKE '1%')", "w": "NULL::DOUBLE", "w_err": "'Div'"}, errs=("w",))
SQL["A12_averageif"] = "SELECT r_regionkey, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders WHERE o_orderpriority ILIKE '1%') AS v, NULL::DOUBLE AS w, 'Div' AS w_err FROM region"
aggregate("A13_minifs_maxifs", {"v": '=MAXIFS(S!B:B,S!E:E,"F")', "w": '=MINIFS(S!B:B,S!E:E,"O",S!A:A,">100")'}, {"v": "max(o_totalprice) FILTER (WHERE o_orderstatus = 'F')", "w": "min(o_totalprice) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey > 100)"})
aggregate("A14_median", {"v": "=MEDIAN(S!C:C)"}, {"v": "median(l_quantity)"}, "lineitem")
aggregate("A14_median_wide", {"v": "=MEDIAN(S!D:D)"}, {"v": "median(l_extendedprice)"}, "lineitem")
aggregate("A16_product", {"v": "=PRODUCT(S!F$1:F$5)"}, {"v": "CAST(product(p_size) FILTER (WHERE p_partkey < 5) AS DOUBLE)"}, "part")
aggregate("A17_sumproduct", {"v": "=SUMPRODUCT(S!D:D,S!E:E)"}, {"v": "CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(28,4))) AS DOUBLE)"}, "lineitem")
aggregate("A18_large_small", {"v": "=LARGE(S!B:B,3)", "w": "=SMALL(S!B:B,2)"}, {"v": "list(o_totalprice ORDER BY o_totalprice DESC)[3]", "w": "list(o_totalprice ORDER BY o_totalprice)[2]"})
aggregate("A19_stdev_var", {"v": "=ROUND(STDEV(S!C:C),6)", "w": "=ROUND(VAR(S!C:C),6)"}, {"v": "round(stddev_samp(l_quantity), 6)", "w": "round(var_samp(l_quantity), 6)"}, "lineitem")
aggregate("A20_loose", {"v": "=MAXA(S!C:C)", "w": "=MINA(S!F:F)"}, {"v": "0.0::DOUBLE", "w": "CAST(min(p_size) AS DOUBLE)"}, "part")
SQL["A20_loose"] = "SELECT r_regionkey, 0.0::DOUBLE AS v, (SELECT CAST(min(p_size) AS DOUBLE) FROM part) AS w FROM region"


@query("A15_mode", "SELECT r_regionkey, (SELECT CAST(p_size AS DOUBLE) FROM part GROUP BY p_size ORDER BY count(*) DESC, min(p_partkey) LIMIT 1) AS v, NULL::DOUBLE AS w, 'Na' AS w_err FROM region")
def a15(spark: SparkSession, d: str) -> DataFrame:
    g = region(spark, d, S=part(spark, d)).fill("T", "=MODE(S!F:F)", name="v").fill("U", "=MODE(S!A:A)", name="w")
    return g.run().select("r_regionkey", "v", "w", "w_err")


@query("A21_distinct", "SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS v FROM orders")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).df.groupBy("o_custkey").agg(F.lit(1).alias("one")).agg(F.count("*").cast("double").alias("v"))


@query("A9_first_error", "SELECT r_regionkey, NULL::DOUBLE AS v, 'Div' AS v_err FROM region")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """An error in a range becomes the aggregate's result."""
    g = region(spark, d).fill("T", "=1/A1", name="x").fill("U", "=SUM(T:T)", name="v")
    return g.run().select("r_regionkey", "v", "v_err")


formula("A22_sum_of_formulas", orders, OK, {"x": "=B1*2", "v": "=SUM(T:T)"}, "SELECT o_orderkey, o_totalprice * 2 AS x, (SELECT CAST(sum(CAST(o_totalprice * 2 AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS v FROM orders")

# rows above and below

W = "WINDOW w AS (ORDER BY event_id)"
formula("W1_lag", events, EK, {"v": ("=B2-B1", 2)}, f"SELECT event_id, value - lag(value) OVER w AS v FROM events {W}")
formula("W2_moving", events, EK, {"v": ("=SUM(B1:B3)", 3)}, "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 3 THEN CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id ROWS 2 PRECEDING) AS DOUBLE) END AS v FROM events")
formula("W3_expanding", events, EK, {"v": "=SUM(B$1:B1)", "w": "=MAX(B$1:B1)", "u": "=COUNTIF(B$1:B1,\">50\")"}, "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS v, max(value) OVER w AS w, CAST(count(*) FILTER (WHERE value > 50) OVER w AS DOUBLE) AS u FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
formula("W4_lead", events, EK, {"v": "=SUM(B1:B3)"}, "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS DOUBLE) AS v FROM events")
formula("W5_chain", events, EK, {"v": ("=T1+1", 2)}, f"SELECT event_id, CASE WHEN row_number() OVER w > 1 THEN CAST(row_number() OVER w - 1 AS DOUBLE) END AS v FROM events {W}")
formula("W6_deep_chain", events, EK, {"v": ("=T1+B6", 6)}, "SELECT event_id, CASE WHEN r > 5 THEN CAST(sum(CASE WHEN r > 5 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) OVER (PARTITION BY r % 5 ORDER BY r ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS v FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events)")
formula("W7_running", events, EK, {"x": "=B1*2", "v": ("=U1+T2", 2)}, "SELECT event_id, value * 2 AS x, CASE WHEN r > 1 THEN CAST(sum(CASE WHEN r > 1 THEN CAST(value * 2 AS DECIMAL(18,2)) ELSE 0 END) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS v FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events)")
formula("W11_whole", events, EK, {"v": "=B1/MAX(B:B)"}, "SELECT event_id, value / max(value) OVER () AS v FROM events")


@query("W8_fold", "WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id, event_id, value, k, value AS v FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.value, e.k, CASE WHEN f.v > 100 THEN e.value ELSE f.v + e.value END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, event_id, v FROM f")
def w8(spark: SparkSession, d: str) -> DataFrame:
    """A recurrence down each user's events: IF(above > 100, value, above + value)."""
    df = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("value"))
    return frames.ordered_fold(df, ["user_id"], ["event_id"], "value", "v", F.lit(0.0), lambda above, x: F.when(above > 100, x).otherwise(above + x)).select("user_id", "event_id", "v")


# lookups

BANDS = [(0.0, "low"), (100000.0, "mid"), (300000.0, "high"), (450000.0, "top")]
BANDS_SQL = "(VALUES (0.0::DOUBLE, 'low'), (100000.0::DOUBLE, 'mid'), (300000.0::DOUBLE, 'high'), (450000.0::DOUBLE, 'top')) AS b(lo, band)"


def bands(spark: SparkSession) -> Grid:
    df = spark.createDataFrame([(i + 1, *b) for i, b in enumerate(BANDS)], f"{ROW} long, lo double, band string")
    return Grid(df, {"A": "lo", "B": "band"}, [ROW])


def nation(spark: SparkSession, d: str) -> Grid:
    return Grid(table(spark, d, "nation"), {"A": "n_nationkey", "B": "n_name", "C": "n_regionkey"}, ["n_nationkey"], dense=True)


@query("J1_vlookup", "SELECT c_custkey, n_name AS v, CASE WHEN n_name IS NULL THEN 'Na' END AS v_err FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    g = Grid(df, {"A": "c_custkey", "B": "c_nationkey"}, [], others={"Nation": nation(spark, d)}, names={"Nations": "Nation!$A:$C"})
    return g.fill("T", "=VLOOKUP(B1,nations,2,FALSE)", name="v").run().select("c_custkey", "v", "v_err")


@query("J1_first_match", "SELECT o_orderkey, (SELECT arg_min(p_partkey, p_partkey) FROM part WHERE p_size = o_orderkey % 60) AS v, CASE WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_size = o_orderkey % 60) THEN 'Na' END AS v_err FROM orders")
def j1_first(spark: SparkSession, d: str) -> DataFrame:
    """Many rows of the table have the key: the first counts."""
    g = orders(spark, d, others={"Part": part(spark, d)})
    g.fill("T", "=MOD(A1,60)", name="k").fill("U", "=XLOOKUP(T1,Part!F:F,Part!A:A)", name="v")
    return g.run().select("o_orderkey", F.col("v").cast("long").alias("v"), "v_err")


@query("J2_approx", f"SELECT o_orderkey, band AS v, CASE WHEN band IS NULL THEN 'Na' END AS v_err FROM orders ASOF LEFT JOIN {BANDS_SQL} ON o_totalprice >= lo")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, others={"Bands": bands(spark)}).fill("T", "=VLOOKUP(B1,Bands!A:B,2)", name="v").run().select("o_orderkey", "v", "v_err")


@query("J3_hlookup", "SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS v, NULL::VARCHAR AS v_err FROM region")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """A lookup along a row: the row is turned into a column, then it is a lookup down."""
    line = spark.createDataFrame([(1, 0.0, 1.0, 2.0)], f"{ROW} long, c1 double, c2 double, c3 double")
    names = spark.createDataFrame([(1, "x", "y", "z")], f"{ROW} long, c1 string, c2 string, c3 string")
    down = arrays.transpose(line, 1, "double").withColumnRenamed("c1", "k").join(arrays.transpose(names, 1).withColumnRenamed("c1", "v"), ROW)
    keyed = table(spark, d, "region").select("r_regionkey", F.pmod("r_regionkey", F.lit(3)).cast("double").alias("k0"))
    return lookups.exact(keyed, "k0", down, "k", "v", "v").select("r_regionkey", "v", "v_err")


@query("J4J6_index_match", "SELECT s_suppkey, n_name AS v FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j46(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    g = Grid(df, {"A": "s_suppkey", "B": "s_nationkey"}, [], others={"Nation": nation(spark, d)})
    return g.fill("T", "=INDEX(Nation!$B:$B,MATCH(B1,Nation!$A:$A,0))", name="v").run().select("s_suppkey", "v")


@query("J5_match_approx", f"SELECT o_orderkey, CAST(k AS DOUBLE) AS v FROM orders ASOF LEFT JOIN (SELECT lo, row_number() OVER (ORDER BY lo) AS k FROM {BANDS_SQL}) AS t ON o_totalprice >= lo")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, others={"Bands": bands(spark)}).fill("T", "=MATCH(B1,Bands!A:A,1)", name="v").run().select("o_orderkey", "v")


@query("J7_xlookup", f"SELECT o_orderkey, coalesce(band, 'none') AS v FROM orders ASOF LEFT JOIN {BANDS_SQL} ON o_totalprice <= lo")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """The next larger key, with a value for a miss."""
    return orders(spark, d, others={"Bands": bands(spark)}).fill("T", '=XLOOKUP(B1,Bands!A:A,Bands!B:B,"none",1)', name="v").run().select("o_orderkey", "v")


@query("J8_lookup", f"SELECT o_orderkey, band AS v FROM orders ASOF LEFT JOIN {BANDS_SQL} ON o_totalprice >= lo")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, others={"Bands": bands(spark)}).fill("T", "=LOOKUP(B1,Bands!A:A,Bands!B:B)", name="v").run().select("o_orderkey", "v")


@query("J9_row_join", "SELECT o_orderkey, p_name AS v FROM orders LEFT JOIN part ON p_partkey = o_orderkey")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, others={"Two": part(spark, d)}).fill("T", "=Two!C1", name="v").run().select("o_orderkey", "v")


formula("J10_countif_row", events, EK, {"v": "=COUNTIF(C:C,C1)"}, "SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE) AS v FROM events")
formula("J10_countif_le", orders, OK, {"v": '=COUNTIF(B:B,"<="&B1)', "w": '=COUNTIF(B:B,"<"&B1)'}, "SELECT o_orderkey, CAST(count(*) OVER w AS DOUBLE) AS v, CAST(rank() OVER (ORDER BY o_totalprice) - 1 AS DOUBLE) AS w FROM orders WINDOW w AS (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING)")
RUN = "RANGE UNBOUNDED PRECEDING"
formula("J10_sumif_row", events, EK, {"v": "=SUMIF(C:C,C1,B:B)", "w": "=AVERAGEIF(D:D,D1,B:B)"}, "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type) AS DOUBLE) AS v, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER u AS DOUBLE) / count(value) OVER u AS w FROM events WINDOW u AS (PARTITION BY user_id)")
formula("J10_countif_ge", orders, OK, {"v": '=COUNTIF(B:B,">="&B1)', "w": '=COUNTIF(B:B,">"&B1)', "x": '=COUNTIF(E:E,"<>"&E1)'}, f"SELECT o_orderkey, CAST(count(*) OVER w AS DOUBLE) AS v, CAST(rank() OVER w - 1 AS DOUBLE) AS w, CAST(count(*) OVER () - count(*) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS x FROM orders WINDOW w AS (ORDER BY o_totalprice DESC {RUN})")
formula("J10_ifs_row", orders, OK, {"v": '=SUMIFS(B:B,E:E,E1,B:B,"<="&B1)', "w": '=COUNTIFS(F:F,F1,B:B,">"&B1)', "x": '=MAXIFS(B:B,F:F,F1,B:B,"<50000")'}, f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice {RUN}) AS DOUBLE) AS v, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) - 1 AS DOUBLE) AS w, CAST(coalesce(max(CASE WHEN o_totalprice < 50000 THEN o_totalprice END) OVER (PARTITION BY o_custkey), 0) AS DOUBLE) AS x FROM orders")


@query("J10_other_sheet", "SELECT c_custkey, CAST(coalesce(s, 0) AS DOUBLE) AS v, CAST(coalesce(n, 0) AS DOUBLE) AS w FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey")
def j10_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's sum and number of orders, which stand on another sheet."""
    g = Grid(table(spark, d, "customer").select("c_custkey"), {"A": "c_custkey"}, ["c_custkey"], dense=True, decimals=2, others={"Orders": orders(spark, d)})
    return g.fill("T", "=SUMIF(Orders!F:F,A1,Orders!B:B)", name="v").fill("U", "=COUNTIF(Orders!F:F,A1)", name="w").run().select("c_custkey", "v", "w")


@query("A23_text_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS _row FROM part")
def a23_text(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers by a text that many rows share, then a number."""
    return frames.with_rows(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"]).select("p_partkey", ROW)

# dynamic arrays


def block(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"], dense=True)


@query("O1_sort", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return arrays.sort(block(spark, d), "p_size", descending=True).select("p_partkey", "p_size")


@query("O2_unique", "SELECT p_size, min(p_partkey) + 1 AS _row FROM part GROUP BY p_size")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return arrays.unique(block(spark, d), ["p_size"]).select("p_size", ROW)


@query("O3_filter", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def o3(spark: SparkSession, d: str) -> DataFrame:
    return arrays.keep(block(spark, d), F.col("p_size") > 25).select("p_partkey", "p_name")


@query("O4_take_drop", "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r > 5 AND r > n - 20")
def o4(spark: SparkSession, d: str) -> DataFrame:
    return arrays.take(arrays.drop(block(spark, d), 5), -20).select("p_partkey", "p_size")


@query("O5_sequence", "SELECT CAST(r AS BIGINT) AS _row, 10.0::DOUBLE + 5 * ((r - 1) * 2) AS c1, 10.0::DOUBLE + 5 * ((r - 1) * 2 + 1) AS c2 FROM range(1, 1001) AS t(r)")
def o5(spark: SparkSession, d: str) -> DataFrame:
    return arrays.sequence(spark, 1000, 2, 10, 5)


@query("O6_transpose", "SELECT 1::BIGINT AS _row, " + ", ".join(f"max(CASE WHEN r_regionkey = {k} THEN r_name END) AS c{k + 1}" for k in range(5)) + " FROM region")
def o6(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.with_rows(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"], dense=True)
    return arrays.transpose(rows.select(ROW, "r_name"), 5)


@query("O7_choose", "SELECT p_name AS c1, CAST(p_size AS INTEGER) AS c2, p_partkey AS c3 FROM part WHERE p_partkey IN (0, 2, (SELECT max(p_partkey) FROM part))")
def o7(spark: SparkSession, d: str) -> DataFrame:
    return arrays.choose_rows(arrays.choose_cols(block(spark, d), [2, -1, 1]), [1, 3, -1]).drop(ROW)


@query("O8_tocol", "SELECT r_regionkey * 2 + 1 + k AS _row, CASE k WHEN 0 THEN CAST(r_regionkey AS VARCHAR) ELSE r_name END AS value FROM region, (VALUES (0), (1)) AS t(k)")
def o8(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.with_rows(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"], dense=True)
    return arrays.to_col(rows)


SQL["O8_tocol"] = "SELECT CAST(r_regionkey * 2 + 1 + k AS BIGINT) AS _row, CASE k WHEN 0 THEN CAST(r_regionkey AS VARCHAR) ELSE r_name END AS value FROM region, (VALUES (0), (1)) AS t(k)"


@query("O8_wraprows", "SELECT CAST(p_partkey // 7 + 1 AS BIGINT) AS _row, " + ", ".join(f"coalesce(max(CASE WHEN p_partkey % 7 = {k} THEN p_size END), -1) AS c{k + 1}" for k in range(7)) + " FROM part GROUP BY p_partkey // 7")
def o8_wrap(spark: SparkSession, d: str) -> DataFrame:
    return arrays.wrap_rows(block(spark, d).select(ROW, "p_size"), 7, -1)


@query("O9_expand", "SELECT CAST(r AS BIGINT) AS _row, coalesce(r_name, 'pad') AS r_name, 'pad' AS c2 FROM range(1, 8) AS t(r) LEFT JOIN region ON r_regionkey = r - 1")
def o9(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.with_rows(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"], dense=True)
    return arrays.expand(rows.select(ROW, "r_name"), 7, 2, "pad")


@query("O10_munit", "SELECT CAST(r AS BIGINT) AS _row, " + ", ".join(f"CAST(r = {k} AS INTEGER)::DOUBLE AS c{k}" for k in range(1, 5)) + " FROM range(1, 5) AS t(r)")
def o10(spark: SparkSession, d: str) -> DataFrame:
    return arrays.identity(spark, 4)


@query("O11_makearray", "SELECT CAST(r AS BIGINT) AS _row, " + ", ".join(f"CAST(r * {k} AS DOUBLE) AS c{k}" for k in range(1, 4)) + " FROM range(1, 101) AS t(r)")
def o11(spark: SparkSession, d: str) -> DataFrame:
    return arrays.make_array(spark, 100, 3, lambda r, c: (r * c).cast("double"))


@query("O12_randarray", None)
def o12(spark: SparkSession, d: str) -> DataFrame:
    return arrays.random_array(spark, 100, 2, seed=7)


@query("O13_textsplit", "SELECT p_partkey + 1 AS _row, unnest(string_split(p_name, ' ')) AS value, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS INTEGER) AS part_col FROM part")
def o13(spark: SparkSession, d: str) -> DataFrame:
    return arrays.text_split(block(spark, d), "p_name", " ").select(ROW, "value", "part_col")


O14_SQL = """WITH a AS (SELECT r_regionkey AS k, CAST(r_regionkey * 2 + 1 AS INTEGER) AS col, list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
b AS (SELECT *, k = 1 AND len(names) >= 3 AS blocked FROM a)
SELECT 1 AS sheet, CAST(i AS INTEGER) AS "row", col, names[i] AS value, CASE WHEN i = 1 THEN 'anchor' ELSE 'spill' END AS kind FROM (SELECT col, names, unnest(range(1, len(names) + 1)) AS i FROM b WHERE NOT blocked)
UNION ALL SELECT 1, 1, col, NULL, 'error' FROM b WHERE blocked"""


@query("O14_spill", O14_SQL)
def o14(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as an array that spills down its column; that of region 1 is blocked by a value in row 3."""
    names = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))  # 25 rows in all
    own = table(spark, d, "region").join(names, F.col("n_regionkey") == F.col("r_regionkey"))
    anchors = own.select(F.lit(1).alias("sheet"), F.lit(1).alias("row"), (F.col("r_regionkey") * 2 + 1).cast("int").alias("col"), F.transform("n", lambda x: F.array(x["n_name"])).alias("cells"))
    return arrays.spilled(spark, anchors, spark.createDataFrame([(1, 3, 3)], "sheet int, row int, col int"))


@query("O18_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def o18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8)


@query("U1_vstack", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def u1(spark: SparkSession, d: str) -> DataFrame:
    a = frames.with_rows(table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name")), ["r_regionkey"], dense=True).select(ROW, "name")
    b = frames.with_rows(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), ["n_nationkey"], dense=True).select(ROW, "name")
    return arrays.vstack(a, b).select("name")


@query("U1_hstack", "SELECT CAST(coalesce(r_regionkey, n_nationkey) + 1 AS BIGINT) AS _row, r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_nationkey")
def u1h(spark: SparkSession, d: str) -> DataFrame:
    a = frames.with_rows(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"], dense=True).select(ROW, "r_name")
    b = frames.with_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], dense=True).select(ROW, "n_name")
    return arrays.hstack(a, b)


@query("U3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("U4_set_equal", "SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey").exceptAll(table(spark, d, "customer").select("c_nationkey").distinct()).agg(F.count("*").alias("n"))


# order, extents, dependencies


@query("O19_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _row FROM orders")
def o19(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers over any order, by runs: no single-partition sort."""
    return frames.with_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", ROW)


@query("A23_extent", "SELECT count(*) AS rows, max(o_orderkey) + 1 AS last FROM orders")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], dense=True).agg(F.count("*").alias("rows"), F.max(ROW).alias("last"))


@query("D7_components", "SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def d7(spark: SparkSession, d: str) -> DataFrame:
    """Nations are formula cells; each reads the range of the next nation of its region."""
    from pyspark.sql import Window

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    nxt = F.lead("id").over(Window.partitionBy("n_regionkey").orderBy("id"))
    formulas = n.select("id", F.lit(1).alias("sheet"), F.col("id").alias("row"), F.lit(1).alias("col"))
    ranges = n.withColumn("to", nxt).where("to is not null").select("id", F.lit(1).alias("sheet"), F.col("to").alias("top"), F.lit(1).alias("left"), F.col("to").alias("bottom"), F.lit(1).alias("right"))
    return components.components(n.select("id"), components.reading(formulas, ranges).select("reader", "source"))


@query("D8_extents", "SELECT n_regionkey AS component, max(n_nationkey) - min(n_nationkey) + 1 AS cells FROM nation GROUP BY n_regionkey")
def d8(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "nation").select(F.col("n_regionkey").alias("component"), F.lit(1).alias("sheet"), F.col("n_nationkey").alias("row"), F.lit(1).alias("col"))
    return components.extents(cells).select("component", "cells")


@query("S2_xlsx", """WITH n AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS r, * FROM nation)
SELECT 0 AS sheet, 'Nation' AS sheet_name, r AS "row", 1 AS col, 'number' AS kind, CAST(n_nationkey AS DOUBLE) AS number, NULL::VARCHAR AS text, NULL::VARCHAR AS formula FROM n
UNION ALL SELECT 0, 'Nation', r, 2, 'text', NULL, n_name, NULL FROM n UNION ALL SELECT 0, 'Nation', r, 3, 'number', 0.0, NULL, '=A' || r || '*2' FROM n""")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """A workbook made of the nations, read back as cells by the data source."""
    from gridspark.sources.xlsx import read_cells
    from gridspark.workspace import new_file

    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    cells = {f"A{i}": float(r["n_nationkey"]) for i, r in enumerate(rows, 1)} | {f"B{i}": r["n_name"] for i, r in enumerate(rows, 1)} | {f"C{i}": f"=A{i}*2" for i in range(1, len(rows) + 1)}
    return read_cells(spark, new_file(spark, "nations.xlsx", {"Nation": cells})).select("sheet", "sheet_name", "row", "col", "kind", "number", "text", "formula")


@query("API1_rows", """SELECT 'Nation' AS sheet, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS "row", '{"key":' || CAST(CAST(n_nationkey AS DOUBLE) AS VARCHAR) || ',"share":' || CAST(n_nationkey / sum(CAST(n_nationkey AS DOUBLE)) OVER () AS VARCHAR) || '}' AS cells FROM nation""")
def api1(spark: SparkSession, d: str) -> DataFrame:
    """The same workbook evaluated: rows as JSON."""
    from gridspark.api import eval_rows
    from gridspark.sources.xlsx_builder import workbook

    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    cells = {f"A{i}": float(r["n_nationkey"]) for i, r in enumerate(rows, 1)} | {f"C{i}": f"=A{i}/SUM(A:A)" for i in range(1, len(rows) + 1)}
    found = [(s, r, v[0], v[2]) for s, r, v in eval_rows(workbook({"Nation": cells}), min_formulas=0, spark=spark)]
    return spark.createDataFrame(found, "sheet string, row int, key double, share double").select("sheet", "row", F.to_json(F.struct("key", "share")).alias("cells"))


BM2_SQL = """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS f0, l_extendedprice * (1 - l_discount) AS f1, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS f2,
CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END AS f3, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity / l_tax END AS f4, CAST(round(CAST(CAST(l_extendedprice / l_quantity AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE) AS f5,
l_returnflag || '-' || l_linenumber AS f6, CAST(l_orderkey % 7 AS DOUBLE) AS f7, abs(l_extendedprice - 30000) AS f8, floor(l_extendedprice) AS f9, l_quantity > 10 AND l_discount < 0.05 AS f10,
upper(l_returnflag) AS f11, l_extendedprice / 100 AS f12, -l_quantity AS f13, CAST(length(l_returnflag) AS DOUBLE) AS f14, l_extendedprice / CAST(t AS DOUBLE) AS f15, l_extendedprice / (CAST(t AS DOUBLE) / n) AS f16,
CAST(r AS DOUBLE) AS f17, CAST(q AS DOUBLE) AS f18, p_retailprice AS f19, CAST(p_size AS DOUBLE) AS f20
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey, (SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_quantity > 25) AS q FROM lineitem)"""


@query("BM2_wide_sheet", BM2_SQL)
def bm2(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_sheet(spark, d).run().select("l_orderkey", "l_linenumber", *(f"f{i}" for i in range(21)))


def benchmark_sheet(spark: SparkSession, d: str) -> Grid:
    """The benchmark's shape over lineitem: row-local columns, four whole-column aggregates, two lookups."""
    g = lineitem(spark, d)
    g.others = {"Part": part(spark, d)}
    g.df = g.df.select(*g.columns.values(), "l_partkey")
    g.columns["H"] = "l_partkey"
    local = ["=C1*2", "=D1*(1-E1)", "=D1*(1-E1)*(1+F1)", "=IF(C1>25,D1,0)", "=IFERROR(C1/F1,0)", "=ROUND(D1/C1,2)", '=G1&"-"&B1', "=MOD(A1,7)", "=ABS(D1-30000)", "=INT(D1)", "=AND(C1>10,E1<0.05)", "=UPPER(G1)", "=D1%", "=-C1", "=LEN(G1)"]
    whole = ["=D1/SUM(D:D)", "=D1/AVERAGE(D:D)", '=SUMIF(G:G,"R",C:C)', '=COUNTIF(C:C,">25")']
    joins = ["=VLOOKUP(H1,Part!A:F,2,FALSE)", "=INDEX(Part!F:F,MATCH(H1,Part!A:A,0))"]
    for i, f in enumerate([*local, *whole, *joins]):
        g.fill(f"B{chr(65 + i)}", f, name=f"f{i}")
    return g
