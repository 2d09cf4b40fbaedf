"""Queries against DuckDB, and operators on small tables cut into small blocks."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark import api
from gridspark.operators import criteria, frames, lookups
from gridspark.operators.frames import ROW
from gridspark.plans.compile import Grid, NotCompilable
from gridspark.queries import QUERIES, SQL
from gridspark.sources.xlsx_builder import workbook

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
    kinds = {c[0]: c[1] for c in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds


def small(spark, n=50, **more):
    df = spark.range(1, n + 1).select(F.col("id"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    return Grid(df, {"A": "id", "B": "x"}, ["id"], dense=True, block_rows=8, **more)


def column(grid, *formulas, at=1):
    for i, f in enumerate(formulas):
        grid.fill("TUVW"[i], f, at=at, name=f"v{i}")
    rows = grid.run().orderBy(ROW).collect()
    return [[r[f"v{i}"] for r in rows] for i in range(len(formulas))]


def test_blocks_do_not_show(spark):
    xs = [float(i * 7 % 11) for i in range(1, 51)]
    moving, lead, run, least = column(small(spark), "=SUM(B1:B3)", "=B4", "=SUM(B$1:B1)", "=MIN(B$1:B1)")
    assert moving == [sum(xs[i : i + 3]) for i in range(50)]
    assert lead == [xs[i + 3] if i + 3 < 50 else None for i in range(50)]
    assert run == [sum(xs[: i + 1]) for i in range(50)]
    assert least == [min(xs[: i + 1]) for i in range(50)]
    (deep,) = column(small(spark), "=T1+B6", at=6)
    want = [None] * 5
    for i in range(5, 50):
        want.append((want[i - 5] or 0) + xs[i])
    assert deep == want


def test_reach_is_bounded(spark):
    with pytest.raises(ValueError):
        small(spark).fill("T", "=B20", name="v").run()


def test_error_stays_in_a_chain(spark):
    g = small(spark, 10).fill("T", "=1/(A1-4)", name="x1").fill("U", "=U1+T2", at=2, name="v")
    rows = g.run().orderBy(ROW).collect()
    assert [r["v_err"] for r in rows] == [None] * 3 + ["Div"] * 7


def test_rows_of_any_order(spark):
    df = spark.createDataFrame([(5.0, "a"), (1.0, "b"), (5.0, "c"), (None, "d")], "x double, k string")
    got = {r["k"]: r[ROW] for r in frames.with_rows(df, ["x", "k"]).collect()}
    assert got == {"d": 1, "b": 2, "a": 3, "c": 4}


def test_lookups(spark):
    table = spark.createDataFrame([(1, "A", 1.0), (2, "b", 2.0), (3, "a", 3.0)], f"{ROW} long, k string, v double")
    df = spark.createDataFrame([("a",), ("B",), ("z",), (None,)], "q string")
    got = {r["q"]: (r["o"], r["o_err"]) for r in lookups.exact(df, "q", table, "k", "v", "o").collect()}
    assert got == {"a": (1.0, None), "B": (2.0, None), "z": (None, "Na"), None: (None, "Na")}
    assert {r["q"]: r["o"] for r in lookups.exact(df, "q", table, "k", "v", "o", last=True).collect()}["a"] == 3.0
    steps = spark.createDataFrame([(float(k), float(k)) for k in range(0, 100, 10)], "k double, v double")
    keys = spark.createDataFrame([(float(x),) for x in (-1, 0, 5, 55, 99, 1000)], "q double")
    down = {r["q"]: r["o"] for r in lookups.nearest(keys, "q", steps, "k", "v", "o", buckets=4).collect()}
    assert down == {-1: None, 0: 0, 5: 0, 55: 50, 99: 90, 1000: 90}
    up = {r["q"]: r["o"] for r in lookups.nearest(keys, "q", steps, "k", "v", "o", above=True, buckets=4).collect()}
    assert up == {-1: 0, 0: 0, 5: 10, 55: 60, 99: None, 1000: None}


def test_criteria(spark):
    df = spark.createDataFrame([("1",), ("1x",), ("a*c",), ("abc",), (None,), ("",)], "t string")
    count = lambda c: df.where(criteria.predicate(F.col("t"), "text", c)).count()
    assert [count(c) for c in ("1", "1*", "a~*c", "a?c", "", "<>", "<>1", ">a")] == [1, 2, 1, 2, 2, 5, 5, 2]


def test_row_criteria_equal_the_whole_file_run(spark):
    """Every function of criteria that follow the row, over blanks, ties and both cases, as the interpreter gives them."""
    rows = [(1, 3.0, "a", 1.0), (2, None, "B", 2.0), (3, 3.0, None, 4.0), (4, 1.0, "A", 8.0), (5, 7.5, "d", 16.0), (6, 1.0, "b", None), (7, -2.0, "c", 64.0)]
    formulas = ["COUNTIF(B:B,B1)", 'COUNTIF(B:B,"<"&B1)', 'COUNTIF(B:B,">="&B1)', 'COUNTIF(B:B,"<>"&B1)', "COUNTIF(C:C,C1)", 'COUNTIF(C:C,"="&C1)', 'COUNTIF(C:C,"<>"&C1)', "SUMIF(C:C,C1,D:D)", 'SUMIF(B:B,">"&B1,D:D)', "SUMIF(B:B,B1)",
                'SUMIFS(D:D,C:C,C1,B:B,"<="&B1)', 'COUNTIFS(C:C,C1,D:D,">3")', "AVERAGEIF(C:C,C1,D:D)", 'MAXIFS(D:D,B:B,"<="&B1)', "MINIFS(D:D,C:C,C1)", "COUNTIF(B$2:B$5,B1)"]
    df = spark.createDataFrame(rows, "k long, b double, c string, d double").repartition(3)
    g = Grid(df, {"A": "k", "B": "b", "C": "c", "D": "d"}, ["k"], dense=True, decimals=2)
    for i, f in enumerate(formulas):
        g.fill(f"E{chr(65 + i)}", "=" + f, name=f"f{i}")
    assert {r["strategy"] for r in g.explain()} == {"join"}
    got = {r["k"]: r.asDict() for r in g.run().collect()}
    cells = {f"{l}{r[0]}": v for r in rows for l, v in zip("ABCD", r, strict=True) if v is not None}
    moved = {f"{'EFGHIJKLMNOPQRST'[i]}{r[0]}": "=" + re.sub(r"(?<![$A-Z:])([BC])1\b", rf"\g<1>{r[0]}", f) for i, f in enumerate(formulas) for r in rows}
    sheet = api.eval_grid(workbook({"S": cells | moved}), spark=spark)["S"]
    for i, f in enumerate(formulas):
        for at, r in enumerate(rows):
            want, have = sheet[at][4 + i], got[r[0]][f"f{i}"]
            assert have == want if isinstance(want, float) else have is None and got[r[0]][f"f{i}_err"] == "Div", (f, r, want, have)


def test_row_criteria_tell_empty_texts_from_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "k long, c string")
    g = Grid(df, {"A": "k", "B": "c"}, ["k"], dense=True).fill("T", "=COUNTIF(B:B,B1)", name="v").fill("U", '=COUNTIF(B:B,"="&B1)', name="w")
    assert sorted((r["k"], r["v"], r["w"]) for r in g.run().collect()) == [(1, 2.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 1.0)]


def test_row_criteria_refused(spark):
    df = spark.createDataFrame([(1, "a*", 1.0), (2, "b", 2.0)], "k long, c string, d double")
    grid = lambda f: Grid(df, {"A": "k", "B": "c", "C": "d"}, ["k"], dense=True).fill("T", f)
    for f in ("=COUNTIF(B:B,B1)", '=COUNTIF(B:B,"<"&B1)', "=COUNTIF(B:B,C1)", '=COUNTIFS(C:C,"<"&C1,A:A,">"&A1)', '=SUMIF(C:C,"<>"&C1)'):
        with pytest.raises(NotCompilable):
            grid(f).run()


def test_row_numbers_of_any_kind(spark):
    import datetime as dt
    import random

    r = random.Random(3)
    for kind, make in {"string": lambda: r.choice(["", "a", "ab", "é", "Z"]), "date": lambda: dt.date(2020, 1, r.randint(1, 5)), "double": lambda: float(r.randint(-3, 3)), "boolean": lambda: r.random() < 0.5}.items():
        rows = [(None if r.random() < 0.2 else make(), i) for i in range(300)]
        df = spark.createDataFrame(rows, f"x {kind}, i long").repartition(5)
        got = frames.with_rows(df, ["x", "i"], buckets=70).collect()
        want = sorted(rows, key=lambda t: ((t[0] is not None, t[0]) if t[0] is not None else (False,), t[1]))
        assert [(t["x"], t["i"]) for t in sorted(got, key=lambda t: t[ROW])] == want and sorted(t[ROW] for t in got) == list(range(1, 301))
    assert frames.with_rows(df.limit(0), ["x", "i"]).count() == 0


def test_median(spark):
    import statistics

    for xs in ([], [None], [4.0], [1.0, 2.0], [5.0] * 9 + [1.0, None], [float(i % 37) for i in range(500)], [1.5, -2.0, 9.0, 9.0]):
        values = spark.createDataFrame([(x,) for x in xs], "x double")
        kept = [x for x in xs if x is not None]
        assert frames.median_of(values, "m").collect()[0]["m"] == (statistics.median(kept) if kept else None)


def test_strategies(spark):
    g = small(spark).fill("T", "=B1*2").fill("U", "=SUM(B1:B3)").fill("V", "=V1+B2", at=2).fill("W", "=VLOOKUP(A1,A:B,2,FALSE)").fill("X", "=IF(X1>3,B2,X1*B2)", at=2)
    assert {r["column"]: r["strategy"] for r in g.explain()} == {"T": "columnar", "U": "window", "V": "prefix", "W": "join", "X": "ordered_fold"}
    with pytest.raises(NotCompilable):
        g.run()


def test_no_single_partition_window(spark):
    g = small(spark).fill("T", "=SUM(B1:B3)", name="v")
    plan = g.run()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id", "", 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_move_once_and_narrow(spark, monkeypatch):
    """Two lookups by one column deal the rows out once, before any formula column stands in them."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 10, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["BM2_wide_sheet"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 3  # of the rows, and of the table of each lookup
    assert re.search(r"Exchange hashpartitioning\(l_partkey[^\n]*\n[^\n]*FileScan parquet", plan)


def test_whole_columns_are_read_from_the_table_as_given(spark):
    """An aggregate of a column that was given makes no other column's aggregates anew."""
    g = small(spark).fill("T", "=B1/SUM(B:B)").fill("U", "=B1/MAX(B:B)")
    assert plan_of(g.run()).count("BroadcastNestedLoopJoin") == 5  # the first row's key for the rows and for each aggregate, and the two aggregates
    g.fill("V", "=A1/SUM(T:T)")
    xs = [float(i * 7 % 11) for i in range(1, 51)]
    got = [(r["T"], r["U"], round(r["V"], 9)) for r in g.run().orderBy(ROW).collect()]
    assert got == [(x / sum(xs), x / max(xs), float(i)) for i, x in enumerate(xs, 1)]


@pytest.mark.parametrize("name", ["BM2_wide_sheet", "J1_first_match", "J4J6_index_match", "F20_dynamic"])
def test_lookups_in_long_tables(spark, duck, monkeypatch, name):
    """Tables of more keys than may be broadcast are joined by sort, however small Spark takes them to be."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 10, raising=False)
    df = QUERIES[name](spark, SF)
    assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)
    cols = sorted(df.columns)
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


def test_long_tables_of_few_keys_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 20, raising=False)
    g = small(spark).fill("T", "=VLOOKUP(A1,B:B,1,FALSE)", name="v")  # 50 rows, 11 keys
    assert "BroadcastHashJoin" in plan_of(g.run())


@pytest.mark.parametrize("limit", [1 << 16, 2])
def test_index_of_match_equals_the_whole_file_run(spark, monkeypatch, limit):
    """First matches, misses, blanks, parts of columns, and ranges of different rows, where the place itself is looked up."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", limit, raising=False)
    rows = [(1, 5.0, 10.0, 7.0), (2, 7.0, 20.0, 5.0), (3, 7.0, 30.0, 9.0), (4, 9.0, None, 1.0), (5, None, 50.0, 7.0), (6, 1.0, 60.0, 3.0)]
    formulas = ["INDEX(C:C,MATCH(D1,B:B,0))", "INDEX(C$2:C$4,MATCH(D1,B$2:B$4,0))", "INDEX(C$3:C$6,MATCH(D1,B$1:B$4,0))", "INDEX(C$2:C$3,MATCH(D1,B$2:B$6,0))", "INDEX(A:C,(MATCH(D1,B:B,FALSE)),3)", "IFERROR(INDEX(C:C,MATCH(D1,B:B,0)),-1)", "INDEX(C:C,MATCH(1/(D1-9),B:B,0))", "VLOOKUP(D1,B:C,2,FALSE)", "MATCH(D1,B$2:B$6,0)"]
    g = Grid(spark.createDataFrame(rows, "a long, b double, c double, d double").repartition(3), dict(zip("ABCD", "abcd", strict=True)), ["a"], dense=True)
    for i, f in enumerate(formulas):
        g.fill("EFGHIJKLM"[i], "=" + f, name=f"f{i}")
    got = {r["a"]: r.asDict() for r in g.run().collect()}
    cells = {f"{l}{r[0]}": (float(v) if l == "A" else v) for r in rows for l, v in zip("ABCD", r, strict=True) if v is not None}
    moved = {f"{'EFGHIJKLM'[i]}{r[0]}": "=" + f.replace("D1", f"D{r[0]}") for i, f in enumerate(formulas) for r in rows}
    sheet = api.eval_grid(workbook({"S": cells | moved}), spark=spark)["S"]
    for i, f in enumerate(formulas):
        for at, r in enumerate(rows):
            want, have, err = sheet[at][4 + i], got[r[0]][f"f{i}"], got[r[0]].get(f"f{i}_err")
            assert (have or 0.0) == (want or 0.0) and err is None if want is None or isinstance(want, float) else have is None and want["kind"] == err, (f, r, want, have, err)


def test_columns_that_move_rows_come_first_and_stand_where_they_stood(spark):
    g = small(spark, names={"Doubles": "$T:$T"})
    g.fill("S", "=A1+0.5", name="s").fill("T", "=B1*2", name="t").fill("U", "=COUNTIF(Doubles,B1)", name="u").fill("V", "=SUM(B1:B2)", name="v").fill("W", "=1/(U1-U1)", name="w")
    out = g.run()
    assert out.columns == ["id", "x", ROW, "s", "t", "v", "u", "w", "w_err"]
    xs = [float(i * 7 % 11) for i in range(1, 51)]
    got = [(r["s"], r["t"], r["u"], r["v"], r["w_err"]) for r in out.orderBy(ROW).collect()]
    assert got == [(i + 1.5, x * 2, float(sum(y * 2 == x for y in xs)), sum(xs[i : i + 2]), "Div") for i, x in enumerate(xs)]


def test_stream_carries_rows(spark, tmp_path):
    from gridspark.streaming.carry import carried

    spark.range(1, 13).selectExpr("id", "id % 2 as k", "cast(id as double) as x").coalesce(1).write.parquet(str(tmp_path / "in1"))
    stream = spark.readStream.schema("id long, k long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = carried(stream, "k", "id", {"A": "x", "B": "s"}, {"B": "=SUM(A1:A3)"}, 2, at=3)
    q = out.writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["s"] for r in spark.table("carried").collect()}
    assert got[5] == 1 + 3 + 5 and got[12] == 8 + 10 + 12 and got[1] is None or got[1] != got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_of_long_chains_in_no_order(spark):
    import random

    from gridspark.operators.components import components

    ids = list(range(600))
    random.Random(5).shuffle(ids)
    chains = [ids[:400], ids[400:599]]
    edges = [(x, y) if k % 2 else (y, x) for c in chains for k, (x, y) in enumerate(zip(c, c[1:], strict=False))]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["component"] for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(c) for c in [*chains, ids[599:]] for i in c}
