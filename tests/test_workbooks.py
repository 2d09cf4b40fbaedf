"""Workbooks: decoding, planning, and equality of all strategies with the whole run."""

import datetime as dt
import random

import pytest

from gridspark import api
from gridspark.model import BLANK, GridError, same_value
from gridspark.plans import planner
from gridspark.sources.xlsx import Package, read_many, wide
from gridspark.sources.xlsx_builder import workbook
from gridspark.workspace import new_file


def cells(data, sheet=0):
    return {(c.row, c.col): c for c in Package.open(data).sheet(sheet).cells}


def test_decoding():
    raw = {"S": {"A1": '<c r="A1" t="s"><v>0</v></c>', "B1": '<c r="B1" t="str"><v>_x0041_b_x005F_x</v></c>', "C1": '<c r="C1" t="inlineStr"><is><t> a </t><rPh><t>no</t></rPh></is></c>', "D1": '<c r="D1" t="b"><v>2</v></c>', "E1": '<c r="E1" t="e"><v>#N/A</v></c>', "F1": '<c r="F1"><v>1x</v></c>', "G1": '<c r="G1"><v></v></c>', "H1": '<c r="H1" t="e"><v>#WHAT</v></c>'}}
    got = cells(workbook({"S": {}}, strings=["str"], raw=raw))
    assert [got[1, c].value for c in range(1, 9)] == ["str", "Ab_x", "a", True, GridError("Na"), "1x", None, GridError("Value")]


def test_temporal_cells():
    got = cells(workbook({"S": {"A1": dt.time(12), "B1": dt.timedelta(days=1.5), "C1": dt.date(2020, 1, 1), "D1": 0.5, "E1": BLANK}}))
    assert [got[1, c].value for c in range(1, 6)] == [dt.time(12), dt.timedelta(days=1, hours=12), dt.date(2020, 1, 1), 0.5, None]


def test_shared_formula():
    raw = {"S": {"B2": '<c r="B2"><f t="shared" ref="B2:B4" si="0">A2*2</f></c>', "B3": '<c r="B3"><f t="shared" si="0"/></c>', "B4": '<c r="B4"><f t="shared" si="0"/></c>'}}
    t = planner.read(workbook({"S": {"A2": 1.0}}, raw=raw))
    assert len(t.formulas) == 3 and len(t.components) == 3 and len(t.templates) == 1


def sheet(n, **columns):
    return {f"{c}{r}": v for c, f in columns.items() for r in range(1, n + 1) if (v := f(r)) is not None}


SHEETS = {
    "row_local": {"S": sheet(40, A=float, B=lambda r: 3.0 * r, C=lambda r: f"=A{r}+B{r}", D=lambda r: f"=C{r}*2", E=lambda r: f"=IF(A{r}>3,SUM(A{r}:B{r}),0)")},
    "chain": {"S": sheet(40, A=lambda r: 10.0 if r == 1 else f"=A{r - 1}+1", B=lambda r: 3.0 * r, C=lambda r: f"=A{r}+B{r}")},
    "moving": {"S": sheet(25, A=float, B=lambda r: f"=SUM(A{r - 2}:A{r})" if r > 2 else None)},
    "aggregates": {"S": sheet(60, A=float, B=lambda r: float(r % 7 - 3), C=lambda r: ["EMEA", "APAC", "AMER"][r % 3], D=lambda r: f"=A{r}/SUM(A:A)", E=lambda r: f'=B{r}+COUNTIF(C:C,"APAC")', F=lambda r: f'=SUMIF(C:C,"APAC",A:A)-AVERAGE(A:A)+MIN(B:B)+MAX(B:B)+{r}')},
    "lookup": {"Main": sheet(30, A=lambda r: float(r % 5 + 1), B=lambda r: f"=VLOOKUP(A{r},Lookup!$A$1:$B$5,2,FALSE)"), "Lookup": sheet(5, A=float, B=lambda r: 100.0 * r)},
    "two_templates": {"S": sheet(4, A=float, B=lambda r: f"=A{r}*2" if r < 3 else f"=A{r}+99")},
    "errors": {"S": sheet(10, A=lambda r: float(r - 5), B=lambda r: f"=1/A{r}", C=lambda r: f"=IFERROR(B{r},-1)", D=lambda r: f"=B{r}+1")},
    "mixed": {"S": {**sheet(10, A=lambda r: "x" if r == 3 else float(r), B=lambda r: f"=A{r}*2")}},
    "spill": {"S": {**sheet(3, A=lambda r: 10.0 * r), "B2": "=INDEX($A$1:$A$3,0)", "D1": "=B4+1"}},
}


@pytest.mark.parametrize("name", SHEETS)
def test_every_strategy_equals_the_whole(spark, name):
    data = workbook(SHEETS[name])
    whole = api.eval_grid(data, spark=spark)
    assert same_grid(api.eval_partitioned(data, min_formulas=0, spark=spark), whole)
    for mode in ("columnar", "components"):
        try:
            rows, _ = api.benchmark_rows(data, mode, spark=spark)
        except ValueError:
            continue
        got = {s: [] for s in whole}
        for s, _, values in rows:
            got[s].append(values)
        assert same_grid(got, whole), mode


def same_grid(a, b):
    return a.keys() == b.keys() and all(len(a[s]) == len(b[s]) and all(same_value(x, y) for p, q in zip(a[s], b[s], strict=True) for x, y in zip(p, q, strict=True)) for s in a)


def test_random_sheets(spark):
    rng = random.Random(5)
    for _ in range(3):
        f = [rng.choice(["=A{r}+B{r}", "=IF(A{r}>B{r},A{r},B{r})", "=ROUND(A{r}/B{r},2)", "=A{r}&\"-\"&B{r}", "=MOD(A{r},B{r})", "=A{r}^2"]) for _ in range(3)]
        data = workbook({"S": sheet(20, A=lambda r: float(rng.randint(-9, 9)), B=lambda r: float(rng.randint(1, 9)), C=lambda r: f[0].format(r=r), D=lambda r: f[1].format(r=r), E=lambda r: f[2].format(r=r))})
        rows, report = api.benchmark_rows(data, "columnar", spark=spark)
        assert same_grid({"S": [v for _, _, v in rows]}, api.eval_grid(data, spark=spark)), f
        assert report["strategy"] == "columnar"


#: Functions and cases without a column form have to give what the whole-file run gives.
FALLBACKS = [
    "=IFNA(A{r},0)", "=XMATCH(A{r},A$1:A$6)", "=DATE(2020,A{r},1)", "=ISTEXT(B{r})", "=TRIM(B{r})", "=EXP(A{r})", "=ROUNDUP(A{r}/3,1)", '=IF(A{r}>3,"a",1)', '=CHOOSE(1+(A{r}>3),"a",2)',
    '=IFERROR(A{r}/(A{r}-2),"none")', '=MATCH("w*",B$1:B$6,0)', '=VLOOKUP("x",A$1:B$6,2,FALSE)', "=VLOOKUP(B{r},B$1:B$6,1,TRUE)", "=MATCH(A{r},B$1:B$6,0)", '=IFS(A{r}>3,"a",TRUE,2)', "=NOSUCHNAME(A{r})",
]


@pytest.mark.parametrize("k", range(4))
def test_columns_without_a_column_form(spark, k):
    letters = "CDEF"
    for i in range(0, len(FALLBACKS), 4):
        if i // 4 != k:
            continue
        cols = {letters[j]: (lambda r, f=f: f.format(r=r)) for j, f in enumerate(FALLBACKS[i : i + 4])}
        data = workbook({"S": sheet(6, A=lambda r: float(r), B=lambda r: ["wa", "wb", " wc ", "x", "y", "z"][r - 1], **cols)})
        whole = api.eval_grid(data, spark=spark)
        assert same_grid(api.eval_partitioned(data, min_formulas=0, spark=spark), whole)
        for f in FALLBACKS[i : i + 4]:  # each alone through the columns' strategy, or a refusal
            one = workbook({"S": sheet(6, A=lambda r: float(r), B=lambda r: ["wa", "wb", " wc ", "x", "y", "z"][r - 1], C=lambda r, f=f: f.format(r=r))})
            try:
                rows, _ = api.benchmark_rows(one, "columnar", spark=spark)
            except ValueError:
                continue
            assert same_grid({"S": [v for _, _, v in rows]}, api.eval_grid(one, spark=spark)), f


def test_values(spark):
    grid = api.eval_grid(workbook(SHEETS["lookup"]), spark=spark)
    assert all(row[1] == row[0] * 100 for row in grid["Main"])
    spill = api.eval_grid(workbook(SHEETS["spill"]), spark=spark)["S"]
    assert [r[1] for r in spill] == [None, 10, 20, 30] and spill[0][3] == 31


def test_names(spark):
    names = '<definedName name="Rate">Target!$A$1</definedName><definedName name="Rate" localSheetId="1">Target!$B$2</definedName>'
    data = workbook({"First": {"A1": "=Rate"}, "Scope": {"A1": "=RATE"}, "Target": {"A1": 10.0, "B2": "=20+22"}}, names=names)
    grid = api.eval_grid(data, spark=spark)
    assert (grid["First"][0][0], grid["Scope"][0][0]) == (10, 42)
    missing = workbook({"S": {"A1": 1.0}}, names='<definedName name="N">Gone!$A$1</definedName>')
    assert api.eval_grid(missing, spark=spark)["Gone"] == []


def test_plan_and_report():
    t = workbook({"S": sheet(50, A=float, B=lambda r: f"=A{r}*2", C=lambda r: f'=IF(B{r}>4,"x",A{r})')})
    plan = api.partition_plan(t, min_formulas=0)
    assert plan["n_formula_cells"] == 100 and plan["n_formula_sources"] == 2 and plan["n_components"] == 50 and plan["strategy"] == "columnar" and plan["partitioned"]
    assert api.partition_plan(t)["fallback_reason"] == "too few formulas"
    assert api.partition_plan(workbook({"S": {"A1": "=INDIRECT(\"B1\")"}}), min_formulas=0)["fallback_reason"] == "INDIRECT or OFFSET"
    assert api.partition_plan(workbook({"S": {"A1": "=RAND()"}}), min_formulas=0)["fallback_reason"] == "unreproducible formulas"
    assert api.partition_plan(workbook({"S": {"A1": "=SUM(A:A)"}}), min_formulas=0)["fallback_reason"] == "self-referencing formulas"
    assert api.partition_plan(workbook({"S": {"A1": "=1+"}}), min_formulas=0)["first_parse_error"]["row"] == 1
    back = api.partition_plan(workbook({"S": {"A1": 1.0, "B502": "=A1+1"}}), min_formulas=0)
    assert back["chunk_reason"].startswith("a reference 501 rows back")


def test_fold():
    for f, want in {"SUM(A:A)": 55, "COUNT(A:A)": 10, "COUNTA(A:A)": 10, "AVERAGE(A:A)": 5.5, "MIN(A:A)": 1, "MAX(A:A)": 10, 'COUNTIF(A:A,">5")': 5, 'SUMIF(A:A,">5")': 40, "SUM($A$1:$A$6)": 21}.items():
        t = planner.read(workbook({"S": sheet(10, A=float, B=lambda r, f=f: f"=A{r}/{f}")}))
        assert planner.fold(t) == 1 and len(t.components) == 10
        assert f"/{want}" in planner.g.printed(t.formulas[0, 1, 2])
    for f in ("MEDIAN(A:A)", "STDEV(A:A)", "LARGE(A:A,2)", "SUM(B:B)", "SUM(A1:A3)"):
        t = planner.read(workbook({"S": sheet(10, A=float, C=lambda r, f=f: f"=A{r}/{f.replace('A1:A3', f'A{r}:A{r + 2}')}", B=lambda r: f"=A{r}")}))
        assert planner.fold(t) == 0, f


def test_batches_keep_components_whole():
    t = planner.read(workbook({"S": sheet(20, A=float, B=lambda r: f"=A{r}", C=lambda r: f"=B{r}")}))
    packed = planner.batches(t, 10)
    assert len(packed) > 1 and sum(len(b) for b in packed) == 20


def test_iterator_and_trim(spark):
    data = workbook({"S": {"A1": 1.0, "B2": "=A1+1", "C5": BLANK}})
    rows = api.eval_rows(data, min_formulas=0, spark=spark)
    assert rows.strategy in ("columnar", "components") and rows.fallback_reason is None
    assert len(list(rows)) == 5 and len(list(api.eval_rows(data, trim=True, min_formulas=0, spark=spark))) == 2
    assert api.probe_dims(data, spark=spark) == [("S", 5, 3)]
    assert api.components(data)["n_components"] == 1


def test_now(spark):
    at = dt.datetime(2024, 3, 15, 10, 0, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert api.eval_grid(workbook({"S": {"A1": "=NOW()", "B1": "=TODAY()"}}), now=at, spark=spark)["S"] == [[dt.datetime(2024, 3, 15, 10, 0), dt.date(2024, 3, 15)]]


def test_many_files(spark):
    paths = [new_file(spark, "many.xlsx", {"S": {"A1": float(k), "B1": "x"}}) for k in range(3)]
    got = read_many(spark, paths[0].rpartition("/")[0] + "/*-many.xlsx")
    assert got.count() == 6
    table = wide(got.where("sheet = 0"), {"A": "number", "B": "text"}).collect()
    assert len(table) == 1 and table[0]["B"] == "x"
