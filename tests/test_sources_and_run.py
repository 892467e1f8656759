"""Files, the whole run, the command line and the registered queries."""

import glob
import os
import shutil
import subprocess
import sys
import warnings
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helmwind.plans import cli, plots
from helmwind.plans.pipeline import run_on_panel
from helmwind.models.jump import losses
from helmwind.operators.clean import Watch, clean_panel, validate_panel
from helmwind.operators.online import fold, register_functions
from helmwind.sources.files import detect_encoding, load_extra_table, load_market_data, load_with_extras, make_sample, read_table
from helmwind.sources.sheets import workbook
from helmwind.sources.store import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2015-01-01", periods=700)
    close = 1000 * np.cumprod(1 + rng.normal(0.0003, np.where((np.arange(700) // 90) % 2, 0.02, 0.006)))
    lines = [f'{d:%Y-%m-%d},"{c:,.4f}",{"" if i in (0, 5) else "2.5%"},{20 + i % 7}' for i, (d, c) in enumerate(zip(days, close))]
    lines.insert(11, lines[10].replace("2.5%", "3.5%"))
    text = "날짜,종가,무위험금리,변동성지수\n" + "\n".join([*lines, "soon,1,1,1"])
    (folder / "utf8.csv").write_bytes(text.encode("utf-8-sig"))
    (folder / "cp949.csv").write_bytes(text.encode("cp949"))
    (folder / "extra.csv").write_text("date,Slow One\n2014-12-01,1.5\n2015-06-01,\n2016-01-01,2.5\n")
    return folder


def test_encodings_and_loading(spark, files):
    assert detect_encoding(spark, str(files / "utf8.csv")) == "utf-8-sig"
    assert detect_encoding(spark, str(files / "cp949.csv")) == "cp949"
    with pytest.warns(UserWarning):
        a = load_market_data(spark, str(files / "utf8.csv"), extra_cols=["변동성지수"]).orderBy("date").toPandas()
        b = load_market_data(spark, str(files / "cp949.csv"), extra_cols=["변동성지수"]).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 699 and a.rf_raw.notna().all() and a.rf_raw.iloc[9] == 3.5
    part = load_market_data(spark, str(files / "utf8.csv"), start_date="2016-01-01", end_date="2016-06-30").toPandas()
    assert str(part.date.min()) == "2016-01-01" and str(part.date.max()) == "2016-06-30"


def test_encoding_is_found_in_split_files(spark, tmp_path):
    """One bad byte far behind the head decides, wherever a file is split; the session keeps its settings."""
    plain = ("date,close,rf\n" + "2020-01-02,1,2\n" * 4000).encode()
    cases = {
        "utf-8-sig": plain + "한글,1,2\n".encode(), "cp949": plain + "똠방각하,1,2\n".encode("cp949"), "latin-1": plain + b"caf\xe9,1,2\n" + plain, "first": plain
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for name, content in cases.items():
            (tmp_path / f"{name}.csv").write_bytes(content)
            assert spark.read.text(str(tmp_path / f"{name}.csv")).rdd.getNumPartitions() > 3
            want = "utf-8-sig" if name == "first" else name
            assert detect_encoding(spark, str(tmp_path / f"{name}.csv")) == want
        found = read_table(spark, str(tmp_path / "cp949.csv"))
        assert found.where("date = '똠방각하'").count() == 1 and found.count() == 4001 and found.columns == ["date", "close", "rf", "row_idx"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_quoted_cells_in_korean_files(spark, tmp_path):
    text = '날짜,"종가, 원",금리\r\n2020-01-02,"1,000.5",2.5%\r\n\r\n2020-01-03,"2 ""000""",\r\n'
    for encoding in ("cp949", "euc-kr"):
        (tmp_path / "k.csv").write_bytes(text.encode(encoding))
        rows = read_table(spark, str(tmp_path / "k.csv")).drop("row_idx").collect()
        assert [tuple(r) for r in rows] == [("2020-01-02", "1,000.5", "2.5%"), ("2020-01-03", '2 "000"', None)] and rows[0].__fields__ == ["날짜", "종가, 원", "금리"]


def book(path, rows, strings="", styles="", extra=""):
    """A workbook from raw XML, as other programs write it."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheets = f'<sheet name="Notes" sheetId="7" r:id="r1"/><sheet name="Data &amp; more" sheetId="2" r:id="r2"/>'  # noqa: F541
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}">{extra}<sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="r2" Type="w" Target="/xl/worksheets/two.xml"/><Relationship Id="r1" Type="w" Target="worksheets/one.xml"/></Relationships>',
        "xl/worksheets/one.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="str"><v>only</v></c></row></sheetData></worksheet>',
        "xl/worksheets/two.xml": f"<worksheet {main}><dimension ref='A1'/><sheetData>{rows}</sheetData><pageMargins/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {main}>{strings}</sst>",
        "xl/styles.xml": f"<styleSheet {main}>{styles}</styleSheet>",
    }
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return str(path)


def test_sheets_of_raw_xml(spark, tmp_path):
    strings = "<si><t>날짜</t></si><si><r><t>Clo</t></r><r><t xml:space='preserve'>se </t></r><rPh sb='0' eb='1'><t>x</t></rPh></si><si><t>rf</t></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/></cellXfs>'
    rows = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>2</v></c><c r="E3" t="s"><v>2</v></c></row><row r="4"/>'
        '<row r="5"><c r="A5" s="1"><v>43832</v></c><c r="B5" s="3"><v>1234.5</v></c><c r="C5" t="b"><v>1</v></c><c r="D5"><v>2</v></c></row>'
        '<row r="6"><c r="A6" s="2"><v>43833</v></c><c r="B6" t="e"><v>#N/A</v></c><c r="D6" t="inlineStr"><is><t>2.5%</t></is></c><c r="E6" t="str"><f>A1</f><v>calc</v></c></row>'
        '<row><c s="4"><v>43834.75</v></c><c><v>1E-3</v></c></row><row r="9"><c r="AB9"><v>5</v></c></row>'
    )
    path = book(tmp_path / "a.xlsx", rows, strings, styles)
    table = read_table(spark, path, "Data & more")
    assert table.columns == ["날짜", "Close", "column_2", "rf", "rf_1", "row_idx"]
    assert [tuple(r) for r in table.orderBy("row_idx").collect()] == [
        ("2020-01-02", "1234.5", "True", "2", None, 4),
        ("2020-01-03", None, None, "2.5%", "calc", 5),
        ("2020-01-04 18:00:00", "0.001", None, None, None, 6),
        (None, None, None, None, None, 8),
    ]
    assert read_table(spark, path, 1).count() == 4 and read_table(spark, path).columns == ["only", "row_idx"]
    old = book(tmp_path / "b.xlsm", '<row><c t="str"><v>d</v></c></row><row><c s="1"><v>1</v></c></row>', styles=styles, extra='<workbookPr date1904="1"/>')
    assert read_table(spark, old, 1).head().d == "1904-01-02"
    with pytest.raises(Exception, match="no sheet 'none'"):
        read_table(spark, path, "none").count()


def test_written_sheets_load_like_csv(spark, files, tmp_path):
    csv = pd.read_csv(files / "utf8.csv", encoding="utf-8-sig")
    days = [d if d == "soon" else pd.Timestamp(d).date() for d in csv["날짜"]]
    body = [[d, c, None if pd.isna(r) else r, int(v)] for d, c, r, v in zip(days, csv["종가"], csv["무위험금리"], csv["변동성지수"])]
    (tmp_path / "m.xlsx").write_bytes(workbook([list(csv.columns), *body]))
    with pytest.warns(UserWarning):
        a = load_market_data(spark, str(files / "utf8.csv"), extra_cols=["변동성지수"]).orderBy("date").toPandas()
        b = load_market_data(spark, str(tmp_path / "m.xlsx"), extra_cols=["변동성지수"]).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_table_function(spark):
    register_functions(spark)
    rows = spark.createDataFrame([("b", d, [float(d % 3), 0.5]) for d in range(40)] + [("a", d, [float(d % 5), 0.1]) for d in range(7)], "series_id string, date int, x array<double>")
    call = "SELECT * FROM jm_online(TABLE(SELECT * FROM {rows}), array(array(0.0D, 0.0D), array(2.0D, 1.0D)), 0.7D)"
    got = spark.sql(call, rows=rows.repartition(5)).toPandas().sort_values(["series_id", "date"])
    for name, own in got.groupby("series_id"):
        x = np.array([r.x for r in rows.where(F.col("series_id") == name).orderBy("date").collect()])
        assert own["regime"].tolist() == fold(losses(x, np.array([[0.0, 0.0], [2.0, 1.0]])), 0.7, None)[0].tolist()
    with pytest.raises(Exception, match="reads a table with the columns"):
        spark.sql(call.replace("SELECT *", "SELECT series_id AS s", 2).replace("SELECT series_id AS s FROM jm", "SELECT * FROM jm"), rows=rows).collect()


def test_cleaning_counts_on_its_way(spark):
    """The same warnings and errors as the pass of its own, from one job."""

    def frame(**columns):
        base = {"series_id": ["s"] * 6, "date": [*"abcd", "e", "e"], "close": [1.0, 2, None, 4, 5, 6], "rf_raw": [0.1, None, 0.2, 0.2, 0.3, 0.1], "row_idx": range(6)}
        rows = spark.createDataFrame(pd.DataFrame(base | columns))
        day = F.when(F.col("date") != "b", F.to_date(F.concat(F.lit("2020-01-0"), F.translate("date", "acde", "1345"))))
        gap = {c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "rf_raw")}
        return rows.withColumns(gap).withColumn("date", day).repartition(3)

    def said(run):
        with warnings.catch_warnings(record=True) as found:
            warnings.simplefilter("always")
            try:
                run()
            except ValueError as error:
                return str(error)
        return sorted(str(w.message) for w in found if w.category is UserWarning)

    for raw in (frame(), frame(close=[1.0, -2, 3, 4, 5, 6]), frame(close=[float("nan")] * 6), frame(rf_raw=[4.0] * 6)):
        for unit in ("annual_percent", "annual_decimal"):
            watch = Watch()

            def on_its_way():
                watch.report(written(clean_panel(raw, unit, watch=watch), "watched"), unit)

            assert said(on_its_way) == said(lambda: validate_panel(raw, unit))
    assert any("repeat" in m for m in said(lambda: validate_panel(frame())))


def test_extra_file(spark, files):
    assert load_extra_table(spark, str(files / "extra.csv")).count() == 3
    panel, specs = load_with_extras(spark, str(files / "utf8.csv"), ["slow_one:ewm:5", "변동성지수"], str(files / "extra.csv"))
    got = panel.orderBy("date").toPandas()
    assert specs == ["slow_one:ewm:5", "변동성지수"] and got["slow_one"].iloc[0] == 1.5 and got["slow_one"].iloc[-1] == 2.5
    assert (got["slow_one"][got.date.astype(str) < "2016-01-01"] == 1.5).all()


def test_sample(spark, files):
    panel = load_market_data(spark, str(files / "utf8.csv"))
    first, again = (make_sample(panel.select("series_id", "date", "close"), 1, True).orderBy("date").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(first, again)
    assert first.rf_raw.between(0.1, 6).all() and first.vol.notna().all()


def test_whole_run(spark, files, tmp_path):
    argv = ["--input", str(files / "utf8.csv"), "--extra-feature", "변동성지수:log", "--model", "sjm", "--max-feats", "2", "--window", "250",
            "--min-window", "200", "--n-init", "2", "--warmup", "60", "--jump-penalty", "10", "--hmm", "--hmm-refit-every", "63",
            "--hmm-n-init", "2", "--outdir", str(tmp_path), "--save-features", "--quiet"]
    tables = cli.main(argv)
    assert {r.strategy for r in tables["performance"].collect()} == {"B & H", "SJM 0/1", "HMM 0/1"}
    written = {p.split("/")[-1] for p in glob.glob(f"{tmp_path}/*")}
    assert {"regimes", "refit_params", "strategy", "performance", "insample_last_window", "hmm_regimes", "hmm_refit_params", "hmm_strategy",
            "feat_weights", "delay_robustness", "features"} <= written
    back = spark.read.option("header", True).csv(f"{tmp_path}/strategy")
    assert back.columns == ["series_id", "date", "regime", "weight", "bought", "sold", "traded", "cost", "rf", "bh", "jm"]
    centers = plots.center_table(tables["refit_params"], ["DD_10", "sortino_20"]).collect()
    assert {r.feature for r in centers} == {"DD_10", "sortino_20"} and plots.thinned(tables["cumret"], 50).count() <= 60
    with pytest.raises(ValueError):
        run_on_panel(tables["panel"], min_cash=0.9, max_cash=0.1)


def same(rows, columns, relation) -> bool:
    order = sorted(columns)
    assert order == sorted(relation.columns)
    ours = sorted((tuple(r[c] for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(r[relation.columns.index(c)] for c in order) for r in relation.fetchall()), key=repr)

    def close(a, b):
        return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9, abs=2e-6))

    return len(ours) == len(theirs) and all(close(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


ENGINE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        assert same(rows, df.columns, duck.sql(sql))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_text_operators(tmp_path, pipeline):
    """A copy of the repository without their folders registers and imports everything else."""
    root = Path(__file__).parent.parent
    gone = {"llm", ".git", "__pycache__"} | (set() if pipeline else {"corpus_pipeline.py"})
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: gone & set(names))
    code = (
        "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names and 'pipeline' not in names;"
        "assert not [n for n in names if n.startswith('op')]; import helmwind.plans.cli, bench"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path / "copy", check=True, stdout=subprocess.DEVNULL)
