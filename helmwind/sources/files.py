"""Market and variable files: encoding, headers, casts; synthetic sample data."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from helmwind.functions.casts import to_day, to_number
from helmwind.operators.asof import asof_join
from helmwind.operators.clean import Watch, clean_panel, dedup_last
from helmwind.operators.frames import KEY
from helmwind.sources.headers import find_column, normalize_header
from helmwind.sources.sheets import read_sheet
from helmwind.sources.store import written

#: Tried in this order on the whole file; the last one decodes anything.
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr", "latin-1")
#: Spark's csv reader decodes these only under a setting for the whole session.
PYTHON_ONLY = ("cp949", "euc-kr")
_SPARK_CHARSET = {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}


def undecodable(lines: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of raw lines: whether each of :data:`ENCODINGS` but the last fails on them.

    No byte of a longer character is a line end in these encodings, so lines are ranges of a
    file that decode by themselves, and a file decodes if all its lines do.
    """
    failed = [False] * (len(ENCODINGS) - 1)
    for batch in lines:
        block = b"\n".join(line.as_buffer().to_pybytes() for line in batch.column(0) if line.is_valid)
        for i, encoding in enumerate(ENCODINGS[:-1]):
            if not failed[i]:
                try:
                    block.decode(encoding)
                except UnicodeDecodeError:
                    failed[i] = True
    yield pa.RecordBatch.from_arrays([pa.array([f]) for f in failed], names=[f"e{i}" for i in range(len(failed))])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes every byte of the file: one pass over its lines for all of them, split like any text file."""
    lines = spark.read.text(path).select(F.col("value").cast("binary"))
    names = [f"e{i}" for i in range(len(ENCODINGS) - 1)]
    found = lines.mapInArrow(undecodable, ", ".join(f"{n} boolean" for n in names)).agg(*[F.bool_or(n).alias(n) for n in names]).head()
    return next((e for e, n in zip(ENCODINGS, names) if not found[n]), ENCODINGS[-1])


def read_table(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """All columns as text, with row_idx in file order. Files of the old Excel format need pandas' optional reader, on the driver."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        return read_sheet(spark, path, sheet)
    if path.lower().endswith(".xls"):
        import pandas as pd

        frame = pd.read_excel(path, sheet_name=0 if sheet is None else sheet, dtype=str)
        frame["row_idx"] = range(len(frame))
        return spark.createDataFrame(frame)
    encoding = detect_encoding(spark, path)
    rows = read_decoded(spark, path, encoding) if encoding in PYTHON_ONLY else spark.read.options(header=True, encoding=_SPARK_CHARSET[encoding], escape='"').csv(path)
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def read_decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """A csv file in an encoding that Spark's reader lacks: raw lines, decoded in tasks, parsed by Spark.

    As in Spark's reader over lines, each line that equals the header is one.
    """
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("raw")).where(F.length("value") > 0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [line.as_buffer().to_pybytes().decode(encoding).rstrip("\r") for line in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    lines = raw.mapInArrow(decode, "line string")
    head = lines.head()
    if head is None:
        raise ValueError(f"no rows in {path}")
    names = next(csv.reader([head.line]))
    names = [n if n and names.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]
    schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    return lines.where(F.col("line") != head.line).select(F.from_csv("line", schema, {"escape": '"'}).alias("c")).select("c.*")


def load_market_data(
    spark: SparkSession,
    path: str,
    sheet: str | int | None = None,
    date_col: str | None = None,
    close_col: str | None = None,
    rf_col: str | None = None,
    rf_unit: str = "annual_percent",
    trading_days: int = 252,
    start_date: str | None = None,
    end_date: str | None = None,
    extra_cols: list[str] | None = None,
    series_id: str = "series",
) -> DataFrame:
    """Clean panel of one file; roles are found by header unless named.

    The panel is written once to the shared folder; what that pass counts gives the errors and warnings.
    """
    table = read_table(spark, path, sheet)
    columns = [c for c in table.columns if c != "row_idx"]
    roles = {r: find_column(columns, r, given) for r, given in (("date", date_col), ("close", close_col), ("rf", rf_col))}
    variables = {c: _named(columns, c) for c in dict.fromkeys(extra_cols or [])}
    raw = table.select(
        F.lit(series_id).alias(KEY),
        to_day(F.col(f"`{roles['date']}`")).alias("date"),
        to_number(F.col(f"`{roles['close']}`")).alias("close"),
        to_number(F.col(f"`{roles['rf']}`")).alias("rf_raw"),
        *[to_number(F.col(f"`{own}`")).alias(c) for c, own in variables.items()],
        "row_idx",
    )
    watch = Watch()
    panel = written(clean_panel(raw, rf_unit, trading_days, start_date, end_date, list(variables), watch=watch), "loaded")
    watch.report(panel, rf_unit)
    return panel


def _named(columns: list[str], wanted: str) -> str:
    found = next((c for c in columns if c == wanted), None) or next((c for c in columns if normalize_header(c) == normalize_header(wanted)), None)
    if found is None:
        raise KeyError(f"no column {wanted!r} among {columns}")
    return found


def load_extra_table(
    spark: SparkSession, path: str, sheet: str | int | None = None, date_col: str | None = None, columns: list[str] | None = None, series_id: str = "series"
) -> DataFrame:
    """series_id, date and numeric columns (all of them unless named), one row per readable date, the last of the file."""
    table = read_table(spark, path, sheet)
    there = [c for c in table.columns if c != "row_idx"]
    day = find_column(there, "date", date_col)
    wanted = {c: _named(there, c) for c in columns} if columns else {c: c for c in there if c != day}
    rows = table.select(
        F.lit(series_id).alias(KEY),
        to_day(F.col(f"`{day}`")).alias("date"),
        *[to_number(F.col(f"`{own}`")).alias(c) for c, own in wanted.items()],
        "row_idx",
    )
    return dedup_last(rows.where("date is not null")).drop("row_idx")


def load_with_extras(
    spark: SparkSession, path: str, specs: list[str] | None = None, extra_file: str | None = None, extra_sheet=None, extra_date_col=None, **options
) -> tuple[DataFrame, list[str]]:
    """Panel with the columns that specs read, from the extra file where it has them, else the main file; and the specs.

    An extra file without specs gives each of its columns as it is.
    """
    from helmwind.functions.specs import parse_spec

    specs = list(specs or [])
    extra = None
    if extra_file is not None:
        extra = load_extra_table(spark, extra_file, extra_sheet, extra_date_col)
        there = [c for c in extra.columns if c not in (KEY, "date")]
        if not specs:
            specs = there
        renamed = {}
        for spec in specs:
            name = parse_spec(spec).column
            own = next((c for c in there if normalize_header(c) == normalize_header(name)), None)
            if own is not None:
                renamed[name] = own
        extra = extra.select(KEY, "date", *[F.col(f"`{own}`").alias(name) for name, own in renamed.items()])
    names = list(dict.fromkeys(parse_spec(s).column for s in specs))
    from_extra = [] if extra is None else [c for c in extra.columns if c in names]
    panel = load_market_data(spark, path, extra_cols=[n for n in names if n not in from_extra], **options)
    if from_extra:
        gaps, bare = Observation(), " or ".join(f"`{c}` is null" for c in from_extra)
        panel = written(asof_join(panel, extra, from_extra).observe(gaps, F.count_if(F.expr(bare)).alias("days")), "joined")
        uncovered = gaps.get["days"]
        if uncovered:
            warnings.warn(f"{uncovered} days come before the first value of a joined variable", stacklevel=2)
    return panel, specs


def make_sample(panel: DataFrame, seed: int = 0, with_extra: bool = False) -> DataFrame:
    """Adds a synthetic rate (percent; a clipped random walk) and, if asked, 20-day volatility in percent, filled backwards.

    The walk's steps follow from the seed and the date by MD5, so that reruns agree. Rates and volatility have three decimals.
    """
    day = Window.partitionBy(KEY).orderBy("date")
    total = day.rowsBetween(Window.unboundedPreceding, 0)
    digits = [F.substring(F.md5(F.concat(F.col("date").cast("string"), F.lit(f"|{seed}|{k}"))), 1, 7) for k in (1, 2)]
    u = [(F.conv(d, 16, 10).cast("double") + 0.5) / float(1 << 28) for d in digits]
    normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])
    walk = F.sum(normal * 0.02).over(total) * 0.5 + 3
    out = panel.withColumn("rf_raw", F.round(F.least(F.greatest(walk, F.lit(0.1)), F.lit(6.0)), 3))
    if with_extra:
        ret = F.col("close") / F.lag("close").over(day) - 1
        frame = day.rowsBetween(-19, 0)
        out = out.withColumn("__ret", ret)
        vol = F.when(F.count("__ret").over(frame) == 20, F.stddev_samp("__ret").over(frame) * F.sqrt(F.lit(252.0)) * 100)
        out = out.withColumn("vol", vol).drop("__ret")
        out = out.withColumn("vol", F.round("vol", 3)).withColumn("vol", F.first("vol", ignorenulls=True).over(day.rowsBetween(0, Window.unboundedFollowing)))
    return out
