"""Sheets of time series: CSV files and, with openpyxl, workbooks.

The header is inferred on the driver from the first rows; the body stays a
DataFrame of strings and is turned long by one `stack`.
"""

from __future__ import annotations

import csv
import datetime as dt
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions.naming import unique_name
from gridlark.sources.files import Files

INDEX = ("timestamp", "range", "index")
LEVELS = ("id", "table", "key", "type", "units")
SPECIAL = ("day", "n days")


def _cell(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, str):
        x = x.strip()
        return x or None
    return x


def is_stamp(x) -> bool:
    if isinstance(x, dt.datetime | dt.date):
        return True
    if not isinstance(x, str) or len(x) < 8:
        return False
    try:
        dt.datetime.fromisoformat(x)
    except ValueError:
        return False
    return True


def is_number(x) -> bool:
    if isinstance(x, bool):
        return False
    if isinstance(x, int | float):
        return True
    try:
        float(x)
    except (TypeError, ValueError):
        return False
    return True


def is_data_row(cells: Sequence) -> bool:
    """Whether a row has as many numbers (stamps count) as other values, or more."""
    live = [c for c in map(_cell, cells) if c is not None]
    numbers = sum(is_number(c) or is_stamp(c) for c in live)
    return bool(live) and numbers >= len(live) - numbers


def validate_levels(rows: dict[str, list] | list[list]) -> dict[str, list]:
    """Level names of header rows: given by labels, or by how many there are."""
    if isinstance(rows, dict):
        if not {"key", "units"} <= set(rows):
            raise model.InsuficientHeaderInfo(f"key and units are needed, there is {sorted(rows)}")
        return {k: rows[k] for k in ("table", "key", "type", "units") if k in rows}
    if len(rows) == 2:
        return dict(zip(("key", "units"), rows, strict=True))
    if len(rows) == 3:
        return dict(zip(("key", "type", "units"), rows, strict=True))
    raise model.InsuficientHeaderInfo(f"2 or 3 header rows are needed, not {len(rows)}")


def infer(rows: Sequence[Sequence], force_index: bool = False, limit: int = 10) -> tuple[dict[str, list], str | None, int]:
    """Header levels (without the index column), what the index is called (None:
    there is none) and the first row of the body."""
    head, labels, index, begin = [], {}, None, None
    for i, row in enumerate(rows):
        cells = [_cell(c) for c in row]
        if all(c is None for c in cells):
            continue
        low = cells[0].lower() if isinstance(cells[0], str) else None
        if low in INDEX and all(c is None for c in cells[1:]):
            index = low
            continue
        if low in LEVELS:
            labels[low] = cells[1:]
            continue
        if is_data_row(cells):
            begin = i
            if index is None and (is_stamp(cells[0]) or force_index):
                index = "timestamp" if is_stamp(cells[0]) else "index"
            break
        if low in INDEX:
            index = low
        head.append(cells)
        if len(head) > limit:
            break
    if begin is None:
        raise model.NoResults("there is no row of data") if not head and not labels else model.InsuficientHeaderInfo("no row of data after the header")
    if {"key", "units"} <= set(labels):
        labels.pop("id", None)
        return validate_levels(labels), index or "index", begin
    if labels:
        raise model.InsuficientHeaderInfo(f"key and units are needed, there is {sorted(labels)}")
    return validate_levels([h[1:] if index else h for h in head]), index, begin


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of `__blk` and `__mid`. Blocks are
    numbered by themselves; only their sizes, a row a block, meet in one place."""
    sizes = df.groupBy("__blk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    first = F.broadcast(sizes.select("__blk", before.alias("__first")))
    here = F.row_number().over(Window.partitionBy("__blk").orderBy("__mid")) - 1
    return df.withColumn("__here", here).join(first, "__blk").withColumn(name, (F.col("__first") + F.col("__here")).cast("long")).drop("__here", "__first")


def _build(spark: SparkSession, body: DataFrame, levels: dict[str, list], index: str | None, sheet: str, taken: set[str], first_id: int) -> tuple[dict[str, DataFrame], int] | None:
    """body: `__blk`, `__mid` and strings c0, c1, ...; tables of the sheet and the next id."""
    shift = 1 if index else 0
    entries, seen = [], set()
    width = max(len(v) for v in levels.values())
    for j in range(width):
        of = {k: (str(v[j]) if j < len(v) and v[j] is not None else None) for k, v in levels.items()}
        if of.get("key") is None:
            continue
        name = (of.get("table") or sheet, of["key"], of.get("type"), of.get("units") or "")
        if name not in seen:
            seen.add(name)
            entries.append((f"c{j + shift}", *name))
    simple = "type" not in levels
    names, parts = {}, []
    for t in dict.fromkeys(e[1] for e in entries):
        if all(e[2].lower() in SPECIAL for e in entries if e[1] == t):
            continue
        names[t] = unique_name(t, taken)
        taken.add(names[t])
    if not names:
        return None
    entries = [(c, names[t], *rest) for c, t, *rest in entries if t in names]
    stats = body.agg(*[x for c, *_ in entries for x in (F.count(c).alias(f"{c}_n"), F.count(F.expr(f"try_cast({c} as double)")).alias(f"{c}_v"))]).first()
    entries = [e for e in entries if stats[f"{e[0]}_n"]]
    if index:
        stamp = F.try_to_timestamp("c0").cast("timestamp_ntz")
        n, stamps, whole = body.agg(F.count("c0"), F.count(stamp), F.count(F.expr("try_cast(c0 as bigint)"))).first()
        is_ts = n > 0 and stamps == n and whole < n
    else:
        is_ts, n, whole = False, 0, 0
    rows = numbered(body, "row_ix")
    if is_ts:
        rounded = F.date_trunc("second", F.try_to_timestamp("c0") + F.expr("interval 500 milliseconds")).cast("timestamp_ntz")
        rows = rows.withColumn("ts", rounded).withColumn("range_ix", F.lit(None).cast("long")).withColumn("label", F.lit(None).cast("string"))
    else:
        is_range = not index
        if index and n and whole == n:
            number = F.expr("try_cast(c0 as bigint)")
            # a range's values lie on a line over their places
            ends = rows.agg(F.count("*").alias("n"), F.min_by(number, "row_ix").alias("a"), F.max_by(number, "row_ix").alias("z")).first()
            step, rest = divmod(ends["z"] - ends["a"], max(1, ends["n"] - 1))
            is_range = ends["n"] > 1 and step != 0 and not rest and rows.where(number != F.lit(ends["a"]) + F.col("row_ix") * step).limit(1).isEmpty()
        value = F.expr("try_cast(c0 as bigint)") if index and is_range else F.col("row_ix")
        rows = rows.withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("range_ix", value if is_range else F.lit(None).cast("long")).withColumn("label", F.col("c0") if index and not is_range else F.lit(None).cast("string"))
    out = {"variables": [], "steps": [], "results": [], "texts": []}
    for pos_t, t in enumerate(dict.fromkeys(e[1] for e in entries)):
        own = [e for e in entries if e[1] == t]
        special = {e[2].lower(): e[0] for e in own if e[2].lower() in SPECIAL}
        own = [e for e in own if e[2].lower() not in SPECIAL]
        base = rows.select(F.lit(0).alias("file_id"), F.lit(t).alias("table"), "row_ix", "ts", "range_ix", "label", (F.col(special["day"]) if "day" in special else F.lit(None).cast("string")).alias("day"), (F.expr(f"try_cast({special['n days']} as double)").cast("int") if "n days" in special else F.lit(None).cast("int")).alias("n_days"))
        out["steps"].append(base)
        numbers, strings = [], []
        for c, _, key, kind, units in own:
            out["variables"].append((0, t, pos_t, first_id, first_id, simple, key, kind, units))
            (numbers if stats[f"{c}_n"] == stats[f"{c}_v"] else strings).append((first_id, c))
            first_id += 1
        for cols, name in ((numbers, "results"), (strings, "texts")):
            if cols:
                value = f"stack({len(cols)}, {', '.join(f'{i}, {c}' for i, c in cols)}) as (id, value)"
                long = rows.selectExpr("0 as file_id", "row_ix", "ts", value).withColumn("table", F.lit(t))
                kind = F.expr("try_cast(value as double)") if name == "results" else F.col("value")
                out[name].append(long.select("file_id", "table", F.col("id").cast("int").alias("id"), "row_ix", "ts", kind.alias("value")))
    made = {"variables": spark.createDataFrame(out["variables"], model.VARIABLES)}
    for name in ("steps", "results", "texts"):
        for df in out[name]:
            made[name] = made[name].unionByName(df) if name in made else df
    return made, first_id


def _changed(spark: SparkSession, path: str) -> dt.datetime:
    """When a file was changed; now, of frames that have no file."""
    files = Files(spark)
    at = dt.datetime.fromtimestamp(files.time(path), dt.timezone.utc) if files.exists(path) else dt.datetime.now(dt.timezone.utc)
    return at.replace(tzinfo=None)


def _dataset(spark: SparkSession, path: str, kind: str, sheets: list[tuple[str, list[list], DataFrame]], force_index: bool, limit: int) -> Dataset:
    taken: set[str] = set()
    whole, first_id = None, 1
    for sheet, top, frame in sheets:
        if all(_cell(c) is None for row in top for c in row):
            continue
        levels, index, begin = infer(top, force_index, limit)
        cells = [c for c in frame.columns if not c.startswith("__")]
        live = frame.where(F.col("__row") >= begin).where(F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cells]).isNotNull())
        live = live.select("__blk", "__mid", *[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in cells])
        built = _build(spark, live, levels, index, sheet, taken, first_id)
        if built is None:
            continue
        tables, first_id = built
        one = Dataset.of(spark, **tables)
        whole = one if whole is None else whole.union(one)
    if whole is None:
        raise model.NoResults(f"{path} has no results")
    name = os.path.splitext(os.path.basename(path))[0]
    files = spark.createDataFrame([(0, path, name, _changed(spark, path), kind)], model.FILES)
    return Dataset(files, whole.variables, whole.steps, whole.results, whole.texts, whole.peaks)


def read_csv(spark: SparkSession, path: str, force_index: bool = False, header_limit: int = 10) -> Dataset:
    """A sheet called like the file. The delimiter is found from the first lines."""
    text = spark.read.text(path)
    first = min(text.inputFiles(), default=path)  # a folder's header is in its first part
    lines = [r["value"] for r in spark.read.text(first).limit(header_limit + 20).collect()]
    filled = [x for x in lines if x.strip(" ,;\t")]
    if not filled:
        raise model.NoResults(f"{path} is empty")
    try:
        sep = csv.Sniffer().sniff("\n".join(filled), ",;\t|").delimiter
    except csv.Error:
        sep = ","
    top = [x for x in csv.reader(lines, delimiter=sep)]
    width = max(len(r) for r in top)
    schema = ", ".join(f"c{i} string" for i in range(width))
    frame = spark.read.csv(path, schema=schema, sep=sep, header=False, enforceSchema=True)
    # Spark's reader passes over blank lines, and so does what the header is found in
    top = [r for r in top if r]
    # parts of a folder follow each other by name, splits of a part by their place
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    frame = numbered(frame.select("*", at.alias("__blk"), F.monotonically_increasing_id().alias("__mid")), "__row")
    name = os.path.splitext(os.path.basename(path))[0]
    return _dataset(spark, path, "csv", [(name, top, frame)], force_index, header_limit)


def read_excel(spark: SparkSession, path: str, sheet_names: Sequence[str] | None = None, force_index: bool = False, header_limit: int = 10) -> Dataset:
    """Sheets of a workbook; needs openpyxl."""
    import pandas as pd

    try:
        book = pd.read_excel(path, sheet_name=list(sheet_names) if sheet_names else None, header=None)
    except ImportError as e:
        raise model.FormatNotSupported("workbooks need openpyxl") from e
    return from_frames(spark, path, book, force_index, header_limit)


def from_frames(spark: SparkSession, path: str, book: dict, force_index: bool = False, header_limit: int = 10) -> Dataset:
    """Sheets given as pandas frames without header (sizes of a workbook)."""
    sheets = []
    for name, pdf in book.items():
        if pdf.empty:
            continue
        rows = [[_cell(c) for c in r] for r in pdf.itertuples(index=False, name=None)]
        text = [(i, 0, i, *[None if c is None else str(c) for c in r]) for i, r in enumerate(rows)]
        schema = "__row long, __blk int, __mid long, " + ", ".join(f"c{i} string" for i in range(pdf.shape[1]))
        sheets.append((str(name), rows[: header_limit + 20], spark.createDataFrame(text, schema)))
    if not sheets:
        raise model.NoResults(f"{path} has no results")
    return _dataset(spark, path, "xlsx", sheets, force_index, header_limit)


def write_csv(ds: Dataset, folder: str) -> None:
    """A folder of CSV files a table, in the template's form; reads back alike."""
    for table in ds.table_names():
        head = [r for r in ds.header() if r["table"] == table]
        wide = sheet_frame(ds, table)
        labels = ["table", "key", *([] if head[0]["is_simple"] else ["type"]), "units"]
        top = [[x, *[str(r[x]) if r[x] is not None else "" for r in head]] for x in labels]
        index = "timestamp" if ds.is_datetime(table) else "range"
        rows = [",".join(f'"{c}"' for c in r) for r in [*top, [index, *[""] * len(head)]]]
        text = wide.select(F.col("row_ix"), F.concat_ws(",", F.col("at"), *[F.coalesce(F.col(f"v{r['id']}").cast("string"), F.lit("")) for r in head]).alias("value"))
        # one file a table, in the order of its rows: a sheet is bounded by its format
        heads = ds.spark.createDataFrame([(i - len(rows), x) for i, x in enumerate(rows)], "row_ix long, value string")
        heads.unionByName(text).repartition(1).sortWithinPartitions("row_ix").select("value").write.mode("overwrite").text(f"{folder}/{table}")


def sheet_frame(ds: Dataset, table: str) -> DataFrame:
    """Wide rows of a table: at, row_ix and a column v<id> a variable."""
    head = [r["id"] for r in ds.header() if r["table"] == table]
    rows = ds.full_table(table).withColumn("at", F.coalesce(F.col("ts").cast("string"), F.col("range_ix").cast("string"), "label", F.col("row_ix").cast("string")))
    return rows.groupBy("row_ix", "at").agg(*[F.max(F.when(F.col("id") == i, F.coalesce(F.col("value").cast("string"), F.col("text")))).alias(f"v{i}") for i in head])


def to_excel(ds: Dataset, path: str) -> None:
    """A workbook with a sheet a table (needs openpyxl); sheets are bounded by
    the format, so their rows may come to the driver."""
    import pandas as pd

    try:
        with pd.ExcelWriter(path) as book:
            for table in ds.table_names():
                head = [r for r in ds.header() if r["table"] == table]
                pdf = sheet_frame(ds, table).orderBy("row_ix").toPandas()
                labels = ["table", "key", *([] if head[0]["is_simple"] else ["type"]), "units"]
                top = [[x, *[r[x] for r in head]] for x in labels] + [["timestamp" if ds.is_datetime(table) else "range", *[None] * len(head)]]
                body = pdf[["at", *[f"v{r['id']}" for r in head]]].to_numpy().tolist()
                pd.DataFrame(top + body).to_excel(book, sheet_name=table, header=False, index=False)
    except ImportError as e:
        raise model.FormatNotSupported("workbooks need openpyxl") from e
