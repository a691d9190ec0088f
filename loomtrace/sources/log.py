"""Event logs from CSV, JSON lines and any table.

A log has the columns ``case_id, activity, ts, resource, lifecycle, attributes, seq``. Events of a case are in the order
of ``(ts, seq)``; absent strings are empty. ``seq`` of a file is unique in the file and rises with its lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_COLUMNS = ("case_id", "activity", "ts", "resource", "lifecycle", "attributes", "seq")
ATTRIBUTES = "map<string,struct<number:double,text:string>>"

#: Layouts of time stamps, the first that fits wins; a fraction of a second is accepted after seconds.
CSV_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS]",
    "dd/MM/yyyy HH:mm:ss[.SSSSSS][.SSS]",
    "MM/dd/yyyy HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
)
JSONL_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd",
)


@dataclass(frozen=True)
class LogColumns:
    """Names of a file's columns or fields, and how it is read."""

    case: str = "case_id"
    activity: str = "activity"
    ts: str = "timestamp"
    resource: str = "resource"
    lifecycle: str = "lifecycle"
    delimiter: str = ","
    skip_rows: int = 0
    layouts: Sequence[str] = ()


def to_log(df: DataFrame, case: str | Column, activity: str | Column, ts: str | Column, seq: str | Column, resource: str | Column | None = None, lifecycle: str | Column | None = None) -> DataFrame:
    """Any table as a log; nulls in optional columns become empty strings."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    text = lambda c: F.lit("") if c is None else F.coalesce(col(c).cast("string"), F.lit(""))
    return df.select(
        col(case).cast("string").alias("case_id"),
        col(activity).cast("string").alias("activity"),
        col(ts).cast("timestamp").alias("ts"),
        text(resource).alias("resource"),
        text(lifecycle).alias("lifecycle"),
        F.lit(None).cast(ATTRIBUTES).alias("attributes"),
        col(seq).cast("long").alias("seq"),
    )


def parse_timestamp(text: Column, layouts: Sequence[str]) -> Column:
    """The time stamp by the first layout that fits, null if none does; layouts without a zone are UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])


def _fail_if(bad: Column, value: Column, what: str, seq: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit("line "), (seq + 1).cast("string"), F.lit(f": {what}"))).cast("string")).otherwise(value)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file with ``seq``: a block's start plus the line's number in it, which rises through the file."""
    lines = spark.read.text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select("value", (F.col("_metadata.file_block_start") + place).alias("seq"))


def read_csv_log(spark: SparkSession, path: str, names: LogColumns = LogColumns()) -> DataFrame:
    """A log from a CSV file with a header.

    Names in the header are trimmed and compared in lower case. An empty case or activity, a bad time stamp or a row of
    another length than the header fails the read and names the line. Other columns become attributes: a cell that is a
    number has ``number``, any other ``text``; empty cells are left out.
    """
    lines = _numbered_lines(spark, path)
    first = lines.where(F.col("seq") == names.skip_rows).select("value").first()
    if first is None:
        raise ValueError(f"{path}: no header")
    split = spark.range(1).select(F.from_csv(F.lit(first[0]), ",".join(f"c{i} string" for i in range(first[0].count(names.delimiter) + 1)), {"sep": names.delimiter}).alias("h")).first()
    header = [(x or "").strip().lower() for x in split.h]
    for needed in (names.case, names.activity, names.ts):
        if needed.lower() not in header:
            raise ValueError(f"{path}: no column {needed}")
    schema = ", ".join([*(f"c{i} string" for i in range(len(header))), "bad string"])
    options = {"sep": names.delimiter, "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    rows = lines.where((F.col("seq") > names.skip_rows) & (F.length(F.trim("value")) > 0)).select("seq", F.from_csv("value", schema, options).alias("r"))
    seq = F.col("seq")
    cell = {h: F.trim(F.coalesce(F.col(f"r.c{i}"), F.lit(""))) for i, h in enumerate(header)}
    known = {n.lower() for n in (names.case, names.activity, names.ts, names.resource, names.lifecycle)}
    others = [F.struct(F.lit(h).alias("key"), F.struct(v.try_cast("double").alias("number"), F.when(v.try_cast("double").isNull(), v).alias("text")).alias("value")) for h, v in cell.items() if h not in known]
    attributes = F.map_from_entries(F.filter(F.array(*others), lambda e: e.value.number.isNotNull() | (e.value.text != ""))) if others else F.lit(None)
    case = _fail_if(F.col("r.bad").isNotNull(), cell[names.case.lower()], "wrong number of fields", seq)
    ts = parse_timestamp(cell[names.ts.lower()], names.layouts or CSV_LAYOUTS)
    return rows.select(
        _fail_if(case == "", case, "empty case", seq).alias("case_id"),
        _fail_if(cell[names.activity.lower()] == "", cell[names.activity.lower()], "empty activity", seq).alias("activity"),
        F.when(ts.isNull(), F.raise_error(F.concat(F.lit("line "), (seq + 1).cast("string"), F.lit(": bad time stamp"))).cast("timestamp")).otherwise(ts).alias("ts"),
        cell.get(names.resource.lower(), F.lit("")).alias("resource"),
        cell.get(names.lifecycle.lower(), F.lit("")).alias("lifecycle"),
        attributes.cast(ATTRIBUTES).alias("attributes"),
        "seq",
    )


def read_jsonl_log(spark: SparkSession, path: str, names: LogColumns = LogColumns()) -> DataFrame:
    """A log from a file of one JSON object a line; empty lines are skipped.

    Ids and activities may be numbers, written without a fraction. Time stamps are text in one of the layouts, or
    numbers: above 1e12 milliseconds since 1970, else seconds, cut to whole seconds. Bad JSON and missing or empty
    required fields fail the read.
    """
    lines = _numbered_lines(spark, path).where(F.length(F.trim("value")) > 0)
    return jsonl_to_log(lines, names)


def jsonl_to_log(lines: DataFrame, names: LogColumns = LogColumns()) -> DataFrame:
    """A log from JSON texts in ``value`` with ``seq``."""
    rows = lines.select("seq", F.try_parse_json("value").alias("v"))
    seq = F.col("seq")

    def field(name: str) -> tuple[Column, Column]:
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")), F.lit("VOID"))
        number = F.try_variant_get("v", f"$.{name}", "double")
        numeric = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        text = F.when(numeric, F.format_string("%.0f", number)).when(kind == "VOID", F.lit("")).otherwise(F.try_variant_get("v", f"$.{name}", "string"))
        return F.trim(F.coalesce(text, F.lit(""))), F.when(numeric, number)

    case, _ = field(names.case)
    activity, _ = field(names.activity)
    stamp, number = field(names.ts)
    seconds = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_seconds(number.cast("long")))
    ts = F.when(number.isNotNull(), seconds).otherwise(parse_timestamp(stamp, names.layouts or JSONL_LAYOUTS))
    known = [names.case, names.activity, names.ts, names.resource, names.lifecycle]
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    others = F.filter(entries, lambda e: ~e.key.isin(known))
    number_of = lambda e: F.try_variant_get(e.value, "$", "double")
    is_text = lambda e: F.schema_of_variant(e.value) == "STRING"
    attributes = F.map_from_entries(F.transform(others, lambda e: F.struct(e.key.alias("key"), F.struct(F.when(~is_text(e), number_of(e)).alias("number"), F.when(is_text(e) | number_of(e).isNull(), F.try_variant_get(e.value, "$", "string")).alias("text")).alias("value"))))
    return rows.select(
        _fail_if(F.col("v").isNull(), _fail_if(case == "", case, "no case", seq), "bad JSON", seq).alias("case_id"),
        _fail_if(activity == "", activity, "no activity", seq).alias("activity"),
        F.when(ts.isNull(), F.raise_error(F.concat(F.lit("line "), (seq + 1).cast("string"), F.lit(": bad time stamp"))).cast("timestamp")).otherwise(ts).alias("ts"),
        field(names.resource)[0].alias("resource"),
        field(names.lifecycle)[0].alias("lifecycle"),
        attributes.cast(ATTRIBUTES).alias("attributes"),
        "seq",
    )
