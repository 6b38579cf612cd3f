"""Tables of daily cells: readers that refuse bad input, and derivations from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.tables import written
from factweave.plans.spec import SourceSpec
from factweave.sources import lines
from factweave.sources.json_file import write_lines

#: What a label may hold, and the prefix of labels that are ours.
LABEL = r"\A[A-Za-z0-9][A-Za-z0-9 ._:&+/-]{0,63}\z"
RESERVED = "__"
ISO_DAY = r"\A\d{4}-\d{2}-\d{2}\z"
NUMBER = r"(?i)\A[-+]?(\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?\z"
NOT_FINITE = r"(?i)\A[-+]?(nan|inf|infinity)\z"
#: Sums are exact in decimals, so they don't depend on the order of rows.
EXACT = T.DecimalType(38, 6)


class SourceError(ValueError):
    """The source breaks a rule; nothing is computed from it."""


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _named(file: str, path: str) -> str:
    """A file as it is called below ``path``."""
    return file.split(path.rstrip("/"), 1)[-1].lstrip("/") or file.rsplit("/", 1)[-1]


def read_cells_csv(spark: SparkSession, path: str, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """Lines of the files below ``path`` as rows, and the files' splits.

    Rows hold all columns as strings, ``_extra`` (too many or too few fields),
    ``_head`` (a header line) and the place of the line.  All files must have
    the same columns in the same order, quoted or not; a file that has not is
    named.  Blank lines are no rows, but count as lines.
    """
    try:
        pieces = written(lines.splits(lines.read_lines(spark, path)), "splits")
    except Exception as e:
        raise SourceError(f"{path} can't be read") from e
    tops = lines.headers(pieces)
    file, header = (tops[0][0], lines.header_names(tops[0][1])) if tops else ("", ())
    if sorted(header) != sorted(spec.columns):
        raise SourceError(f"{_named(file, path)}: columns must be {', '.join(spec.columns)}; found {', '.join(header) or 'none'}")
    odd = [_named(f, path) for f, line in tops if lines.header_names(line) != header]
    if odd or len(tops) == lines.MOST_HEADERS:
        raise SourceError(f"{', '.join(odd) or path}: columns must be {', '.join(header)}, in this order, as in {_named(file, path)}")
    schema = ", ".join(f"`{h}` STRING" for h in (*header, "_corrupt"))
    row = F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    head = F.col("value").isin([line for _, line in tops])
    read = lines.read_lines(spark, path).select(row.alias("r"), head.alias("_head"), (F.trim("value") == "").alias("_blank"), *lines.PLACE)
    rows = read.where("NOT _blank").select("r.*", "_head", *lines.PLACE)
    return rows.withColumn("_extra", F.col("_corrupt").isNotNull()).drop("_corrupt"), pieces


def rule_checks(spec: SourceSpec) -> list[tuple[str, str, Column]]:
    """(rule, column, condition of a row that breaks it) on columns of strings."""
    day = stripped(F.col(spec.date))
    checks = [("date", spec.date, F.coalesce(~day.rlike(ISO_DAY) | F.try_to_date(day, "yyyy-MM-dd").isNull(), F.lit(True)))]
    for d in spec.dims:
        label = F.coalesce(stripped(F.col(d)), F.lit(""))
        checks += [
            ("empty_label", d, label == ""),
            ("reserved_label", d, label.startswith(RESERVED)),
            ("label_vocabulary", d, (label != "") & ~label.startswith(RESERVED) & ~label.rlike(LABEL)),
        ]
    for m in spec.measures:
        text = F.coalesce(stripped(F.col(m)), F.lit(""))
        value = F.expr(f"try_cast({_quoted(m)} AS DOUBLE)")
        odd = text.rlike(NOT_FINITE)
        checks += [
            ("not_numeric", m, ~odd & ~text.rlike(NUMBER)),
            ("not_finite", m, odd | (text.rlike(NUMBER) & F.coalesce(F.abs(value) == float("inf"), F.lit(False)))),
            ("negative", m, text.rlike(NUMBER) & (F.coalesce(value, F.lit(0.0)) < 0)),
        ]
    return checks


def _quoted(name: str) -> str:
    return f"regexp_replace(`{name}`, '(?U)^\\\\s+|\\\\s+$', '')"


def _broken(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """rule, column, n, at: how often each rule is broken and the first place (null where rows have none)."""
    placed = set(lines.PLACE) <= set(rows.columns)
    place = lines.place() if placed else F.lit(None).cast("string")
    head = F.col("_head") if "_head" in rows.columns else F.lit(False)
    checks = [(r, c, cond & ~head) for r, c, cond in rule_checks(spec)]
    if "_extra" in rows.columns:
        checks.append(("field_count", "*", F.col("_extra") & ~head))
    counted = rows.agg(
        *[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)], *[F.min(F.when(cond, place)).alias(f"p{i}") for i, (_, _, cond) in enumerate(checks)],
        F.count_if(~head).alias("rows"), F.min(F.when(F.lit(False), place)).alias("nowhere"))
    cell = lambda r, c, n, at: F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), n.alias("n"), at.alias("at"))
    cells = [cell(r, c, F.col(f"c{i}"), F.col(f"p{i}")) for i, (r, c, _) in enumerate(checks)]
    cells.append(cell("no_rows", "*", (F.col("rows") == 0).cast("long"), F.col("nowhere")))
    single = counted.select(F.explode(F.array(*cells)).alias("v")).select("v.*")
    keys = [stripped(F.col(c)).alias(f"k{i}") for i, c in enumerate((spec.date, *spec.dims))]
    keyed, names = rows.where(~head).select(*keys, place.alias("at")), [f"k{i}" for i in range(len(keys))]
    if placed:  # of each key the second row; each task passes on two rows a key at most
        order = Window.partitionBy(*names).orderBy("at")
        repeated = keyed.withColumn("turn", F.row_number().over(order)).where("turn = 2")
    else:
        repeated = keyed.groupBy(*names).agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n > 1")
    repeated = repeated.agg(F.count("*").alias("n"), F.min("at").alias("at")).select(F.lit("duplicate_cell").alias("rule"), F.lit("*").alias("column"), "n", "at")
    return single.unionByName(repeated).where("n > 0")


def source_violations(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """rule, column, n: how often each rule is broken; offending values are withheld."""
    return _broken(rows, spec).drop("at")


def first_offences(rows: DataFrame, pieces: DataFrame, spec: SourceSpec) -> DataFrame:
    """rule, column, n, file, line: how often each rule is broken in files, and where first (a duplicate at its second row).

    A header line that comes again in its file is an offence of its own, counted once a file.
    """
    again = rows.where("_head").withColumn("turn", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at"))).where("turn = 2")
    again = again.agg(F.count("*").alias("n"), F.min(lines.place()).alias("at")).select(F.lit("repeated_header").alias("rule"), F.lit("*").alias("column"), "n", "at")
    found = _broken(rows, spec).unionByName(again.where("n > 0"))
    return lines.located(found, pieces)


def typed_cells(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Strings that passed the rules, as day, labels and doubles."""
    return rows.select(
        F.try_to_date(stripped(F.col(spec.date)), "yyyy-MM-dd").alias("day"),
        *[stripped(F.col(d)).alias(d) for d in spec.dims],
        *[F.expr(f"try_cast({_quoted(m)} AS DOUBLE)").alias(m) for m in spec.measures],
    )


def load_cells(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Checked cells of a CSV file or folder; raises SourceError with the rules that are broken and where first."""
    rows, pieces = read_cells_csv(spark, path, spec)
    broken = first_offences(rows, pieces, spec).orderBy("rule", "column").collect()
    if broken:
        where = lambda v: f", first in {_named(v['file'], path)} line {v['line']}" if v["file"] else ""
        raise SourceError("; ".join(f"{v['rule']} in {v['column']}: {v['n']} rows{where(v)}" for v in broken))
    return typed_cells(rows.where("NOT _head"), spec)


def write_cells_csv(cells: DataFrame, path: str, spec: SourceSpec, *, money: str = "gmv") -> None:
    """One CSV file with a header, its lines in the order of days and labels; money with two decimals."""
    columns = [F.date_format("day", "yyyy-MM-dd").alias(spec.date), *spec.dims]
    columns += [F.col(m).cast("decimal(18,2)" if m == money else "decimal(18,0)").alias(m) for m in spec.measures]
    keys = [spec.date, *spec.dims]
    write_lines(cells.select(*columns).select(*keys, F.to_csv(F.struct(*keys, *spec.measures)).alias("value")), keys, path, ",".join([*keys, *spec.measures]) + "\n")


ORDERS = SourceSpec(dims=("region", "priority"))
EVENTS = SourceSpec(dims=("bucket", "part"))


def cells_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, region and priority: orders taken (sessions), finished ones (orders), their total price (gmv)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    rows = read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(
        F.to_date("o_orderdate").alias("day"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("priority")
    ).agg(
        F.count("*").cast("double").alias("sessions"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("gmv"),
    )


def event_sums(events: DataFrame) -> DataFrame:
    """Per day, user bucket and part of the day: events, purchases and their value, as exact sums that add up."""
    bought = F.col("event_type") == "purchase"
    return events.groupBy(
        F.to_date("ts").alias("day"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("bucket"),
        F.concat(F.lit("h"), F.floor(F.hour("ts") / 6).cast("string")).alias("part"),
    ).agg(
        F.count("*").alias("sessions"), F.count_if(bought).alias("orders"),
        F.coalesce(F.sum(F.when(bought, F.col("value").cast("decimal(18,2)"))), F.lit(0)).cast("decimal(28,2)").alias("gmv"),
    )


def cells_from_events(events: DataFrame) -> DataFrame:
    """``event_sums`` as cells."""
    return event_sums(events).select("day", "bucket", "part", *[F.col(m).cast("double").alias(m) for m in ("sessions", "orders", "gmv")])


def source_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_rows"))
