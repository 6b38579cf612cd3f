"""One file with lines in total order, put together from sorted parts; JSON of that kind.

Rows are sorted by ranges of their keys, so each task writes a part of the file
and the parts follow each other.  The file system joins them: by its own
concatenation where it has one, else by copying their bytes through a buffer.
No task and no process holds the file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUFFER = 1 << 20


def sorted_fields(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of all its structs in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """JSON of columns with sorted keys at every depth; nulls are written as such, and so are doubles that JSON can't hold."""
    fields = [df.schema[c] for c in sorted(columns)]
    finite = lambda f: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return F.to_json(F.struct(*[sorted_fields(finite(f), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def member(key: Column, value: Column) -> Column:
    """``"key":value`` with the key's JSON string."""
    name = F.to_json(F.array(key))
    return F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), value)


class Folder:
    """A folder or file of the file system that its URI names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, text: str) -> None:
        out = self.system.create(self.path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def parts(self) -> list:
        """Files that tasks wrote, by the number of the task."""
        found = [s.getPath() for s in self.system.listStatus(self.path) if s.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda p: int(p.getName().split("-")[1]))

    def join(self, parts: list) -> None:
        """``parts`` one after the other as this file, which is there only when it is whole; they may be gone then."""
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}.{uuid.uuid4().hex}")
        if self.system.hasPathCapability(self.path, "fs.capability.paths.concat"):
            self.system.rename(parts[0], draft)
            rest = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
            for i, p in enumerate(parts[1:]):
                rest[i] = p
            self.system.concat(draft, rest)
        else:
            out = self.system.create(draft, True, BUFFER)
            try:
                for p in parts:
                    part = self.system.open(p, BUFFER)
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BUFFER, False)
                    finally:
                        part.close()
            finally:
                out.close()
        self.system.delete(self.path, False)
        if not self.system.rename(draft, self.path):
            raise OSError(f"{self.path.toString()} can't be put in place")

    def delete(self) -> None:
        self.system.delete(self.path, True)


def write_lines(rows: DataFrame, order: list[str], path: str, before: str, after: str = "") -> None:
    """The column ``value`` of ``rows`` as lines of one file, in the order of columns, between two texts."""
    spark = rows.sparkSession
    work = f"{path}.parts-{uuid.uuid4().hex}"
    rows.orderBy(*order).select("value").write.text(f"{work}/rows")
    start, end = Folder(spark, f"{work}/start"), Folder(spark, f"{work}/end")
    start.write(before)
    end.write(after)
    Folder(spark, path).join([start.path, *Folder(spark, f"{work}/rows").parts(), end.path])
    Folder(spark, work).delete()


def write_json(rows: DataFrame, key: str, name: str, head: dict, path: str) -> None:
    """``{**head, name: {key: row, ...}}`` as one file: keys in order at every depth, a row a line.

    ``key`` must be unique and not null.  Members of ``head`` are few; those
    whose names come after ``name`` follow the rows.  No rows give an empty object.
    """
    first = rows.agg(F.min(key)).first()[0]
    comma = F.when(F.col(key) == F.lit(first), F.lit("")).otherwise(F.lit(","))
    text = rows.select(key, F.concat(comma, member(F.col(key), canonical_json(rows, *rows.columns))).alias("value"))
    said = lambda names: "".join(f"{json.dumps(n)}:{json.dumps(head[n], sort_keys=True, ensure_ascii=False, default=str)},\n" for n in names)
    before = said(n for n in sorted(head) if n < name)
    after = said(n for n in sorted(head) if n > name).rstrip(",\n")
    write_lines(text, [key], path, f"{{{before}{json.dumps(name)}:{{\n", f"}}{',' if after else ''}\n{after}}}\n")
