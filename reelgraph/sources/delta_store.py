"""Durable changes that cost what they change: a base, small change files merged at read time, and a compaction.

``path/data/<table>/<version>`` holds rows, ``path/gone/<table>/<version>`` the values of a column whose rows no longer count, and
``path/commits/<number>`` the list of both in force.  A change is one commit over all its tables: readers see all of it or
nothing, and of two writers that began from one commit the second is refused (as in ``graph_commits``).

A row counts if no later deletion names its value: every file carries the number of its commit, deletions act on files with a smaller number.
An upsert is the deletion of its keys and its rows under one number.  A read unites the files of a table and joins, per column that deletions
use, one row per deleted value; that side is as large as the changes since the last compaction, which the planner sees from its files and
broadcasts or shuffles by.  ``compact`` writes the merged tables as a new base when the changes have grown to a share of it.

Nulls and edges: a null key or value is deleted by nothing.  Repeated rows under one key in one upsert all stay.  A table named in no commit is
empty.  Readers of older commits keep working until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reelgraph.sources import exchange, graph_commits

#: Parts of a table's state: files of rows, and files of deleted values with their column.
EMPTY: dict = {"rows": [], "gone": []}


def state(spark: SparkSession, path: str, commit: int | None = None) -> dict:
    """What a commit names, the newest if none is given: per table its files with their commit numbers."""
    return graph_commits.versions(spark, path, commit)


class Change:
    """One commit in the making; nothing counts before ``commit``, and its deletions act on earlier commits alone.

    ``keys`` names each table's key.  The tables given may be read from the same path.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, str], began: int | None = None):
        self.spark, self.path, self.keys = spark, path, keys
        self.began = graph_commits.head(spark, path) if began is None else began
        self.state = {n: {k: list(v) for k, v in s.items()} for n, s in state(spark, path, self.began).items()}
        self.number, self.version = self.began + 1, uuid.uuid4().hex

    def _of(self, table: str) -> dict:
        if table not in self.keys:
            raise ValueError(f"{table} is no table of this store")
        return self.state.setdefault(table, {k: list(v) for k, v in EMPTY.items()})

    def _rows(self, table: str, rows: DataFrame) -> None:
        name = f"{self.version}-{len(self._of(table)['rows'])}"
        rows.write.parquet(f"{self.path}/data/{table}/{name}")
        self._of(table)["rows"].append([self.number, name])

    def append(self, table: str, rows: DataFrame) -> "Change":
        self._rows(table, rows)
        return self

    def upsert(self, table: str, rows: DataFrame) -> "Change":
        """``rows`` take the place of the stored rows with their keys."""
        self.delete(table, rows, self.keys[table])
        return self.append(table, rows)

    def delete(self, table: str, values: DataFrame, column: str | None = None) -> "Change":
        """Stored rows whose ``column`` (the key, if not named) holds a value that ``values`` holds in it count no more."""
        column = column or self.keys[table]
        name = f"{self.version}-{len(self._of(table)['gone'])}"
        gone = values.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        gone.write.parquet(f"{self.path}/gone/{table}/{name}")
        self._of(table)["gone"].append([self.number, name, column])
        return self

    def replace(self, table: str, rows: DataFrame) -> "Change":
        """A new base: all files before count no more."""
        self._of(table)
        self.state[table] = {k: list(v) for k, v in EMPTY.items()}
        self._rows(table, rows)
        return self

    def commit(self) -> int:
        return graph_commits._publish(self.spark, self.path, self.began, self.state)


def load(spark: SparkSession, path: str, schemas: Mapping[str, str], commit: int | None = None) -> dict[str, DataFrame]:
    """The tables as of a commit, lazily; files are named by the commit, so no folder is listed for others."""
    named = state(spark, path, commit)
    return {table: _merged(spark, path, table, ddl, named.get(table, EMPTY)) for table, ddl in schemas.items()}


def _merged(spark: SparkSession, path: str, table: str, ddl: str, files: dict) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    last: dict[str, int] = {}
    for number, _, column in files["gone"]:
        last[column] = max(number, last.get(column, 0))
    merged = None
    by_number: dict[int, list[str]] = {}
    for number, name in files["rows"]:
        by_number.setdefault(number, []).append(f"{path}/data/{table}/{name}")
    for number, paths in sorted(by_number.items()):
        part = spark.read.schema(schema).parquet(*paths).withColumn("__number", F.lit(number))
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        return spark.createDataFrame([], schema)
    first = min(by_number)
    for i, column in enumerate(sorted(c for c, n in last.items() if n > first)):
        gone = None
        for number, name, of in files["gone"]:
            if of == column and number > first:
                part = spark.read.schema("value string").parquet(f"{path}/gone/{table}/{name}").withColumn("number", F.lit(number))
                gone = part if gone is None else gone.unionByName(part)
        latest = gone.groupBy(F.col("value").alias(f"__value{i}")).agg(F.max("number").alias(f"__gone{i}"))
        merged = merged.join(latest, F.col(column).cast("string") == F.col(f"__value{i}"), "left")
        merged = merged.where(F.col(f"__gone{i}").isNull() | (F.col(f"__gone{i}") <= F.col("__number"))).drop(f"__value{i}", f"__gone{i}")
    return merged.select(*schema.names)


def file_bytes(spark: SparkSession, path: str, commit: int | None = None) -> dict[str, tuple[int, int]]:
    """Per table the bytes of its base and of the changes since, from file sizes."""
    out = {}
    for table, files in state(spark, path, commit).items():
        sizes = [_bytes(spark, f"{path}/data/{table}/{name}") for _, name in files["rows"]]
        gone = [_bytes(spark, f"{path}/gone/{table}/{name}") for _, name, _ in files["gone"]]
        out[table] = (sizes[0] if sizes else 0, sum(sizes[1:]) + sum(gone))
    return out


def _bytes(spark: SparkSession, path: str) -> int:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(named.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(named).getLength())


def compact(spark: SparkSession, path: str, schemas: Mapping[str, str], keys: Mapping[str, str], share: float = 0.1) -> int | None:
    """Write new bases for the tables whose changes exceed ``share`` of their base; None if there is none."""
    began = graph_commits.head(spark, path)
    due = [t for t, (base, more) in file_bytes(spark, path, began).items() if more > share * base]
    if not due:
        return None
    change, tables = Change(spark, path, keys, began), load(spark, path, schemas, began)
    for table in due:
        change.replace(table, tables[table])
    return change.commit()


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Delete the files that none of the last ``keep`` commits names; returns how many folders went.

    Files of changes in the making look like those of changes that ended half-way: run it when none runs.
    """
    newest = graph_commits.head(spark, path)
    named = set()
    for number in range(max(1, newest - keep + 1), newest + 1):
        for table, files in state(spark, path, number).items():
            named |= {("data", table, f[1]) for f in files["rows"]} | {("gone", table, f[1]) for f in files["gone"]}
    dropped = 0
    for kind in ("data", "gone"):
        for table in exchange.names_in(spark, f"{path}/{kind}"):
            for name in exchange.names_in(spark, f"{path}/{kind}/{table}"):
                if (kind, table, name) not in named:
                    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{table}/{name}")
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
                    dropped += 1
    return dropped
