"""Tables that change together: immutable parts of rows, and a manifest a version that names the parts.

A change writes its rows as new parts first and its manifest last; readers take all tables from the newest whole manifest, so
they see all of a change or nothing of it, whatever write a crash broke off. A manifest is created, never overwritten: of
two changes that began at the same version the second fails. A change that carries a batch number is known by it, so a
batch that runs again after its commit is told apart from one that broke off before.

Updates are merged on read: a part of changes holds the key and what is new of each changed row only, and the newest change of
each column counts. `compact` writes the merged rows as one part. A table may be partitioned by a column (a bucket of
its key), and a read that filters on it opens those folders only.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType


@dataclass(frozen=True)
class Kind:
    """Columns as DDL, the key by which rows are updated (a number that grows, or None), and what the parts are partitioned by."""

    columns: str
    key: str | None = "id"
    partition: str | None = None


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Tables:
    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind]):
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds

    def _path(self, at: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path(f"{self.root}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> dict | None:
        rows = self.spark.read.text(f"{self.root}/_versions/{number:012d}.json", wholetext=True).collect()
        try:
            return json.loads(rows[0][0]) if rows else None
        except ValueError:  # a crash cut it short
            return None

    def state(self) -> dict:
        """The newest whole manifest, with the number that the next one gets."""
        numbers = self._numbers()
        whole = next((m for m in map(self._manifest, reversed(numbers)) if m), {"version": 0, "batch": None, "tables": {}})
        return whole | {"next": (numbers[-1] if numbers else 0) + 1}

    def structure(self, name: str) -> StructType:
        return StructType.fromDDL(self.kinds[name].columns)

    def _parts(self, name: str, parts: list[str], schema: StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        own = StructType(list(schema.fields)).add("part", StringType())
        return self.spark.read.schema(own).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/part={p}" for p in parts]).select(*schema.names)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """The table's rows in the newest version, or in the one given."""
        own = (state or self.state())["tables"].get(name, {"rows": [], "changes": []})
        schema, key = self.structure(name), self.kinds[name].key
        rows = self._parts(name, own["rows"], schema)
        if not own["changes"]:
            return rows
        logged = self._parts(name, own["changes"], StructType(list(schema.fields)).add("_set", ArrayType(StringType())).add("_order", LongType()))
        newest = [F.max_by(F.struct(F.col(c)), F.when(F.array_contains("_set", c), F.col("_order"))).alias(f"_{c}") for c in schema.names if c != key]
        merged = rows.join(logged.groupBy(F.col(key).alias("_key")).agg(*newest), F.col(key) == F.col("_key"), "left")
        return merged.select(*[F.col(c) if c == key else F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.{c}")).otherwise(F.col(c)).alias(c) for c in schema.names])

    def change(self, batch: int | None = None) -> Change:
        return Change(self, batch)

    def done(self, batch: int) -> bool:
        """Whether the batch has been committed."""
        last = self.state()["batch"]
        return last is not None and last >= batch

    def compact(self, *names: str) -> None:
        """The tables' merged rows as one part each."""
        change = self.change()
        for name in names:
            change.replace(name, self.read(name, change.before))
        change.commit()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes parts that none of the last `keep` versions names; the number of them. Not while a change is under way."""
        used = {(n, p) for m in map(self._manifest, self._numbers()[-keep:]) if m for n, t in m["tables"].items() for p in t["rows"] + t["changes"]}
        gone = 0
        for name in self.kinds:
            path, fs = self._path(f"{self.root}/{name}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if (name, s.getPath().getName().removeprefix("part=")) not in used:
                    gone += fs.delete(s.getPath(), True)
        return gone


class Change:
    """Writes to several tables that `commit` makes visible at once."""

    def __init__(self, tables: Tables, batch: int | None):
        self.tables, self.before = tables, tables.state()
        self.after = copy.deepcopy(self.before)
        self.after |= {"batch": self.before["batch"] if batch is None else batch, "version": self.before["next"]}
        del self.after["next"]

    def _of(self, name: str) -> dict:
        return self.after["tables"].setdefault(name, {"rows": [], "changes": [], "last": 0})

    def last(self, name: str) -> int:
        """The largest key that the table has had."""
        return self._of(name)["last"]

    def _write(self, rows: DataFrame, name: str) -> str:
        part, by = uuid.uuid4().hex, self.tables.kinds[name].partition
        writer = rows.write.partitionBy(by) if by and "_set" not in rows.columns else rows.write
        writer.parquet(f"{self.tables.root}/{name}/part={part}")
        return part

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows (columns that they lack are null); the rows as they were written."""
        schema, key, own = self.tables.structure(name), self.tables.kinds[name].key, self._of(name)
        part = self._write(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), name)
        own["rows"].append(part)
        found = self.tables._parts(name, [part], schema)
        if key:
            own["last"] = max(own["last"], found.agg(F.max(key)).first()[0] or 0)
        return found

    def replace(self, name: str, rows: DataFrame | None) -> None:
        """The table's rows from now on; none where rows is None."""
        self._of(name).update({"rows": [], "changes": []})
        if rows is not None:
            self.append(name, rows)

    def update(self, name: str, rows: DataFrame, *columns: str) -> None:
        """rows(key, columns): what these columns of the rows with these keys are from now on. Keys are unique; unknown ones change nothing."""
        schema, key, own = self.tables.structure(name), self.tables.kinds[name].key, self._of(name)
        own["order"] = own.get("order", 0) + 1
        full = [(F.col(f.name) if f.name in (key, *columns) else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        own["changes"].append(self._write(rows.select(*full, F.array(*map(F.lit, columns)).alias("_set"), F.lit(own["order"]).cast("long").alias("_order")), name))

    def commit(self) -> int:
        path, fs = self.tables._path(f"{self.tables.root}/_versions/{self.after['version']:012d}.json")
        if self.tables.state()["version"] != self.before["version"] or fs.exists(path):
            raise Conflict(f"version {self.after['version']} is there")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(self.after).encode()))
        finally:
            out.close()
        return self.after["version"]
