"""Tables whose content is what their newest ledger entry names: runs become visible whole or not at all.

A run writes its rows into a folder of its own and then one ledger entry, which lists the folders that count and a mark for
each writer (its last batch).  Readers take the newest entry, so files of a run that failed are never seen, and a run that
is repeated writes over its own folder.  Entries are numbered; the second of two writers with one number fails.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = "_run"


class LedgerConflict(RuntimeError):
    """Another writer has published meanwhile: read the state again and repeat."""


@dataclass(frozen=True)
class State:
    version: int = 0
    folders: tuple[str, ...] = ()
    marks: dict = field(default_factory=dict)
    fields: tuple = ()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField.fromJson(f) for f in self.fields])


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def state(self) -> State:
        where = self._at("_ledger")
        if not self._files.exists(where):
            return State()
        names = [s.getPath().getName() for s in self._files.listStatus(where)]
        versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not versions:
            return State()
        entry = self.spark.read.text(f"{self.path}/_ledger/{max(versions):012d}.json", wholetext=True).first()[0]
        found = json.loads(entry)
        return State(max(versions), tuple(found["folders"]), found["marks"], tuple(found["fields"]))

    def table(self, state: State | None = None) -> DataFrame | None:
        """The rows that count; None before the first run."""
        state = self.state() if state is None else state
        if not state.fields:
            return None
        if not state.folders:
            return self.spark.createDataFrame([], state.schema())
        schema = T.StructType([*state.schema().fields, T.StructField(_RUN, T.StringType())])
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/{f}" for f in state.folders]).select(*state.schema().fieldNames())

    def stage(self, rows: DataFrame, run: str, partitions: Sequence[str] = ()) -> str:
        """Writes a run's rows where no reader looks yet; a repeated run replaces its own.  All runs take one partitioning."""
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/data/{_RUN}={run}")
        return f"{_RUN}={run}"

    def publish(self, before: State, rows: DataFrame, folders: Sequence[str], marks: dict | None = None, instead: bool = False) -> State:
        """Makes staged folders count, after what counted in ``before`` or ``instead`` of it."""
        known = {f["name"]: f for f in before.fields}
        for f in json.loads(rows.schema.json())["fields"]:
            if known.setdefault(f["name"], f)["type"] != f["type"]:
                raise TypeError(f"{f['name']} was {known[f['name']]['type']} and now is {f['type']}")
        kept = [f for f in (() if instead else before.folders) if f not in folders]
        after = State(before.version + 1, (*kept, *folders), before.marks | (marks or {}), tuple(known.values()))
        entry = json.dumps({"folders": after.folders, "marks": after.marks, "fields": after.fields})
        target, part = self._at(f"_ledger/{after.version:012d}.json"), self._at(f"_ledger/.{after.version}-{abs(hash(entry))}")
        self._files.mkdirs(self._at("_ledger"))
        if self._files.exists(target):
            raise LedgerConflict(f"entry {after.version} of {self.path} exists")
        out = self._files.create(part, True)
        out.write(bytearray(entry.encode()))
        out.close()
        if not self._files.rename(part, target):
            raise LedgerConflict(f"entry {after.version} of {self.path} exists")
        return after

    def compact(self, run: str, partitions: Sequence[str] = ()) -> State:
        """All rows that count in one folder; the old folders stay for readers that have begun."""
        before = self.state()
        rows = self.table(before)
        if rows is None:
            return before
        return self.publish(before, rows, [self.stage(rows, run, partitions)], instead=True)


def new_rows(rows: DataFrame, landed: DataFrame | None, keys: Sequence[str], partitions: Sequence[str] = ()) -> DataFrame:
    """The rows whose keys haven't landed; null equals null.

    Keys lie in one partition each, so only partitions that the rows touch are read.
    """
    if landed is None:
        return rows
    same = lambda a, b, names: [a[k].eqNullSafe(b[f"_l_{k}"]) for k in names]
    touched = rows.select(*[F.col(p).alias(f"_l_{p}") for p in partitions]).distinct() if partitions else None
    if touched is not None:
        landed = landed.join(touched, same(landed, touched, partitions), "left_semi")
    have = landed.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
    return rows.join(have, same(rows, have, keys), "left_anti")
