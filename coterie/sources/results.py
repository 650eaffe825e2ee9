"""Result tables of whole runs, written aside and made visible at once.

Every write puts its tables into a fresh folder and then adds one row to the log of the
root: the run and all its tables. That row is one file, so a reader sees all tables of a write or
none; a run that fails, or loses its driver, leaves what was visible before. Nothing is overwritten in
place, so readers of an earlier version go on until `vacuum` is called.

Of two writers of one run the later to log wins as a whole. Tables keep their names and types, empty
ones too. A run that was never written or was deleted has no tables.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coterie.functions.frames import children, forget

LOG = "run_id string, version long, written string, tables array<struct<name string, path string, schema string>>"


def _log_path(root: str) -> str:
    return f"{root.rstrip('/')}/log"


def _log(spark: SparkSession, root: str) -> DataFrame:
    if not children(spark, _log_path(root)):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(_log_path(root))


def _add(spark: SparkSession, root: str, runs: Mapping[str, Sequence[tuple[str, str, str]]]) -> None:
    """One file with a row for each run: the change becomes visible for all of them at once."""
    version, written = time.time_ns(), uuid.uuid4().hex
    rows = [(run, version, written, list(tables)) for run, tables in runs.items()]
    if rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(_log_path(root))


def visible(spark: SparkSession, root: str) -> DataFrame:
    """`run_id, name, path, schema`: the tables of each run's last version."""
    last = _log(spark, root).groupBy("run_id").agg(F.max_by("tables", F.struct("version", "written")).alias("tables"))
    return last.select("run_id", F.inline("tables"))


def _tables(spark: SparkSession, root: str, run_id: str) -> dict[str, tuple[str, str, str]]:
    rows = visible(spark, root).where(F.col("run_id") == run_id).collect()
    return {r["name"]: (r["name"], r["path"], r["schema"]) for r in rows}


def _written(tables: Mapping[str, DataFrame], root: str) -> dict[str, tuple[str, str, str]]:
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = (name, f"{folder}/{name}", df.schema.json())
    return out


def write_results(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame], clean: bool = False) -> None:
    """Record the tables of a run in place of its earlier ones; `clean` takes all other runs out as well."""
    new = list(_written(tables, root).values())
    gone = [r["run_id"] for r in visible(spark, root).select("run_id").distinct().collect()] if clean else []
    _add(spark, root, {r: [] for r in gone} | {run_id: new})


def replace_results(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame]) -> None:
    """Record some tables of a run anew; its other tables stay."""
    _add(spark, root, {run_id: list((_tables(spark, root, run_id) | _written(tables, root)).values())})


def read_results(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a run by name; none if the run is not there."""

    def read(path: str, schema: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)

    return {name: read(path, schema) for name, path, schema in _tables(spark, root, run_id).values()}


def update_results(spark: SparkSession, root: str, run_id: str, name: str, where: Column, values: Mapping[str, object]) -> None:
    """Set fields of the rows that meet a condition; rows for which it is null stay as they are."""
    rows = read_results(spark, root, run_id)[name]
    unknown = set(values) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such fields in {name}: {sorted(unknown)}")

    def field(c: str, kind: str) -> Column:
        old = F.col(f"`{c}`")
        return F.when(where, F.lit(values[c]).cast(kind)).otherwise(old).alias(c) if c in values else old

    replace_results(spark, root, run_id, {name: rows.select(*[field(c, kind) for c, kind in rows.dtypes])})


def delete_results(spark: SparkSession, root: str, run_id: str | None = None, names: Sequence[str] | None = None) -> None:
    """Take tables (all, if no names are given) of one run or of every run out of sight."""
    seen = visible(spark, root).where(F.lit(True) if run_id is None else F.col("run_id") == run_id).collect()
    kept: dict[str, list[tuple[str, str, str]]] = {r["run_id"]: [] for r in seen}
    for r in seen:
        if names is not None and r["name"] not in names:
            kept[r["run_id"]].append((r["name"], r["path"], r["schema"]))
    _add(spark, root, kept)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the folders that no run shows any more, how many it tells. No run may be writing meanwhile."""
    folders = children(spark, f"{root.rstrip('/')}/data")
    used = {r["path"].rsplit("/", 2)[1] for r in visible(spark, root).select("path").collect()}
    gone = [f for f in folders if f.rstrip("/").rsplit("/", 1)[1] not in used]
    for folder in gone:
        forget(spark, folder)
    return len(gone)
