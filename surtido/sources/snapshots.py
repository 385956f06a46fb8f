"""State tables as numbered versions, published by commit files.

``root/_commits/00000007.json`` names the folders of rows that make up version
7. Folders have names of their own and are never renamed or written twice, so a
reader sees a version whole or not at all, whatever the store, and a job that
dies leaves the version before in force. Of two writers that started from one
version only one can create the next number (:mod:`.commits`); the other reads
again and applies its change anew, so no change is lost.

A version is one folder with the whole table (``update_snapshot``), or, for
tables with a key, several with the rows changed since (``merge_snapshot``):
reading folds them, the last row of a key counts. Folders of changes of like
size are merged when there are ``fan`` of them, and with the whole table once
they hold as many rows, so a commit writes its own changes and, on the average,
a logarithm's worth of earlier ones, however large the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from .commits import Taken, hadoop, publish, read_text

#: Marks a change that removes its key.
REMOVED = "_borrado"
_ORDER = "_orden"


class StaleVersion(RuntimeError):
    """Another writer published the version after the one that was read."""


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Version numbers with a commit, in order; the older ones are deleted, so they are few."""
    path, fs = hadoop(spark, f"{root}/_commits")
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _commit_path(root: str, version: int) -> str:
    return f"{root}/_commits/{version:08d}.json"


def _commit(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(read_text(spark, _commit_path(root, version))) if version else {"key": [], "runs": []}


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest version; 0 before the first."""
    return max(_versions(spark, root), default=0)


def new_folder(root: str) -> str:
    """Path for the rows, or the files, of a version to come; nothing refers to it before its commit."""
    return f"{root}/data-{uuid.uuid4().hex}"


def publish_version(
    spark: SparkSession, root: str, after: int, runs: list[dict], key: Sequence[str] = (), keep: int = 20
) -> int:
    """Make ``runs`` the version following ``after``, or raise :class:`StaleVersion`; versions beyond ``keep`` go."""
    text = json.dumps({"id": uuid.uuid4().hex, "key": list(key), "runs": runs})
    try:
        publish(spark, _commit_path(root, after + 1), text)
    except Taken as error:
        raise StaleVersion(f"{root}: {after + 1}") from error
    versions = _versions(spark, root)
    old = [v for v in versions if v <= after + 1 - keep]
    if old:
        used = {run["path"] for v in versions if v not in old for run in _commit(spark, root, v)["runs"]}
        for version in old:
            for run in _commit(spark, root, version)["runs"]:
                if run["path"] not in used:
                    path, fs = hadoop(spark, f"{root}/{run['path']}")
                    fs.delete(path, True)
            path, fs = hadoop(spark, _commit_path(root, version))
            fs.delete(path, False)
    return after + 1


def latest_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest version, of a table or of files that are published whole."""
    runs = _commit(spark, root, latest_version(spark, root))["runs"]
    return f"{root}/{runs[-1]['path']}" if runs else None


def row_bound(spark: SparkSession, root: str) -> int:
    """No fewer than the rows of the newest version, from its commit alone."""
    return sum(run["rows"] for run in _commit(spark, root, latest_version(spark, root))["runs"])


def _with_order(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add(REMOVED, BooleanType()).add(_ORDER, LongType())


def _last_changes(spark: SparkSession, root: str, runs: list[dict], schema: StructType, key: list[str]) -> DataFrame:
    """The last change of each key."""
    changes = spark.read.schema(_with_order(schema)).parquet(*(f"{root}/{run['path']}" for run in runs))
    if len(runs) == 1:  # a folder holds a key once
        return changes
    rest = [c for c in schema.names if c not in key]
    last = changes.groupBy(*key).agg(F.max(F.struct(_ORDER, REMOVED, *rest)).alias("_row"))
    return last.select(*key, "_row.*").select(*_with_order(schema).names)


def _folded(spark: SparkSession, root: str, runs: list[dict], schema: StructType, key: list[str]) -> DataFrame:
    whole = [run for run in runs if not run["changes"]]
    changes = [run for run in runs if run["changes"]]
    parts = [spark.read.schema(schema).parquet(f"{root}/{run['path']}") for run in whole]
    if changes:
        last = _last_changes(spark, root, changes, schema, key)
        parts = [p.join(last.select(*key), key, "left_anti").select(*schema.names) for p in parts]
        parts.append(last.filter(~F.col(REMOVED)).select(*schema.names))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, root: str, schema: StructType, version: int) -> DataFrame:
    commit = _commit(spark, root, version)
    return _folded(spark, root, commit["runs"], schema, commit["key"])


def read_snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Newest version; an empty table before the first."""
    return read_version(spark, root, schema, latest_version(spark, root))


def _written(df: DataFrame, root: str, changes: bool) -> dict:
    path = new_folder(root)
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).count()  # from the footers
    return {"path": path.rsplit("/", 1)[1], "rows": rows, "changes": changes}


def write_snapshot(df: DataFrame, root: str, after: int | None = None, keep: int = 20) -> int:
    """Publish ``df`` as the version following ``after`` (default: the newest now) and return its number.

    Raises :class:`StaleVersion` if that number is taken.
    """
    spark = df.sparkSession
    if after is None:
        after = latest_version(spark, root)
    run = _written(df, root, False)
    try:
        return publish_version(spark, root, after, [run], keep=keep)
    except StaleVersion:
        path, fs = hadoop(spark, f"{root}/{run['path']}")
        fs.delete(path, True)
        raise


def update_snapshot(
    root: str, schema: StructType, change: Callable[[DataFrame], DataFrame], spark: SparkSession,
    attempts: int = 10, keep: int = 20,
) -> int:
    """Read the newest version, publish ``change`` of it; again from the start if another writer came first.

    Returns the number of the new version.
    """
    for _ in range(attempts):
        version = latest_version(spark, root)
        try:
            return write_snapshot(change(read_version(spark, root, schema, version)), root, version, keep)
        except StaleVersion:
            continue
    raise StaleVersion(f"{root}: {attempts} writers came first")


def _level(rows: int, fan: int) -> int:
    level = 0
    while rows >= fan:
        rows, level = rows // fan, level + 1
    return level


def _merged(spark: SparkSession, root: str, runs: list[dict], schema: StructType, key: list[str], fan: int) -> list[dict]:
    """``runs`` with the newest ones merged where ``fan`` of them are of like size."""
    tail = 0
    for run in reversed(runs):
        if not run["changes"] or _level(run["rows"], fan) > _level(runs[-1]["rows"], fan):
            break
        tail += 1
    if tail < fan:
        return runs
    before, newest = runs[:-tail], runs[-tail:]
    whole = before[0]["rows"] if before and not before[0]["changes"] else 0
    if sum(run["rows"] for run in runs if run["changes"]) >= whole:
        return [_written(_folded(spark, root, runs, schema, key), root, False)]
    return [*before, _written(_last_changes(spark, root, newest, schema, key), root, True)]


def merge_snapshot(
    root: str, schema: StructType, key: Sequence[str], change: Callable[[DataFrame], DataFrame], spark: SparkSession,
    attempts: int = 10, keep: int = 100, fan: int = 8,
) -> int:
    """As ``update_snapshot``, but ``change`` gives only the rows to insert, replace or, with a true ``_borrado``, remove.

    ``key`` tells rows apart; ``change`` gives each key once. What is written is
    in proportion to the changes, not to the table.
    """
    key = list(key)
    for _ in range(attempts):
        version = latest_version(spark, root)
        commit = _commit(spark, root, version)
        changed = change(_folded(spark, root, commit["runs"], schema, key))
        gone = F.coalesce(F.col(REMOVED), F.lit(False)) if REMOVED in changed.columns else F.lit(False)
        rows = changed.select(
            *(F.col(f.name).cast(f.dataType) for f in schema), gone.alias(REMOVED),
            F.lit(version + 1).cast("bigint").alias(_ORDER))
        new = _written(rows, root, True)
        try:
            return publish_version(
                spark, root, version, _merged(spark, root, [*commit["runs"], new], schema, key, fan), key, keep)
        except StaleVersion:
            path, fs = hadoop(spark, f"{root}/{new['path']}")
            fs.delete(path, True)
    raise StaleVersion(f"{root}: {attempts} writers came first")


def remove_orphans(spark: SparkSession, root: str, older_than_ms: int = 7 * 86_400_000) -> int:
    """Delete folders that no version refers to and that have lain for ``older_than_ms``: what dead writers left."""
    path, fs = hadoop(spark, root)
    if not fs.exists(path):
        return 0
    used = {run["path"] for v in _versions(spark, root) for run in _commit(spark, root, v)["runs"]}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    lost = [s for s in fs.listStatus(path) if s.getPath().getName().startswith("data-")
            and s.getPath().getName() not in used and now - s.getModificationTime() > older_than_ms]
    for status in lost:
        fs.delete(status.getPath(), True)
    return len(lost)
