"""Statements of the record store as DataFrame operations: guarded inserts, access view, relational division."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``target`` doesn't have yet by null-safe keys, each key once."""
    condition = [rows[k].eqNullSafe(target[k]) for k in keys]
    return rows.dropDuplicates(keys).join(target.select(*keys), condition, "left_anti")


def observe(records: DataFrame, runs: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, record_id, snapshot) for records of a run's own project that were not observed in it before."""
    pairs = runs.join(records, "project_id").select("run_id", "record_id", "snapshot")
    return pairs.join(observed.select("run_id", "record_id"), ["run_id", "record_id"], "left_anti")


def module_access(workspaces: DataFrame, modules: DataFrame, package_modules: DataFrame, choices: DataFrame) -> DataFrame:
    """Access of each workspace to each module: its own choice, else its package's; never to a disabled module.

    ``workspaces``: workspace, package; ``modules``: module, enabled; ``package_modules``: package, module;
    ``choices``: workspace, module, choice (null follows the package).
    """
    granted = package_modules.select("package", "module", F.lit(True).alias("granted"))
    return (
        workspaces.crossJoin(F.broadcast(modules))  # dimension tables: a few modules
        .join(granted, ["package", "module"], "left")
        .join(choices, ["workspace", "module"], "left")
        .select(
            "workspace",
            "module",
            F.coalesce("granted", F.lit(False)).alias("by_package"),
            "choice",
            (F.col("enabled") & F.coalesce("choice", "granted", F.lit(False))).alias("allowed"),
        )
    )


def holds_exactly(holdings: DataFrame, holder: str, item: str, wanted: DataFrame) -> DataFrame:
    """Holders whose set of items is the wanted one, neither more nor less."""
    total = wanted.select(item).distinct()
    want = total.agg(F.count(F.lit(1)).alias("want"))
    mine = holdings.select(holder, item).distinct()
    counted = mine.join(total.withColumn("hit", F.lit(1)), item, "left").groupBy(holder).agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")
    )
    return counted.crossJoin(F.broadcast(want)).where("n = want and hits = want").select(holder)  # one row


def holds_all(holdings: DataFrame, holder: str, item: str, wanted: DataFrame) -> DataFrame:
    """Holders that have every wanted item."""
    total = wanted.select(item).distinct()
    want = total.agg(F.count(F.lit(1)).alias("want"))
    hits = holdings.select(holder, item).distinct().join(total, item).groupBy(holder).agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(F.broadcast(want)).where("hits = want").select(holder)  # one row


def active(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not soft-deleted."""
    return rows.where(F.col(deleted).isNull())


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after ``UPDATE ... WHERE``, and the rows it changed, as ``RETURNING`` gives them."""
    hit = F.coalesce(condition, F.lit(False))
    after = rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    return after, rows.where(hit).withColumns(values)


def delete_where(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows without those whose key stands in ``keys``; null keys delete nothing."""
    return rows.join(keys.select(*by).distinct(), by, "left_anti").select(*rows.columns)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], stamp: Column | None = None, stamped: str = "updated_at") -> DataFrame:
    """``target`` with ``rows`` (one per key) put in: those of known keys replace, the others are added.

    ``stamp`` is set on replaced rows only; new rows keep what they bring.
    """
    condition = [rows[k].eqNullSafe(target[k]) for k in keys]
    known = target.select(*keys).distinct().withColumn("known", F.lit(True))
    put = rows
    if stamp is not None:
        met = rows.join(known, [rows[k].eqNullSafe(known[k]) for k in keys], "left")
        put = met.select(*(F.when(F.col("known"), stamp).otherwise(rows[c]).alias(c) if c == stamped else rows[c] for c in rows.columns))
    return target.join(rows, condition, "left_anti").unionByName(put)


def switch_package(choices: DataFrame, access: DataFrame, switches: DataFrame) -> DataFrame:
    """Individual choices (workspace, module, choice) after workspaces change their package.

    ``switches``: workspace, custom. A regular package removes the workspace's choices; the custom one keeps them and
    makes what the old package gave (``access``: workspace, module, by_package) a choice where there was none.
    """
    stay = choices.join(switches.where("not custom"), "workspace", "left_anti")
    copied = (
        access.join(switches.where("custom").select("workspace"), "workspace", "left_semi")
        .select("workspace", "module", F.col("by_package").alias("choice"))
        .join(choices.where("choice is not null"), ["workspace", "module"], "left_anti")
    )
    return stay.where("choice is not null").unionByName(copied)


def deviations(access: DataFrame) -> DataFrame:
    """Per workspace: whether any choice differs from what its package gives, and those modules in order."""
    differs = F.col("choice").isNotNull() & (F.col("choice") != F.col("by_package"))
    return access.groupBy("workspace").agg(
        F.bool_or(differs).alias("deviates"), F.array_sort(F.array_compact(F.collect_list(F.when(differs, F.col("module"))))).alias("modules")
    )


def access_changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of both tables whose value is not the same, null and null being the same: none after a migration that keeps access."""
    other = after.select(*keys, F.col(value).alias("after"))
    return before.select(*keys, F.col(value).alias("before")).join(other, keys).where(~F.col("before").eqNullSafe(F.col("after")))


def optional(rows: DataFrame, column: str, wanted: object | None) -> DataFrame:
    """All rows where nothing is wanted, else those with the value."""
    return rows if wanted is None else rows.where(F.col(column) == F.lit(wanted))


def visible_to(rows: DataFrame, memberships: DataFrame, user: object, by: str) -> DataFrame:
    """The rows of groups that the user is a member of."""
    return rows.join(memberships.where(F.col("user") == F.lit(user)).select(by), by, "left_semi")


def unexpired(sessions: DataFrame, expires: str, now: Column) -> DataFrame:
    return sessions.where(F.col(expires) > now)


def sql_order(column: str, descending: bool = False) -> Column:
    """Order with nulls as large values: last when rising, first when falling."""
    c = F.col(column)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def pending_migrations(available: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions not yet applied, with the place in which they are to run."""
    left = available.join(applied.select("version"), "version", "left_anti")
    return left.withColumn("place", F.row_number().over(Window.orderBy("version")))  # a list of files, not data


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    """(run, attempt, version) of the attempt that counts for each committed run; None before the first commit.

    A manifest is a file named after its run and version that holds the attempt's name. The highest version counts.
    """
    path, files = _file_system(spark, f"{folder}/committed")
    if not files.exists(path):
        return None
    name = F.regexp_extract("path", "([^/]+)$", 1)
    each = spark.read.format("binaryFile").load(f"{folder}/committed").select(
        F.try_url_decode(F.regexp_extract(name, r"^(.*)\.(\d+)$", 1)).alias("run"), F.regexp_extract(name, r"^(.*)\.(\d+)$", 2).cast("long").alias("version"), F.col("content").cast("string").alias("attempt")
    )
    return each.groupBy("run").agg(F.max_by("attempt", "version").alias("attempt"), F.max("version").alias("version"))


def committed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run): the names of all committed runs."""
    found = _manifests(spark, folder)
    return found.select("run") if found is not None else spark.createDataFrame([], "run string")


def run_version(spark: SparkSession, folder: str, run: str) -> int:
    """The version of a run that readers see; 0 for none."""
    found = _manifests(spark, folder)
    row = found.where(F.col("run") == run).first() if found is not None else None
    return row["version"] if row else 0


def write_run(tables: dict[str, DataFrame], folder: str, run: str, after: int | None = None) -> str:
    """Write all tables of a run to folders of an attempt of its own, then commit them by one manifest; the attempt's name.

    Readers see the attempt that the newest manifest names, so a run is seen whole or not at all, and one that is written
    again stays readable until its new manifest stands. ``after`` is the version that this write replaces, by default
    the one that stands now. Of two writers that replace the same version the first to commit wins; the other
    raises ``RunConflict``, and its files are seen by no one.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (run_version(spark, folder, run) if after is None else after) + 1
    attempt = f"a-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.withColumns({"run": F.lit(run), "attempt": F.lit(attempt)}).write.parquet(f"{folder}/{name}/{attempt}")
    marker, files = _file_system(spark, f"{folder}/committed/{quote(run, safe='')}.{version}")
    try:
        out = files.create(marker, False)  # fails if another writer has this version
    except Py4JJavaError as e:
        if not files.exists(marker):
            raise
        raise RunConflict(f"run {run} already has version {version}") from e
    out.write(bytearray(attempt.encode()))
    out.close()
    return attempt


class RunConflict(Exception):
    """Another writer has committed the version of a run that this one meant to write."""


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of all committed runs of a table, with their ``run``."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/{name}")
    done = _manifests(spark, folder)
    if done is None:
        return rows.drop("attempt").limit(0)
    return rows.join(done.select("run", "attempt"), ["run", "attempt"], "left_semi").drop("attempt")
