"""Erasure of people from stored Parquet tables, file by file.

The files that hold a person are found by the id column and the name of the file alone; only these are read whole and
rewritten without the person, in their own partition folders, and every other file keeps its time.  The new files are written aside first;
a journal then names what is to be moved in and what deleted, so that a run that was cut off is
finished by the next one.  Every table and request leaves an audit row.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldnote.session import cut_lineage, local_table, small
from fieldnote.sources.files import Folder, exact
from fieldnote.sources.keyed import KeyedTable

AUDIT = "request string, name string, files bigint, files_rewritten bigint, rows_erased bigint"
_OWN = "_erasure"


def audit_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ["request", "name"], StructType.fromDDL(AUDIT), buckets=1)


def finish(spark: SparkSession, path: str) -> int:
    """Carries out what journals of cut-off runs still name; how many there were."""
    table = Folder(spark, path)
    journals = [n for n in table.names(_OWN) if n.endswith(".json")]
    for name in journals:
        said = json.loads(table.read(f"{_OWN}/{name}"))
        for old, new in said["moves"]:
            if table.exists(old):
                table.move(old, new)
        for old in said["deletes"]:
            table.delete(old)
        table.delete(f"{_OWN}/{name.removesuffix('.json')}")
        table.delete(f"{_OWN}/{name}")
    return len(journals)


def erase(spark: SparkSession, tables: dict[str, tuple[str, str]], ids: DataFrame, key: str, request: str, audit: str) -> DataFrame:
    """Erases the people in ``ids`` from every table (name: path and id column); the audit rows of the request."""
    gone = small(cut_lineage(ids.select(F.col(key).alias("_id")).filter("_id IS NOT NULL").distinct()))
    for name, (path, column) in tables.items():
        finish(spark, path)
        row = _erase(spark, path, column, gone, request)
        audit_table(spark, audit).upsert(local_table(spark, [(request, name, *row)], AUDIT), unique=True)
    return audit_table(spark, audit).read().filter(F.col("request") == request)


def _erase(spark: SparkSession, path: str, column: str, gone: DataFrame, request: str) -> tuple[int, int, int]:
    whole, table = spark.read.parquet(path), Folder(spark, path)
    files = len(whole.inputFiles())
    where = F.col("_metadata.file_path")
    held = whole.select(F.col(column).alias("_id"), where.alias("file")).join(gone, "_id", "left_semi")
    found = {r["file"]: r["n"] for r in held.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # names, as in the file index
    if not found:
        return files, 0, 0
    names = {f: table.inside(f) for f in found}
    folders = sorted({n.rpartition("/")[0] for n in names.values()})
    at = local_table(spark, [(f, folders.index(n.rpartition("/")[0])) for f, n in names.items()], "_file string, _folder int")
    touched = [exact(f"{table.root}/{n}") for n in names.values()]
    columns = spark.read.parquet(touched[0]).columns  # without those that the folders hold
    rows = spark.read.schema(whole.select(*columns).schema).parquet(*touched).withColumn("_file", where)
    kept = rows.join(gone, F.col(column) == F.col("_id"), "left_anti").join(F.broadcast(at), "_file").select(*columns, "_folder")
    aside = f"{_OWN}/{request}"
    table.delete(aside)
    kept.write.partitionBy("_folder").parquet(f"{table.root}/{aside}")
    moves = []
    for i, folder in enumerate(folders):
        for n, part in enumerate(table.names(f"{aside}/_folder={i}")):
            moves.append((f"{aside}/_folder={i}/{part}", f"{folder}/part-{request}-{n:05d}.parquet".lstrip("/")))
    table.write(f"{_OWN}/{request}.json", json.dumps({"moves": moves, "deletes": list(names.values())}))
    finish(spark, path)
    return files, len(found), sum(found.values())
