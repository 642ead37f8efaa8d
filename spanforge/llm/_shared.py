"""The folder that driver and executors share, and places that tell rows apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files up to which their list is broadcast; a longer one is joined by shuffle.
BROADCAST_FILES = 200_000
#: Rows of one file that a place can number.
FILE_ROWS = 1 << 40


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session names none, one of our own: a temporary folder if driver and executors are one
    process (tests), else one in the warehouse, which all of them share.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        alone = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="spark-shared-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex}"
        context.setCheckpointDir(named or own)
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and cut off from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that rows do not have yet."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def _source(rows: DataFrame, field: str) -> Column | None:
    """A field of what the reader tells of each row of a table straight from files; None for other tables."""
    plan = rows._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    while plan.nodeName() in ("Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return None
    try:
        rows.select(found := rows.metadataColumn("_metadata")[field])
    except AnalysisException:
        return None
    return found


def with_place(rows: DataFrame, name: str = "place") -> DataFrame:
    """Adds a number that no two rows share and that is the same in every pass, however files are packed into tasks.

    It is made of the number of the row's file and the row's place in it. Parquet tables as read,
    filtered or not, need no copy; other tables are written to the shared folder first, as rows out of a shuffle may
    come in another order when they are made again.
    """
    path = _source(rows, "file_path")
    index = _source(rows, "row_index")
    if path is None or index is None:
        folder = new_folder(rows.sparkSession, "rows")
        rows.write.parquet(folder)
        rows = rows.sparkSession.read.parquet(folder)
        path, index = _source(rows, "file_path"), _source(rows, "row_index")
    file, at, number = (free_name(rows, x) for x in ("in_file", "at_row", "file_number"))
    # One row for each file, of which the driver holds the list anyway.
    files = rows.select(path.alias(file)).distinct().withColumn(number, F.row_number().over(Window.orderBy(file)) - F.lit(1))
    files = checkpointed(files)
    few = files.count() <= BROADCAST_FILES
    out = rows.select("*", path.alias(file), index.alias(at)).join(F.broadcast(files) if few else files, file)
    return out.select(*rows.columns, (F.col(number) * F.lit(FILE_ROWS) + F.col(at)).alias(name))
