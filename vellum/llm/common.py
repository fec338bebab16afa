"""Shared pieces of the corpus operators: scratch tables, word splitting, group sizing.

Words are maximal runs of anything but U+0020 and U+0009-U+000D, so ``bytes.split()`` gives them
in Python (on UTF-8) and ``WORD`` in Spark's regex functions.
"""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
BATCH = 256  # rows with a whole text or its set in one Arrow batch
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_value(module_name: str) -> None:
    """Ships a module's functions with the tasks, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    temporary one; a cluster must name one, as its executors share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def persist(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends there, so
    a lost executor costs a re-read, never a re-computation. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vellum/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def persist_batched(df: DataFrame, label: str) -> DataFrame:
    """``persist`` with Arrow batches of ``BATCH`` rows, so a worker holds few whole texts or sets at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return persist(df, label)
    finally:
        conf.set(key, before)


def free(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``persist`` wrote. Nothing may read them any more."""
    for df in tables:
        _forget(df.sparkSession, df.scratch_path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_groups(docs: DataFrame, column: str = "text", target: int = 6 << 20) -> int:
    """How many groups of about ``target`` bytes of text the documents make (a column-pruned scan)."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(16, -(-total // target))


def bounded(df: DataFrame, most: int) -> bool:
    """True if ``df`` has at most ``most`` rows: the size check that every broadcast here stands behind."""
    return df.limit(most + 1).count() <= most


def let(value: Column, body) -> Column:
    """``body`` of a value computed once. A column that a lambda refers to may be inlined there by the
    optimizer and computed again for every element; a lambda's own variable never is."""
    return F.get(F.transform(F.array(value), body), 0)
