"""Reading tables, cutting lineage in the shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a folder
    of its own; a cluster must name one, as no machine's own folder would do.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_own_shared_dir", None):
        sc._own_shared_dir = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, sc._own_shared_dir, ignore_errors=True)
        sc.setCheckpointDir(sc._own_shared_dir)
    return sc._own_shared_dir


#: Open scopes of staged paths, innermost last; the first holds what no scope has claimed.
_scopes: list[list[str]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark drops the shuffle files of finished jobs when the driver forgets them, which else may take half an hour."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, because all that rests on them is written.

    Shuffle files of finished jobs are forgotten too.
    """
    for df in tables:
        for scope in _scopes:
            if df._staged in scope:
                scope.remove(df._staged)
        _delete(df.sparkSession, df._staged)
    if tables:
        forget(tables[0].sparkSession)


class Staging:
    """Collects what is staged inside a ``with`` block; ``release`` deletes it once all that rests on it is written."""

    def __enter__(self) -> Staging:
        self.paths: list[str] = []
        _scopes.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self.paths)
        _scopes[-1].extend(self.paths)

    def release(self, spark: SparkSession) -> None:
        for path in self.paths:
            for scope in _scopes:
                if path in scope:
                    scope.remove(path)
            _delete(spark, path)
        self.paths = []


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage in a way that survives lost executors, and lets several
    consumers read one computation. The schema is kept, so no inference runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(v)`` where ``v`` stands for ``value``, computed once per row.

    Binding through a one-element array keeps Catalyst from writing the
    expression out again inside nested lambdas, which would make them quadratic.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased; null has none.

    The separators become spaces in the pass that lower-cases, so the split
    needs no regular expression.
    """
    gaps = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A) and c != 0x20)
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + gaps, LOWER + " " * len(gaps))
    return F.array_remove(F.split(plain, " "), "")


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")
