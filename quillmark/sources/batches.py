"""Batches that can be cut and run again: one row for each input, good or failed, written slice by slice."""

from __future__ import annotations

import signal
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DONE, _PREFIX = "_SUCCESS", "slice-"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _slices(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names of slices that were committed, and of those that were cut."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return [], []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(_PREFIX))
    whole = [n for n in names if fs.exists(_folder(spark, f"{path}/{n}/{_DONE}")[0])]
    return whole, [n for n in names if n not in whole]


def committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All rows of committed slices; what a cut run left behind isn't read."""
    names = _slices(spark, path)[0]
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def attempted(rows: DataFrame, checks: list[tuple[Column, str]], columns: dict[str, Column]) -> DataFrame:
    """Rows with ``columns`` and ``error``: the reason of the first check that applies, and then null columns; '' is good.

    Columns should be of functions that don't raise (try_*); a check on null doesn't apply.
    """
    error = F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in checks], F.lit("")) if checks else F.lit("")
    d = rows.withColumn("error", error)
    return d.withColumns({n: F.when(F.col("error") == "", c) for n, c in columns.items()})


@contextmanager
def _time_limit(seconds: float) -> Iterator[None]:
    """Raises TimeoutError in this worker's Python code after so many seconds; a call that never returns to Python isn't cut."""
    def over(*_):
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def applied(rows: DataFrame, key: str, value: str, f: Callable, returns: str, seconds: float = 30.0) -> DataFrame:
    """(key, result, error) of a Python function of one value: no row's failure or delay stops the others.

    ``error`` is '', EXTRACTION_TIMEOUT or EXTRACTION_ERROR with the exception's name; the result is then null.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out, why = [], []
            for x in pdf[value]:
                try:
                    with _time_limit(seconds):
                        out.append(f(x))
                    why.append("")
                except TimeoutError:
                    out.append(None)
                    why.append("EXTRACTION_TIMEOUT")
                except Exception as e:  # noqa: BLE001 - any failure of one row becomes its reason
                    out.append(None)
                    why.append(f"EXTRACTION_ERROR: {type(e).__name__}")
            yield pd.DataFrame({key: pdf[key], "result": pd.Series(out, dtype=object), "error": why})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, result {returns}, error string")


def resumed(inputs: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], path: str, slices: int = 16, stop_after: int | None = None) -> DataFrame:
    """Process the inputs that no committed slice holds, and return all committed rows.

    Inputs are dealt by a hash of their key; each slice is written into a folder of its own and counts once its commit
    mark stands, so a run that is cut loses its open slice alone, and a further run with the same inputs writes nothing.
    Rows that repeat a key are one input (the first by all columns), a null key is a key. ``process`` must give one row
    with the key for each input, failures included. ``stop_after`` ends after so many slices.
    """
    spark = inputs.sparkSession
    one = inputs.groupBy(key).agg(F.min(F.struct(*inputs.columns)).alias("_x")).select("_x.*")
    schema = process(one.where("false")).schema
    p, fs = _folder(spark, path)
    for name in _slices(spark, path)[1]:
        fs.delete(_folder(spark, f"{path}/{name}")[0], True)
    done = committed(spark, path, schema).select(F.col(key).alias("_done"))
    todo = one.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti").withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    # the slices that still hold inputs: at most ``slices`` numbers
    open_ = sorted(r[0] for r in todo.select("_slice").distinct().collect())
    for k in open_[:stop_after]:
        process(todo.where(F.col("_slice") == k).drop("_slice")).write.parquet(f"{path}/{_PREFIX}{k:05d}-{uuid.uuid4().hex}")
    return committed(spark, path, schema)


def counts(results: DataFrame) -> DataFrame:
    """One row: inputs, good, failed, and how often each reason came (in order of frequency, then name)."""
    by = results.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))
    reasons = F.array_sort(F.collect_list(F.when(F.col("error") != "", F.struct((-F.col("n")).alias("n"), "error"))))
    g = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inputs"), F.coalesce(F.sum(F.when(F.col("error") == "", F.col("n"))), F.lit(0)).alias("good"), reasons.alias("r"))
    return g.select("inputs", "good", (F.col("inputs") - F.col("good")).alias("failed"), F.transform("r", lambda x: F.concat_ws(" ", (-x["n"]).cast("string"), x["error"])).alias("reasons"))


def snapshot(df: DataFrame, folder: str, day: str, keep_days: int) -> None:
    """A dated copy ``folder/snapshot=day`` and no copy older than ``keep_days`` before it; a copy of the same day is replaced."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/snapshot={day}")
    p, fs = _folder(spark, folder)
    oldest = (pd.Timestamp(day) - pd.Timedelta(days=keep_days)).strftime("%Y-%m-%d")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("snapshot=") and name.removeprefix("snapshot=") < oldest:
            fs.delete(s.getPath(), True)
