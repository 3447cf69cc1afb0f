"""Session, scratch tables and joins shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

# A lookup side is broadcast only below this many bytes (measured, not guessed).
BROADCAST_LIMIT = 32 * 1024 * 1024
# How many ways a lookup side is replicated when it is too big to broadcast.
LOOKUP_SALTS = 16
# Tasks of the driver whose jobs run at the same time.
AT_ONCE = 3

_local_scratch: dict[str, str] = {}


def local_session(app: str = "alarmloom", cpus: str = "8", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB (or one row), however wide the rows of a kernel are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        known = sc._jsc.sc().getCheckpointDir()
        shared = known.get() if known.isDefined() else None
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch.setdefault(
        sc.applicationId, tempfile.mkdtemp(prefix="alarmloom-", dir="/tmp")
    )


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    return f"{scratch_root(spark)}/alarmloom/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut the lineage with a table in the shared folder; survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as an inline table (plans that differ only in it share their code)."""
    fields = [f.split() for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)

    def cell(v, kind):
        if v is None:
            return f"CAST(NULL AS {kind})"
        return f"CAST('{v!r}' AS {kind})" if kind != "string" else "'" + v.replace("'", "''") + "'"

    values = ", ".join(
        "(" + ", ".join(cell(v, kind) for v, (_, kind) in zip(row, fields)) + ")" for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; exact file sizes when df is a scan of a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    rows_in_lookup: int | None = None,
    hot: bool = True,
) -> DataFrame:
    """Join many rows to a table with one row per key, whatever the share of the hottest key.

    A small lookup side is broadcast: the driver holds several at once, each with its hash table, so the limit counts rows in
    memory, where those of a file take about four times its bytes. A larger one is replicated over a few salts, and the rows of
    one key are dealt to those salts by a hash of ``spread``, so that no task gets all of them.
    Keys that are known to have few rows each (``hot=False``) need no salts; Spark splits what is skewed all the same.
    ``rows_in_lookup`` is a counted upper bound; without it Catalyst's size estimate decides.
    """
    if rows_in_lookup is None:
        held = 4 * planned_bytes(lookup)
    else:
        held = rows_in_lookup * (16 + 16 * len(lookup.columns))
    if held <= BROADCAST_LIMIT // 8:
        return rows.join(F.broadcast(lookup), keys, how)
    if not hot:
        return rows.join(lookup.hint("merge"), keys, how)
    taken = {c.lower() for c in (*rows.columns, *lookup.columns)}
    salt = "_salt"
    while salt in taken:
        salt = "_" + salt
    salted = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1)))).hint("merge")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(LOOKUP_SALTS)).cast("int"))
    return dealt.join(salted, [*keys, salt], how).drop(salt)


def side_by_side(spark: SparkSession, tasks: list[Callable]) -> Iterator:
    """What independent driver tasks return, in their order; none is begun after one has failed.

    An experiment is hundreds of short jobs one after the other, which leave most cores idle; a few at a time share them.
    """
    with ThreadPoolExecutor(AT_ONCE) as pool:
        held = [pool.submit(t) for t in map(inheritable_thread_target(spark), tasks)]
        try:
            for f in held:
                yield f.result()
        finally:
            for f in held:
                f.cancel()


def add_up(terms: list[Column]) -> Column:
    """Left-to-right sum of unrolled expressions."""
    return reduce(lambda a, b: a + b, terms)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
