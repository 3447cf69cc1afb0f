"""Column helpers shared by the corpus operators.

Conventions of every operator: a null text is an empty text; a null id is a value of its own that sorts
before all others; repeated rows are kept and get equal results; columns an operator does not name are
never read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, planned_bytes

# A key with more than this part of all rows is joined by broadcast: there are at most so many.
HOT_KEYS = 2048

# Spark broadcasts a table by its own estimate only below this many bytes: it sizes what an explode repeats, or a compressed file
# holds, far too low, and the driver holds several at once.
GUESSED_LIMIT = 256 * 1024

# What stands for a null id inside joins, so that it equals itself.
NULL_ID = -(2**63)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names that clash with none of ``taken``, whatever its case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(col(text_col), F.lit("")).alias("text"))


def identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that identify a row by its id and its text: repeated rows are one row to a join."""
    return [F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID)).alias("rid"),
            F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("rhash")]


def tune(spark: SparkSession) -> None:
    """Bounded Arrow batches, shuffle files that go with the job that wrote them, and no broadcast of more than
    ``GUESSED_LIMIT`` that no operator asks for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > GUESSED_LIMIT:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(GUESSED_LIMIT))


def share_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_LIMIT // 16) -> DataFrame:
    """``rows`` with the columns of their key's row in ``lookup`` (keys, n, ...), where n counts the rows of a key.

    A written ``lookup`` of at most ``limit`` bytes is broadcast (rows and their hash table take about eight times as much). Of a larger one only the keys that hold more than 1 / HOT_KEYS of the counted
    rows are, at most HOT_KEYS of them; the rows of all other keys meet in a shuffle."""
    if planned_bytes(lookup) <= limit:
        return rows.join(F.broadcast(lookup), keys, how)
    most = (lookup.agg(F.sum("n")).head()[0] or 0) / HOT_KEYS
    hot = F.broadcast(lookup.filter(F.col("n") > most))
    cold = lookup.filter(F.col("n") <= most)
    rest = rows.join(F.broadcast(lookup.filter(F.col("n") > most).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys, how))
