"""Raw flow files to labelled feature tables."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import cleaning as cl
from ..operators.sampling import stratified_fraction
from ..runtime import durable, local_rows, lookup_join
from .specs import DatasetSpec, dataset_spec

ROW_ID, ORIGIN = "row_id", "origin_file"


@dataclass
class Ingested:
    """Rows (row_id, origin_file, raw_label, y_true, extras, features) and the feature names."""

    rows: DataFrame
    features: list[str]


def list_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the CSV files directly under ``root`` on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted(f for f in found if f.endswith(".csv"))


def select_files(paths: list[str], spec: DatasetSpec) -> list[str]:
    """Files of the first pattern that matches any, minus excluded names, or the exact stems."""
    for pattern in spec.files:
        hit = []
        for p in paths:
            name = p.rsplit("/", 1)[-1]
            if not fnmatch(name, pattern):
                continue
            if any(word in name.lower() for word in spec.exclude):
                continue
            if spec.stems is not None and name.removesuffix(".csv") not in spec.stems:
                continue
            hit.append(p)
        if hit:
            return sorted(hit)
    raise FileNotFoundError(f"no data file for {spec.name}")


def column_list(spark: SparkSession, root: str, spec: DatasetSpec, paths: list[str]) -> tuple[str, ...]:
    """Names from the side file when it lists exactly as many columns, else the defaults."""
    names = {p.rsplit("/", 1)[-1]: p for p in paths}
    for candidate in spec.side_file:
        if candidate in names:
            side = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(names[candidate])
            if "Name" in side.columns:
                rows = [r["Name"] for r in side.select("Name").limit(len(spec.header) + 1).collect()]
                if len(rows) == len(spec.header):
                    return tuple(str(r) for r in rows)
    return spec.header


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The header line of a file; nothing else of it is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_headed(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text under the header of the first file, plus file name and row position.

    Files with the same header are one scan."""
    by_header: dict[str, list[str]] = {}
    for p in paths:
        by_header.setdefault(first_line(spark, p, encoding), []).append(p)
    frames = []
    for same in by_header.values():
        f = spark.read.option("header", True).option("encoding", encoding).option(
            "mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).csv(same)
        frames.append(_placed(f))
    return _located(cl.union_aligned(frames), paths)


def read_headerless(
    spark: SparkSession, paths: list[str], names: tuple[str, ...], encoding: str = "windows-1252"
) -> DataFrame:
    """Text columns under the given names; a one-byte encoding never fails on a byte.

    The CSV scan has no windows-1252: such files are read as ISO-8859-1, and the code points in which the two differ are
    translated. The five bytes without a character keep their ISO-8859-1 control characters.
    """
    western = encoding.lower() in ("windows-1252", "cp1252")
    schema = StructType([StructField(n, StringType()) for n in names])
    read = spark.read.schema(schema).option("header", False).option("encoding", "ISO-8859-1" if western else encoding).csv(paths)
    rows = _placed(read)
    if western:
        rows = rows.withColumns({n: F.translate(F.col(f"`{n}`"), *_WESTERN) for n in names})
    return _located(rows, paths)


def _western_marks() -> tuple[str, str]:
    """Control characters of ISO-8859-1 and the characters that windows-1252 has for the same bytes."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs)


_WESTERN = _western_marks()


# Names of the place of a row while it is being numbered.
_FILE, _BLOCK, _SEEN = "_file", "_block", "_seen"
# A row id is the number of the file times this, plus a position in the file below its length.
FILE_SPAN = 1 << 44


def _placed(df: DataFrame) -> DataFrame:
    # the name in the metadata is percent-encoded, in which a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select("*", name.alias(ORIGIN), F.col("_metadata.file_path").alias(_FILE),
                     F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_SEEN))


def _located(df: DataFrame, paths: list[str]) -> DataFrame:
    """Rows with a long id that orders them by file (in the order of ``paths``) and by position inside it.

    A split starts at its byte offset and holds fewer rows than bytes, so offset plus row number within the
    split is unique and ordered, however Spark packs splits into tasks. Written once, since the numbers within
    a split must not change between passes.
    """
    spark = df.sparkSession
    rows = durable(df, "located")
    numbered = local_rows(spark, [(p.rsplit("/", 1)[-1], i) for i, p in enumerate(paths)], "_name string, _number long")
    begins = rows.groupBy(_FILE, _BLOCK).agg(F.min(_SEEN).alias("_begin"), F.first(ORIGIN).alias("_name")).join(
        F.broadcast(numbered), "_name").drop("_name")
    at = F.col("_number") * F.lit(FILE_SPAN) + F.col(_BLOCK) + F.col(_SEEN) - F.col("_begin")
    return lookup_join(rows, durable(begins, "splits"), [_FILE, _BLOCK], [_SEEN]).withColumn(ROW_ID, at).drop(
        _FILE, _BLOCK, _SEEN, "_begin", "_number")


def label_column(df: DataFrame, spec: DatasetSpec) -> tuple[str, Column]:
    col = cl.first_present(df.columns, list(spec.label))
    if spec.label_mode == "set":
        return col, cl.label_by_set(F.col(f"`{col}`"), spec.benign)
    if spec.label_mode == "mixed":
        return col, cl.label_mixed(df, col)
    return col, cl.label_by_token(F.col(f"`{col}`"), spec.benign[0], spec.trim_label)


def ingest(
    raw: DataFrame, spec: DatasetSpec, chunk: str | None = None, seed: int = 42,
    row_id: str = ROW_ID, origin: str = ORIGIN,
) -> Ingested:
    """Clean, label, encode and sample one raw table as its spec says."""
    col, y = label_column(raw, spec)
    extra = [c for c in spec.extra if c in raw.columns]
    text = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan"))
    df = raw.withColumn("_raw_label", text).withColumn("y_true", y)
    df = df.withColumns({f"_x_{c}": F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")))
                         for c in extra})
    for c in spec.categories:
        if c in df.columns:
            coded = cl.encode_category(df, c, row_id, "_code")
            df = coded.withColumn(c, F.col("_code").cast("double")).drop("_code")
    meta = [row_id, origin, "_raw_label", "y_true", *[f"_x_{c}" for c in extra]]
    meta += [chunk] if chunk else []
    gone = {col, *spec.drop}
    features = [c for c in raw.columns if c not in gone and c not in meta]
    df = df.select(*meta, *[F.col(f"`{c}`") for c in features])
    if spec.clean == "flexible":
        numeric = cl.numeric_columns(df, features)
        clean = cl.clean_flexible(df.select(*meta, *[F.col(f"`{c}`") for c in numeric]), numeric, False)
    else:
        numeric = features
        clean = cl.clean_strict(df, numeric)
    if spec.sample:
        strata = [origin, *([chunk] if chunk else []), "y_true"]
        clean = stratified_fraction(durable(clean, "clean"), spec.sample, strata, row_id, seed)
    rows = clean.select(
        F.col(row_id).alias(ROW_ID), F.col(origin).alias(ORIGIN), F.col("_raw_label").alias("raw_label"),
        "y_true", *[F.col(f"_x_{c}").alias(c) for c in extra],
        F.array(*[F.col(f"`{c}`") for c in numeric]).alias("features"))
    return Ingested(rows, numeric)


def load_dataset(
    spark: SparkSession, root: str, name: str | DatasetSpec, data_type: str = "csv"
) -> Ingested:
    """Find the files of a dataset, read them and ``ingest`` them; an empty result is an error."""
    spec = name if isinstance(name, DatasetSpec) else dataset_spec(name, data_type)
    paths = list_files(spark, root)
    if not paths:
        raise FileNotFoundError(f"no CSV files under {root}")
    files = select_files(paths, spec)
    if spec.header:
        raw = read_headerless(spark, files, column_list(spark, root, spec, paths), spec.encoding)
    else:
        raw = read_headed(spark, files, spec.encoding)
    out = ingest(raw, spec)
    if out.rows.isEmpty():
        raise RuntimeError(f"no valid rows for {spec.name}")
    return out
