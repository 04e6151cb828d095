"""Table readers: format dispatch, CSV sniffing and path expansion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order in which encodings and delimiters are tried.
CSV_ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")
CSV_DELIMITERS = (",", ";", "\t", "|")
SUPPORTED = (".csv", ".json", ".parquet")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _decodes(lines: list[bytes], encoding: str) -> bool:
    try:
        for line in lines:
            line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _all_decode(raw: DataFrame, encoding: str) -> bool:
    def bad(batches):
        for b in batches:
            lines = [x for x in b.column(0).to_pylist() if x is not None and not _decodes([x], encoding)]
            yield pa.RecordBatch.from_arrays([pa.array(lines[:1], pa.binary())], names=["value"])
    return raw.select(F.col("value").cast("binary")).mapInArrow(bad, "value binary").isEmpty()


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """First (encoding, delimiter) under which the header has several columns.

    Every encoding is tried on every line; the delimiter comes from the header.
    """
    raw = spark.read.text(path)
    lines = [bytes(r[0]) for r in raw.select(F.col("value").cast("binary")).limit(1).collect()]
    if not lines:
        raise ValueError(f"cannot read CSV: {path}")
    valid_utf8 = raw.filter(~F.is_valid_utf8("value")).isEmpty()
    for encoding in CSV_ENCODINGS:
        if not (valid_utf8 if encoding == "utf-8" else _all_decode(raw, encoding)):
            continue
        header = lines[0].decode(encoding)
        for sep in CSV_DELIMITERS:
            if sep in header:
                return encoding, sep
    raise ValueError(f"cannot read CSV: {path}")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    encoding, sep = sniff_csv(spark, path)
    if encoding not in ("utf-8", "latin-1"):
        # Spark 4 accepts only the standard charsets unless this is set.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = (spark.read.option("header", True).option("sep", sep)
              .option("encoding", "ISO-8859-1" if encoding == "latin-1" else encoding))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read one CSV, JSON or Parquet path; errors name the missing or unsupported file."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such file: {path}")
    ext = _suffix(path)
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file format: {ext}")
    if ext == ".csv":
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ext == ".parquet":
        return reader.parquet(path)
    # One object per line splits across tasks; an array or a pretty-printed document does not.
    whole = F.startswith(F.ltrim("value"), F.lit("{")) & F.get_json_object("value", "$").isNotNull()
    lines = spark.read.text(path).filter(F.trim("value") != "")
    per_line = not lines.isEmpty() and lines.filter(~whole).isEmpty()
    return reader.option("multiLine", not per_line).json(path)


def resolve_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Expand globs and directories, keep supported suffixes, keep input order."""
    found: list[str] = []
    for raw in paths:
        fs, p = _hadoop_path(spark, raw)
        if "*" in raw or "?" in raw:
            status = fs.globStatus(p) or []
        elif not fs.exists(p):
            continue
        elif fs.getFileStatus(p).isDirectory() and _suffix(raw) not in SUPPORTED:
            status = fs.listStatus(p)
        else:
            status = [fs.getFileStatus(p)]
        found += sorted(str(s.getPath().toString()) for s in status
                        if _suffix(str(s.getPath().toString())) in SUPPORTED)
    if not found:
        raise FileNotFoundError(f"no loadable data files: {paths}")
    return found


def load_tables(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """One DataFrame per resolved path, keyed by stem; equal stems get ``_n``."""
    tables: dict[str, DataFrame] = {}
    for path in resolve_paths(spark, paths):
        stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        name, n = stem, 1
        while name in tables:
            name, n = f"{stem}_{n}", n + 1
        tables[name] = read_table(spark, path)
    return tables
