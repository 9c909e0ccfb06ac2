"""File sources and sinks: backfill scan with format detection (A1), zstd parquet sink (A2),
ledger JSON as array or lines (A14), and shared scratch locations.

Listing uses the Hadoop FileSystem of the path (works for HDFS/S3/local), never ``os``."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, passing_shuffles

_SUFFIX = {".parquet": "parquet", ".csv": "csv", ".ndjson": "json", ".jsonl": "json", ".json": "json"}
# Directory formats tried in order (first glob with a match wins).
_DIR_ORDER = [("parquet", "*.parquet"), ("csv", "*.csv"), ("json", "*.ndjson"), ("json", "*.jsonl")]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's reliable checkpoint directory (shared storage on a
    cluster; set from ``spark.checkpoint.dir``)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` by its rows in a fresh shared folder: like a reliable checkpoint, but in columns and compressed,
    for frames with a row per edge or record (rows of a checkpoint are serialised one by one)."""
    path = shared_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passed(df: DataFrame) -> DataFrame:
    """:func:`stored`, and the shuffle files of its plan go: for steps over all edges, whose exchanges would lie
    on the disks beside those of the next steps.  Nothing that ``df`` has cached may lean on them."""
    with passing_shuffles(df.sparkSession):
        return stored(df.select("*"))


def infer_format(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[str, str]:
    """A1: (spark format, load path).  ``jsonl`` = ``ndjson``; by suffix for files; for a
    directory, the first pattern of parquet, csv, ndjson, jsonl that matches; else errors."""
    if fmt:
        f = fmt.lower()
        f = "json" if f in ("ndjson", "jsonl", "json") else f
        if f not in ("parquet", "csv", "json"):
            raise ValueError(f"unsupported format {fmt!r}")
        return f, path
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isFile():
        for suf, f in _SUFFIX.items():
            if path.lower().endswith(suf):
                return f, path
        raise ValueError(f"cannot infer the format of {path}")
    for f, pattern in _DIR_ORDER:
        hits = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + pattern))
        if hits is not None and len(hits) > 0:
            return f, path.rstrip("/") + "/" + pattern
    raise ValueError(f"no parquet, csv, ndjson or jsonl files under {path}")


def scan_backfill(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1: lazy scan of a backfill file or directory (csv with header; JSON lines)."""
    f, load = infer_format(spark, path, fmt)
    reader = spark.read
    if f == "csv":
        reader = reader.option("header", "true")
    return reader.format(f).load(load)


def write_parquet_zstd(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A2: zstd-compressed parquet directory (parents created by the writer)."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_ledger_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines, an array in each file, or an array framed over many files (see
    :func:`write_ledger_json`), told apart by the first character that is not blank; records that are
    not objects land in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if schema is not None:
        from pyspark.sql import types as T
        fields = list(schema.fields)
        if "_corrupt_record" not in schema.fieldNames():   # a copy: never mutate the caller's schema
            fields.append(T.StructField("_corrupt_record", T.StringType()))
        reader = reader.schema(T.StructType(fields))
    fs, p = _fs(spark, path)
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, _OPEN)):
        lines = spark.read.text(path).where(~F.col("value").isin("[", "]", ","))
        records = lines.select(F.regexp_replace("value", "^,", "").alias("value"))
        if schema is None:
            raise ValueError("an array over many files is read with a schema")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        return records.select(F.from_json("value", T.StructType(fields), options).alias("r")).select("r.*")
    return reader.option("multiLine", json_form(spark, path) == "array").json(path)


_OPEN, _CLOSE = "part-!open.json", "part-~close.json"


def write_ledger_json(df: DataFrame, path: str, form: str = "lines") -> None:
    """JSON ``lines`` (one object per line), or one ``array`` over the files of all tasks.

    For the array every task writes its rows with commas between them; what stands before, between and
    behind these files are small files of their own, named so that all files one after another in
    the order of their names are one JSON array."""
    if form == "lines":
        df.write.mode("overwrite").json(path)
        return
    if form != "array":
        raise ValueError(f"unknown form {form!r}")
    spark = df.sparkSession
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    record = F.to_json(F.struct(*df.columns))
    df.select(F.when(first, record).otherwise(F.concat(F.lit(","), record)).alias("value")).write.mode("overwrite").text(path)
    fs, p = _fs(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getLen() > 0 and f.getPath().getName().startswith("part-"))
    frames = {_OPEN: "[\n", _CLOSE: "]\n"} | {f"{n[:10]}-~.json": ",\n" for n in names[:-1]}
    for name, text in frames.items():
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, name))
        out.write(bytearray(text, "ascii"))
        out.close()


def json_form(spark: SparkSession, path: str) -> str | None:
    """``array`` or ``lines`` by the first character that is not blank; None for no content."""
    fs, p = _fs(spark, path)
    files = sorted(fs.listStatus(p), key=lambda f: f.getPath().getName())
    for f in files:
        if not f.isFile() or f.getPath().getName().startswith(("_", ".")):
            continue
        stream = fs.open(f.getPath())
        try:
            b = stream.read()
            while b >= 0 and chr(b).isspace():
                b = stream.read()
        finally:
            stream.close()
        if b >= 0:
            return "array" if chr(b) == "[" else "lines"
    return None
