"""Reading, probing and writing files. Everything per file is computed for whole folders at once."""

from __future__ import annotations

import _hashlib
import ctypes
import re
from functools import reduce
from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.types import ref

# Delimiters looked for, in this order of preference, and what is used without one.
DELIMITERS = [",", "\t", ";", "|"]
FALLBACK = ","
# Bytes of a file that one task hashes, bytes read at a time, and bytes of OpenSSL's SHA256_CTX (112, no pointers).
RANGE, BLOCK, STATE = 128 << 20, 4 << 20, 128


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole lines with their file; the text source splits large files and never decodes."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def _every_file(spark: SparkSession, path: str) -> DataFrame:
    """All files from the listing that Spark made, empty ones too (a scan skips those)."""
    names = spark.read.text(path).inputFiles()
    # spelt as in the metadata of rows, with one slash where there is no host
    return spark.createDataFrame([(re.sub("^([a-z]+):///", r"\1:/", n),) for n in names], "file string")


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, delimiter, encoding, quoted_ends)`` for every file below a path, in one pass over their lines.

    A delimiter is judged by the share of lines that hold it equally often (its most common
    count above zero). A file is ``utf-8`` where every line is valid UTF-8, else ``iso-8859-1``.
    Counts are combined per file before the shuffle; large files are split among tasks. An empty
    file has the fallback delimiter and is ``utf-8``. ``quoted_ends``: some line has an odd number of quotes, so that a
    quoted field goes on in the next.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    lines = lines.withColumn("sound", F.is_valid_utf8("value")).withColumn("odd", quotes % 2 == 1)
    counted = lines.select(
        "file",
        "sound",
        "odd",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("place"),
                        (F.length("value") - F.length(F.replace(F.col("value"), F.lit(d)))).alias("times"),
                    )
                    for i, d in enumerate(DELIMITERS)
                ]
            )
        ),
    )
    votes = counted.groupBy("file", "place", "times").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("sound").alias("sound"), F.bool_or("odd").alias("odd")
    )
    best = votes.groupBy("file").agg(
        F.max(F.when(F.col("times") > 0, F.struct("n", -F.col("place")))).alias("best"),
        F.bool_and("sound").alias("sound"),
        F.bool_or("odd").alias("odd"),
    )
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return _every_file(spark, path).join(best, "file", "left").select(
        "file",
        F.coalesce(F.get(names, (-F.col("best.col2")).cast("int")), F.lit(FALLBACK)).alias("delimiter"),
        F.when(F.coalesce("sound", F.lit(True)), "utf-8").otherwise("iso-8859-1").alias("encoding"),
        F.coalesce("odd", F.lit(False)).alias("quoted_ends"),
    )


def detect_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """``(file, delimiter)`` for every file below a path."""
    return probe_files(spark, path).select("file", "delimiter")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(file, encoding)`` for every file below a path."""
    return probe_files(spark, path).select("file", "encoding")


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    corrupt_column: str | None = None,
) -> DataFrame:
    """A delimited text table with a header; fields may be quoted, a quote inside is doubled.

    Delimiter, encoding and whether line ends occur inside quotes (``multi_line``) are detected per file where not given: files
    that share them are read together, and the parts are united by column name (files with other columns are an error). A file
    with line ends inside quotes is read by one task, others are split. Whole numbers stay whole, of whatever widths. Without ``schema`` types are inferred, which reads the
    data once more. With ``corrupt_column`` lines that do not fit are kept there as text.
    """
    groups = [(delimiter or FALLBACK, encoding or "utf-8", bool(multi_line), [path])]
    if delimiter is None or encoding is None or multi_line is None:
        found = probe_files(spark, path).select(
            "file",
            F.lit(delimiter).alias("delimiter") if delimiter else "delimiter",
            F.lit(encoding).alias("encoding") if encoding else "encoding",
            F.lit(multi_line).alias("multi") if multi_line is not None else F.col("quoted_ends").alias("multi"),
        )
        kinds = found.groupBy("delimiter", "encoding", "multi").agg(F.collect_set("file").alias("files"))
        groups = [tuple(r) for r in kinds.collect()]  # names of files
        if len(groups) == 1:
            groups = [(*groups[0][:3], [path])]
    parts = []
    for sep, charset, multi, files in sorted(groups):
        reader = (
            spark.read.option("header", True)
            .option("sep", sep)
            .option("encoding", charset)
            .option("escape", '"')
            .option("multiLine", multi)
            .option("mode", "PERMISSIVE")
        )
        wanted = schema
        if wanted is None:
            wanted = reader.option("inferSchema", True).csv(files).schema
        if corrupt_column is not None:
            wanted = T.StructType.fromDDL(wanted) if isinstance(wanted, str) else T.StructType(list(wanted.fields))
            wanted = wanted.add(corrupt_column, T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        parts.append(reader.schema(wanted).csv(files))
    if len({frozenset(df.columns) for df in parts}) > 1:
        raise ValueError(f"files below {path} have different columns: {[df.columns for df in parts]}")
    return reduce(DataFrame.unionByName, _same_types(parts))


def _common_type(found: set[T.DataType]) -> T.DataType:
    """The type that holds the values of all: whole numbers stay whole, other numbers become doubles, all else text."""
    if len(found) == 1:
        return next(iter(found))
    if all(isinstance(t, T.IntegralType) for t in found):
        return T.LongType()
    whole = all(isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0) for t in found)
    if whole:  # the reader infers decimals without a fraction for numbers beyond a long
        return T.DecimalType(38, 0)
    return T.DoubleType() if all(isinstance(t, T.NumericType) for t in found) else T.StringType()


def _same_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns whose types were inferred differently get their common type."""
    kinds: dict[str, set] = {}
    for df in parts:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    to = {c: _common_type(found) for c, found in kinds.items() if len(found) > 1}
    return [df.select(*[ref(c).cast(to[c]).alias(c) if c in to else ref(c) for c in df.columns]) for df in parts]


def write_table(df: DataFrame, path: str) -> str:
    """Store a table with its types. An existing path is an error, never overwritten."""
    df.write.mode("errorifexists").parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by suffix: ``.csv``, ``.tsv`` and ``.txt`` as delimited text, all else as Parquet."""
    if path.lower().endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path)
    return spark.read.parquet(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes)`` from the listing; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes")
    )


def dataset_profile(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row: ``n_rows, n_cols, file_size_bytes, columns array<struct<name, dtype>>``."""
    fields = F.array(
        *[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"))
            for f in df.schema.fields
        ]
    )
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    size = F.lit(None).cast("bigint")
    if path is not None:
        size = F.lit(file_sizes(df.sparkSession, path).agg(F.sum("bytes")).first()[0])
    return rows.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        size.alias("file_size_bytes"),
        fields.alias("columns"),
    )


def digest(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def _by_ranges(spark: SparkSession, files: list[tuple[str, int]], salt: str) -> list[tuple[str, int, str]]:
    """``(file, bytes, fingerprint)`` of long files, ``RANGE`` bytes a task.

    SHA-256 is sequential, but what it has come to is a few numbers: a task goes on from those of the range before and
    hands on its own, by way of the driver. Files go side by side, a job for each range of the longest. Python's
    hashlib cannot hand a state on, so the functions of its OpenSSL are called themselves; one built without them is an error.
    """

    def hashed(row: tuple[str, int, int, bytes | None]) -> tuple[str, bytes]:
        file, start, end, state = row
        sha = ctypes.CDLL(_hashlib.__file__)
        context = ctypes.create_string_buffer(state or bytes(STATE), STATE)
        if state is None:
            sha.SHA256_Init(context)
        scheme, _, rest = file.partition(":")
        store, place = FileSystem.from_uri(f"{scheme}:{quote(rest)}")
        with store.open_input_file(place) as f:
            f.seek(start)
            while start < end:
                part = f.read(min(BLOCK, end - start))
                if not part:
                    raise OSError(f"{file} has become shorter")
                sha.SHA256_Update(context, part, ctypes.c_size_t(len(part)))
                start += len(part)
        return file, context.raw

    def closed(state: bytes) -> str:
        sha, context, out = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state, STATE), ctypes.create_string_buffer(32)
        sha.SHA256_Update(context, salt.encode(), ctypes.c_size_t(len(salt.encode())))
        sha.SHA256_Final(out, context)
        return out.raw.hex()[:16]

    states: dict[str, bytes] = {}
    for start in range(0, max(n for _, n in files), RANGE):
        rows = [(f, start, min(n, start + RANGE), states.get(f)) for f, n in files if n > start]
        states.update(spark.sparkContext.parallelize(rows, len(rows)).map(hashed).collect())  # a state per long file
    return [(f, n, closed(states[f])) for f, n in files]


def fingerprints(spark: SparkSession, path: str, salt: str = "") -> DataFrame:
    """``(file, bytes, fingerprint)``: the first 16 hex digits of SHA-256 over content and salt.

    A file of up to ``RANGE`` bytes is one row of one task; longer ones are read at once, range after range, a task each.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    salted = F.concat(F.col("content"), F.lit(salt).cast("binary")) if salt else F.col("content")
    short = content.where(F.col("length") <= RANGE).select(
        F.col("path").alias("file"),
        F.col("length").alias("bytes"),
        digest(salted).alias("fingerprint"),
    )
    long = [tuple(r) for r in content.where(F.col("length") > RANGE).select("path", "length").collect()]  # names of files
    if not long:
        return short
    return short.unionByName(spark.createDataFrame(_by_ranges(spark, long, salt), "file string, bytes bigint, fingerprint string"))


def changed_files(current: DataFrame, seen: DataFrame) -> DataFrame:
    """The files whose fingerprint has not been seen."""
    return current.join(seen.select("file", "fingerprint"), ["file", "fingerprint"], "left_anti")
