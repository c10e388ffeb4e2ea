"""Sources and sinks: tables written to fresh folders, probed and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.lineage import scratch_path
from dqspark.operators.clean import clean
from dqspark.sources.files import (
    changed_files,
    dataset_profile,
    detect_delimiters,
    detect_encodings,
    digest,
    fingerprints,
    read_delimited,
    read_table,
    write_table,
)



def _folder():
    return F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("folder")


@query(
    "csv_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
)
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "orders")
    dirt.table(spark, sf_dir, "orders").write.option("header", True).option("sep", "|").csv(path)
    df = read_delimited(spark, path)
    return df.select(
        F.col("o_orderkey").cast("bigint"),
        F.col("o_custkey").cast("bigint"),
        "o_orderstatus",
        F.round("o_totalprice", 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderpriority",
    )


@query(
    "csv_quotes",
    "SELECT doc_id, n_chars, sha256(text) AS text_sha256, lang FROM documents",
)
def csv_quotes(spark, sf_dir):
    """Texts with quotes, delimiters and line ends, written and read back."""
    path = scratch_path(spark, "quoted")
    docs = dirt.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", "lang")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    schema = "doc_id bigint, n_chars bigint, text string, lang string"
    df = read_delimited(spark, path, delimiter=",", encoding="utf-8", schema=schema)
    return df.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"), "lang")


@query(
    "csv_mixed_files",
    """SELECT p_partkey, p_name || ' café' AS p_name, p_size FROM part
UNION ALL SELECT 9007199254740993 + s_suppkey, 'a "quoted"' || chr(10) || 'naïve ' || s_name, s_nationkey FROM supplier""",
)
def csv_mixed_files(spark, sf_dir):
    """One folder, two encodings, two delimiters, ids of two widths, and line ends inside quotes."""
    path = scratch_path(spark, "mixed")
    part = dirt.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" café")).alias("p_name"), "p_size")
    other = dirt.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + F.lit(9007199254740993)).alias("p_partkey"),
        F.concat(F.lit('a "quoted"\nnaïve '), "s_name").alias("p_name"),
        F.col("s_nationkey").alias("p_size"),
    )
    part.write.option("header", True).mode("append").csv(path)
    written = other.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"')
    written.mode("append").csv(path)
    df = read_delimited(spark, path)
    return df.select("p_partkey", "p_name", F.col("p_size").cast("int"))


@query(
    "csv_dialect",
    "SELECT * FROM (VALUES ('comma', ','), ('tab', chr(9)), ('semicolon', ';'), ('pipe', '|')) v(folder, delimiter)",
)
def csv_dialect(spark, sf_dir):
    path = scratch_path(spark, "dialects")
    for folder, sep, name in (
        ("comma", ",", "orders"),
        ("tab", "\t", "customer"),
        ("semicolon", ";", "part"),
        ("pipe", "|", "lineitem"),
    ):
        dirt.table(spark, sf_dir, name).write.option("header", True).option("sep", sep).csv(f"{path}/{folder}")
    return detect_delimiters(spark, f"{path}/*").select(_folder(), "delimiter").distinct()


@query(
    "encoding_probe",
    "SELECT * FROM (VALUES ('utf8', 'utf-8'), ('latin', 'iso-8859-1')) v(folder, encoding)",
)
def encoding_probe(spark, sf_dir):
    path = scratch_path(spark, "encodings")
    docs = dirt.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs.write.option("header", True).csv(f"{path}/utf8")
    docs.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/latin")
    found = detect_encodings(spark, f"{path}/*").select(_folder(), "encoding")
    return found.groupBy("folder").agg(F.min("encoding").alias("encoding"))


@query(
    "parquet_roundtrip",
    f"""WITH {dirt.ORDERS}
SELECT o_orderkey, strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS order_date,
  'timestamp_ntz' AS dtype FROM o""",
)
def parquet_roundtrip(spark, sf_dir):
    parsed = clean(dirt.orders(spark, sf_dir), "order_date", "parse_dates", format="%Y-%m-%d")
    df = read_table(spark, write_table(parsed, scratch_path(spark, "parsed")))
    return df.select(
        "o_orderkey",
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        F.lit(df.schema["order_date"].dataType.simpleString()).alias("dtype"),
    )


@query(
    "dataset_profile",
    """SELECT n_rows, 6 AS n_cols, true AS has_bytes, name, dtype FROM (SELECT count(*) AS n_rows FROM orders), (VALUES
  ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'),
  ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) v(name, dtype)""",
)
def profile_of_dataset(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    p = dataset_profile(spark.read.parquet(path), path)
    return p.select("n_rows", "n_cols", (F.col("file_size_bytes") > 0).alias("has_bytes"), F.inline("columns"))


@query(
    "text_fingerprint",
    "SELECT doc_id, substring(sha256(text), 1, 16) AS fingerprint FROM documents",
)
def text_fingerprint(spark, sf_dir):
    docs = dirt.table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(F.col("text").cast("binary")).alias("fingerprint"))


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    return fingerprints(spark, sf_dir)


@query("changed_inputs", "SELECT 'orders.parquet' AS file WHERE (SELECT count(*) FROM orders) > 0")
def changed_inputs(spark, sf_dir):
    """Against a record of all files but one, that one is new."""
    now = fingerprints(spark, sf_dir)
    new = changed_files(now, now.where(~F.col("file").endswith("orders.parquet")))
    return new.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"))
