"""Relations that the registered queries start from, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corestrata.operators import chunking, families

SIZE, SMALL_SIZE = 256, 64
PAIR = ["family", "version"]

OLD_PATH = "source || '/' || lang || '/f' || CAST(doc_id AS STRING) || '_1.0.0.' || CAST(doc_id % 5 AS STRING) || '.dll'"
NEW_PATH = "CASE doc_id % 8 WHEN 2 THEN 'moved/f' || CAST(doc_id AS STRING) || '.bin' WHEN 3 THEN source || '/' || lang || '/f' || CAST(doc_id AS STRING) || '_1.0.1.' || CAST(doc_id % 5 AS STRING) || '.dll' ELSE source || '/' || lang || '/f' || CAST(doc_id AS STRING) || '_1.0.0.' || CAST(doc_id % 5 AS STRING) || '.dll' END"
NEW_TEXT = "CASE WHEN doc_id % 8 IN (1, 3) THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END"
ENTRY_NAME = "CASE WHEN c_custkey % 17 = 1 THEN 'aux.txt' WHEN c_custkey % 19 = 1 THEN c_name WHEN c_custkey % 23 = 1 THEN 'dot.' ELSE 'f' || CAST(c_custkey AS STRING) END"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, family, bytes) of whole texts."""
    return chunking.contents(read(spark, sf_dir, "documents"), {"content_id": "doc_id", "family": "source"}, F.col("text"))


def document_chunks(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return chunking.fixed_chunks(documents(spark, sf_dir), size)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, version, bytes): a conversation after each of its turns, an append-only history."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n")
    return chunking.contents(read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said")), {"family": "conv_id", "version": "turn"}, F.col("said"))


def pair_chunks(spark: SparkSession, sf_dir: str, size: int = SMALL_SIZE, target_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of each version's predecessor and of the version itself, both under the version's keys."""
    content = histories(spark, sf_dir)
    base, target = pair_contents(content)
    return chunking.fixed_chunks(base, size), chunking.fixed_chunks(target, target_size or size)


def pair_contents(content: DataFrame) -> tuple[DataFrame, DataFrame]:
    steps = families.transitions(content.select(*PAIR), 1)
    base = content.withColumnRenamed("version", "from_version").join(steps.select("family", "from_version", "to_version"), ["family", "from_version"]).select("family", F.col("to_version").alias("version"), "bytes")
    target = content.join(steps.select("family", F.col("to_version").alias("version")), PAIR, "left_semi")
    return base, target


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a tree (family, path, length, sha256, bytes): files removed, changed, moved, renamed with a new version, copied."""
    docs = read(spark, sf_dir, "documents").withColumn("family", F.col("lang"))
    row = lambda df, path, text: df.select("family", F.expr(path).alias("path"), F.encode(F.expr(text), "UTF-8").alias("bytes")).select("family", "path", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("sha256"), "bytes")
    old = row(docs, OLD_PATH, "coalesce(text, '')")
    new = row(docs.where("doc_id % 8 <> 0"), NEW_PATH, NEW_TEXT)
    copies = row(docs.where("doc_id % 8 = 4"), "'copy/f' || CAST(doc_id AS STRING) || '.bin'", "coalesce(text, '')")
    return old, new.unionByName(copies)


# The same in DuckDB's SQL.


def sql_chunks(name: str, source: str, keys: str, size: int) -> str:
    return f"""{name} AS (SELECT {keys}, CAST(i AS BIGINT) AS idx, CAST(i * {size} AS BIGINT) AS off, CAST(least({size}, octet_length(b) - i * {size}) AS BIGINT) AS len,
        sha256(b[i * {size} + 1 : least((i + 1) * {size}, octet_length(b))]) AS id FROM {source}, unnest(range(0, (octet_length(b) + {size - 1}) // {size})) AS t(i))"""


SQL_DOCUMENTS = "d AS MATERIALIZED (SELECT doc_id AS content_id, source AS family, encode(coalesce(text, '')) AS b FROM documents)"
SQL_DOCUMENT_CHUNKS = f"{SQL_DOCUMENTS}, {sql_chunks('k', 'd', 'content_id, family', SIZE)}"
SQL_HISTORIES = """v AS MATERIALIZED (SELECT conv_id AS family, turn AS version, encode(string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS b FROM conversations),
    steps AS (SELECT * FROM (SELECT family, version AS from_version, lead(version) OVER (PARTITION BY family ORDER BY version) AS to_version FROM v) WHERE to_version IS NOT NULL)"""


def sql_pairs(base: int = SMALL_SIZE, target: int = SMALL_SIZE) -> str:
    return f"""{SQL_HISTORIES}, {sql_chunks('bk', 'v', 'family, version', base)}, {sql_chunks('tk', 'v', 'family, version', target)},
    base AS MATERIALIZED (SELECT s.family, s.to_version AS version, idx, off, len, id FROM bk JOIN steps s ON bk.family = s.family AND bk.version = s.from_version),
    target AS MATERIALIZED (SELECT s.family, s.to_version AS version, idx, off, len, id FROM tk JOIN steps s ON tk.family = s.family AND tk.version = s.to_version)"""


SQL_TREES = f"""o AS MATERIALIZED (SELECT lang AS family, {OLD_PATH} AS path, encode(coalesce(text, '')) AS b FROM documents),
    n AS MATERIALIZED (SELECT lang AS family, {NEW_PATH} AS path, encode({NEW_TEXT}) AS b FROM documents WHERE doc_id % 8 <> 0
        UNION ALL SELECT lang, 'copy/f' || CAST(doc_id AS STRING) || '.bin', encode(coalesce(text, '')) FROM documents WHERE doc_id % 8 = 4),
    old AS MATERIALIZED (SELECT family, path, CAST(octet_length(b) AS BIGINT) AS length, sha256(b) AS sha256 FROM o),
    new AS MATERIALIZED (SELECT family, path, CAST(octet_length(b) AS BIGINT) AS length, sha256(b) AS sha256 FROM n)"""
