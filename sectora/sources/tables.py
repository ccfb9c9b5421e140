"""Readers of a landing zone and of exported packs, and the cache table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import cache_misses
from .http import HttpReader

MANIFEST = """struct<schema_version:int,parser_version:string,generated_at:string,source:struct<url:string,fetched_at:string>,
filing:struct<cik:string,accession:string,form_type:string,filing_date:string,company_name:string>,
sections:array<struct<id:string,title:string,path:string,char_start:int,char_end:int,tokens_approx:long,sha256:string>>,
artifacts:map<string,string>,warnings:array<string>,tokens_total:long>"""
CACHE = "key string, url string, cached_at timestamp, size long, headers map<string,string>, content binary"


def json_documents(spark: SparkSession, path: str, key_pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """(cik, json): whole JSON files, the key taken from the file name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_path", key_pattern, 1).alias("cik"), F.col("value").alias("json"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(accession, filename, content): ``path/{accession}/{filename}`` as bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("accession"), F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "content")


def scan_packs(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable manifest below ``path/{cik}/{accession}``, with defaults for missing keys.

    ``directory`` is the name of the accession's folder, which company texts link to.
    """
    rows = spark.read.option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    where = "_metadata.file_path"
    rows = rows.select(F.regexp_extract(where, "([^/]+)/[^/]+/manifest.json$", 1).alias("d1"), F.regexp_extract(where, "([^/]+)/manifest.json$", 1).alias("directory"), F.from_json("value", MANIFEST).alias("m"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = rows.where("m IS NOT NULL").withColumn("cik", F.coalesce(empty("m.filing.cik"), "d1"))
    return rows.select(
        "cik", F.coalesce(empty("m.filing.accession"), "directory").alias("accession"), F.coalesce(empty("m.filing.company_name"), F.concat(F.lit("CIK "), F.col("cik"))).alias("company_name"),
        F.coalesce(empty("m.filing.form_type"), F.lit("Unknown")).alias("form_type"), F.coalesce("m.filing.filing_date", F.lit("")).alias("filing_date"), F.coalesce("m.tokens_total", F.lit(0)).alias("tokens_total"),
        F.col("m.source.url").alias("source_url"), F.coalesce("m.sections", F.array().cast("array<struct<id:string,title:string,path:string,char_start:int,char_end:int,tokens_approx:long,sha256:string>>")).alias("sections"),
        F.coalesce("m.artifacts", F.create_map().cast("map<string,string>")).alias("artifacts"), "directory",
    )


def scan_packs_if_any(spark: SparkSession, path: str) -> DataFrame:
    """:func:`scan_packs`, without rows where there is no such folder yet."""
    try:
        return scan_packs(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = "cik string, accession string, company_name string, form_type string, filing_date string, tokens_total long, source_url string, sections array<struct<id:string>>, artifacts map<string,string>, directory string"
        return spark.createDataFrame([], empty)


class CacheTable:
    """URL contents as Parquet: a folder per :meth:`put`, partitioned by the first two digits of the key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """All rows as of now; puts are named one by one, so that plans of earlier and later states differ."""
        folder, store = self._folder()
        puts = [str(f.getPath()) for f in store.listStatus(folder)] if store.exists(folder) else []
        kind = CACHE + ", put string, prefix string"
        return self.spark.read.schema(kind).option("basePath", self.path).parquet(*puts) if puts else self.spark.createDataFrame([], kind)

    def missing(self, urls: DataFrame, now, max_age_seconds: int | None) -> DataFrame:
        return cache_misses(urls, self.read(), now, max_age_seconds)

    def put(self, rows: DataFrame) -> None:
        """Append (url, headers, content) rows."""
        full = rows.select(F.sha2("url", 256).alias("key"), "url", F.current_timestamp().alias("cached_at"), F.length("content").cast("long").alias("size"), "headers", "content")
        full.withColumn("prefix", F.substring("key", 1, 2)).write.partitionBy("prefix").parquet(f"{self.path}/put={uuid.uuid4().hex}")

    def newest(self) -> DataFrame:
        """The latest entry of each URL."""
        return self.read().groupBy("url").agg(F.max_by(F.struct("content", "headers", "cached_at"), "cached_at").alias("r")).select("url", "r.*")

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))

    def clear(self) -> None:
        folder, store = self._folder()
        store.delete(folder, True)


def fetch_urls(urls: DataFrame, make_reader, partitions: int = 1) -> DataFrame:
    """(url, headers, content, error) of each URL; ``make_reader`` builds one :class:`HttpReader` per partition.

    The rate limit holds per partition, hence one partition by default: the source
    allows so many requests a second in all, and more tasks would not speed it up.
    """

    def run(frames):
        import pandas as pd

        reader: HttpReader = make_reader()
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    body, headers = reader.fetch(url)
                    rows.append((url, headers, body, None))
                except Exception as e:  # noqa: BLE001  a failed file becomes a row, not a failed job
                    rows.append((url, {}, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "headers", "content", "error"])

    return urls.select("url").coalesce(partitions).mapInPandas(run, "url string, headers map<string,string>, content binary, error string")
