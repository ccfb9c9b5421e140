"""Company documents and filings over HTTP, through the cache table: what is fresh is read, the rest is fetched once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ARCHIVES_BASE, DATA_BASE
from ..functions import text
from ..operators.lookups import filing_files
from .tables import CacheTable, fetch_urls

#: Seconds that a cached document stays fresh; files of a filing never change.
SUBMISSIONS_AGE, INDEX_AGE, FACTS_AGE = 3600, 86400, 86400


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA_BASE}/submissions/CIK"), text.normalize_cik(cik), F.lit(".json"))


def facts_url(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA_BASE}/api/xbrl/companyfacts/CIK"), text.normalize_cik(cik), F.lit(".json"))


def file_url(name: Column) -> Column:
    """URL of a file of the filing whose cik and accession are columns."""
    return F.concat_ws("/", F.lit(ARCHIVES_BASE), F.col("cik"), F.replace("accession", F.lit("-"), F.lit("")), name)


class Remote:
    """Documents by URL; ``make_reader`` builds the :class:`sectora.sources.http.HttpReader` of a task."""

    def __init__(self, spark: SparkSession, cache: CacheTable, make_reader, force: bool = False):
        self.spark, self.cache, self.make_reader, self.force = spark, cache, make_reader, force

    def get(self, keyed: DataFrame, max_age: int | None) -> DataFrame:
        """``keyed`` (with a column url) with content (bytes) and error of each URL; contents that were fetched are cached."""
        urls = keyed.select("url").where("url IS NOT NULL").distinct()
        missing = urls if self.force else self.cache.missing(urls, F.current_timestamp(), max_age)
        tried = f"{self.cache.path.rstrip('/')}-tried/{uuid.uuid4().hex}"
        fetch_urls(missing, self.make_reader).write.parquet(tried)  # each URL is asked once, whatever reads the result
        got = self.spark.read.parquet(tried)
        self.cache.put(got.where("error IS NULL").select("url", "headers", "content"))
        failed = got.where("error IS NOT NULL").select(F.col("url").alias("_u"), "error")
        stored = self.cache.newest().select(F.col("url").alias("_v"), F.col("content").alias("_content"))
        out = keyed.join(failed, keyed.url == failed._u, "left").join(stored, keyed.url == stored._v, "left")
        return out.select(*keyed.columns, F.when(F.col("error").isNull(), F.col("_content")).alias("content"), "error")

    def submissions(self, ciks: DataFrame) -> DataFrame:
        """(cik, json, error) of companies."""
        got = self.get(ciks.select("cik", submissions_url(F.col("cik")).alias("url")), SUBMISSIONS_AGE)
        return got.select("cik", text.decode_bytes(F.col("content")).alias("json"), "error")

    def facts(self, ciks: DataFrame) -> DataFrame:
        """(cik, json, error) of companies."""
        got = self.get(ciks.select("cik", facts_url(F.col("cik")).alias("url")), FACTS_AGE)
        return got.select("cik", text.decode_bytes(F.col("content")).alias("json"), "error")

    def files(self, filings: DataFrame) -> DataFrame:
        """(cik, accession, ord, filename, content, error) of the documents that each filing's index names, the primary document first."""
        keys = filings.select("cik", "accession", "primary_document")
        index = self.get(keys.withColumn("url", file_url(F.lit("index.json"))), INDEX_AGE)
        listed = filing_files(index.select("accession", "primary_document", text.decode_bytes(F.col("content")).alias("json")))
        wanted = listed.join(keys.select("cik", "accession"), "accession").withColumn("url", file_url(F.col("filename")))
        return self.get(wanted, None).select("cik", "accession", "ord", "filename", "content", "error")


def missing_files(files: DataFrame) -> DataFrame:
    """(accession, lost): a warning for each document of a filing that could not be fetched, in order."""
    told = F.struct("ord", F.concat(F.lit("Failed to fetch "), F.col("filename"), F.lit(": "), F.col("error")).alias("warning"))
    return files.where("error IS NOT NULL").groupBy("accession").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["warning"]).alias("lost"))
