"""Filings of a company, files of a filing and facts of a filing, from their JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SUBMISSIONS = "struct<name:string,filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,primaryDocument:array<string>>>>"
INDEX = "struct<directory:struct<item:array<struct<name:string>>>>"
FACT = "struct<accn:string,start:string,end:string,val:string,form:string,frame:string>"
#: HTML files of a filing that are no filing documents.
SKIPPED_FILES = r"(?i)^(?:index\.html?$|.*-index\.html?$|index-headers\.html?$|R\d+\.htm|ex\d+|FilingSummary\.html?$)"


def submission_rows(submissions: DataFrame) -> DataFrame:
    """(cik, pos, accession, form_type, filing_date, primary_document, company_name) from (cik, json); pos is the source order."""
    s = submissions.select(text.normalize_cik(F.col("cik")).alias("cik"), F.from_json("json", SUBMISSIONS).alias("j"))
    r = "j.filings.recent"
    zipped = F.arrays_zip(*[F.col(f"{r}.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "primaryDocument")])
    rows = s.select("cik", F.coalesce("j.name", F.lit("Unknown")).alias("company_name"), F.posexplode(zipped).alias("pos", "f"))
    return rows.select("cik", "pos", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form_type"), F.to_date("f.filingDate").alias("filing_date"), F.col("f.primaryDocument").alias("primary_document"), "company_name")


def latest_filing(rows: DataFrame, form: str) -> DataFrame:
    """Per company the first row, in source order, whose normalised form is ``form``."""
    wanted = rows.where(text.normalize_form(F.col("form_type")) == text.normalize_form(F.lit(form)))
    return wanted.withColumn("n", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where("n = 1").drop("n")


def filing_by_accession(rows: DataFrame, accession: str) -> DataFrame:
    return rows.where(F.col("accession") == text.dashed_accession(F.lit(accession)))


def list_filings(rows: DataFrame, form: str | None = None, limit: int = 10) -> DataFrame:
    """Per company the first ``limit`` rows in source order; a limit of 0 or less gives none."""
    if form:
        rows = rows.where(text.normalize_form(F.col("form_type")) == text.normalize_form(F.lit(form)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where(F.col("n") <= limit).drop("n")


def filing_files(indexes: DataFrame) -> DataFrame:
    """(accession, ord, filename) from (accession, primary_document, json): the primary document first, then other HTML documents."""
    names = indexes.select("accession", "primary_document", F.explode(F.from_json("json", INDEX)["directory"]["item"]).alias("i")).select("accession", F.col("i.name").alias("filename"), "primary_document")
    other = names.where((F.col("filename") != F.col("primary_document")) & F.col("filename").rlike(r"(?i)\.html?$") & ~F.col("filename").rlike(SKIPPED_FILES)).select("accession", "filename").distinct()
    w = Window.partitionBy("accession").orderBy(F.lower("filename"), "filename")
    first = indexes.select("accession", F.lit(0).alias("ord"), F.col("primary_document").alias("filename"))
    return first.unionByName(other.withColumn("ord", F.row_number().over(w)))


def concat_parts(files: DataFrame) -> DataFrame:
    """(accession, html, files) from (accession, ord, content): decoded file by file and joined by line ends in order."""
    decoded = files.select("accession", F.struct("ord", text.decode_bytes(F.col("content")).alias("html")).alias("p"))
    grouped = decoded.groupBy("accession").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return grouped.select("accession", F.array_join(F.transform("p", lambda x: x["html"]), "\n").alias("html"), F.size("p").alias("files"))


def fact_rows(facts: DataFrame) -> DataFrame:
    """(cik, taxonomy, concept, unit, accession, period, value, form, frame, typed, place) from (cik, json).

    Levels that are not objects are skipped one by one, as the maps are read level by level.
    ``value`` is the fact's value as text, ``typed`` the JSON value itself; ``place`` is the
    position in the document, level by level.
    """

    def level(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        rows = df.select(*keys, "place", F.posexplode(F.from_json("json", "map<string,string>")).alias("n", name, "json"))
        return rows.select(*keys, name, F.array_append("place", F.col("n")).alias("place"), "json")

    top = facts.select("cik", F.array().cast("array<int>").alias("place"), F.get_json_object("json", "$.facts").alias("json"))
    concepts = level(level(top, ["cik"], "taxonomy"), ["cik", "taxonomy"], "concept")
    units = level(concepts.select("cik", "taxonomy", "concept", "place", F.get_json_object("json", "$.units").alias("json")), ["cik", "taxonomy", "concept"], "unit")
    values = units.select("cik", "taxonomy", "concept", "unit", "place", F.posexplode(F.from_json("json", "array<string>")).alias("n", "v"))
    typed = F.try_variant_get(F.try_parse_json("v"), "$.val", "variant")
    f = values.select("cik", "taxonomy", "concept", "unit", F.array_append("place", F.col("n")).alias("place"), typed.alias("typed"), F.from_json("v", FACT).alias("f"))
    return f.where("f IS NOT NULL").select("cik", "taxonomy", "concept", "unit", F.coalesce("f.accn", F.lit("")).alias("accession"), text.period(F.col("f.start"), F.col("f.end")).alias("period"), F.col("f.val").alias("value"), F.col("f.form").alias("form"), F.col("f.frame").alias("frame"), "typed", "place")


def facts_of(rows: DataFrame, accession: str) -> DataFrame:
    """The facts of one filing; dashes do not matter."""
    return rows.where(F.replace("accession", F.lit("-"), F.lit("")) == accession.replace("-", ""))


def nested_facts(rows: DataFrame) -> DataFrame:
    """(cik, facts): taxonomy to concept to list of facts with typed values, in the order of the document; empty groups do not occur."""
    earlier = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    fact = F.struct("period", F.col("typed").alias("value"), "unit", "form", "frame")
    in_order = lambda x: F.array_sort(F.collect_list(F.struct("place", x.alias("x"))), earlier)
    by_concept = rows.groupBy("cik", "taxonomy", "concept").agg(F.transform(in_order(fact), lambda p: p["x"]).alias("facts"), F.min("place").alias("place"))
    entry = lambda name, value: F.map_from_entries(F.transform(in_order(F.struct(name, value)), lambda p: p["x"]))
    by_taxonomy = by_concept.groupBy("cik", "taxonomy").agg(entry("concept", "facts").alias("concepts"), F.min("place").alias("place"))
    return by_taxonomy.groupBy("cik").agg(entry("taxonomy", "concepts").alias("facts"))


def pending(requests: DataFrame, manifests: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Requests (cik, accession) without a stored manifest; the manifest's key may lack the dashes (legacy layout).

    Columns of both in ``also`` must agree too, which tells filings apart where an accession number occurs twice.
    """
    key = ["cik", "accession", *also]
    known = manifests.withColumn("accession", text.dashed_accession(F.col("accession"))).select(key).distinct()
    return requests.join(known, key, "left_anti")


def cache_misses(wanted: DataFrame, cache: DataFrame, now, max_age_seconds: int | None) -> DataFrame:
    """URLs without a fresh cache entry; entries without a time count as fresh, and so do all without an age limit."""
    fresh = cache
    if max_age_seconds is not None:
        fresh = cache.where(F.col("cached_at").isNull() | (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("cached_at") <= max_age_seconds))
    return wanted.join(fresh.select(F.sha2("url", 256).alias("_k")).distinct(), F.sha2(wanted["url"], 256) == F.col("_k"), "left_anti")
