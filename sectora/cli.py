"""Commands over a landing zone: build, company-llms, list, cache, site.

The landing zone holds ``submissions/{cik}.json``, ``files/{accession}/{filename}``
(with ``index.json`` the documents it lists count, else all HTML documents) and,
optionally, ``facts/{cik}.json``.  Without one, documents come over HTTP and are kept
in the ``--cache``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import lookups
from .plans import export, pack, site
from .sources import remote, tables
from .sources.http import HttpReader

#: Files that a site does not copy.
IGNORED = r"/(?:\.DS_Store|__pycache__|\.pytest_cache)(?:/|$)"


class Landing:
    """Documents and files below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _documents(self, kind: str, ciks: DataFrame) -> DataFrame:
        found = tables.json_documents(self.spark, f"{self.path}/{kind}/*.json")
        return found.withColumn("cik", text.normalize_cik(F.col("cik"))).join(ciks.select(text.normalize_cik(F.col("cik")).alias("cik")), "cik", "left_semi")

    def submissions(self, ciks: DataFrame) -> DataFrame:
        return self._documents("submissions", ciks)

    def facts(self, ciks: DataFrame) -> DataFrame:
        return self._documents("facts", ciks)

    def files(self, wanted: DataFrame) -> DataFrame:
        """(accession, ord, filename, content, error) of the files of each wanted filing: those of its index, where there is one, else all HTML documents."""
        bare = F.replace("accession", F.lit("-"), F.lit(""))
        keys = wanted.select("accession", "primary_document", bare.alias("k"))
        files = tables.html_files(self.spark, f"{self.path}/files").withColumn("k", bare).drop("accession").join(keys, "k")
        indexes = files.where("filename = 'index.json'").select("accession", "primary_document", text.decode_bytes(F.col("content")).alias("json"))
        there = files.select("accession", "filename", "content")
        listed = lookups.filing_files(indexes).join(there, ["accession", "filename"], "left")
        listed = listed.select("accession", "ord", "filename", "content", F.when(F.col("content").isNull(), "no such file").alias("error"))
        fine = (F.col("filename") == F.col("primary_document")) | (F.col("filename").rlike(r"(?i)\.html?$") & ~F.col("filename").rlike(lookups.SKIPPED_FILES))
        order = Window.partitionBy("accession").orderBy(F.col("filename") != F.col("primary_document"), F.lower("filename"), "filename")
        free = files.join(indexes.select("accession"), "accession", "left_anti").where(fine).withColumn("ord", F.row_number().over(order) - 1)
        return listed.unionByName(free.select("accession", "ord", "filename", "content", F.lit(None).cast("string").alias("error")))


def _source(spark, args):
    if args.landing:
        return Landing(spark, args.landing)
    agent = args.user_agent
    reader = args.make_reader or (lambda: HttpReader(agent))
    return remote.Remote(spark, tables.CacheTable(spark, args.cache), reader, getattr(args, "force", False))


def _of(spark, args):
    ciks = spark.createDataFrame([(args.cik,)], "cik string")
    return lookups.submission_rows(_source(spark, args).submissions(ciks)).where(F.col("cik") == text.normalize_cik(F.lit(args.cik)))


def build(spark, args) -> int:
    if not (args.accession or args.form):
        print("build needs --accession or --form", file=sys.stderr)
        return 2
    rows = _of(spark, args)
    wanted = lookups.filing_by_accession(rows, args.accession) if args.accession else lookups.latest_filing(rows, args.form)
    if not wanted.limit(1).count():
        print("no such filing", file=sys.stderr)
        return 1
    scanned = tables.scan_packs_if_any(spark, args.out)
    done = None if args.force else pack.existing(wanted, scanned)
    todo = wanted if args.force else pack.pending(wanted, scanned.select("cik", "accession"))
    source = _source(spark, args)
    files = source.files(todo).persist()
    filings = todo.join(lookups.concat_parts(files.where("content IS NOT NULL").select("accession", "ord", "content")), "accession")
    for r in remote.missing_files(files).select(F.explode("lost").alias("lost")).limit(20).collect():  # a glance for the console
        print(f"warning: {r.lost}", file=sys.stderr)
    if empty := todo.join(filings, ["cik", "accession"], "left_anti").select("accession").limit(1).collect():
        print(f"no HTML files of filing {empty[0].accession}", file=sys.stderr)
        return 1
    facts = None
    if args.with_xbrl:
        found = lookups.facts_of(lookups.fact_rows(source.facts(wanted.select("cik"))), args.accession or wanted.first()["accession"])
        facts = lookups.nested_facts(found).join(wanted.select("cik", "accession"), "cik").select("cik", "accession", F.to_json("facts", {"ignoreNullFields": "false"}).alias("json"))
    packs = pack.build_packs(filings, args.with_chunks, facts, ranks=args.ranks)
    packs = pack.Packs(packs.rows.persist(), packs.with_chunks)
    if args.force:
        export.remove_folders(wanted.select(F.concat_ws("/", "cik", "accession")), args.out)
    export.write_files(packs.files, args.out).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).show()
    shown = packs.summary()
    (shown if done is None else shown.unionByName(done)).show(truncate=False)
    return 0


def company_llms(spark, args) -> int:
    """Company text from the exported packs; links use the directory names."""
    cik = text.normalize_cik(F.lit(args.cik))
    scanned = tables.scan_packs(spark, args.out).where(F.col("cik") == cik).withColumn("accession", F.col("directory")).drop("company_name")
    named = scanned.join(_of(spark, args).select("cik", "company_name").distinct(), "cik")
    rows = pack.company_filings(named).select(F.concat(F.col("cik"), F.lit("/llms.txt")).alias("path"), pack.company_text(F.col("company_name"), F.col("cik"), F.col("filings")).alias("content"))
    n = export.write_files(rows, args.out).count()
    if not n:
        print("no packs of this company", file=sys.stderr)
    return int(not n)


def list_filings(spark, args) -> int:
    lookups.list_filings(_of(spark, args), args.form, args.limit).orderBy("pos").show(args.limit, truncate=False)
    return 0


def cache(spark, args) -> int:
    stored = tables.CacheTable(spark, args.cache)
    if args.action == "clear":
        stored.clear()
    else:
        stored.stats().show()
    return 0


def build_site(spark, args) -> int:
    """The pages of all exported packs, and copies of their files."""
    packs = tables.scan_packs(spark, args.packs)
    texts = spark.read.option("recursiveFileLookup", True).text(args.packs, wholetext=True).where(~F.col("_metadata.file_path").rlike(IGNORED))
    files = texts.select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)/((?:sections/|optional/)?[^/]+)$", 1).alias("folder"), F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)/((?:sections/|optional/)?[^/]+)$", 2).alias("name"), F.col("value").alias("content"))
    copies = files.select(F.concat_ws("/", "folder", "name").alias("path"), "content")
    meta = packs.select("cik", "accession", "company_name", "form_type", F.concat_ws("/", "cik", "directory").alias("folder"))
    full = files.where("name = 'filing.full.md'").join(meta, "folder").select("cik", "accession", "company_name", "form_type", F.col("content").alias("markdown"))
    titles = packs.select("cik", "accession", F.concat_ws("/", "cik", "directory").alias("folder"), F.explode("sections").alias("s")).select("cik", "accession", "folder", F.col("s.id").alias("id"), F.col("s.title").alias("title"), F.col("s.path").alias("name"))
    sections = titles.join(files, ["folder", "name"], "left").select("cik", "accession", "id", "title", F.coalesce("content", F.lit("")).alias("content"))
    manifest = F.struct(
        "sections", "artifacts", "tokens_total", F.struct(F.col("source_url").alias("url")).alias("source"), F.struct("form_type", "filing_date", "company_name").alias("filing")
    )
    pages = site.filing_overview(packs.select("cik", "accession", manifest.alias("manifest"))).unionByName(site.text_pages(full, sections))
    companies = site.company_pages(packs)
    out = pages.select(F.concat_ws("/", "cik", "accession", "path").alias("path"), F.col("html").alias("content"))
    out = out.union(copies).union(companies.select("path", F.col("html").alias("content"))).union(site.root_page(companies).select("path", F.col("html").alias("content")))
    export.remove_folders(packs.select(F.concat_ws("/", "cik", "accession")).distinct(), args.out)  # copies replace what was there
    export.write_files(out, args.out).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).show()
    site.site_counts(packs).show()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, make_reader=None) -> int:
    """``make_reader`` replaces the HTTP reader of remote commands (a test's transport, say)."""
    p = argparse.ArgumentParser(prog="sectora")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *flags):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, options in flags:
            c.add_argument(flag, **options)

    need, yes = {"required": True}, {"action": "store_true"}
    where = (("--landing", {}), ("--cache", {"help": "cache of remote documents, where no landing zone is named"}), ("--user-agent", {"default": "sectora"}))
    command("build", build, *where, ("--cik", need), ("--accession", {}), ("--form", {}), ("--out", need), ("--with-chunks", yes), ("--with-xbrl", yes), ("--force", yes), ("--ranks", {"help": "file of a byte-level vocabulary that counts the tokens"}))
    command("company-llms", company_llms, *where, ("--cik", need), ("--out", need))
    command("list", list_filings, *where, ("--cik", need), ("--form", {}), ("--limit", {"type": int, "default": 10}))
    command("cache", cache, ("action", {"choices": ["clear", "stats"], "nargs": "?", "default": "stats"}), ("--cache", need))
    command("site", build_site, ("--packs", need), ("--out", need), ("--base-url", {}))
    args = p.parse_args(argv)
    args.make_reader = make_reader
    if hasattr(args, "landing") and not (args.landing or args.cache):
        p.error("name a --landing zone or a --cache for remote documents")
    spark = spark or SparkSession.builder.appName("sectora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
