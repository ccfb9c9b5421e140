"""Incremental ingestion: new filings of a landing folder become sections, each filing once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import section_rows
from ..plans.pack import KEY, filing_markdown

FILINGS = "cik string, accession string, form_type string, filing_date date, company_name string, primary_document string, html string"


def ingest_sections(spark: SparkSession, landing: str, target: str, checkpoint: str):
    """Process the Parquet files of ``landing`` that were not seen before and stop; returns the finished query.

    A filing counts once, in whichever batch it comes first; of repeats within a
    batch the smallest html stays.  A batch that is run again overwrites its own
    rows and looks at the earlier ones only.
    """
    stream = spark.readStream.schema(FILINGS).parquet(landing)

    def batch(filings: DataFrame, number: int) -> None:
        one = filings.groupBy(*KEY).agg(F.min_by(F.struct("form_type", "filing_date", "company_name", "primary_document", "html"), F.struct("html", "form_type")).alias("f")).select(*KEY, "f.*")
        if number:
            earlier = spark.read.schema("cik string, accession string, batch long").parquet(target).where(F.col("batch") < number).select(*KEY).distinct()
            one = one.join(earlier, KEY, "left_anti")
        rows = section_rows(filing_markdown(one).select(*KEY, "form_type", "markdown"), form="form_type")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
