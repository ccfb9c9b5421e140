"""Filing analytics on Spark: filings as rows, from raw HTML to sections, chunks and roll-ups."""
