"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions only.

Names, numbers and units of a text become typed placeholders, so that a question
whose figures or persons were exchanged keeps its template.  Every WINDOW-token
window of benchmark items and documents is hashed twice: as a template, and with
names as lower-case words, so that a copy in other letter case meets too.
Documents with a hit are compared with the item along the alignment of the hit:
template or words must agree on enough of the item, and the placeholders must be
filled consistently (equal values of the item by equal values of the document).
Where fewer than PLAIN words agree, only equal values count.  Items of fewer than
LEAST tokens are sought as they are, by windows of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 6
COVERAGE = 0.6  # share of an item's tokens that must match
LEAST = 8  # tokens that must match; shorter items must occur whole and unchanged
PLAIN = 3  # matched words that must not be placeholders, else only equal values match
BROADCAST_WINDOWS = 500_000  # larger benchmarks are joined by shuffle
NAME, NUMBER, UNIT = "", "", ""
#: Unit words that follow a number.
UNITS = ("km", "cm", "mm", "m", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "h", "hr", "hrs", "hours", "hour", "min", "mins", "minutes", "minute", "s", "sec", "seconds", "days", "day", "weeks", "week", "months", "month", "years", "year", "miles", "mile", "meters", "metres", "feet", "foot", "inches", "inch", "dollars", "dollar", "cents", "euros", "euro", "pounds", "pound", "percent")
_UNITS = "|".join(sorted(UNITS, key=len, reverse=True))
_CAPITAL = r"\p{Lu}(?<=[\p{L}\p{N},;'’)\-][ ].)[\p{L}\p{M}]*"  # a word with a capital, not at the start of a sentence or line
_NUMBER = r"\p{Nd}+(?:[.,:]\p{Nd}+)*"
_MEASURE = rf" {{0,3}}({_UNITS})(?![\p{{L}}\p{{M}}])"
_BETWEEN = rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{NUMBER}{UNIT}]+"


def template_tokens(text: Column) -> Column:
    """Template tokens of a whole text: lower-case words and placeholders (null: empty array)."""
    return _split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _CAPITAL, NAME)))


def folded_tokens(text: Column) -> Column:
    """The same tokens whatever the letter case: names are lower-case words."""
    return _split(F.lower(F.coalesce(text, F.lit(""))))


def _split(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, _NUMBER + _MEASURE, f" {NUMBER} {UNIT} "), _NUMBER, f" {NUMBER} ")
    return F.array_remove(F.split(t, _BETWEEN), "")


def marked_tokens(text: Column) -> Column:
    """The same tokens with the value behind each placeholder (of a number its whole part)."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"({_CAPITAL})", f"{NAME}$1"))
    value = _NUMBER.replace(r"\p{Nd}+", r"(\p{Nd}+)", 1)
    t = F.regexp_replace(t, value + _MEASURE, f" {NUMBER}$1 {UNIT}$2 ")
    t = F.regexp_replace(t, rf"(?<![{NUMBER}\p{{Nd}}]){value}", f" {NUMBER}$1 ")
    return F.array_remove(F.split(t, _BETWEEN), "")


def _template(token: Column) -> Column:
    return F.when(token.substr(1, 1).isin(NAME, NUMBER, UNIT), token.substr(1, 1)).otherwise(token)


def _value(token: Column) -> Column:
    return F.when(token.substr(1, 1).isin(NAME, NUMBER, UNIT), token.substr(F.lit(2), F.length(token))).otherwise(token)


def exact_text(text: Column) -> Column:
    """Lower-case words and whole numbers of a text, one space around each."""
    between = r"[^\p{L}\p{M}\p{Nd}.,:]+|(?<!\p{Nd})[.,:]+|[.,:]+(?!\p{Nd})"
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), between, " "), " +", " ")), F.lit(" "))


def _window_hash(tokens: Column, i: Column, length: int = WINDOW) -> Column:
    return F.xxhash64(*[F.get(tokens, i + k) for k in range(length)])


def _starts(tokens: Column, length: int = WINDOW) -> Column:
    return F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length))


def window_hashes(texts: DataFrame, key: str) -> DataFrame:
    """(key, n, k, hash) of every window of ``texts`` (key, text), which starts at token k modulo n; null hashes are void."""
    tokens = texts.select(key, folded_tokens(F.col("text")).alias("f"), template_tokens(F.col("text")).alias("w"))  # no filter on the tokens: it would compute them twice
    starts = _starts(F.col("f"))
    folded = F.transform(starts, lambda i: _window_hash(F.col("f"), i))
    # without a name both forms are one
    named = F.transform(starts, lambda i: F.when(F.array_contains(F.slice("w", i + 1, WINDOW), NAME), _window_hash(F.col("w"), i)))
    hashed = tokens.select(key, (F.size("f") - (WINDOW - 1)).alias("n"), F.concat(folded, named).alias("h"))
    # posexplode would add a filter on the array below, and with it compute the tokens again
    return hashed.select(key, "n", F.posexplode_outer("h").alias("k", "hash"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, ipos) of every window of the items of LEAST tokens or more."""
    spread = window_hashes(benchmark.where("item_id IS NOT NULL"), "item_id").where(F.col("hash").isNotNull() & (F.col("n") > LEAST - WINDOW))
    return spread.select("hash", "item_id", (F.col("k") % F.col("n")).alias("ipos"))


def short_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, item_id) of items of fewer than LEAST tokens that a document holds word by word; None without such items."""
    sized = benchmark.where("item_id IS NOT NULL").select("item_id", folded_tokens(F.col("text")).alias("f"), exact_text(F.col("text")).alias("e"))
    items = written(sized.where(F.size("f").between(1, LEAST - 1)).distinct(), "bench-short")
    lengths = sorted(r.n for r in items.select(F.size("f").alias("n")).distinct().collect())  # at most LEAST - 1 values
    if not lengths:
        return None
    hashed = F.coalesce(*[F.when(F.size("f") == n, _window_hash(F.col("f"), F.lit(0), n)) for n in lengths])
    bench = written(items.select(hashed.alias("hash"), "item_id", "e"), "bench-short-hashes")
    tokens = docs.select("doc_id", folded_tokens(F.col("text")).alias("f"))

    def runs(n: int) -> Column:
        return F.coalesce(F.transform(_starts(F.col("f"), n), lambda i: _window_hash(F.col("f"), i, n)), F.array().cast("array<bigint>"))

    spread = tokens.select("doc_id", F.array_distinct(F.concat(*map(runs, lengths))).alias("h")).select("doc_id", F.explode_outer("h").alias("hash"))
    small = bench.count() <= BROADCAST_WINDOWS
    keys = bench.select("hash").distinct()
    hits = written(spread.join(F.broadcast(keys) if small else keys, "hash").distinct(), "bench-short-hits")
    holders = docs.join(written(hits.select("doc_id").distinct(), "bench-short-docs"), "doc_id", "left_semi").select("doc_id", exact_text(F.col("text")).alias("t"))
    return hits.join(bench, "hash").join(holders, "doc_id").where(F.contains("t", "e")).select("doc_id", "item_id").distinct()


def _combined(each: Column) -> Column:
    """The places and slots of alignments that agree: each of (w, places, slots) in turn joins unless a slot of it has another value already."""
    start = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<a:string,b:string>>").alias("slots"), F.lit(0).alias("left_out"))

    def joined(acc: Column, x: Column) -> Column:
        clash = F.exists(x["slots"], lambda c: F.exists(acc["slots"], lambda d: (c["a"] == d["a"]) & (c["b"] != d["b"])))
        more = F.struct(F.array_union(acc["places"], x["places"]).alias("places"), F.array_union(acc["slots"], x["slots"]).alias("slots"), acc["left_out"].alias("left_out"))
        return F.when(clash, F.struct(acc["places"].alias("places"), acc["slots"].alias("slots"), (acc["left_out"] + 1).alias("left_out"))).otherwise(more)

    return F.aggregate(each, start, joined)


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, consistent): benchmark items found in documents, one row per pair.

    ``coverage`` is the share of the item's template tokens that the document
    holds along the found alignments, the longest first and others as far as they
    fill the item's slots with the same values; ``consistent`` is false where
    alignments with other values were left out.  Only pairs with coverage
    of COVERAGE and LEAST tokens are returned, and items of
    fewer than LEAST tokens that occur whole with equal values.  Null ids, null and
    empty texts find nothing; rows that repeat an id share their findings; other
    columns are ignored.
    """
    docs, benchmark = docs.select("doc_id", "text").where("doc_id IS NOT NULL"), benchmark.select("item_id", "text")
    bench = written(benchmark_windows(benchmark).distinct(), "bench-windows")
    hashes = written(bench.select("hash").distinct(), "bench-hashes")
    small = hashes.count() <= BROADCAST_WINDOWS
    spread = window_hashes(docs, "doc_id")
    hits = written(spread.join(F.broadcast(hashes) if small else hashes, "hash").select("doc_id", (F.col("k") % F.col("n")).alias("dpos"), "hash"), "bench-hits")
    aligned = hits.join(bench, "hash").select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("delta")).distinct()
    aligned = written(aligned.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set("delta")).alias("deltas")), "bench-aligned")
    found = docs.join(written(aligned.select("doc_id").distinct(), "bench-docs"), "doc_id", "left_semi").select("doc_id", marked_tokens(F.col("text")).alias("d"))
    items = benchmark.where("item_id IS NOT NULL").select("item_id", marked_tokens(F.col("text")).alias("q")).where(F.size("q") >= LEAST)
    pairs = aligned.join(items, "item_id").join(found, "doc_id")
    # only the stretch of the document that an alignment covers is kept
    each = pairs.select("doc_id", "item_id", "q", F.explode("deltas").alias("delta"), "d")
    each = each.select("doc_id", "item_id", "q", "delta", F.transform("q", lambda _, i: F.when(i + F.col("delta") >= 0, F.get("d", i + F.col("delta")))).alias("v"))
    cells = each.select("doc_id", "item_id", "q", F.arrays_zip(F.col("q").alias("a"), F.col("v").alias("b"), F.transform("q", lambda _, i: i).alias("i")).alias("z"))
    same = F.filter("z", lambda c: (_template(c["a"]) == _template(c["b"])) | (_value(c["a"]) == _value(c["b"])))
    kept = cells.select("doc_id", "item_id", F.size("q").alias("n"), same.alias("m"))
    slots = F.transform(F.filter("m", lambda c: _template(c["a"]) != c["a"]), lambda c: F.struct(c["a"].alias("a"), _value(c["b"]).alias("b")))
    words = F.size(F.filter("m", lambda c: _template(c["a"]) == c["a"]))
    # placeholders with hardly a word between them say nothing unless their values agree
    told = F.when(words >= PLAIN, F.col("m")).otherwise(F.filter("m", lambda c: _value(c["a"]) == _value(c["b"])))
    judged = kept.select("doc_id", "item_id", "n", told.alias("m"), F.array_distinct(F.when(words >= PLAIN, slots).otherwise(F.slice(slots, 1, 0))).alias("s"))
    # an alignment whose slots contradict each other counts nothing
    judged = judged.withColumn("consistent", F.size("s") == F.size(F.array_distinct(F.transform("s", lambda c: c["a"]))))
    sized = judged.where(F.col("consistent") & (F.size("m") > 0))
    one = F.struct((-F.size("m")).alias("w"), F.transform("m", lambda c: c["i"]).alias("places"), F.col("s").alias("slots"))
    whole = sized.groupBy("doc_id", "item_id", "n").agg(F.array_sort(F.collect_set(one)).alias("each"))  # equal alignments count once
    total = whole.select("doc_id", "item_id", "n", _combined(F.col("each")).alias("c")).select("doc_id", "item_id", "n", F.size("c.places").alias("matched"), (F.col("c.left_out") == 0).alias("consistent"))
    good = total.where((F.col("matched") >= LEAST) & (F.col("matched") >= F.col("n") * COVERAGE)).select("doc_id", "item_id", (F.col("matched") / F.col("n")).alias("coverage"), "consistent")
    short = short_items(docs, benchmark)
    if short is not None:
        good = good.unionByName(short.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(True).alias("consistent")))
    # rows that repeat an id may differ in their texts: the best finding counts
    return good.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("consistent").alias("consistent"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, items, leaks), one row per input row; items is the sorted, comma-separated list of leaked items."""
    leaks = leaked_items(docs, benchmark)
    per_doc = written(leaks.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items")), "bench-leaks")
    out = docs.select("doc_id").join(per_doc, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.col("n_items").isNotNull().alias("leaks"))
