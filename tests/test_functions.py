"""Functions and operators of the filing engine: golden cases, quirks and random comparisons."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sectora.functions import html, text
from sectora.operators import chunks, headings, lookups, sections
from sectora.plans import pack, site
from sectora.sources import http, tables


def column(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


# -- keys -------------------------------------------------------------------------------------------------------------


def test_keys(spark):
    assert column(spark, text.normalize_cik, "320193", "0000320193", "00012345678901", "") == ["0000320193"] * 2 + ["12345678901", "0000000000"]
    assert column(spark, text.normalize_form, " 10k ", "10-q/A", "8K", "424b4", None) == ["10-K", "10-Q/A", "8-K", "424B4", ""]
    assert column(spark, text.section_form, "10-K/A", "s-1/a") == ["10-K", "S-1"]
    assert column(spark, text.dashed_accession, "000032019324000123", "0000320193-24-000123", "12-3") == ["0000320193-24-000123"] * 2 + ["123"]


def test_slug_and_ids(spark):
    assert column(spark, text.slugify, "Risk Factors", "Legal & Regulatory and More", "__A  b__", "x" * 40)[:3] == ["risk_factors", "legal_regulatory_more", "a_b"]
    rng = random.Random(1)
    titles = ["".join(rng.choice("aB1 _&é \t.") + rng.choice(["", " and ", "x"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    assert column(spark, text.slugify, *titles) == [headings.slug(t, 30) for t in titles]
    parted = [re.sub("([a-z0-9])([A-Z])", r"\1 \2", " ".join(t.split())) for t in [*titles, "a" * 200, "word " * 40]]
    assert column(spark, text.clean_title, *titles, "a" * 200, "word " * 40) == [t if len(t) <= 100 else t[:100].rpartition(" ")[0] if " " in t[:100] else t[:100] for t in parted]
    rows = [("10-K", "I", "1", "Business"), ("10-Q/A", None, "2", ""), ("8-K", "I", "2.02", "Results"), ("424B4", "", "other", "Risk Factors")]
    got = spark.createDataFrame(rows, "f string, p string, i string, t string").select(text.section_id(F.col("f"), F.col("p"), F.col("i"), F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ["10k_parti_item1_business", "10q_item2", "8k_item_2_02_results", "424b4_itemother_risk_factors"]


# -- markup -----------------------------------------------------------------------------------------------------------


def test_ixbrl(spark):
    page = '<html xmlns:ix="http://www.xbrl.org/x" xmlns:foo="http://fasb.org/y" lang="en"><ix:header><foo:a>1</foo:a></ix:header>  <IX:nonFraction\nname="x">2</ix:nonFraction><b>k</b></html>'
    assert column(spark, text.strip_ixbrl, page, "<p>plain</p>") == ['<html lang="en">1 2<b>k</b></html>', "<p>plain</p>"]
    assert column(spark, text.has_ixbrl, page, "matrix: 1", "<p>no</p>", "Inline XBRL") == [True, True, False, True]


@pytest.mark.parametrize(
    ("style", "hidden"),
    [("display : NONE", 1), ("visibility:hidden", 1), ("font-size:0", 1), ("font-size:0.5em", 0), ("border-width:0", 1), ("line-height:0;", 1), ("opacity:0.0", 1), ("opacity:0.5", 0), ("position:absolute;\nleft:-5px", 1), ("color:red", 0)],
)
def test_hidden_styles(spark, style, hidden):
    assert column(spark, text.is_hidden_style, style) == [bool(hidden)]
    assert (html.clean(f'a<div style="{style}">b</div>c') == "ac") == bool(hidden)


def test_clean():
    assert html.clean("<p class=x ONCLICK=y data-z=1 title='a\"b' b>t</p><!-- c --><script>s</script><br/>") == '<p title="a&quot;b">t</p><br>'
    assert html.clean("<nav><li>a<li>b</nav>gone") == ""  # unclosed elements deepen a hidden subtree
    assert html.clean("a &lt;b&gt; c") == "a <b> c"
    assert html.clean("x\r\n\r\n\r\n\r\n y\t\t z ") == "x\n\ny z"
    assert html.visible_text("<div>a</div>b<p hidden>c</p><span aria-hidden=true>d</span> &amp;amp;") == "a b &"


def test_semantic(spark):
    page = "<b>x</b><BR><u>y</u><font size=1>z</font><tt>c</tt><a href=''>no</a><a href='javascript:x()'>js</a>"
    assert column(spark, lambda c: text.unwrap_dead_links(text.semantic_tags(c)), page) == ["<strong>x</strong><BR><em>y</em>z<code>c</code>nojs"]
    assert html.absolute_links_in("<a href=' x.htm '><a href='#a'><a href='/y'>", "https://h/d/") == '<a href="https://h/d/x.htm"><a href="#a"><a href="https://h/y">'


@pytest.mark.parametrize(
    ("source", "md"),
    [
        ("<h2>A <b>b</b></h2><p>one<br>two</p>", "## A b\n\nonetwo"),
        ("<p>x <strong>y</strong> <em>z</em> <code>c</code> <a href='u'>l</a></p>", "x **y** *z* `c` [l](u)"),
        ("<ul><li>a</li><li><b>b</b></li></ul><ol><li>c</li></ol><ul></ul>", "- a\n- **b**\n\n1. c"),
        ("<table><tr><th>a</th><td>z</td></tr><tr><td>b|c</td><td>d</td></tr></table>", "| a |  |\n| --- | --- |\n| b\\|c | d |"),
        ("<table><tr><td>a</td></tr></table>", "| a |\n| --- |\n| a |"),
        ("<table></table>x<hr/>y", "x\n\n---\n\ny"),
        ("<div>a</div><div>b</div>", "a\n b"),
        ("<body>in</body><body>out</body>", "in"),
        ("<blockquote>a\nb</blockquote><pre>x &lt; y</pre>", "> a\n> b\n\n```\nx < y\n```"),
        ("a&nbsp;b &amp; c", "a b & c"),
    ],
)
def test_markdown(source, md):
    assert re.sub("\n{3,}| +\n+", lambda m: "\n\n" if m[0].count("\n") > 2 else m[0], html.to_markdown(source)).replace("\n \n", "\n\n") == md


def test_markdown_normalised(spark):
    docs = ["a\r\nb\rc", "a\n\n\n\nb", "a \t\nb  \nc   \n d", "  \n a\u2003\n", ""]
    assert column(spark, html.normalize_markdown, *docs) == ["a\nb\nc", "a\n\nb", "a\nb  \nc  \n d", "a", ""]
    assert column(spark, html.safe_href, " https://x ", "JavaScript:x", " ", "data:1") == ["https://x", None, None, None]


def test_markdown_to_html():
    md = "# T & x\n\npara `a<b` [l](https://x \"q) [bad](javascript:x) **b [n](u)**\nmore\n\n- a\n* b\n\n1. c\n2. d\n\n> q\n>\n> r\n\n---\n\n| h | i |\n| --- | --- |\n| 1 | **2** |\n\n```\n<x>\n```"
    out = html.markdown_html(md)
    assert "<h1>T &amp; x</h1>" in out and "<code>a&lt;b</code>" in out and "javascript" not in out and "@@" not in out
    assert '<strong>b <a href="u">n</a></strong> more</p>' in out and "<ul>\n<li>a</li>\n<li>b</li>\n</ul>" in out and "<ol>\n<li>c</li>\n<li>d</li>\n</ol>" in out
    assert "<blockquote>\n<p>q</p>\n<p>r</p>\n</blockquote>\n<hr>\n<table>" in out and "<td><strong>2</strong></td>" in out and out.endswith("<pre><code>&lt;x&gt;</code></pre>")


# -- chunks -----------------------------------------------------------------------------------------------------------


def test_chunk_spans_cover_and_end_at_boundaries():
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice("abc. \n! ?") for _ in range(rng.randrange(0, 120)))
        limit = rng.randrange(1, 8)
        ends = {m.end() for p in (r"[.!?]\s+", r"\n\n+") for m in re.finditer(p, t)}
        got = chunks.spans(t, limit)
        at = 0
        for a, b in got:
            assert a == at and (b - a) // 4 <= limit and b > a
            reach = [e for e in ends | {len(t)} if a < e <= a + 4 * limit + 3]
            assert b == (max(reach) if reach else min(len(t), a + 4 * limit))
            at = b
        assert at == len(t)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "s", "One. Two.  Three"), (2, "s", ""), (3, "s", None)], "doc int, id string, content string")
    rows = chunks.chunk_rows(docs, 1).orderBy("doc", "chunk_index").collect()
    assert [r.text for r in rows] == ["One. ", "Two.  ", "Three"] and [r.tokens for r in rows] == [1, 1, 1] and {r.doc for r in rows} == {1}
    assert rows[0].chunk_id == hashlib.sha256(b"s:0:one.").hexdigest()[:16]


# -- sections ---------------------------------------------------------------------------------------------------------

QUARTERLY = """| Table of Contents | |
| --- | --- |
| Item 1. | Financial Statements |
| Item 2. | Discussion |

PART I
Item 1. Financial Statements
text Item 3. ends here with a sentence.Item 2. Management Discussion and more.PART II Item 1A. Risk
| Item 5. | Other Information |
**Item 9. Bold**
SIGNATURES"""


def test_quarterly_headings():
    got = [(p, i, t) for _, _, p, i, t in headings.headings(QUARTERLY, "10-Q")]
    assert got[0] == ("I", "1", "Financial Statements")
    assert ("I", "2", "Management Discussion and more.PART II Item 1A. Risk") in got
    assert ("II", "5", "Other Information") in got and got[-1] == ("II", "other", "SIGNATURES")
    assert not any(i == "9" for _, i, _ in got)


def test_contents_rule_random():
    """Rows of a table after a mention are skipped; compared with a plain automaton over line kinds."""
    rng = random.Random(4)
    kinds = {"b": "", "t": "| Item {n}. | x |", "m": "| Item {n}. table of contents | x |", "x": "Item {n}. y", "c": "see table of contents"}
    for _ in range(1500):
        line_kinds = [rng.choice("btmxc") for _ in range(rng.randrange(1, 12))]
        lines = [kinds[k].format(n=i + 1) for i, k in enumerate(line_kinds)]
        armed = inside = False
        expect = []
        for i, k in enumerate(line_kinds):
            row = k in "tm"
            if k == "b":
                armed, inside = armed and not inside, False
                continue
            armed |= k in "mc"
            if inside and not row:
                armed = inside = False
            inside |= row and armed
            if k in "tmx" and not (inside and row):
                expect.append(str(i + 1))
        assert [h[3] for h in headings.headings("\n".join(lines), "10-K")] == expect, line_kinds


def test_section_rows(spark):
    md = ["## Item 1. A\nx\n## Item 1. A\ny\n## Item 1. A\nz", "free text", "p" * 120 + "\n\nItem 7. End", None, "Item 4."]
    docs = spark.createDataFrame([(i, "10-K", m) for i, m in enumerate(md)], "doc int, form string, markdown string")
    rows = sections.section_rows(docs).orderBy("doc", "ord").collect()
    assert [r.id for r in rows if r.doc == 0] == ["10k_item1_a", "10k_item1_a_1", "10k_item1_a_2"]
    assert [r.content for r in rows if r.doc == 0] == ["## Item 1. A\nx", "## Item 1. A\ny", "## Item 1. A\nz"] and len(rows[1].warnings) == 1
    assert [(r.id, r.char_end) for r in rows if r.doc in (1, 3)] == [("unknown_01", 9), ("unknown_01", 0)]
    assert [r.id for r in rows if r.doc == 2] == ["unknown_00", "10k_item7_end"] and [r.title for r in rows if r.doc == 4] == ["Item 4"]


def test_general_headings():
    md = "**RISK FACTORS**\n**AB**\n**Prospectus**\n# USE OF PROCEEDS\n# lower case title\nx **NOT AT START**\n**RISK FACTORS**\n# TABLE OF CONTENTS"
    assert [h[4] for h in headings.headings(md, "424B4")] == ["RISK FACTORS", "USE OF PROCEEDS"]


# -- lookups ----------------------------------------------------------------------------------------------------------


def test_facts_skip_odd_levels(spark):
    body = {"facts": {"us-gaap": {"A": {"units": {"USD": [{"accn": "1-2", "start": "s", "end": "e", "val": 1.5}, {"accn": "12", "end": "e", "val": 2}, 7], "X": 3}}, "B": 5}, "dei": 4}}
    rows = lookups.fact_rows(spark.createDataFrame([("1", json.dumps(body)), ("2", "broken"), ("3", None)], "cik string, json string"))
    assert sorted((r.period, r.value) for r in lookups.facts_of(rows, "12").collect()) == [("e", "2"), ("s/e", "1.5")]


def test_nested_facts_keep_types_and_order(spark):
    values = [3, 1.5, "text", None, True]
    body = {"facts": {"z": {"B": {"units": {"USD": [{"accn": "1", "end": "e", "val": v} for v in values], "EUR": [{"accn": "1", "val": 7}]}}, "A": {"units": {"USD": [{"accn": "1", "val": 2}]}}}, "a": {"N": {"units": {"x": [{"accn": "1", "val": 1}]}}}}}
    nested = lookups.nested_facts(lookups.fact_rows(spark.createDataFrame([("1", json.dumps(body))], "cik string, json string")))
    got = json.loads(nested.select(F.to_json("facts", {"ignoreNullFields": "false"}).alias("j")).first().j)
    assert list(got) == ["z", "a"] and list(got["z"]) == ["B", "A"] and [f["value"] for f in got["z"]["B"]] == [*values, 7]
    assert got["z"]["B"][0] == {"period": "e", "value": 3, "unit": "USD", "form": None, "frame": None}


def test_files_of_a_filing(spark):
    index = {"directory": {"item": [{"name": n} for n in ("b.htm", "A.HTML", "a.html", "R1.htm", "ex10.htm", "x-index.html", "main.htm", "pic.jpg", "b.htm")]}}
    df = spark.createDataFrame([("1", "main.htm", json.dumps(index)), ("2", "only.htm", None)], "accession string, primary_document string, json string")
    got = [(r.accession, r.filename) for r in lookups.filing_files(df).orderBy("accession", "ord").collect()]
    assert got == [("1", "main.htm"), ("1", "A.HTML"), ("1", "a.html"), ("1", "b.htm"), ("2", "only.htm")]


def test_cache_table(spark, tmp_path):
    store = tables.CacheTable(spark, str(tmp_path / "cache"))
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert store.missing(urls, "2030-01-01", 10).count() == 2
    store.put(spark.createDataFrame([("u1", {"a": "b"}, bytearray(b"xyz"))], "url string, headers map<string,string>, content binary"))
    assert [r.url for r in store.missing(urls, datetime.datetime.now(), 3600).collect()] == ["u2"]
    assert store.missing(urls, datetime.datetime(2100, 1, 1), 3600).count() == 2 and store.missing(urls, "2100-01-01", None).count() == 1
    assert store.stats().first().bytes == 3 and bytes(store.newest().first().content) == b"xyz"
    store.clear()
    assert store.stats().first().files == 0


# -- HTTP -------------------------------------------------------------------------------------------------------------


def test_http_retries_and_limits():
    log, naps = [], []
    answers = [(503, {"Retry-After": "99"}, b""), (429, {}, b""), (200, {"Content-Encoding": "gzip"}, gzip.compress(b'{"a": 1}'))]

    def transport(url, headers):
        log.append(url)
        return answers[len(log) - 1]

    clock = [0.0]
    reader = http.HttpReader("me", transport, http.RateLimiter(10, lambda: clock[0], naps.append), naps.append)
    assert reader.fetch_json("u") == {"a": 1} and naps == [60.0, 2.0]
    with pytest.raises(http.HttpError):
        http.HttpReader("me", lambda u, h: (404, {}, b""), sleep=naps.append).fetch("u")
    pauses = []
    limiter = http.RateLimiter(2, lambda: clock[0], pauses.append)
    for _ in range(3):
        limiter.acquire()
    assert pauses == [0.5] and limiter.tokens == 0
    clock[0] += 10  # the bucket holds no more than its rate
    for _ in range(3):
        limiter.acquire()
    assert pauses == [0.5, 0.5]
    broken = [ValueError("short read"), EOFError(), (200, {}, b"ok")]

    def breaks(url, headers):
        answer = broken.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert http.HttpReader("me", breaks, sleep=naps.append).fetch("u")[0] == b"ok" and not broken
    assert http.gunzipped(b"plain", {"content-encoding": "gzip"}) == b"plain"
    assert http.HttpReader("me", lambda u, h: (200, {}, "\xe9".encode("latin-1").join([b'"', b'"']))).fetch_json("u") == "é"


# -- packs, site, commands --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    acc = "0000000042-24-000001"
    recent = {"form": ["8-K", "10-K"], "accessionNumber": ["0000000042-24-000009", acc], "filingDate": ["2024-05-01", "2024-03-01"], "primaryDocument": ["p.htm", "main.htm"]}
    for path, content in {
        "submissions/42.json": json.dumps({"name": "Acme & Co", "filings": {"recent": recent}}),
        f"files/{acc}/main.htm": "<html><body><h1>PART I</h1><h2>ITEM 1. Business</h2><p>We <b>sell</b> caf\xe9.</p><h2>ITEM 2. Properties</h2><p>None.</p></body></html>",
        f"files/{acc}/R2.htm": "<p>no</p>",
        "facts/0000000042.json": json.dumps({"facts": {"dei": {"N": {"units": {"USD": [{"accn": acc, "end": "2023-12-31", "val": 5}]}}}}}),
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content.encode("latin-1"))
    return root


def test_commands_end_to_end(spark, landing, tmp_path, capsys):
    from sectora.cli import main

    out, pages = tmp_path / "packs", tmp_path / "site"
    common = ["--landing", str(landing), "--cik", "42"]
    assert main(["build", *common, "--out", str(out)], spark) == 2
    assert main(["build", *common, "--form", "10-Q", "--out", str(out)], spark) == 1
    for _ in range(2):
        assert main(["build", *common, "--form", "10k", "--out", str(out), "--with-chunks", "--with-xbrl", "--force"], spark) == 0
        folder = out / "0000000042" / "0000000042-24-000001"
        manifest = (folder / "manifest.json").read_text()
    m = json.loads(manifest)
    assert manifest.endswith("}\n") and m["generated_at"] == "2024-03-01T00:00:00Z" and [s["id"] for s in m["sections"]] == ["10k_parti_item1_business", "10k_parti_item2_properties"]
    for path, digest in m["artifacts"].items():
        assert hashlib.sha256((folder / path).read_bytes()).hexdigest() == digest
    assert {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")} == {*m["artifacts"], "manifest.json"}
    assert "We **sell** café." in (folder / "filing.full.md").read_text() and '"value": 5' in (folder / "optional/xbrl.json").read_text()
    capsys.readouterr()
    assert main(["build", *common, "--form", "10k", "--out", str(out)], spark) == 0 and "Pack already exists, use --force to rebuild" in capsys.readouterr().out
    (folder / "sections/stale.md").write_text("of an older build")
    assert main(["build", *common, "--form", "10k", "--out", str(out), "--with-chunks", "--with-xbrl", "--force"], spark) == 0 and not (folder / "sections/stale.md").exists()
    (out / "0000000042/.DS_Store").write_text("x")
    assert json.loads((folder / "optional/chunks.ndjson").read_text().splitlines()[0])["section_id"] == "10k_parti_item1_business"
    assert main(["company-llms", *common, "--out", str(out)], spark) == 0
    assert (out / "0000000042/llms.txt").read_text() == "# Acme & Co SEC Filings\n\n> CIK: 0000000042\n\n## Recent Filings\n\n- [10-K 2024-03-01](0000000042-24-000001/llms.txt)\n"
    assert main(["list", *common, "--limit", "1"], spark) == 0 and "2024-05-01" in capsys.readouterr().out
    assert main(["site", "--packs", str(out), "--out", str(pages)], spark) == 0
    for path in ("index.html", "0000000042/index.html", "0000000042/0000000042-24-000001/index.html", "0000000042/0000000042-24-000001/full.html", "0000000042/0000000042-24-000001/sections/parti_item1_business.html", "0000000042/0000000042-24-000001/manifest.json"):
        assert (pages / path).exists(), path
    assert "Acme &amp; Co (0000000042)" in (pages / "index.html").read_text() and not (pages / "0000000042/.DS_Store").exists()
    legacy = out / "0000000042/000000004224000001"
    folder.rename(legacy)
    capsys.readouterr()
    assert main(["build", *common, "--form", "10k", "--out", str(out)], spark) == 0 and "(legacy layout)" in capsys.readouterr().out and not folder.exists()
    store = tables.CacheTable(spark, str(tmp_path / "kept"))
    store.put(spark.createDataFrame([("u1", {"a": "b"}, bytearray(b"xyz"))], "url string, headers map<string,string>, content binary"))
    assert main(["cache", "--cache", str(tmp_path / "kept")], spark) == 0 and main(["cache", "clear", "--cache", str(tmp_path / "kept")], spark) == 0
    assert not (tmp_path / "kept").exists()


def test_remote_build_from_http_to_pack(spark, tmp_path, capsys):
    from sectora.cli import main

    acc, top = "0000000042-24-000001", "https://www.sec.gov/Archives/edgar/data/0000000042/000000004224000001"
    recent = {"form": ["10-K"], "accessionNumber": [acc], "filingDate": ["2024-03-01"], "primaryDocument": ["main.htm"]}
    index = {"directory": {"item": [{"name": n} for n in ("b.htm", "main.htm", "gone.htm", "R1.htm", "ex1.htm")]}}
    page = "<h2>ITEM 1. Business</h2><p>{}</p>"
    site_map = {
        "https://data.sec.gov/submissions/CIK0000000042.json": json.dumps({"name": "Acme", "filings": {"recent": recent}}).encode(),
        f"{top}/index.json": json.dumps(index).encode(),
        f"{top}/main.htm": page.format("caf\xe9").encode("latin-1"),
        f"{top}/b.htm": b"<p>Second part</p>",
        "https://data.sec.gov/api/xbrl/companyfacts/CIK0000000042.json": json.dumps({"facts": {"dei": {"N": {"units": {"USD": [{"accn": acc, "end": "2023-12-31", "val": 1.5}]}}}}}).encode(),
    }
    log = tmp_path / "log"

    def make_reader():
        def transport(url, headers):
            with log.open("a") as f:
                f.write(url + "\n")
            return (200, {}, site_map[url]) if url in site_map else (404, {}, b"")

        return http.HttpReader("me", transport)

    argv = ["build", "--cache", str(tmp_path / "cache"), "--cik", "42", "--form", "10-K", "--out", str(tmp_path / "packs"), "--with-xbrl"]
    assert main(argv, spark, make_reader) == 0
    asked = log.read_text().split()
    assert sorted(asked) == sorted([*site_map, f"{top}/gone.htm"])  # each once, exhibits and rendered files never
    assert "Failed to fetch gone.htm: HTTP 404" in capsys.readouterr().err
    folder = tmp_path / "packs/0000000042" / acc
    assert "café" in (folder / "filing.full.md").read_text() and "Second part" in (folder / "filing.full.md").read_text() and '"value": 1.5' in (folder / "optional/xbrl.json").read_text()
    assert main([*argv, "--form", "10-K", "--force"], spark, make_reader) == 0 and len(log.read_text().split()) == 2 * len(asked)
    log.write_text("")
    assert main(["list", "--cache", str(tmp_path / "cache"), "--cik", "42"], spark, make_reader) == 0 and not log.read_text()


def test_built_filings_are_left_out(spark):
    row = ("0000000001", "0000000001-24-000001", "10-K", datetime.date(2024, 1, 15), "C", "m.htm", "<p>free text</p>")
    filings = spark.createDataFrame([row], "cik string, accession string, form_type string, filing_date date, company_name string, primary_document string, html string")
    built = spark.createDataFrame([("0000000001", "000000000124000001")], "cik string, accession string")
    assert pack.build_packs(filings, built=built).manifests.count() == 0
    r = pack.build_packs(filings).summary().first()
    assert r.sections_count == 1 and r.warnings[0].startswith("No section headings")
    pages = site.filing_overview(pack.build_packs(filings).manifests).first()
    assert "<h2>SECTIONS</h2>" in pages.html
    manifest = next(f.content for f in pack.build_packs(filings).files.collect() if f.path.endswith("manifest.json"))
    assert manifest.startswith('{\n  "artifacts": {\n    "filing.full.md": "') and '"generated_at": "2024-01-15T00:00:00Z"' in manifest and manifest.endswith("}\n")


def test_a_build_reads_its_html_once_and_shuffles_nothing(spark):
    row = ("0000000001", "0000000001-24-000001", "10-K", datetime.date(2024, 1, 15), "C", "m.htm", "<h2>Item 1. A</h2><p>" + "One sentence. " * 900 + "</p><h2>Item 2. B</h2>")
    filings = spark.createDataFrame([row], "cik string, accession string, form_type string, filing_date date, company_name string, primary_document string, html string")
    packs = pack.build_packs(filings, with_chunks=True)
    plan = packs.files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("over(") + plan.count("clean(") <= 12
    files = {f.path.split("/", 2)[2]: f.content for f in packs.files.collect()}
    lines = [json.loads(x) for x in files["optional/chunks.ndjson"].splitlines()]
    assert [x["chunk_index"] for x in lines] == [0, 1, 2, 0] and "".join(x["text"] for x in lines[:3]) == files["sections/10k_item1_a.md"]
    assert all(json.loads(files["manifest.json"])["artifacts"][p] == hashlib.sha256(c.encode()).hexdigest() for p, c in files.items() if p != "manifest.json")


def test_packs_with_a_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sectora.functions import tokens

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    row = ("0000000001", "0000000001-24-000001", "10-K", datetime.date(2024, 1, 15), "C", "m.htm", "<h2>Item 1. A</h2><p>" + "One sentence here. " * 300 + "</p>")
    filings = spark.createDataFrame([row], "cik string, accession string, form_type string, filing_date date, company_name string, primary_document string, html string")
    packs = pack.build_packs(filings, with_chunks=True, max_tokens=200, ranks=ranks)
    count = lambda x: len(tokens.encoder(ranks).encode_ordinary(x))
    r = packs.rows.first()
    assert r.tokens_total == count(r.markdown) and r.manifest.sections[0].tokens_approx == count(r.sections[0].content) and r.warnings == []
    assert len(r.chunks) > 3 and all(c.tokens == count(c.text) <= 200 for c in r.chunks)


def test_streaming_ingest(spark, tmp_path):
    from sectora.streaming.ingest import FILINGS, ingest_sections

    land, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = lambda n: ("1", f"a{n}", "8-K", datetime.date(2024, 1, 1), "C", "m.htm", "<p>Item 2.02 Results</p>")
    for batch in ([1, 1], [2, 1], [2, 3, 3]):  # filings come again within a batch and in later ones
        spark.createDataFrame([row(n) for n in batch], FILINGS).write.mode("append").parquet(land)
        ingest_sections(spark, land, target, state)
    assert sorted(r.accession for r in spark.read.parquet(target).collect()) == ["a1", "a2", "a3"]


def test_pluggable_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sectora.functions import tokens

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    body = "One sentence here. Another one follows! " * 40 + "x" * 500
    assert column(spark, lambda c: tokens.count_tokens(c), body, "") == [len(body) // 4, 0]
    n = len(tokens.encoder(ranks).encode_ordinary(body))
    assert column(spark, lambda c: tokens.count_tokens(c, ranks), body, "") == [n, 0]
    assert body.startswith(column(spark, lambda c: tokens.truncate(c, 5, ranks), body)[0])
    got = tokens.spans_by_tokens(body, 30, ranks)
    assert got[0][0] == 0 and got[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert all(len(tokens.encoder(ranks).encode_ordinary(body[a:b])) <= 30 for a, b in got)
