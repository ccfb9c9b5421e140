"""The ten operators against brute force, round trips and held-out accuracy; nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import textwrap
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sectora.llm import chat, common, decontaminate, embeddings, html_extract, jaccard, language, licences, packing, toxicity, warc
from tests import oracle

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, set_id string, salt string, w string"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(None if i is None else i, t, "en", "s", None, 0.5, "x", "y", "z") for i, t in (texts if isinstance(texts[0] if texts else (), tuple) else enumerate(texts, start))], DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -- 1: decontamination -----------------------------------------------------------------------------------------------

ITEM = "Yesterday Alice bought 12 apples and 3 km of rope, then Alice gave 12 apples to her friend Robert who lives far away in the old town near the river."


def test_template_windows_and_slots(spark):
    again = ITEM.replace("Alice", "Maria").replace("12", "45").replace("Robert", "Peter").replace("3 km", "7 miles")
    torn = ITEM.replace("Alice bought 12", "Alice bought 45").replace("then Alice", "then Maria").replace("friend Robert", "friend Zoe")
    other = " ".join(words(random.Random(1), 60))
    docs = documents(spark, [f"start {ITEM} end", f"{other}. {again}", None, "", "short", other, torn.replace("Yesterday Alice", "Yesterday Zoe"), ITEM] + [ITEM])
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (None, ITEM), (10, "an entirely different question about ships and the weather of the northern seas")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, bench).collect()}
    assert {(0, 7), (1, 7), (7, 7), (8, 7)} <= got
    assert not {d for d, _ in got} & {2, 3, 4, 5, 6}
    report = decontaminate.decontamination_report(docs, bench)
    assert report.count() == 9 and {r.doc_id for r in report.where("leaks").collect()} == {d for d, _ in got}
    assert decontaminate.decontamination_report(docs.limit(0), bench).count() == 0
    assert not decontaminate.decontamination_report(docs, bench.limit(0)).where("leaks").count()


def test_tokens_agree_and_plan_is_native(spark):
    docs = common.table(spark, SF, "documents").union(spark.createDataFrame([(1, "A. Bob's 3.5km, 1,200 kg x1y2 Ünder Öl", "", "", 1)], "a long, b string, c string, d string, e long"))
    tokens = docs.select(decontaminate.template_tokens(F.col("text")).alias("a"), F.transform(decontaminate.marked_tokens(F.col("text")), decontaminate._template).alias("b"))
    assert tokens.where("a <> b").count() == 0
    plan = decontaminate.decontamination_report(common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_whole_items_are_found(spark):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    expect = {(d, i) for d, t in texts.items() for i, q in items.items() if q in (t or "")}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, bench).collect()} >= expect


def test_slots_are_judged_over_all_alignments(spark):
    item = "Alice paid 12 coins for the red boat that Alice saw near the old harbour and then Alice sold 12 nets to the men who came from the far north coast"
    again = item.replace("Alice", "Maria").replace("12", "45")
    words_of = again.split()
    moved = " ".join([*words_of[:13], "slowly", *words_of[13:]])
    first, second = " ".join(words_of[:13]), " ".join(words_of[13:]).replace("Maria", "Zoe").replace("45", "99")
    docs = documents(spark, [f"So {moved}", f"So {first} slowly {second}", f"So {again}. Then {again.replace('Maria', 'Zoe').replace('45', '99')}"])
    bench = spark.createDataFrame([(1, f"Then {item}")], "item_id long, text string")
    got = {r.doc_id: (r.coverage, r.consistent) for r in decontaminate.leaked_items(docs, bench).collect()}
    assert set(got) == {0, 2} and got[0][0] > 0.9 and got[0][1] and got[2][0] > 0.9


def brute_leaks(docs, items):
    """All pairs, all alignments, token by token; docs and items are lists of marked tokens by id."""
    mark = {decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT}
    value = lambda t: t[1:] if t[0] in mark else t
    template = lambda t: t[0] if t[0] in mark else t
    folded = lambda t: t[0] if t[0] in mark - {decontaminate.NAME} else value(t)
    w, out = decontaminate.WINDOW, set()
    for d, dt in docs:
        for i, q in items:
            if len(q) < decontaminate.LEAST:
                continue
            deltas = set()
            for form, needs_name in ((folded, False), (template, True)):
                a, b = [form(t) for t in q], [form(t) for t in dt]
                for x in range(len(a) - w + 1):
                    for y in range(len(b) - w + 1):
                        if a[x : x + w] == b[y : y + w] and (not needs_name or decontaminate.NAME in a[x : x + w]):
                            deltas.add(y - x)
            found = []
            for delta in deltas:
                m = [k for k in range(len(q)) if 0 <= k + delta < len(dt) and (template(q[k]) == template(dt[k + delta]) or value(q[k]) == value(dt[k + delta]))]
                if sum(template(q[k]) == q[k] for k in m) >= decontaminate.PLAIN:
                    slots = frozenset((q[k], value(dt[k + delta])) for k in m if template(q[k]) != q[k])
                else:
                    m, slots = [k for k in m if value(q[k]) == value(dt[k + delta])], frozenset()
                if m and len(slots) == len({a for a, _ in slots}):
                    found.append((-len(m), m, slots))
            places, held = set(), {}
            for _, m, slots in sorted(found, key=lambda f: f[:2]):
                if all(held.get(a, b) == b for a, b in slots):
                    places |= set(m)
                    held.update(slots)
            if len(places) >= decontaminate.LEAST and len(places) >= decontaminate.COVERAGE * len(q):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    names, plain = ["Alice", "Bob", "Clara", "Dmitri", "Eva"], [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("rt", "sk", "pf", "ld", "mb", "st")]
    items = [(k, " ".join(["So", *(rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(names), str(rng.randrange(9)), f"{rng.randrange(9)} km"]) for _ in range(rng.randrange(9, 30)))])) for k in range(12)]
    texts = []
    for _ in range(120):
        _, text = rng.choice(items)
        swap = {n: rng.choice(names) for n in names} if rng.random() < 0.6 else {}
        figure = {str(n): str(rng.randrange(9)) for n in range(9)} if rng.random() < 0.6 else {}
        w = [figure.get(swap.get(t, t), swap.get(t, t)) for t in text.split()]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(1, len(w))
            w[at : at + rng.randrange(0, 2)] = [rng.choice(plain + names)] * rng.randrange(0, 2)
        texts.append(" ".join([*(rng.choice(plain) for _ in range(5)), *w, *(rng.choice(plain) for _ in range(5))]))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = lambda df, key: [(r[0], r[1]) for r in df.select(key, decontaminate.marked_tokens(F.col("text"))).collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, bench).collect()}
    expect = brute_leaks(marked(docs, "doc_id"), marked(bench, "item_id"))
    assert got == expect and 30 < len(expect) < 400


def test_every_window_case_and_length_is_sought(spark):
    rng = random.Random(8)
    plain = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base = plain(12)
    edited = [*base[:1], "edit", *base[2:8], "edit", *base[9:]]  # equal runs of 1, 6 and 3 tokens
    dense = "Then Paris 12 Rome 14 Oslo 16 Bern 18 Kiev 20 Riga 22 Baku 24"
    pad = [" ".join(plain(k)) for k in (30, 31, 32)]
    texts = [f"{p} {' '.join(edited)} {p}" for p in pad]
    texts += [f"so {dense} so", "so Then Zagreb 5 Lima 6 Cairo 7 Quito 8 Seoul 9 Tunis 3 Hanoi 4 so"]
    texts += [ITEM.upper(), ITEM.title(), ITEM.lower(), f"{pad[0]} what is 3.5 plus 7? {pad[1]}", f"{pad[0]} What is 3.7 plus 7? {pad[1]}", "WHERE IS OSLO", "where is Oslostad"]
    items = [(1, " ".join(base)), (2, dense), (3, ITEM), (4, "What is 3.5 plus 7?"), (5, "Where is Oslo?")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (5, 3), (6, 3), (7, 3), (8, 4), (10, 5)}
    odd = [ITEM, ITEM.upper(), ITEM.title(), "3 Kg of 4 KM, 1,200.5 M x1Y2 Öl", dense, None]
    sizes = documents(spark, odd).select(F.size(decontaminate.template_tokens(F.col("text"))).alias("a"), F.size(decontaminate.folded_tokens(F.col("text"))).alias("b"))
    assert sizes.where("a <> b").count() == 0


# -- 2: packing -------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    odd = [None, "", "it's <|endoftext|> ÀÉ İ ﬁ a\x1cb \u2003 'tis", "word " * 9000, "x" * 300]
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()} | {10_000 + i: t for i, t in enumerate(odd)}
    rows = packing.pack_pieces(common.written(packing.token_pieces(documents(spark, [*texts.items(), (10_001, "")]), PATH), "t"), group_pieces=40).collect()
    expect = collections.Counter()
    for d, t in [*texts.items(), (10_001, "")]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.asarray(ids[k : k + 4096], "<u4")
            expect[d, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    bound = packing.bins_needed(np.bincount([r.length for r in rows], minlength=4097))
    assert bound <= len(bins) <= bound * 1.02 + 1
    assert packing.pack_documents(documents(spark, [(1, "a")]).limit(0), PATH).count() == 0


def test_pieces_of_odd_texts_have_the_tokenizers_ids(monkeypatch):
    from tokenizers import Tokenizer

    rng, tok, chars = random.Random(1), Tokenizer.from_file(PATH), "abzAZ019 .,!'<>|éÉ×÷ßÿÀ\n\t\x1c\x0b\u2003\xa0日😀İΣ-_"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "<|endoftext|> x<|startoftext|>y", "Don't 'tis I'M"]
    monkeypatch.setattr(packing, "BATCH", 3000)
    monkeypatch.setattr(packing, "CACHE", 500)
    coder = packing.CachedEncoder(PATH)
    assert coder.split and coder.bare
    assert [np.frombuffer(r, "<u4").tolist() for r in coder.encode_many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_of_null_ids_and_repeats(spark):
    rows = packing.pack_documents(documents(spark, [(None, "a b"), (None, "a b"), (3, None), (3, None)]), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == [(False, 3, 0, 0, 1)] * 2 + [(True, 0, 0, 0, 3)] * 2
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == sorted({r.offset for r in rows})


def test_bounds_never_exceed_an_optimum():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.integers(1, 100, rng.integers(1, 9))
        bound = packing.bins_needed(np.bincount(lengths, minlength=101), 100)
        best = packing.best_fit_decreasing(lengths, 100)[2]

        def fits(k, items, loads):
            if not items:
                return True
            return any(loads[b] + items[0] <= 100 and fits(k, items[1:], [*loads[:b], loads[b] + items[0], *loads[b + 1 :]]) for b in range(k))

        optimum = next(k for k in range(1, 10) if fits(k, sorted(map(int, lengths), reverse=True), [0] * k))
        assert bound <= optimum <= len(best)
    assert packing.bins_needed(np.bincount([60] * 5, minlength=101), 100) == 5


def test_packed_sequences_hold_the_ids(spark):
    docs = documents(spark, ["a b", "c"])
    ids = sorted(x for r in packing.packed_sequences(docs, PATH).collect() for x in r.ids)
    assert len(ids) == 5 and ids[:2] == [1, 1]


# -- 3: HTML ----------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body><div id="cookie-notice">cookies</div><nav><a href=/>Home</a></nav>
<div class="wrap-{n}"><div class="sidebar">side</div><article class="post-{n}"><h1>Title &amp; {n}</h1><p>One <b>bold</b>er&nbsp;text.<p>Two<br>lines
<form><input>find</form><ul><li>a<li>b</ul></article><section id="comments"><article class="comment">nice</article></section></div>
<footer>foot</footer><script>var a = "</p>";</script></body></html>"""


def test_main_text_by_host_consensus(spark):
    rows = [(i, f"https://u@H.example:8{i}/p?{i}", PAGE.replace("{n}", str(i)), "q", "r") for i in range(5)]
    rows += [(5, "https://h.example/x", "<html><body><p>only this</p></body></html>", "q", "r"), (6, None, None, "q", "r"), (7, "nonsense", "", "q", "r"), (7, "nonsense", "plain <i>te</i>xt", "q", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string")
    got = sorted(html_extract.extract_main_text(pages).collect(), key=lambda r: (r.page_id, r.n_chars))
    assert [r.text for r in got[:5]] == [f"Title & {i} One bolder text. Two lines a b" for i in range(5)]
    assert [r.text for r in got[5:]] == ["only this", "", "", "plain text"]
    assert all(r.n_chars == len(r.text) for r in got) and got[0].host == "h.example" and got[0].paths[0] == "html>body>div.wrap-#>article.post-#"
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_nothing_but_boilerplate_is_dropped():
    body = "".join(f"<p>{'long text ' * 20}{i}</p>" for i in range(3))
    long = " ".join(f"{'long text ' * 20}{i}" for i in range(3))
    nav = "<nav>menu</nav>"
    page = html_extract.Page(f"<body>{nav}<article><h1>Head</h1><p>lead</p><div class=body><p>first</p><div><p>second</p><section>{body}</section></div></div></article><footer>foot</footer></body>")
    assert page.extract([]) == page.extract([page.vote()[0]]) == f"Head lead first second {long}"
    halves = html_extract.Page(f"<body>{nav}<div class=a><p>{'one ' * 60}</p></div><div class=b><p>{'two ' * 50}</p></div></body>")
    assert halves.extract(["body>div.a"]) == ("one " * 60 + "two " * 50).strip()
    divs = html_extract.Page(f"<body>{nav}<div class=wrap><h1>Head</h1><p>lead</p><div class=text>{body}</div></div></body>")
    assert divs.extract([divs.vote()[0]]) == f"Head lead {long}"
    two = html_extract.Page(f"<body><div><article>{body}</article></div><article><p>other</p></article></body>")
    assert two.extract([]) == f"{long} other"


def main_text(*parts, paths=()):
    return html_extract.Page("".join(parts)).extract(list(paths))


@pytest.mark.parametrize(
    ("markup", "expect"),
    [
        ("<html><head><title>t</title><body><article><p>Hello world</p></article>", "Hello world"),
        ("<article><p>Pick <select><option>a<option>b<p>Rest</p><p>more</p></article>", "Pick Rest more"),
        ("<article><p>Pick <select><option>a</option></select> of text</p></article>", "Pick of text"),
        ("<article><p>see <svg><path d=x/><text>no</text><p>after</p></article>", "see after"),
        ("<article><p>if <svg/> then <svg><circle/></svg> on</p></article>", "if then on"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then</p></article>", "if x=2 then"),
        ("<article><p>if <math><mi>x</mi><p>after</p></article>", "if x after"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>body</p></article>", "Title body"),
        ("<article><div class=header><h1>Title</h1><i>by X</i></div><p>body</p><address>Main street</address></article>", "Title body Main street"),
        ("<article><p>body</p><div class=refs><ol><li><a href=x>A long reference</a></li></ol></div></article>", "body A long reference"),
        ("<body><div class=header><h1>Site</h1></div><address>x</address><article><p>body</p><noscript>no</noscript></article>", "body"),
        ("<article><p>a</p><noscript><p>js</p><p>more</p></noscript><p>b</p></article>", "a b"),
        ("<article><header><h1><a><span><b><i>Deep title</i></b></span></a></h1><p>byline</p></header><p>b</p></article>", "Deep title b"),
    ],
)
def test_markup_that_once_lost_text(markup, expect):
    assert main_text(markup) == expect


class PlainReader(HTMLParser):
    """Text inside article elements, without the elements of the contract; blocks part words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "meta", "hr", "img", "link", "input"):
            self.open.append(tag)
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.out.append(" ")

    def handle_data(self, data):
        if "article" in self.open and not {"nav", "footer", "script", "style", "form", "aside"} & set(self.open):
            self.out.append(data)


def test_main_text_of_all_pages_equals_a_plain_reader(spark):
    pages = common.table(spark, SF, "pages")
    expect = {}
    for r in pages.collect():
        reader = PlainReader()
        reader.feed(r.html or "")
        reader.close()
        expect[r.page_id] = " ".join("".join(reader.out).split())
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert got == expect and all(expect.values())


def test_ties_of_votes_and_long_pages(spark):
    body = "<p>" + "word &amp; more " * 20 + "</p>"
    a, b = f"<div class=a>{body}</div><nav>menu</nav>", f"<div class=b>{body}</div><nav>menu</nav>"
    long = "<article>" + "".join(f"<p>line {i} <b>x</b></p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://h.example/1", a), (2, "http://h.example/2", b), (3, "http://h.example/3", long), (4, "http://h.example/3", long), (5, None, "<div>" * 20_000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = [{r.page_id: (r.text, r.n_chars, r.paths) for r in html_extract.extract_main_text(pages.repartition(n)).collect()} for n in (1, 3)]
    assert runs[0] == runs[1] and runs[0][5][0] == "deep"
    assert runs[0][1][0] == runs[0][2][0] == " ".join(["word & more"] * 20)
    assert runs[0][3][0] == " ".join(f"line {i} x" for i in range(60_000)) == runs[0][4][0]


def test_broken_markup_does_not_crash():
    rng = random.Random(5)
    parts = ["<p", ">", "</p>", "<div class='a\"b'>", "&amp;", "x", "<!--", "-->", "<script>", "</script", "<td>", "</table>", '"', "<article>", " ", "</body>"]
    for _ in range(500):
        page = html_extract.Page("".join(rng.choice(parts) for _ in range(30)))
        page.extract([page.vote()[0]])
    html_extract.Page("<div>" * 800 + "x").extract([])


# -- 4: toxicity ------------------------------------------------------------------------------------------------------


def toxic_fixture(spark, n=600):
    rng = random.Random(7)
    bad = ["blarg", "snorp", "zonk", "frell", "grunk"]
    texts, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(len(w)), b.upper() + "!")
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    texts += [(n, None), (n + 1, ""), (n + 1, ""), (n + 2, "12 34"), (None, "blarg snorp zonk")]
    return documents(spark, texts), spark.createDataFrame([*labels, (None, 1), (3, None), (n + 50, 1)], "doc_id long, toxic int")


def test_toxicity_held_out_and_edges(spark):
    docs, labels = toxic_fixture(spark)
    report = toxicity.toxicity_report(docs, labels)
    rows = report.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert [r.predicted for r in rows if r.doc_id in (600, 601, 602)] == [0] * 4
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    assert any(r.evidence for r in rows if r.predicted)
    assert toxicity.toxicity_report(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity_report(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0


def test_block_max_search_is_exact():
    rng = random.Random(11)
    terms = [f"t{i}".encode() for i in range(30)]
    vectors = []
    for _ in range(500):
        v = {t: rng.random() for t in rng.sample(range(30), rng.randrange(0, 6))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(terms, np.ones(30), vectors, [rng.randrange(2) for _ in vectors], list(range(500)))
    for q in vectors[:100]:
        full = sorted(((-sum(w * v.get(t, 0) for t, w in q.items()), n) for n, v in enumerate(vectors)))
        brute = [(-s, n) for s, n in full if s < 0][:10]
        got = index.nearest(q, 10)
        assert np.allclose([s for s, _ in got], [s for s, _ in brute])


def test_scores_equal_a_brute_force_reference(spark):
    """Weights, vectors, cosines and votes from the texts and labels alone."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    index = toxicity.train_toxicity_index(docs, labels, common.crc_mod("doc_id", 5) != 0)
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    words_of = {d: collections.Counter(re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())) for d, t in text.items()}
    examples = index.ids.tolist()
    assert len(examples) > 20 and all(zlib.crc32(str(d).encode()) % 5 for d in examples) and index.labels.tolist() == [toxic[d] for d in examples]
    n1, n0 = sum(toxic[d] for d in examples), sum(1 - toxic[d] for d in examples)
    weight = {}
    for w in {w for d in examples for w in words_of[d]}:
        t, c = sum(w in words_of[d] for d in examples if toxic[d]), sum(w in words_of[d] for d in examples if not toxic[d])
        table = [(t, n1), (c, n0), (n1 - t, n1), (n0 - c, n0)]
        share = [(t + c) / (n0 + n1)] * 2 + [1 - (t + c) / (n0 + n1)] * 2
        g = 2 * sum(x * math.log(x / (r * n)) for (x, n), r in zip(table, share, strict=True) if x)
        idf = math.log((len(text) + 1) / (sum(w in ws for ws in words_of.values()) + 1)) + 1
        weight[w] = idf * max(g, 1e-3) ** 2
    assert np.allclose([weight[t] for t in index.terms], index.weight, rtol=1e-6)

    def unit(d):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in words_of[d].items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {d: unit(d) for d in examples}
    for d in list(text)[:80]:
        q = unit(d)
        near = sorted(((sum(x * vectors[e].get(w, 0) for w, x in q.items()), -k) for k, e in enumerate(examples)), reverse=True)[: toxicity.NEIGHBOURS]
        near = [(c, -k) for c, k in near if c > 0]
        got = index.nearest(index.vector(toxicity.words_of(text[d])), toxicity.NEIGHBOURS)
        assert np.allclose([c for c, _ in got], [c for c, _ in near], atol=1e-9)
        if near:
            votes = [1 / (1 - min(1, c) + 0.05) for c, _ in got]
            raw = (sum(v * toxic[examples[k]] for v, (_, k) in zip(votes, got, strict=True)) + index.prior) / (sum(votes) + 1)
            assert abs(raw - index.vote(index.vector(toxicity.words_of(text[d])))[0]) < 1e-9


# -- 5: WARC ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 4])
def test_archives_round_trip(spark, least):
    rows = [(1, "http://a/", "same ü"), (2, "http://b/", "same ü"), (9, None, "same ü"), (3, "http://c c/\r\nX: y", None), (4, "u", ""), (5, "u", "one"), (6, "u", "one"), (6, "u", "one"), (None, "u", "one"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n\0"), (8, "u", "x" * 9_000_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = common.scratch(spark, "t")
    warc.write_archives(pages, path, least)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i or -1, largest.get(h or "", -1))
    for i, _, h in rows:
        body = (h or "").encode()
        r = next(r for r in got if r.page_id == i and r.payload_bytes == len(body))
        revisit = len(body) >= least and i != largest[h or ""]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (largest[h or ""] if revisit else None)
        assert r.payload == (None if revisit else body)
    warc.write_archives(pages.limit(0), common.scratch(spark, "t"))


def test_archive_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 2000)
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([10, 900, 3000])))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = common.scratch(spark, "t")
    warc.write_archives(pages, path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 17 * 2000 + 3000
    assert sorted((r.page_id, r.payload.decode()) for r in warc.read_archives(spark, path).collect()) == [(i, h) for i, _, h in rows]


def test_archives_equal_sql(spark):
    assert oracle.differences(warc.archive_report(common.table(spark, SF, "pages")), oracle.connect(SF), warc.oracle_sql()) == []


def test_damaged_archive_is_refused():
    data = warc.gzip_members(warc.build_record(1, "u", b"payload", None, None))
    assert [b for _, b in warc.parse_archive(data + data)][1].endswith(b"payload")
    with pytest.raises(Exception):
        list(warc.parse_archive(data[:-9]))


# -- 6: language ------------------------------------------------------------------------------------------------------


def test_language_held_out_and_edges(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(90_001, None, "en"), (90_002, "", "en"), (90_003, "12 !? 34", "fr"), (None, "the and of the", None), (90_004, "x", None)], "doc_id long, text string, lang string")
    rows = language.language_report(docs.union(extra)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.lang_pred for r in rows if r.doc_id in (90_001, 90_002, 90_003)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(truth) + 5
    assert language.language_report(docs.limit(0)).count() == 0


def test_windows_cover_the_whole_text():
    model = language.ByteCnn(["a", "b"]).quantised()
    long = ("abc def " * 50_000)[: language.BLOCK + 777]
    codes = np.frombuffer(long.encode() + bytes(-(len(long) + 4) % 256 + 8), np.uint8)
    one = model.log_probs(codes[: (len(codes) - 4) // 256 * 256 + 4])
    assert len(one) == (len(codes) - 4) // 256
    langs, scores = model.predict([long, "abc", None])
    assert langs[2] == "und" and len(scores) == 3


def test_convolution_equals_a_plain_one():
    """int16 tables and shifted additions against a loop over every position, in floating point."""
    model = language.ByteCnn([f"l{i}" for i in range(70)], seed=3)  # any number of languages
    rng = np.random.default_rng(5)
    model.bias += rng.normal(0, 0.1, len(model.bias)).astype(np.float32)
    codes = rng.integers(0, 256, 3 * language.WINDOW + language.LOOKAHEAD, dtype=np.uint8)
    got = model.quantised().log_probs(codes)
    for w in range(3):
        pooled = []
        for width, t in zip(language.WIDTHS, model.tables, strict=True):
            at = range(w * language.WINDOW, (w + 1) * language.WINDOW)
            pooled += [max(sum(t[j, codes[i + j], f] for j in range(width)) for i in at) for f in range(language.FILTERS)]
        logits = np.maximum(np.asarray(pooled) + model.bias, 0) @ model.dense + model.out
        plain = logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        assert np.abs(got[w] - plain).max() < 0.01


def test_predictions_do_not_depend_on_neighbours_or_repeats(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language.train_language_model(docs)
    texts = [r.text for r in docs.collect()]
    alone = [model.predict([t]) for t in texts[:60]]
    together = model.predict(texts[:60] + texts[:60])
    assert [a[0][0] for a in alone] * 2 == together[0] and np.allclose([a[1][0] for a in alone] * 2, together[1])


# -- 7: licences ------------------------------------------------------------------------------------------------------


def test_licences_against_sql_and_edges(spark):
    docs = common.table(spark, SF, "documents")
    assert oracle.differences(licences.scan_licences(docs), oracle.connect(SF), licences.oracle_sql()) == []
    mit = licences.KNOWN[0][1]
    changed = "Copyright (c) 2020 Someone\nAll rights reserved.\n" + mit.upper().replace("LICENSE", "Licence").replace(",", " ,")
    d = documents(spark, [mit, changed, mit + " more words", None, "", "© 2021 A\nreleased under the mit licence", "Licensed under CC BY-NC 4.0.\ntext\nLicensed under CC BY-NC 4.0.", "a license"])
    got = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in licences.scan_licences(d).collect()}
    assert got[0][0] == got[1][0] == "MIT" and got[2][0] is None and got[3] == got[4] == got[7] == (None, "", 0)
    assert got[5] == ("MIT", "MIT", 1) and got[6] == (None, "CC-BY-NC-4.0", 2)
    assert licences.scan_licences(d.limit(0)).count() == 0
    assert "Python" not in licences.scan_licences(d)._jdf.queryExecution().toString()


def test_whole_long_licences_are_known(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    paths = [Path("/usr/share/common-licenses", n) for n in names]
    if not all(p.exists() for p in paths):
        pytest.skip("no licence texts on this machine")
    texts = [p.read_text() for p in paths]
    texts += [texts[0][: texts[0].index("END OF TERMS")], texts[2].replace("\n", "  \r\n"), texts[0].replace("perpetual", "brief")]
    got = {r.doc_id: r.license_id for r in licences.scan_licences(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*names.values(), "Apache-2.0", "GPL-3.0-only", None]


def test_licences_are_known_at_every_line_width(spark):
    long = [(i, t) for i, t in licences.KNOWN if len(t) > 300]
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n, break_long_words=False) for p in t.split("\n\n"))
    rows = [(200 * k + n, f"Copyright (c) 2019 Jane Doe\n\n{wrap(t, n)}") for k, (_, t) in enumerate(long) for n in range(40, 121)]
    got = {r.doc_id: r.license_id for r in licences.scan_licences(documents(spark, rows)).collect()}
    assert got == {200 * k + n: i for k, (i, _) in enumerate(long) for n in range(40, 121)}


def test_a_registry_of_the_caller_needs_no_marker_word(spark):
    docs = documents(spark, [(1, "Do What You Like With It!"), (2, "x\nFree beer for all.\ny"), (None, "Free beer for all."), (3, "Copyright Jane Doe\nfree beer, for ALL")])
    got = {r.doc_id: (r.license_id, r.n_notices) for r in licences.scan_licences(docs, known=[("like", "do what you like with it"), ("beer", "Free beer for all")], full=()).collect()}
    assert got == {1: ("like", 1), 2: (None, 1), 3: ("beer", 1), None: (None, 0)}


def test_every_known_text_holds_a_marker():
    assert all(re.search(licences.MARKER, t, re.I) for _, t in licences.KNOWN)


# -- 8: Jaccard join --------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, n, percent):
    rng = random.Random(percent)
    rows = []
    for _ in range(25):
        base = words(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 30, 60, 120, 300]), 300)
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            if rng.random() < 0.4:
                w = w[: len(w) - rng.randrange(0, 1 + len(w) // 10)] + words(rng, rng.randrange(0, 1 + len(w) // 12), 300)
            rows.append((len(rows), "\n".join(w) if rng.random() < 0.2 else " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    passage = " ".join(words(rng, 60))
    rows += [(len(rows) + i, " ".join(words(rng, 20 + 4 * i)) + " " + passage) for i in range(12)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "a\x1cb")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("percent", [10, 40, 55, 67, 100])
def test_jaccard_of_nested_sets_at_other_percentages(spark, percent):
    rng = random.Random(percent)
    rows = []
    for _ in range(12):
        base = words(rng, 160)
        for share in rng.sample([0.05, 0.12, 0.2, 0.35, 0.42, 0.5, 0.57, 0.66, 0.7, 0.8, 0.9, 1.0], 5):
            rows.append((len(rows), " ".join(base[: int(share * len(base))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), 3, percent).collect()}
    assert got == brute_components(rows, 3, percent)
    with pytest.raises(ValueError):
        jaccard.jaccard_components(documents(spark, rows), 3, 101)


def test_jaccard_of_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = words(rng, 70)
    rows = []
    for i in range(500):  # edits from a small vocabulary meet again in other copies
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85)
    assert len({c for _, c in got.values()}) > 20


def test_jaccard_equals_sql(spark):
    assert oracle.differences(jaccard.jaccard_components(common.table(spark, SF, "documents")), oracle.connect(SF), jaccard.oracle_sql()) == []


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "a b c d e"), (None, None), (7, None)]
    got = [(r.doc_id, r.component_id, r.n_shingles) for r in jaccard.jaccard_components(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(3, 3, 2), (5, 3, 2), (5, 3, 2), (7, 7, 0), (None, None, 0), (None, None, 2), (None, None, 2)], key=repr)
    assert jaccard.jaccard_components(documents(spark, rows).limit(0)).count() == 0


def test_signatures_meet_for_every_linking_pair():
    rng = np.random.default_rng(9)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        cut, add = int(rng.integers(0, 1 + n // 6)), int(rng.integers(0, 1 + n // 6))
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            (x, need), (y, as_many) = jaccard.signatures(a), jaccard.signatures(b)
            assert len(np.intersect1d(x, y)) >= max(need, as_many)


def test_long_texts_are_hashed_whole():
    text = " ".join(words(random.Random(2), 90_000))
    small = jaccard.CHUNK
    try:
        jaccard.CHUNK = 1000
        cut = jaccard.ngram_sets([text, "x y"])
    finally:
        jaccard.CHUNK = small
    assert (cut[0] == jaccard.ngram_sets([text])[0]).all() and len(cut[1]) == 1


# -- 9: chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    nasty = ["", None, "\\", "###", "####", "</turn>", "\\</turn>", "### Assistant: x\n</turn>\n", "\n", "a\\###b</turn", "ünï 😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "Wei:rd\nrole", None, ""]), "".join(rng.choice(nasty) or "" for _ in range(3)) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat.chat_report(turns).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        groups[c].append((t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        replies = "".join(x for _, r, x in g if r == "assistant")
        assert got[c].n_turns == len(g) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest()
        assert got[c].loss_chars == len(replies) and got[c].loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    examples = chat.prefix_target_examples(turns).collect()
    assert sum(e.loss_end > e.loss_start or chat.parse(e.text)[-1][0] == "assistant" for e in examples) == sum(r[2] == "assistant" for r in rows)
    assert chat.prefix_target_examples(turns.limit(0)).count() == 0


def test_chat_equals_sql(spark):
    assert oracle.differences(chat.chat_report(common.table(spark, SF, "conversations")), oracle.connect(SF), chat.oracle_sql()) == []


# -- 10: embeddings ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2048, 7])
def test_cosine_components_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))
    rows = [v + rng.normal(size=16) * s for v in x for s in (0, 0.05, 0.1)] + [x[0]] * 12 + [3 * x[1]]
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [float("inf")] * 16), (905, []), (906, [1e-30, 0.0]), (907, [2e-30, 0.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(i, v, "q", 1) for i, v in data + odd], "vec_id long, embedding array<float>, rep string, mult int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.cosine_components(frame).collect()}
    u = embeddings._unit([v for _, v in data])
    near = u @ u.T >= 0.95
    root = list(range(len(data)))
    for _ in data:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(data))]
    missed = sum(abs(got[i][0] - (near[i].sum() - 1)) for i in range(len(data)))
    assert missed <= 0.02 * near.sum()
    assert sum(got[i][1] != root[i] for i in range(len(data))) <= 2
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905)) and got[906][1] == got[907][1] == 906
    assert embeddings.cosine_components(frame.limit(0)).count() == 0


def test_cosines_equal_sql(spark):
    assert oracle.differences(embeddings.cosine_components(common.table(spark, SF, "embeddings")), oracle.connect(SF), embeddings.oracle_sql()) == []


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embeddings._unit(rng.normal(size=(4000, 48)).tolist())
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    a, b = embeddings.sketches(x).view(np.uint64), embeddings.sketches(embeddings._unit(y.tolist())).view(np.uint64)
    assert np.bitwise_count(a ^ b).sum(1).max() <= embeddings.sketch_limit(0.95) < 40


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
