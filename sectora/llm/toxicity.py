"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled texts with every word of theirs.  A
word's weight is its TF-IDF times the square of its contrast between the labels (the
log-likelihood ratio of its document frequencies in the sample): by plain TF-IDF the
rare filler words would decide the cosine.  No word is left out; a word that the
examples lack has no contrast and no weight.  The cosine over these vectors is exact,
document frequencies are counted over all documents, and block maxima only skip
blocks that cannot enter the top k.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, released, written

LEARN_TOXIC = 1500  # bound: labelled examples with label 1
LEARN_CLEAN = 2500  # bound: labelled examples with label 0
NEIGHBOURS = 15
BLOCK = 64  # examples per posting block
SHARES = (0.05, 0.01, 0.0)  # of a query's weight that may be open when candidates are looked at
FEW = 100  # candidates that are compared exactly; with more, lighter terms are added first
THRESHOLD = 0.5
LEAST_CONTRAST = 1e-3  # of a word that is as frequent under either label
#: Bytes to words: ASCII letters in lower case and all bytes of non-ASCII letters stay, the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased letter runs of the whole text."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _example_words(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, word, sketch): distinct words of each labelled text with three min-hashes of its word triples."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            ids, toxic, words, sketches = [], [], [], []
            for doc_id, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words_of(text)
                grams = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                sketches.append([min(zlib.crc32(g, seed) for g in grams) for seed in (0, 1, 2)])
                ids.append(doc_id)
                toxic.append(label)
                words.append([x.decode("utf-8", "replace") for x in sorted(set(w))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "toxic", "words", "sketch"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words array<string>, sketch array<long>")


def labelled_sample(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """At most LEARN_TOXIC and LEARN_CLEAN labelled texts with the smallest hash of doc_id (labels of one document must agree)."""
    agreed = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(learn)
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high")
    )
    u = F.xxhash64("doc_id")
    picked = [agreed.where(F.col("toxic") == label).select("doc_id", "toxic").orderBy(u, "doc_id").limit(bound) for label, bound in ((1, LEARN_TOXIC), (0, LEARN_CLEAN))]
    chosen = picked[0].union(picked[1])  # at most LEARN_TOXIC + LEARN_CLEAN rows: safe to broadcast
    one = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return one


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


_LOADED: dict[str, BlockMaxIndex] = held_by(__name__)


def _restored(key: str, terms: bytes, *rest) -> BlockMaxIndex:
    """An index that came to a worker: its postings are made there, once for all tasks."""
    if key not in _LOADED:
        _LOADED.clear()
        *arrays, slope, offset = rest
        index = BlockMaxIndex(terms.split(b" ") if terms else [], *arrays)
        index.slope, index.offset, index.key = slope, offset, key
        _LOADED[key] = index
    return _LOADED[key]


class BlockMaxIndex:
    """Unit vectors of the examples, by example and as postings, in blocks of examples with the largest weight of each term.

    ``vectors`` are dicts from term number to weight, or three arrays: the first entry
    of each example (and the end), terms and weights of the entries.
    """

    def __init__(self, terms: list[bytes], weight: np.ndarray, vectors, labels: list[int], ids: list[int]):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.weight, self.labels, self.ids = np.asarray(weight, np.float64), np.asarray(labels, np.float64), np.asarray(ids, np.int64)
        self.blocks = -(-len(self.ids) // BLOCK)
        if not isinstance(vectors, tuple):
            ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
            vectors = ends, np.fromiter((t for v in vectors for t in v), np.int32, ends[-1]), np.fromiter((w for v in vectors for w in v.values()), np.float64, ends[-1])
        self.rows, self.entry_term, self.entry_weight = vectors
        self.key = uuid.uuid4().hex
        sizes = np.diff(self.rows)
        example = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(self.entry_term, kind="stable")
        self.posting_example, self.posting_weight = example[order], self.entry_weight[order]
        self.postings = np.searchsorted(self.entry_term[order], np.arange(len(terms) + 1))
        # the largest weight of each term in each block that holds it
        place = self.entry_term[order].astype(np.int64) * max(1, self.blocks) + self.posting_example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        self.peak = np.maximum.reduceat(self.posting_weight, first) if len(first) else np.zeros(0)
        self.peak_block = (place[first] % max(1, self.blocks)).astype(np.int32)
        self.peaks = np.searchsorted(place[first] // max(1, self.blocks), np.arange(len(terms) + 1))
        self.top = np.zeros(len(terms))  # largest weight of each term
        np.maximum.at(self.top, place[first] // max(1, self.blocks), self.peak)
        blank = sizes == 0
        # a text without an index term is as near to every example without one: their labels, with one vote of the prior
        prior = (self.labels.sum() + 1) / (len(self.ids) + 4)  # a quarter where nothing is known
        self.prior = prior
        self.blank = float((self.labels[blank].sum() + prior) / (blank.sum() + 1))
        self.slope, self.offset = 1.0, 0.0
        self.query = np.zeros(len(terms))  # scratch: weights of the query at hand

    def __reduce__(self):
        return _restored, (self.key, b" ".join(self.terms), self.weight, (self.rows, self.entry_term, self.entry_weight), self.labels, self.ids, self.slope, self.offset)

    def example(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of an example."""
        return self.entry_term[self.rows[n] : self.rows[n + 1]], self.entry_weight[self.rows[n] : self.rows[n + 1]]

    def arrays(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index terms of a text and their weights in its unit vector."""
        found = np.fromiter(map(self.terms.get, words, itertools.repeat(-1)), np.int64, len(words))
        terms, n = np.unique(found[found >= 0], return_counts=True)
        w = (1 + np.log(n)) * self.weight[terms]
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def vector(self, words: list[bytes]) -> dict[int, float]:
        """Unit vector of a text over the index terms."""
        terms, w = self.arrays(words)
        return dict(zip(terms.tolist(), w.tolist(), strict=True))

    def _exact(self, examples: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of the query with some examples, from their own entries."""
        sizes = self.rows[examples + 1] - self.rows[examples]
        at = _slices(self.rows[examples], sizes)
        self.query[terms] = weights
        each = self.query[self.entry_term[at]] * self.entry_weight[at]
        self.query[terms] = 0
        return np.bincount(np.repeat(np.arange(len(examples)), sizes), each, len(examples))

    def nearest(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, exact, ties by position; ``skip`` leaves one example out.

        Postings are added up from the heaviest terms on, until what the block maxima
        of the lighter terms allow leaves few blocks, and in them few examples, that
        can still enter the top k; those are compared exactly.
        """
        if isinstance(query, dict):
            query = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        terms, weights = query
        if not len(terms) or not len(self.ids):
            return []
        order = np.argsort(-weights * self.top[terms], kind="stable")
        terms, weights = terms[order], weights[order]
        rest = np.concatenate([np.cumsum((weights * self.top[terms])[::-1])[::-1], [0.0]])  # what terms from each place on can add
        score = np.zeros(len(self.ids))
        done = 0
        for share in SHARES:
            upto = int(np.argmax(rest <= share * rest[0]))
            if upto > done:
                part, w = terms[done:upto], weights[done:upto]
                lengths = self.postings[part + 1] - self.postings[part]
                at = _slices(self.postings[part], lengths)
                score += np.bincount(self.posting_example[at], np.repeat(w, lengths) * self.posting_weight[at], len(score))
                done = upto
            if skip >= 0:
                score[skip] = 0
            floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
            if done == len(terms):
                found = np.flatnonzero(score >= max(floor, 1e-300))
                cosine = score[found]
                break
            if floor > rest[done]:
                found = np.flatnonzero(score + rest[done] >= floor - 1e-9)
                if len(found) > FEW:
                    part, w = terms[done:], weights[done:]
                    lengths = self.peaks[part + 1] - self.peaks[part]
                    at = _slices(self.peaks[part], lengths)
                    light = np.bincount(self.peak_block[at], np.repeat(w, lengths) * self.peak[at], self.blocks)
                    found = found[score[found] + light[found // BLOCK] >= floor - 1e-9]
                if len(found) <= FEW:
                    cosine = self._exact(found, terms, weights)
                    break
        best = np.lexsort((found, -cosine))[:k]
        best = best[(cosine[best] > 0) & (found[best] != skip)]
        return list(zip(cosine[best].tolist(), found[best].tolist(), strict=True))

    def vote(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, list[tuple[float, int]]]:
        """Share of label 1 among the nearest examples, each weighing 1 / (distance + 0.05), with one vote of the prior."""
        near = self.nearest(query, NEIGHBOURS, skip)
        if not near:
            return self.blank, near
        w = np.asarray([1 / (1 - min(1.0, s) + 0.05) for s, _ in near])
        y = self.labels[[n for _, n in near]]
        return float((w @ y + self.prior) / (w.sum() + 1)), near

    def calibrate(self) -> BlockMaxIndex:
        """Platt scaling on leave-one-out votes of the examples that hold an index term."""
        pairs = [(self.vote(self.example(n), n)[0], self.labels[n]) for n in np.flatnonzero(np.diff(self.rows)).tolist()]
        if len(pairs) >= 20 and 0 < sum(y for _, y in pairs) < len(pairs):
            x = np.asarray([math.log(p / (1 - p)) for p, _ in ((min(max(p, 1e-4), 1 - 1e-4), y) for p, y in pairs)])
            y = np.asarray([y for _, y in pairs])
            a, b = 1.0, 0.0
            for _ in range(50):  # Newton steps with a ridge towards (1, 0)
                p = 1 / (1 + np.exp(-(a * x + b)))
                g = np.asarray([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
                w = p * (1 - p)
                h = np.asarray([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
                da, db = np.linalg.solve(h, g)
                a, b = a - da, b - db
                if abs(da) + abs(db) < 1e-9:
                    break
            if a > 0:
                self.slope, self.offset = float(a), float(b)
        return self

    def score(self, words: list[bytes]) -> tuple[float, list[tuple[int, float]]]:
        """Calibrated probability of label 1 and the evidence: (doc_id, cosine) of the examples that voted."""
        raw, near = self.vote(self.arrays(words))
        if near:
            raw = min(max(raw, 1e-9), 1 - 1e-9)
            raw = 1 / (1 + math.exp(-(self.slope * math.log(raw / (1 - raw)) + self.offset)))
        return raw, [(int(self.ids[n]), float(s)) for s, n in near]


def _document_frequencies(docs: DataFrame, index: BlockMaxIndex) -> tuple[np.ndarray, int]:
    """How many of all documents hold each index term, and how many documents there are."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.terms), np.int64), 0
        get = index.terms.get
        for b in batches:
            held: list[int] = []
            for text in b.column(0):
                n += 1
                held += [i for i in map(get, set(words_of(text.as_py()))) if i is not None]
            df += np.bincount(held, minlength=len(df)) if held else 0
        keys = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), -1], pa.int64()), pa.array([*df[keys].tolist(), n], pa.int64())], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, n = (c.to_numpy() for c in got.columns)
    out = np.zeros(len(index.terms))
    out[terms[terms >= 0]] = n[terms >= 0]
    return out, int(n[terms < 0].sum())


def contrast(held: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Log-likelihood ratio of words that ``held`` examples hold, ``toxic`` of them with label 1, among n0 and n1 examples."""
    t, c = np.asarray(toxic, np.float64), np.asarray(held, np.float64) - toxic
    rate = (t + c) / (n0 + n1)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    return np.maximum(0.0, 2 * (part(t, rate * n1) + part(c, rate * n0) + part(n1 - t, (1 - rate) * n1) + part(n0 - c, (1 - rate) * n0)))


def train_toxicity_index(docs: DataFrame, labels: DataFrame, learn) -> BlockMaxIndex:
    """Build the index from the labelled documents where ``learn`` (a condition on doc_id) holds.

    Without labelled examples of both labels the index is empty and every score is the prior.
    """
    examples = written(_example_words(labelled_sample(docs, labels, learn)), "toxic-examples")
    seen: set[tuple[int, int]] = set()
    kept: list[tuple[int, int]] = []
    for r in sorted(examples.select("doc_id", "toxic", "sketch").collect(), key=lambda r: (r["doc_id"], r["sketch"])):
        keys = {(r["toxic"], k, x) for k, x in enumerate(r["sketch"])}
        if not keys & seen:  # near copies of an example would make their own words look telling
            kept.append((r["doc_id"], r["toxic"]))
        seen |= keys
    ids = {d for d, _ in kept}
    total = Counter(y for _, y in kept)
    if not (total[0] and total[1]):
        return BlockMaxIndex([], np.zeros(0), [{} for _ in kept], [y for _, y in kept], [d for d, _ in kept])
    spark = docs.sparkSession
    keep = F.broadcast(spark.createDataFrame(sorted(ids), "long").withColumnRenamed("value", "doc_id"))
    one = examples.join(keep, "doc_id").dropDuplicates(["doc_id"])
    counts = one.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("word").toArrow()
    terms = [w.encode() for w in counts.column("word").to_pylist()]  # the words of a bounded number of texts
    index = BlockMaxIndex(terms, np.ones(len(terms)), [], [], [])
    df, n = _document_frequencies(docs, index)
    telling = contrast(counts.column("n").to_numpy(), counts.column("t").to_numpy(), total[0], total[1])
    weight = (np.log((n + 1) / (df + 1)) + 1) * np.maximum(telling, LEAST_CONTRAST) ** 2
    index = BlockMaxIndex(terms, weight, [], [], [])
    texts = labelled_sample(docs, labels, learn).join(keep, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [index.arrays(words_of(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.astype(np.int32) for t, _ in vs], pa.list_(pa.int32())), pa.array([w for _, w in vs], pa.list_(pa.float64()))], names=["doc_id", "toxic", "t", "w"])

    rows = texts.mapInArrow(run, "doc_id long, toxic int, t array<int>, w array<double>").toArrow().combine_chunks()
    sizes = pc.list_value_length(rows.column("t")).combine_chunks().to_numpy()
    entry_terms, entry_weights = (pc.list_flatten(rows.column(c)).combine_chunks().to_numpy() for c in ("t", "w"))
    first = np.cumsum(sizes) - sizes
    ids, labels_of = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()

    def heavy(i: int) -> list[int]:
        t, w = entry_terms[first[i] : first[i] + sizes[i]], entry_weights[first[i] : first[i] + sizes[i]]
        return t[np.lexsort((t, -w))[:3]].tolist()

    # neighbours in the index hold the same heavy terms, so that block maxima differ between blocks
    order = np.asarray(sorted(range(len(ids)), key=lambda i: (heavy(i), ids[i])), np.int64)
    at = _slices(first[order], sizes[order])
    vectors = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64), entry_terms[at].astype(np.int32), entry_weights[at]
    return BlockMaxIndex(terms, weight, vectors, labels_of[order], ids[order]).calibrate()


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, text: str = "text", score: str = "toxicity", evidence: str | None = "evidence") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text appended and, if named, its evidence.

    Null and empty texts and texts without an index term get the share of label 1
    among the examples without one, and no evidence.  Other columns pass through;
    an input column named like an output column raises.
    """
    new = [c for c in (score, evidence) if c]
    if set(new) & set(docs.columns):
        raise ValueError(f"docs already has a column of {new}")
    at = docs.columns.index(text)
    kind = "array<struct<doc_id:bigint,cosine:double>>"
    out = docs.select("*", F.lit(0.0).alias(score), *([F.lit(None).cast(kind).alias(evidence)] if evidence else []))
    arrow_kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, proof = [], []
            for x in b.column(at):
                s, e = index.score(words_of(x.as_py()))
                scores.append(s)
                proof.append([{"doc_id": d, "cosine": c} for d, c in e])
            more = [pa.array(scores, pa.float64())] + ([pa.array(proof, arrow_kind)] if evidence else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, out.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """Contract rows of op4: learn from the other folds, score every document."""
    base = docs.select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    index = train_toxicity_index(base, labels, remainder != held)
    out = score_toxicity(base, index, score="score")
    return out.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
