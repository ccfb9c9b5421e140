"""Language identification with a byte convolutional network trained in numpy.

Each filter of width w sums one learned weight per (offset, byte) pair, so a
convolution over one-hot bytes is a table look-up and w shifted additions.  The
largest response of every filter within a fixed-length window is kept (max
pooling), a dense softmax layer turns the pooled responses into class
probabilities, and a text's windows are combined by their mean log probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

WIDTHS = (2, 3, 4)
FILTERS = 16  # per width; a multiple of 8 (eight int16 weights travel as one 16-byte item)
WINDOW = 256  # filter start positions per window
LOOKAHEAD = max(WIDTHS)
BLOCK = 256 * WINDOW  # bytes convolved at a time
LEARN_TEXTS = 600  # bound: labelled texts per language
LEARN_WINDOWS = 3  # bound: windows per labelled text
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


class ByteCnn:
    """Filter tables (one per width: offset, byte, filter), pooled bias and the dense layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = list(classes)
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.out = np.zeros(len(classes), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteCnn:
        """Adam on cross entropy; ``windows`` is (n, WINDOW + LOOKAHEAD) uint8."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.dense, self.out]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        cols = np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                pick = order[start : start + batch]
                x, y = windows[pick], labels[pick]
                rows = np.arange(len(x))
                pooled, places = [], []
                for w, t in zip(WIDTHS, self.tables, strict=True):
                    a = t[0][x[:, :WINDOW]]
                    for j in range(1, w):
                        a = a + t[j][x[:, j : j + WINDOW]]
                    p = a.argmax(1)
                    places.append(p)
                    pooled.append(np.take_along_axis(a, p[:, None, :], 1)[:, 0])
                z = np.concatenate(pooled, 1) + self.bias
                h = np.maximum(z, 0)
                logits = h @ self.dense + self.out
                logits -= logits.max(1, keepdims=True)
                prob = np.exp(logits)
                prob /= prob.sum(1, keepdims=True)
                prob[rows, y] -= 1
                prob /= len(x)
                dz = (prob @ self.dense.T) * (z > 0)
                grads = []
                for k, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g, d = np.zeros_like(t), dz[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (x[rows[:, None], places[k] + j], cols[None, :]), d)
                    grads.append(g)
                grads += [dz.sum(0), h.T @ prob, prob.sum(0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def quantised(self) -> ByteCnnRuntime:
        scale = 32000 / (max(WIDTHS) * max(float(np.abs(t).max()) for t in self.tables) + 1e-9)
        packed = [
            [[np.ascontiguousarray(np.rint(t[j][:, g : g + 8] * scale).astype(np.int16)).view(np.complex128)[:, 0] for j in range(len(t))] for g in range(0, FILTERS, 8)]
            for t in self.tables
        ]
        return ByteCnnRuntime(self.classes, packed, scale, self.bias, self.dense, self.out)


class ByteCnnRuntime:
    """The trained network with int16 filter tables."""

    def __init__(self, classes, packed, scale, bias, dense, out):
        self.classes, self.packed, self.scale, self.bias, self.dense, self.out = classes, packed, scale, bias, dense, out

    def log_probs(self, codes: np.ndarray, breaks: np.ndarray | None = None) -> np.ndarray:
        """One row per window; ``codes`` holds whole windows and LOOKAHEAD bytes more.

        ``breaks`` are the places where another text begins; what lies before them sees zeros behind them.
        """
        total = (len(codes) - LOOKAHEAD) // WINDOW
        breaks = np.zeros(0, np.int64) if breaks is None else breaks
        parts = []
        for start in range(0, total * WINDOW, BLOCK):
            n = min(BLOCK, total * WINDOW - start)
            x = codes[start : start + n + LOOKAHEAD]
            own = breaks[np.searchsorted(breaks, start, "right") : np.searchsorted(breaks, start + n, "right")] - start
            shifted = [x[:n]]
            for j in range(1, LOOKAHEAD):
                y = x[j : j + n].copy()
                for i in range(1, j + 1):
                    y[own - i] = 0
                shifted.append(y)
            pooled = []
            for groups in self.packed:
                for tables in groups:
                    a = tables[0][shifted[0]].view(np.int16)
                    for j in range(1, len(tables)):
                        a += tables[j][shifted[j]].view(np.int16)
                    a = a.reshape(n // WINDOW, WINDOW * 8)
                    while a.shape[1] > 8:
                        half = a.shape[1] // 2
                        a = np.maximum(a[:, :half], a[:, half:])
                    pooled.append(a)
            h = np.maximum(np.concatenate(pooled, 1).astype(np.float32) / self.scale + self.bias, 0)
            logits = h @ self.dense + self.out
            logits -= logits.max(1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Class and probability of every text; ``und`` with score 1 where there is no letter."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        langs, scores = [UNDETERMINED] * len(texts), [1.0] * len(texts)
        if not known or not self.classes:
            return langs, scores if self.classes else [0.0] * len(texts)
        chunks, counts = [], []
        for i in known:
            raw = texts[i].encode("utf-8", "replace").lower()
            n = -(-(len(raw) + LOOKAHEAD) // WINDOW)
            chunks.append(raw + bytes(n * WINDOW - len(raw)))
            counts.append(n)
        chunks.append(bytes(LOOKAHEAD))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        rows = self.log_probs(np.frombuffer(b"".join(chunks), np.uint8), starts[1:] * WINDOW)
        mean = np.add.reduceat(rows, starts, axis=0) / np.asarray(counts)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        for k, i in enumerate(known):
            langs[i], scores[i] = self.classes[best[k]], float(prob[k, best[k]])
        return langs, scores


def training_windows(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Evenly spread windows of labelled texts, their class numbers and the classes in order."""
    classes = sorted({lang for lang, _ in rows})
    xs, ys = [], []
    for lang, text in rows:
        raw = text.encode("utf-8", "replace").lower()
        spots = max(1, min(LEARN_WINDOWS, len(raw) // WINDOW))
        for k in range(spots):
            at = k * max(0, len(raw) - WINDOW) // max(1, spots - 1) if spots > 1 else 0
            piece = raw[at : at + WINDOW]
            xs.append(piece + bytes(WINDOW + LOOKAHEAD - len(piece)))
            ys.append(classes.index(lang))
    x = np.frombuffer(b"".join(xs), np.uint8).reshape(len(xs), WINDOW + LOOKAHEAD) if xs else np.zeros((0, WINDOW + LOOKAHEAD), np.uint8)
    return x, np.asarray(ys, np.int64), classes


def train_language_model(docs: DataFrame, learn: F.Column | None = None) -> ByteCnnRuntime:
    """Fit the network on at most LEARN_TEXTS texts per language out of the rows where ``learn`` holds.

    Rows with a null text or lang never teach.  The sample is the rows with the
    smallest hash of doc_id and text, so it is the same in every run.
    """
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    if learn is not None:
        rows = rows.where(learn)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return ByteCnn([]).quantised()
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * LEARN_TEXTS / n + 20.0 / n))])
    u = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    # a bounded stretch of a bounded number of texts reaches the driver
    length = F.length("text")
    at = (F.pmod(F.xxhash64("doc_id"), F.lit(97)) / 97.0 * F.greatest(F.lit(0), length - 4 * WINDOW)).cast("int") + 1
    picked = rows.where(u < share[F.col("lang")]).select("lang", F.substring("text", at, F.lit(4 * WINDOW)).alias("part"), u.alias("u"))
    got: dict[str, list[tuple[float, str]]] = {}
    for r in picked.collect():
        got.setdefault(r["lang"], []).append((r["u"], r["part"]))
    sample = [(lang, part) for lang in sorted(got) for _, part in sorted(got[lang])[:LEARN_TEXTS] if _LETTER.search(part)]
    x, y, classes = training_windows(sample)
    return ByteCnn(classes).fit(x, y).quantised() if classes else ByteCnn([]).quantised()


def identify_language(docs: DataFrame, model: ByteCnnRuntime, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` of every whole text appended.

    Null texts and texts without a letter get ``und`` with score 1; equal texts, repeated rows
    too, get equal results whatever stands beside them.  All input columns pass through
    untouched; an input column named like an output column raises.
    """
    if {pred, score} & set(docs.columns):
        raise ValueError(f"docs already has a column {pred} or {score}")
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for s in range(0, b.num_rows, 512):
                a, c = model.predict(b.column(at).slice(s, 512).to_pylist())
                langs += a
                scores += c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def language_report(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """Contract rows of op6: learn from the other folds, predict every document."""
    base = docs.select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    model = train_language_model(base, remainder != held)
    out = identify_language(base.select("doc_id", "text"), model, score="score")
    return out.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
