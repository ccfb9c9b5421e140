"""N-gram Jaccard join by vertical partitioning.

A document is its set of word n-grams, as 64-bit hashes.  Two sets of sizes m <= n
with 100 * overlap >= T * union differ in at most D = floor((m + n) * (100 - T) /
(100 + T)) n-grams.  A first cut of the hash range into D + D / 8 + 1 fragments finds
the sets that can link at all: of F non-empty fragments F - D at least hold the same
n-grams in both sets of a linking pair, so sets that share fewer digests with other
sets go, such as those that share a passage only.  A set so sparse that its differences
could fill all its non-empty fragments also offers its prefix n-grams, and one met
digest is enough for it.

Among the sets left the global n-gram order is: class of document frequency (its
binary length), then hash, rare n-grams first.  A pair can only link if it shares
an n-gram early enough in this order in both sets for the rest to reach the overlap
it needs; such n-grams are the candidates' witnesses.  Candidates are verified by
vertical partitions: the order is cut into fragments, every set into one segment
per fragment, partial overlaps are counted per fragment and summed per pair.

Equal sets form one node from the start.  Each witness first compares its sets with
the one that shares most of its n-grams only; then witnesses whose sets are still in
different components are compared across components.  A set far from a group's
centre has rare n-grams ahead of those that the group shares, so groups of copies
are never expanded into all pairs, and no link between components is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, released, remove, written

WORDS = 4
PERCENT = 85
BAND = 1.5  # ratio of the size bands that share one cutting
CHUNK = 400_000  # bytes of text hashed at a time
_P = 0x9E3779B97F4A7C15 | 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def spans_hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes of ``raw``."""
    codes = np.frombuffer(raw, np.uint8)
    up, down = _POWERS.upto(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of every word of ``raw`` (which ends in white space), A-Z in lower case."""
    folded = raw.translate(_FOLD)
    gap = _SPACE[np.frombuffer(folded, np.uint8)]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], inside[:-1]]))
    return spans_hashed(folded, starts, ends), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space into pieces of about CHUNK bytes, each ending in white space."""
    at = 0
    while len(raw) - at > CHUNK:
        cut = max(raw.rfind(bytes([c]), at, at + CHUNK) for c in (0x20, 0x0A, 0x09, 0x0D))
        if cut <= at:
            cut = min((p for p in (raw.find(bytes([c]), at + CHUNK) for c in (0x20, 0x0A, 0x09, 0x0D)) if p >= 0), default=len(raw))
        yield raw[at : cut + 1] + b" "
        at = cut + 1
    yield raw[at:] + b" "


def ngram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every whole text.

    Fewer words than ``words`` make one n-gram of the whole sequence; no word makes the empty set.
    """
    out: list[np.ndarray] = []
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(words)]

    def grams(h: np.ndarray) -> np.ndarray:
        n = len(h) - words + 1
        if n < 1:
            if not len(h):
                return np.zeros(0, np.uint64)
            return mix(sum((h[k : k + 1] * factors[k] for k in range(len(h))), np.full(1, len(h), np.uint64)))
        a = h[:n] * factors[0]
        for k in range(1, words):
            a = a + h[k : k + n] * factors[k]
        return np.unique(mix(a))

    while i < len(raws):
        if len(raws[i]) > CHUNK:
            out.append(grams(np.concatenate([word_hashes(p)[0] for p in _pieces(raws[i])])))
            i += 1
            continue
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) <= CHUNK):
            size += len(raws[j]) + 1
            j += 1
        h, starts = word_hashes(b" ".join(raws[i:j]) + b" ")
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[i:j])]))
        out += [grams(h[a:b]) for a, b in itertools.pairwise(edges)]
        i = j
    return out


def set_id(grams: np.ndarray) -> int:
    """Signed 64-bit digest of a set of n-grams."""
    return int((mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))).astype(np.int64))


def band_edges(limit: int) -> list[int]:
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


_EDGES = band_edges(1 << 40)


def signatures(grams: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Digests of the non-empty fragments of a set, for its own size band and every band where a larger partner may lie,
    and how many of them it shares at least with other sets if it links with one."""
    n = len(grams)
    band = int(np.searchsorted(_EDGES, n, "right")) - 1
    out = []
    need = n
    mixed = mix(grams)
    for b in range(band, int(np.searchsorted(_EDGES, n * 100 // percent, "right"))):
        most = _EDGES[b + 1] - 1
        apart = 2 * most * (100 - percent) // (100 + percent)
        k = apart + apart // 8 + 1
        place = ((grams >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append(mix(np.add.reduceat(mixed, first) ^ mix(place[first] + np.uint64(b << 40))))
        partner = min(most, n * 100 // percent)
        equal = len(first) - (n + partner) * (100 - percent) // (100 + percent)
        need = min(need, equal)
        if equal < 1:
            prefix = n - -(-n * percent // 100) + 1
            out.append(mix(grams[:prefix] ^ np.uint64(0x5DEECE66D5DEECE6)))
    return np.unique(np.concatenate(out)).view(np.int64), max(1, need)


def _batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def text_hash():
    """The column text_hash of rows with a text."""
    return F.xxhash64("text").alias("text_hash")


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns = [], []
            for s in range(0, b.num_rows, 1000):
                for g in ngram_sets(b.column(1).slice(s, 1000).to_pylist(), words):
                    ids.append(set_id(g))
                    ns.append(len(g))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], names=["doc_id", "text_hash", "set_id", "n"])

    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, "doc_id long, text_hash long, set_id long, n long")


_ALONE, _MET = -1, -2  # what a map task knows of a key: one set of its own holds it, or several


def _involved(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ids of sets that share as many fragments with other sets as a link needs; each map task sends one set per fragment.

    A set that occurs in several map tasks may be counted more than once, which only lets more sets through.
    """
    names = ["key", "a", "need", "c"]
    flush_rows = 400_000

    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not keys:
                return
            ids, sizes, needs = (np.asarray(c, np.int64) for c in zip(*owners, strict=True))
            key, member = np.concatenate(keys), np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(key, kind="stable")
            key, member = key[order], member[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lead = np.zeros(len(key), bool)
            lead[first] = True
            met = np.where(np.diff(np.append(first, len(key))) > 1, _MET, _ALONE)
            yield _batch(names, key[first], ids[member[first]], needs[member[first]], met)
            others, count = np.unique(member[~lead], return_counts=True)
            yield _batch(names, mix(ids[others].astype(np.uint64)).view(np.int64), ids[others], needs[others], count)
            keys.clear()
            owners.clear()
            held = 0

        for b in batches:
            for s in range(0, b.num_rows, 1000):
                for g in ngram_sets(b.column(0).slice(s, 1000).to_pylist(), words):
                    me = set_id(g)
                    if len(g) and me not in seen:
                        seen.add(me)
                        sig, need = signatures(g, percent)
                        keys.append(sig)
                        owners.append((me, len(sig), need))
                        held += len(sig)
                if held >= flush_rows:
                    yield from flush()
        yield from flush()

    @released
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by key; of a key that goes on in the next batch one row is carried over
        carried = [np.zeros(0, np.int64)] * 4
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            own = rows[3] < 0
            ids, needs, counts = [rows[1][~own]], [rows[2][~own]], [rows[3][~own]]
            if own.any():
                key, member, need, c = (np.concatenate([x, y[own]]) for x, y in zip(carried, rows, strict=True))
                order = np.lexsort((c, member, key))
                key, member, need, c = key[order], member[order], need[order], c[order]
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])])
                key, member, need, c = key[once], member[once], need[once], c[once]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sizes = np.diff(np.append(first, len(key)))
                low = np.minimum.reduceat(c, first)
                met = np.repeat((sizes > 1) | (low == _MET), sizes)
                carried = [key[-1:], member[-1:], need[-1:], low[-1:]]
                found, at, count = np.unique(member[met], return_index=True, return_counts=True)
                ids.append(found)
                needs.append(need[met][at])
                counts.append(count)
            yield _batch(["set_id", "need", "c"], np.concatenate(ids), np.concatenate(needs), np.concatenate(counts))

    sent = docs.select("text").mapInArrow(emit, "key long, a long, need long, c long")
    counted = sent.repartition("key").sortWithinPartitions("key").mapInArrow(reduce, "set_id long, need long, c long")
    return counted.groupBy("set_id").agg(F.max("need").alias("need"), F.sum("c").alias("c")).where("c >= need").select("set_id")


def _bodies(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(set_id, n, grams): the n-grams of the named documents."""
    chosen = docs.select("doc_id", "text").join(ids.select("doc_id"), "doc_id", "left_semi")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                sets = [g for g in ngram_sets(b.column(0).slice(s, 200).to_pylist(), words) if len(g)]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), lists], names=["set_id", "n", "grams"])

    return chosen.select("text").mapInArrow(run, "set_id long, n long, grams array<bigint>")


def _ordered(bodies: DataFrame, percent: int) -> DataFrame:
    """(set_id, n, cap, g): the n-grams that another involved set holds too, in the global order (class, hash).

    ``cap`` is their number: the others come first in the order, can be shared
    with no set, and sets with too many of them for any link are left out.
    """
    grams = bodies.select("set_id", "n", F.explode("grams").alias("gram"))
    known = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram", F.length(F.bin("c")).alias("k"))
    sets = grams.join(known, "gram").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "gram"))).alias("g"))
    return sets.select("set_id", "n", F.size("g").cast("long").alias("cap"), "g").where(F.col("cap") * 100 >= F.col("n") * percent)


def _segments(ordered: DataFrame) -> DataFrame:
    """(set_id, fragment, grams): every set cut at the same places of the global order (each class in quarters of its hash range)."""
    fragment = lambda x: x["k"] * 4 + F.shiftright(x["gram"], 62).cast("int")
    cut = ordered.select("set_id", "g", F.explode(F.array_distinct(F.transform("g", fragment))).alias("fragment"))
    return cut.select("set_id", "fragment", F.transform(F.filter("g", lambda x: fragment(x) == F.col("fragment")), lambda x: x["gram"]).alias("grams"))


def _needed(m, n, percent: int):
    """The overlap that sets of m and n n-grams need to link."""
    return F.floor(((m + n) * percent + 99 + percent) / (100 + percent)).cast("long")


_INFO = ("set_id", "n", "cap", "pos")


def _witnesses(ordered: DataFrame, percent: int) -> DataFrame:
    """(gram, set_id, n, cap, pos): the n-grams early enough in a set for a link with a set of its witness, with their place in the order."""
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    head = F.slice("g", 1, F.col("cap").cast("int") - least + 1)
    rows = ordered.select("set_id", "n", "cap", F.posexplode(F.transform(head, lambda x: x["gram"])).alias("i", "gram"))
    rows = written(rows.select("gram", "set_id", "n", "cap", (F.col("n") - F.col("cap") + F.col("i")).alias("pos")), "jaccard-prefix")
    met = rows.groupBy("gram").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.min("n").alias("smallest")).where("lo < hi").select("gram", "smallest")
    partner = F.greatest("smallest", F.floor((F.col("n") * percent + 99) / 100).cast("long"))
    out = written(rows.join(met, "gram").where(F.col("pos") <= F.col("n") - _needed(F.col("n"), partner, percent)).select("gram", *_INFO), "jaccard-witness")
    remove(rows.sparkSession, rows.scratch_path)
    return out


def _named(prefix: str) -> list:
    return [F.col(c).alias(prefix + c) for c in _INFO]


def _possible(percent: int):
    """Whether sizes, caps and the places of the witness in two sets allow a link."""
    x, y = F.col("x_n"), F.col("y_n")
    need = _needed(x, y, percent)
    sizes = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    return sizes & (F.least("x_cap", "y_cap") >= need) & (F.col("x_pos") <= x - need) & (F.col("y_pos") <= y - need)


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b, na, nb): the pairs of ``met``, smaller id first, with their sizes."""
    first = F.col("x_set_id") < F.col("y_set_id")
    ends = [F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")]
    return met.select(*ends, F.when(first, F.col("x_n")).otherwise(F.col("y_n")).alias("na"), F.when(first, F.col("y_n")).otherwise(F.col("x_n")).alias("nb")).distinct()


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: partial overlaps counted per vertical fragment and summed per pair."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
    return whole.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _torn(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the component c of each set, only for witnesses that touch two components or more."""
    named = written(rows.join(parts, rows.set_id == parts.node, "left").select("gram", *_INFO, F.coalesce("component", "set_id").alias("c")), "jaccard-named")
    torn = named.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("gram")
    out = written(named.join(torn, "gram", "left_semi"), "jaccard-torn")
    remove(rows.sparkSession, named.scratch_path)
    return out


def _components(ordered: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another one."""
    segments = written(_segments(ordered), "jaccard-segments")
    rows = _witnesses(ordered, percent)
    best = F.max(F.struct((F.col("y_cap") / F.col("y_n")).alias("share"), *(f"y_{c}" for c in _INFO))).alias("h")
    heads = rows.select("gram", *_named("y_")).groupBy("gram").agg(best, F.count("*").alias("m")).where("m > 1").select("gram", *(f"h.y_{c}" for c in _INFO))
    near = rows.select("gram", *_named("x_")).join(written(heads, "jaccard-heads"), "gram").where((F.col("x_set_id") != F.col("y_set_id")) & _possible(percent))
    parts = written(connected_components(_verified(written(_pairs(near), "jaccard-pairs"), segments, percent)), "jaccard-parts")
    rows = _torn(rows, parts)
    x = rows.select("gram", F.col("c").alias("cx"), *_named("x_"))
    y = rows.select("gram", F.col("c").alias("cy"), *_named("y_"))
    across = written(_pairs(x.join(y, "gram").where((F.col("cx") < F.col("cy")) & _possible(percent))), "jaccard-across")
    more = written(_verified(across, segments, percent), "jaccard-links")
    if not more.limit(1).count():
        return parts
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    joints = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(joints).toDF("old", "new")
    named = parts.join(moved, parts.component == moved.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    return named.union(moved.join(parts, moved.old == parts.node, "left_anti").select("old", "new"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row of ``docs`` (doc_id, text).

    ``n_shingles`` is the number of distinct word n-grams; ``component_id`` the
    smallest doc_id reachable over links (100 * intersection >= percent * union,
    ``percent`` a whole number from 1 to 100, exact for each).  Null, empty and
    blank texts have no n-gram and link with nothing: their component is their own
    id, as it is for a null doc_id.  Repeated rows are copies of each other.
    Other columns of ``docs`` are ignored.  ``with_hash`` adds text_hash, which
    tells rows of one doc_id and unlike texts apart.
    """
    if percent != int(percent) or not 1 <= percent <= 100:
        raise ValueError("percent must be a whole number from 1 to 100")
    docs = docs.select("doc_id", "text")
    sets = written(_set_rows(docs, words), "jaccard-sets")
    first = written(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "jaccard-first")
    nodes = written(_involved(docs.where("doc_id IS NOT NULL"), words, percent), "jaccard-nodes")
    ids = written(first.join(nodes, "set_id").select("doc_id"), "jaccard-ids")
    bodies = written(_bodies(docs, ids, words).dropDuplicates(["set_id"]), "jaccard-bodies")
    ordered = written(_ordered(bodies, percent), "jaccard-ordered")
    remove(docs.sparkSession, bodies.scratch_path, nodes.scratch_path, ids.scratch_path)
    parts = _components(ordered, percent)
    labels = written(first.join(parts, first.set_id == parts.node, "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("c")), "jaccard-labels")
    lowest = labels.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = written(labels.join(lowest, "c").select("set_id", "component_id"), "jaccard-names")
    out = sets.withColumn("k", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("set_id")))
    extra = ["text_hash"] if with_hash else []
    return out.join(named, out.k == named.set_id, "left").select("doc_id", *extra, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def oracle_sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """The same rows of ``documents`` in DuckDB's SQL, over all pairs that share an n-gram: for small tables with unique doc_ids."""
    return f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {words - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - {words - 2}))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.other, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id"""
