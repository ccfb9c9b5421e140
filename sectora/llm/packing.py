"""Best-fit packing of tokenised documents with certified bin counts.

Documents become token pieces of at most CAPACITY ids.  Pieces are dealt to groups;
every group packs by best-fit decreasing and certifies its bin count against
lower bounds from dual feasible functions.  A group gives back its least filled
bins (its gap to the bound, and one more that rounding may hide); the documents
of those bins are exchanged between groups and packed again, in ever fewer
groups, until one group is left or a round saves nothing.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, released, written
from .jaccard import spans_hashed

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 25_000  # pieces that one task packs at once
MAX_ROUNDS = 8
CACHE = 400_000  # bound: cached pieces per worker; the cache is emptied beyond it
BATCH = 1 << 18  # bytes of text encoded at a time (a longer text at once)

#: Byte classes. Latin-1 letters are the two bytes C3 9F and C3 A0 to C3 BF without C3 B7, once in lower case.
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _GAP
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x27, 0x3C]] = _ODD  # ' and < may begin contractions and special tokens
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SECOND = np.zeros(256, bool)
_SECOND[[0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True
_SECOND_UPPER = np.zeros(256, bool)
_SECOND_UPPER[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
_PIECE = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")


def plain_pieces(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """``raw`` (ending in white space) in lower case, start and end of its pieces, and which of them are odd.

    Words of plain letters, digits and signs are cut at the pre-tokenizer's borders
    (runs of letters, single digits, runs of signs); any other word is one odd piece.
    """
    codes = np.frombuffer(bytearray(raw.translate(_LOWER)), np.uint8)
    lead = np.flatnonzero(codes[:-1] == 0xC3)
    second = codes[lead + 1]
    upper = lead[_SECOND_UPPER[second]] + 1
    codes[upper] += 32
    kind = _KIND[codes]
    lead = lead[_SECOND[codes[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    gap = kind == _GAP
    before = np.concatenate([[True], gap[:-1]])
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        w = np.unique(np.searchsorted(starts, odd, "right") - 1)
        for a, b in zip(starts[w].tolist(), ends[w].tolist(), strict=True):
            kind[a:b] = _ODD
    first = ~gap
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | first[1:])) + 1
    return codes.tobytes(), starts, ends, kind[starts] == _ODD


class CachedEncoder:
    """Ids of a whole text by a ``tokenizers`` file, with a cache of pieces.

    White space never joins neighbours in these vocabularies, so a text is the
    concatenation of its words; plain words are also cut at the pre-tokenizer's
    borders.  Pieces are found and looked up by 64-bit hash for many texts at once,
    and only new ones are encoded.  ``split`` tells whether the file drops white
    space and allows that; else every text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = "The cat's 42 (blue) hats,\n\tand  more."
        plain = "The 42 (blue) hats, and"
        self.known: dict[int, int] = {}  # hash of a piece: its place in starts
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.ends = self._word_ends()
        pieces = [p for w in plain.split() for p in _PIECE.findall(w.lower())]
        self.split = b"".join(map(self._raw, probe.split())) == self._raw(probe) and b"".join(map(self._raw, pieces)) == self._raw(plain)
        self.bare = self._bare(path) if self.split and self.ends is not None else None
        if self.bare and self._joined(pieces) != [self._raw(p) for p in pieces]:
            self.bare = None

    def _word_ends(self) -> np.ndarray | None:
        """Which ids close a word, for vocabularies that mark word ends."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        return ends if ends.any() else None

    @staticmethod
    def _bare(path: str):
        """The same model for pieces that are normalised and cut already."""
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        t.normalizer = None
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        return t

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of many plain pieces from one text, parted at the ids that close a word."""
        ids = np.asarray(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        if len(cuts) != len(pieces):
            return self._batch(pieces)
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are taken together up to BATCH bytes."""
        if not self.split:
            return list(map(self._raw, texts))
        raws = [t.encode("utf-8", "replace") for t in texts]
        out: list[bytes] = []
        i = 0
        while i < len(raws):
            j, size = i, 0
            while j < len(raws) and (j == i or size + len(raws[j]) <= BATCH):
                size += len(raws[j])
                j += 1
            out += self._together(raws[i:j])
            i = j
        return out

    def _together(self, raws: list[bytes]) -> list[bytes]:
        text, starts, ends, odd = plain_pieces(b"\n".join(raws) + b"\n")
        hashes, first, place = np.unique(spans_hashed(text, starts, ends), return_index=True, return_inverse=True)
        found = np.fromiter(map(self.known.get, hashes.tolist(), itertools.repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(found < 0)
        if len(new):
            at = first[new]
            spans = [text[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            strange = odd[at].tolist()
            plain = [w for w, o in zip(spans, strange, strict=True) if not o]
            coded = iter((self._joined if self.bare else self._batch)(plain) if plain else [])
            others = iter(self._batch([w for w, o in zip(spans, strange, strict=True) if o]))
            made = [next(others) if o else next(coded) for o in strange]
            found[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            lengths = np.asarray([len(m) // 4 for m in made], np.int64)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
            self.known.update(zip(hashes[new].tolist(), found[new].tolist(), strict=True))
        mine = found[place]
        lengths = self.lengths[mine]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[mine] - sums[:-1], lengths) + np.arange(sums[-1])].tobytes()
        cuts = (4 * sums[np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))]).tolist()
        if len(self.known) > CACHE:
            self.known, self.starts, self.lengths, self.ids = {}, self.starts[:1], self.lengths[:1], self.ids[:0]
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]


_ENCODERS: dict[str, CachedEncoder] = held_by(__name__)


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]): each text's ids and END_ID, cut into ``capacity`` ids.

    A null or empty text is the single id END_ID.  ``salt`` spreads pieces, repeated rows too, over groups.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"] + ["ids"] * with_ids
    tail = np.asarray([END_ID], "<u4").tobytes()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_many
        serial = 0
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = []
                coded = encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, raw in zip(part.column(0).to_pylist(), coded, strict=True):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        serial += 1
                        crc = zlib.crc32(piece)
                        salt = zlib.crc32(f"{serial} {doc_id} {crc}".encode())
                        rows.append((doc_id, k, at // 4, len(piece) // 4, crc, salt, np.frombuffer(piece, "<u4") if with_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(cols[i], kinds[i]) for i in range(len(names))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + ", ids array<long>" * with_ids)


def bins_needed(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Largest lower bound on the bins for ``counts[x]`` pieces of length x: continuous, threshold and rounding dual feasible functions."""
    x = np.arange(capacity + 1)
    counts = np.asarray(counts, np.int64)
    if not counts.sum():
        return 0
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    best = -(-int(volume[-1]) // capacity)
    # threshold e: above capacity - e a piece fills a bin, below e it counts nothing
    e = np.arange(1, capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    best = max(best, int((big + -(-middle // capacity)).max()))
    for k in range(1, 101):  # rounding: (k + 1) x / capacity down to whole parts, of which k fill a bin; whole values keep their share
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(whole, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; a bit set of free spaces finds the tightest bin."""
    n = len(lengths)
    bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        above = mask >> x
        if above:
            room = x + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += x
        left = room - x
        if left:
            if not free[left]:
                mask |= 1 << left
            free[left].append(b)
    return bins, offsets, np.asarray(fills, np.int64)


def _pack_round(pieces: DataFrame, groups: int, turn: int, last: bool, capacity: int) -> DataFrame:
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
    names = [*keep, "sequence_id", "offset", "closed", "saved"]
    g = F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)).cast("long").alias("g")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        group = table.column("g").to_numpy()
        for k in np.unique(group):
            part = table.filter(pa.array(group == k)).combine_chunks()
            lengths = part.column("length").to_numpy()
            bins, offsets, fills = best_fit_decreasing(lengths, capacity)
            bound = bins_needed(np.bincount(lengths, minlength=capacity + 1), capacity)
            gap = len(fills) - bound
            closed = np.ones(len(fills), bool)
            if not last:
                loose = np.argsort(fills, kind="stable")[: gap + 1]
                closed[loose[fills[loose] < capacity]] = False
            sequence = (np.int64(turn) << 56) + (np.int64(k) << 32) + bins
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in keep), pa.array(sequence), pa.array(offsets), pa.array(closed[bins]), pa.array(np.full(len(bins), gap))], names=names)

    return pieces.select(*keep, g).repartition(groups, "g").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, closed boolean, saved long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Every piece is placed once; sequences hold at most ``capacity`` ids without gaps."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = sum(counts.values())
    placed: list[DataFrame] = []
    left = pieces
    for turn in range(MAX_ROUNDS):
        groups = max(1, -(-total // group_pieces))
        last = groups == 1 or turn == MAX_ROUNDS - 1
        out = written(_pack_round(left, groups, turn, last, capacity), "packed")
        placed.append(out.where("closed"))
        if last:
            break
        left = out.where("NOT closed")
        before, total = total, left.count()
        if not total:
            break
        if total > 0.9 * before:  # nothing but whole groups came back: one more round closes them
            placed.append(written(_pack_round(left, groups, turn + 1, True, capacity), "packed"))
            break
    result = placed[0]
    for p in placed[1:]:
        result = result.union(p)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, doc_ids, ids): the packed sequences themselves, at most ``capacity`` ids each (doc_id must be a key)."""
    places = pack_documents(docs, tokenizer, capacity)
    ids = token_pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids")
    rows = places.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("r"))
    return rows.select("sequence_id", F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Contract rows of op2: one row per piece with its place.

    Null and empty texts are the single id END_ID.  Rows with a null or repeated
    doc_id are packed one by one like any other; other columns are ignored.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
