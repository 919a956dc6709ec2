"""Benchmark decontamination: edit-similar passages by CGK embedding and bit sampling.

Method. Texts are sequences of words (lower case, without signs). The CGK embedding walks
over a sequence: step j writes the word under the walk and then stays or moves on by a
random bit of (j, word). Sequences at a small edit distance soon walk in step again, so
their walks agree in most places (Hamming distance). A repetition samples a few steps of a
walk as its key. Walks start at every word of a document and, for each benchmark item, at
several anchors of the item, more than it allows edits, since an edit at an anchor spoils its
walks; a document window as long as the item whose key equals an item's key is a candidate.
The number of repetitions is measured for each item length: passages with all allowed edits are
drawn, and repetitions are added until the target share of them is found. A walk whose key after
its first sampled step is no item's ends there. Every candidate is verified by the exact edit
distance in words.

With `exact` each item is also cut into one piece more than it allows edits. One piece of any
passage within the distance is left whole, and a walk that goes straight on over it has the same
key, so no passage is missed. The query leaves this off.

A document contains an item if some passage is within `1 - SIMILARITY` of the item's words
(at least 0.8 similar). Items are indexed in blocks of bounded size, all documents are read
against each block, and a document is settled inside one task, so nothing is shuffled and a
passage that many documents share costs each of them the same.

Defined cases: null or empty texts and items contain no words and match nothing; items of
fewer than five words must occur word for word; repeated items and repeated documents each
get rows of their own; null ids pass through; empty tables give an empty result; other
columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, documents, table
from .ngrams import WORD_BYTES, Texts, pieces

by_value(__name__)

SIMILARITY = 0.8
SAMPLED = 3
#: Share of the passages with all allowed edits that the repetitions have to find.
RECALL = 0.998
#: Passages drawn to measure it, and the most repetitions tried.
TRIALS = 1000
MOST_REPEATS = 60
#: Items in one index.
ITEMS = 20_000
#: Anchors of an item that allows few edits.
LEAST_ANCHORS = 4
FIRST_BITS = 20


def item_words(texts: list[str]) -> list[np.ndarray]:
    """The hashed words of each item."""
    batch = Texts(pa.array(texts, pa.string()), WORD_BYTES)
    h, first, last = batch.words()
    return [h[a:b] for a, b in zip(first, last, strict=True)]


def walk(words: np.ndarray, at: np.ndarray, repeat: int, steps: np.ndarray,
         known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the walks that start at the places `at` (the words under the walk at `steps`) and
    the numbers of these walks. With `known`, a bitmap of the keys after the first sampled step,
    walks without one of these end there."""
    rng = np.random.default_rng(1000 + repeat)
    coins = rng.integers(0, 1 << 32, steps[-1] + 1, dtype=np.uint32) | np.uint32(1)
    number, last = np.arange(len(at)), len(words) - 1
    key = words[at].astype(np.uint64)  # the first word is part of every key
    for step in range(int(steps[-1]) + 1):
        word = words[at]
        if step in steps:
            key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            if known is not None and step == steps[0]:
                bit = key >> np.uint64(64 - FIRST_BITS)
                stays = np.flatnonzero(known[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1)
                number, key, at, word = number[stays], key[stays], at[stays], word[stays]
        at = np.minimum(at + ((word * coins[step]) >> np.uint32(31)), last)
    return key, number


def straight_walk(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As `walk`, for walks that look at each of `length` words."""
    last = len(words) - 1
    key = words[at].astype(np.uint64)
    for step in range(1, length):
        key = (key ^ words[np.minimum(at + step, last)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key, np.arange(len(at))


def item_pieces(length: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item of `length` words, one more than it allows edits."""
    bounds = np.arange(edits(length) + 2) * length // (edits(length) + 1)
    return [(a, b - a) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def sampled_steps(length: int, repeat: int) -> np.ndarray:
    """The steps of a walk over `length` words that one repetition looks at. A walk is at most
    at word j in step j, so it stays inside the words."""
    if length < 2:
        return np.zeros(1, np.int64)
    rng = np.random.default_rng(77_000 + 100 * length + repeat)
    return np.sort(rng.choice(np.arange(1, length), min(SAMPLED, length - 1), replace=False))


def walk_words(length: int) -> int:
    """The words that a walk over an item may look at, a power of two."""
    return 1 << max(length // 2, 1).bit_length() - 1


def stretches(length: int) -> list[range]:
    """The places of an item's anchors, one of each range: more than it allows edits."""
    span = length - walk_words(length) + 1
    step = max(1, span // max(LEAST_ANCHORS, edits(length) + 1))
    return [range(a, min(a + step, span)) for a in range(0, span, step)]


def drawn_edits(words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """`words` with all allowed edits, changed, left out or added words, at random places or
    about evenly dealt, which leaves the shortest whole parts."""
    edited, allowed, even = words.tolist(), edits(len(words)), rng.random() < 0.5
    for k, kind in enumerate(rng.integers(0, 3, allowed)):
        place = int((k + rng.random()) * len(edited) / allowed) if even else int(rng.integers(0, len(edited)))
        edited[place:place + (kind < 2)] = [] if kind == 1 else [int(rng.integers(0, 1 << 32))]
    return np.array(edited, np.uint32)


@functools.cache
def repeats_needed(length: int) -> int:
    """The repetitions that find the share RECALL of drawn passages of an item length."""
    rng = np.random.default_rng(length)
    steps = walk_words(length)
    items = rng.integers(0, 1 << 32, (TRIALS, length), dtype=np.uint32)
    passages = np.concatenate([drawn_edits(words, rng) for words in items])
    offsets = np.array([int(rng.choice(places)) for places in stretches(length)])
    at = (np.arange(TRIALS)[:, None] * length + offsets).ravel()
    found = np.zeros(TRIALS, bool)
    for repeat in range(MOST_REPEATS):
        sampled = sampled_steps(steps, repeat)
        key, _ = walk(items.ravel(), at, repeat, sampled)
        other, _ = walk(passages, np.arange(len(passages)), repeat, sampled)
        found |= np.isin(key, other).reshape(TRIALS, -1).any(1)
        if found.mean() >= RECALL:
            return repeat + 1
    return MOST_REPEATS


class Index:
    """Walk keys of the anchors of one block of items, with `exact` of their pieces too."""

    def __init__(self, items: list[np.ndarray], exact: bool = False):
        self.items = items
        self.counts = [Counter(x.tolist()) for x in items]
        counts: dict[int, int] = {}
        for words in items:
            for w in set(words.tolist()):
                counts[w] = counts.get(w, 0) + 1
        # (item, offset) by the words that a walk may look at and the repetitions needed
        by_walk: dict[tuple[int, int], list[tuple[int, int]]] = {}
        by_piece: dict[int, list[tuple[int, int]]] = {}  # (item, offset) by the words of a piece
        for number, words in enumerate(items):
            if not len(words):
                continue
            anchors = by_walk.setdefault((walk_words(len(words)), repeats_needed(len(words))), [])
            for choice in stretches(len(words)):
                # in each stretch the word that fewest items have
                anchors.append((number, min(choice, key=lambda o: (counts[int(words[o])], o))))
            for offset, size in item_pieces(len(words)) if exact else ():
                by_piece.setdefault(size, []).append((number, offset))
        # all items behind each other; a walk from an anchor stays inside its item
        flat = np.concatenate([np.zeros(0, np.uint32), *items])
        starts = np.cumsum([0] + [len(x) for x in items])
        tables = [(anchors, [(repeat, sampled_steps(seen, repeat)) for repeat in range(repeats)])
                  for (seen, repeats), anchors in sorted(by_walk.items())]
        self.tables = []
        for anchors, repeats in tables:
            at = np.array([starts[n] + o for n, o in anchors])
            keyed = []
            for repeat, steps in repeats:
                known = np.zeros(1 << FIRST_BITS, bool)
                known[walk(flat, at, repeat, steps[:1])[0] >> np.uint64(64 - FIRST_BITS)] = True
                keyed.append((functools.partial(walk, repeat=repeat, steps=steps, known=np.packbits(known)),
                              walk(flat, at, repeat, steps)[0]))
            self.add(anchors, keyed)
        for size, anchors in sorted(by_piece.items()):
            at = np.array([starts[n] + o for n, o in anchors])
            keys_of = functools.partial(straight_walk, length=size)
            self.add(anchors, [(keys_of, keys_of(flat, at)[0])])

    def add(self, anchors: list[tuple[int, int]], keyed: list[tuple]) -> None:
        firsts = np.zeros(1 << FIRST_BITS, bool)
        for number, offset in anchors:
            firsts[self.items[number][offset] >> np.uint32(32 - FIRST_BITS)] = True
        orders = [np.argsort(key, kind="stable") for _, key in keyed]
        self.tables.append((firsts, np.array(anchors), [
            (keys_of, key[order], order) for (keys_of, key), order in zip(keyed, orders, strict=True)]))

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (start, item) rows: where an item may begin in `words`."""
        found = []
        for firsts, anchors, repeats in self.tables:
            begin = np.flatnonzero(firsts[words >> np.uint32(32 - FIRST_BITS)])
            for keys_of, keys, order in repeats:
                if not len(begin):
                    break
                key, walks = keys_of(words, begin)
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                hit = np.flatnonzero(high > low)
                many = (high - low)[hit]
                which = order[np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                start = np.repeat(begin[walks[hit]], many) - anchors[which, 1]
                found.append(np.stack([start, anchors[which, 0]], 1))
        if not found:
            return np.zeros((0, 2), np.int64)
        spots = np.concatenate(found)
        key = np.unique((spots[:, 1] << 40) | (spots[:, 0] + (1 << 20)))  # places may be below 0
        return self.plausible(words, (key & ((1 << 40) - 1)) - (1 << 20), key >> 40)

    def plausible(self, words: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of (start, item) rows in the order of items, those whose surroundings hold enough of
        the item's words for the allowed distance."""
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1, [len(item)]))
        keep = np.zeros(len(item), bool)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = self.items[item[a]]
            allowed = edits(len(own))
            near = np.arange(-allowed, len(own) + allowed)
            known = np.unique(own)
            for at in range(a, b, 1 << 14):
                some = slice(at, min(b, at + (1 << 14)))
                window = words[np.clip(start[some, None] + near, 0, len(words) - 1)]
                found = known[np.minimum(np.searchsorted(known, window), len(known) - 1)] == window
                keep[some] = found.sum(1) >= len(own) - allowed
        return np.stack([start[keep], item[keep]], 1)


def edits(words: int) -> int:
    """The edit distance that an item of so many words allows."""
    return int(words * (1 - SIMILARITY) + 1e-9)


def distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Edit distance in words of `item` to the nearest part of `passage`, and that part's end."""
    row = np.zeros(len(passage) + 1, np.int64)  # the part may begin anywhere
    steps = np.arange(len(passage) + 1)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (passage != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def matches(index: Index, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple]:
    """(text, item, distance, words of the item, place) of every verified pair of a slice."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    spots = index.candidates(words)
    # the text in which the anchor's window lies
    for start, number in spots.tolist():
        item = index.items[number]
        allowed = edits(len(item))
        text = int(np.searchsorted(first, min(start + len(item) // 2, len(words) - 1), "right")) - 1
        while text >= 0 and last[text] == first[text]:
            text -= 1
        # an anchor near a text's end may point past it
        for t in {text, int(np.searchsorted(first, max(start, 0), "right")) - 1}:
            if t < 0 or best.get((t, number), (1 << 30, 0))[0] == 0:
                continue
            a, b = int(first[t]), int(last[t])
            if start >= a and start + len(item) <= b and np.array_equal(words[start:start + len(item)], item):
                best[t, number] = (0, start - a)
                continue
            lo, hi = max(a, start - allowed), min(b, start + len(item) + allowed)
            if hi - lo < len(item) - allowed:
                continue
            near = set(words[lo:hi].tolist())
            if sum(n for w, n in index.counts[number].items() if w in near) < len(item) - allowed:
                continue  # too few of the item's words occur at all
            d, end = distance(item, words[lo:hi])
            if d <= allowed and (d, lo) < best.get((t, number), (1 << 30, 0)):
                best[t, number] = (d, max(0, lo + end - len(item) - a))
    return [(t, n, d, len(index.items[n]), place) for (t, n), (d, place) in sorted(best.items())]


def indexes(benchmark: DataFrame, exact: bool) -> Iterator:
    """Broadcast (index, item ids) of each block of items, pickled here so that workers need no
    copy of this package."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil(items.count() / ITEMS))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):  # about ITEMS items each
        some = items.filter(block_of == block).filter("text IS NOT NULL").orderBy("item_id", "text").collect()
        index = Index(item_words([r["text"] for r in some]), exact) if some else None
        yield benchmark.sparkSession.sparkContext.broadcast(
            cloudpickle.dumps((index, [r["item_id"] for r in some])))


def matches_of(piece: pa.RecordBatch, index: Index | None) -> list[tuple]:
    if index is None or not index.tables:
        return []
    return matches(index, *Texts(pc.fill_null(piece["text"], ""), WORD_BYTES).words())


def contaminated(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, distance (edits in
    words), item_words, place (word of the document at which the passage begins)."""
    rows, parts = documents(docs), []
    for shared in indexes(benchmark, exact):

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = cloudpickle.loads(shared.value)
            for batch in batches:
                for piece in pieces(batch):
                    hits = matches_of(piece, index)
                    text, item, d, n, place = (list(x) for x in zip(*hits)) if hits else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [piece["doc_id"].take(pa.array(text, pa.int64())),
                         pa.array([ids[i] for i in item], pa.int64()), pa.array(d, pa.int32()),
                         pa.array(n, pa.int32()), pa.array(place, pa.int64())],
                        ["doc_id", "item_id", "distance", "item_words", "place"])

        parts.append(rows.mapInArrow(
            found, "doc_id long, item_id long, distance int, item_words int, place long"))
    return functools.reduce(DataFrame.unionByName, parts)


def clean_rows(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no item."""
    bounded_batches(docs.sparkSession)
    for shared in indexes(benchmark, exact):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, _ = cloudpickle.loads(shared.value)
            for batch in batches:
                for piece in pieces(batch):
                    stays = np.ones(piece.num_rows, bool)
                    stays[[hit[0] for hit in matches_of(piece, index)]] = False
                    yield piece.filter(pa.array(stays))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_contamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in every whole document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
