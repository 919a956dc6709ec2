"""Token ids in files compressed by a Re-Pair grammar per shard.

Method. Documents are put in ascending id order, encoded, and cut into shards of whole
documents. Inside a shard, rounds of Re-Pair replace frequent pairs of neighbouring symbols
by new symbols (nonterminals), left to right and without overlap, until no pair is frequent
enough or the symbol space is used up. A pair never starts with the end symbol, so every
document begins at a symbol boundary.

File format: Parquet, one row per shard, with
  part, shard     order of the shards (all of part 0, then part 1, ...)
  first           ids of the part before this shard
  n_ids           ids in this shard
  doc_ids, doc_n  the documents of the shard and the ids of each, end id included
  n_terminals     symbols below this are ids, the others are rules
  rules           left and right symbol of each rule, unsigned 32-bit little-endian pairs
  lengths         ids that each rule expands to, unsigned 32-bit
  narrow          whether sequence has 16-bit symbols
  sequence        the compressed sequence, unsigned 16-bit if all symbols fit, else 32-bit
The expansion lengths give the position of every symbol without expanding it, so a range of
ids is read by expanding only the symbols that it touches.

Defined cases: a null text counts as empty and holds only the end id; null ids come first;
equal ids are ordered by text; an empty table writes an empty file set; other columns are
ignored; a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import by_value, documents, scratch_dir, table
from .ngrams import pieces
from .tokens import Slices, gather

by_value(__name__)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
#: A pair that occurs less often in a shard is not worth a rule.
MIN_PAIRS = 32
#: Pairs at least this share as frequent as the most frequent one are replaced together.
ROUND_SHARE = 1 / 64
#: Distinct words whose ids a worker remembers.
WORDS = 1_500_000
#: Bytes of text encoded at once.
SLICE_BYTES = 12 << 20


def byte_signs() -> dict[int, str]:
    """The sign that byte-level pre-tokenizers write for each byte of UTF-8 text."""
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    signs: dict[int, str] = {}
    for code in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)]:
        signs.update(zip(chr(code).encode(), level.pre_tokenize_str(chr(code))[0][0], strict=True))
    return signs


class WordIds:
    """Ids of white-space separated words (A-Z in lower case), encoded once and remembered.

    The tokenizer folds case, drops white space and never looks across it, so the ids of a
    text are those of its words. A comma or full stop after an ASCII letter is a piece of
    its own, so a word is looked up without it.
    """

    TAILS = ("", ".", ",")

    def __init__(self, path: str, most: int):
        self.tokenizer = Tokenizer.from_file(path)
        # words hold no added token: texts that do are encoded as a whole
        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.byte_signs = byte_signs()
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = Slices([], np.dtype("<u4"))
        self.learn(pa.array(self.TAILS, pa.string()))

    def learn(self, words: pa.Array) -> None:
        """Remember the ids of `words`, none of which is known."""
        made, other, places = [b""] * len(words), [], []
        tokenize = self.tokenizer.model.tokenize
        for i, word in enumerate(words.to_pylist()):
            if word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):
                # letters that the normaliser leaves as they are: one piece, byte by byte
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_signs)
                made[i] = array("I", [t.id for t in tokenize(piece)]).tobytes()
            elif word:
                other.append(word)
                places.append(i)
        for i, e in zip(places, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            made[i] = array("I", e.ids).tobytes()
        new = Slices(made, np.dtype("<u4"))
        self.words = pa.concat_arrays([self.words, words])
        self.ids = Slices.of_lengths(np.concatenate([self.ids.flat, new.flat]),
                                     np.concatenate([self.ids.lengths, new.lengths]))

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word; unknown ones are learned."""
        if len(self.words) > self.most:
            self.forget()
        at = pc.index_in(words, self.words)
        if at.null_count:
            missing = pc.is_null(at)
            new = pc.unique(words.filter(missing))
            place = pc.add(pc.index_in(words.filter(missing), new), pa.scalar(len(self.words), pa.int32()))
            self.learn(new)
            at = pc.replace_with_mask(at, missing, place)
        return at.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all `texts` in order, and how many belong to each."""
        special = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else pa.array([], pa.bool_())
        if not pc.any(special).as_py():
            return self.encode_words(texts)
        ids, n = self.encode_words(pc.if_else(special, pa.scalar("", texts.type), texts))
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        own = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(
            texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
        parts = np.split(ids, np.cumsum(n)[at])
        n = n.copy()
        n[at] = [len(x) for x in own]
        return np.concatenate([x for pair in zip(parts, [*own, np.zeros(0, "<u4")], strict=True) for x in pair]), n

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for texts without an added token."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        # the last byte of each word, and the one before it
        offsets = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset:distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        last = np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 1, 0)], 0) if len(data) else offsets[1:]
        before = data[np.maximum(offsets[1:] - 2, 0)] if len(data) else offsets[1:]
        tail = np.where((before >= 97) & (before <= 122), (last == 46) + 2 * (last == 44), 0)
        # a letter stands before the tail, so trimming takes this one sign only
        base = self.find(pc.if_else(pa.array(tail > 0), pc.ascii_rtrim(distinct, ".,"), distinct))
        both = np.stack([base, tail], 1)
        ids = Slices.of_lengths(self.ids.join(both.ravel()), self.ids.lengths[both].sum(1))
        codes = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(ids.lengths[codes])))[np.cumsum(per_text)]
        return ids.join(codes), np.diff(ends, prepend=0)


def word_ids(path: str, most: int = WORDS) -> WordIds:
    """The worker process's table for `path`; it outlives a task when the worker does."""
    home = sys.modules.setdefault("_brandlens_word_ids", types.ModuleType("_brandlens_word_ids"))
    if path not in home.__dict__:
        home.__dict__[path] = WordIds(path, most)
    return home.__dict__[path]


# ---- the grammar -----------------------------------------------------------------------


def frequent_pairs(keys: np.ndarray, shift: int, ends: np.ndarray, least: int, share: float,
                   most: int) -> np.ndarray:
    """The frequent pairs of `keys` that do not begin with the end of a document, the most
    frequent ones first."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(at, len(keys)))
    often = counts >= least
    pairs, counts = keys[at[often]], counts[often]
    inside = ~ends[pairs >> keys.dtype.type(shift)]
    pairs, counts = pairs[inside], counts[inside]
    chosen = np.flatnonzero(counts >= counts.max(initial=0) * share)
    return pairs[chosen[np.argsort(-counts[chosen], kind="stable")[:most]]]


def without_overlap(at: np.ndarray) -> np.ndarray:
    """Which places count when every one covers two symbols: in a run of neighbouring places
    every second one, from the left."""
    keep = np.ones(len(at), bool)
    joined = np.flatnonzero(np.diff(at) == 1) + 1  # places that touch the one before
    if len(joined):
        new_run = np.concatenate(([True], np.diff(joined) != 1))
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(joined)), 0))
        keep[joined] = (np.arange(len(joined)) - first) % 2 == 1
    return keep


def compress(ids: np.ndarray, n_terminals: int, end_id: int, least: int = MIN_PAIRS,
             share: float = ROUND_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules as pairs, expansion length of each rule, compressed sequence)."""
    narrow = n_terminals < 1 << 16
    seq = ids.astype(np.uint32)
    space = (1 << 16 if narrow else 1 << 31) - n_terminals  # symbols left for rules
    # a pair is one key; narrow symbols need half the width
    kind, shift, mixer = ((np.uint32, 16, 0x9E3779B1) if narrow
                          else (np.uint64, 32, 0x9E3779B97F4A7C15))
    to_slot = kind(8 * np.dtype(kind).itemsize - 20)
    rules: list[np.ndarray] = []
    lengths = np.ones(n_terminals, np.uint32)
    ends = np.zeros(n_terminals, bool)
    ends[end_id] = True
    while space > 0 and len(seq) > 1:
        keys = (seq[:-1].astype(kind) << kind(shift)) | seq[1:]
        pairs = frequent_pairs(keys, shift, ends, least, share, min(space, 1 << 13))
        if not len(pairs):
            break
        # one pair to a slot; of pairs that share a slot the most frequent one has its turn
        slots, first = np.unique((pairs * kind(mixer)) >> to_slot, return_index=True)
        pairs = pairs[first]
        pair_at = np.zeros(1 << 20, kind)  # an empty slot holds a key of another slot
        pair_at[0] = 1
        pair_at[slots] = pairs
        rule_at = np.zeros(1 << 20, np.int16)
        rule_at[slots] = np.arange(len(pairs))  # at most 2^13
        slot = (keys * kind(mixer)) >> to_slot
        at = np.flatnonzero(pair_at[slot] == keys)
        at = at[without_overlap(at)]
        rule = rule_at[slot[at]].astype(np.uint32)
        left = (pairs >> kind(shift)).astype(np.uint32)
        right = (pairs & kind((1 << shift) - 1)).astype(np.uint32)
        seq[at] = rule + np.uint32(len(lengths))
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        ends = np.concatenate([ends, ends[right]])
        space -= len(pairs)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return made, lengths[n_terminals:], seq.astype(np.uint16 if narrow else np.uint32)


class Grammar:
    """A shard's rules, ready to expand."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, n_terminals: int):
        self.lengths = np.concatenate([np.ones(n_terminals, np.int64), lengths.astype(np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.empty(int(self.lengths.sum()), np.uint32)
        self.flat[:n_terminals] = np.arange(n_terminals)
        for k, (left, right) in enumerate(rules.tolist()):  # rules name only earlier symbols
            at, a, b = self.starts[n_terminals + k], self.starts[left], self.starts[right]
            middle = at + self.lengths[left]
            self.flat[at:middle] = self.flat[a:a + self.lengths[left]]
            self.flat[middle:middle + self.lengths[right]] = self.flat[b:b + self.lengths[right]]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts, self.lengths, seq)

    def read(self, seq: np.ndarray, start: int, n: int) -> np.ndarray:
        """`n` ids from place `start` on; expands only the symbols that hold them."""
        ends = np.cumsum(self.lengths[seq])
        first, last = np.searchsorted(ends, [start, start + n - 1], "right")
        before = ends[first - 1] if first else 0
        return self.expand(seq[first:last + 1])[start - before:start - before + n]


def grammar_of(row) -> tuple[Grammar, np.ndarray]:
    """The grammar and the sequence of one row of the file."""
    return (Grammar(np.frombuffer(row.rules, "<u4").reshape(-1, 2), np.frombuffer(row.lengths, "<u4"),
                    row.n_terminals), np.frombuffer(row.sequence, "<u2" if row.narrow else "<u4"))


# ---- writing and reading ----------------------------------------------------------------

def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list]]:
    """Texts and ids of the rows of all batches, in groups of about `most` bytes: the words of a
    large group repeat more, so fewer are looked up."""
    rows: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, most):
            rows.append(piece)
            size += pc.sum(pc.binary_length(piece["text"])).as_py()
            if size >= most:
                yield pa.concat_arrays([r["text"] for r in rows]), pa.concat_arrays([r["doc_id"] for r in rows]).to_pylist()
                rows, size = [], 0
    if rows:
        yield pa.concat_arrays([r["text"] for r in rows]), pa.concat_arrays([r["doc_id"] for r in rows]).to_pylist()


schema = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_n", pa.list_(pa.int64())), ("n_terminals", pa.int32()),
    ("narrow", pa.bool_()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])
SHARDS = ("part int, shard int, first long, n_ids long, doc_ids array<long>, doc_n array<long>, "
          "n_terminals int, narrow boolean, rules binary, lengths binary, sequence binary")


def write(docs: DataFrame, out: str, path: str = VOCABULARY, end_id: int = END_ID,
          shard_ids: int = SHARD_IDS) -> None:
    """Encode `docs` and write the shards, ordered by doc_id, to the folder `out`."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        n_terminals = words.tokenizer.get_vocab_size()
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, doc_n, parts, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            rules, lengths, seq = compress(ids, n_terminals, end_id)
            row = (part, shard, first, len(ids), doc_ids, doc_n, n_terminals, seq.dtype == np.uint16,
                   rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for texts, ids_of_texts in gathered(batches, SLICE_BYTES):
            ids, n = words.encode(texts)
            # the end id after the ids of each document
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            at = 0
            for doc_id, end, count in zip(ids_of_texts, np.cumsum(n).tolist(), n.tolist(), strict=True):
                doc_ids.append(doc_id)
                doc_n.append(count)
                size += count
                if size >= shard_ids:
                    parts.append(ids[at:end])
                    yield packed()
                    at, shard, first = end, shard + 1, first + size
                    doc_ids, doc_n, parts, size = [], [], [], 0
            parts.append(ids[at:])
        if doc_ids:
            yield packed()

    (documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(shards, SHARDS)
     .write.option("compression", "zstd").parquet(out))


def read(spark, out: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files in `out`: doc_id, start (ids before it), n_tokens, ids_crc32
    (of its ids as read) and, unless they are not wanted, ids (unsigned 32-bit little-endian)."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                grammar, seq = grammar_of(row)
                ids = grammar.expand(seq).astype("<u4").tobytes()
                n = np.array(row.doc_n, np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                texts = [ids[4 * a:4 * b] for a, b in zip(starts, ends, strict=True)]
                made = pd.DataFrame({
                    "doc_id": pd.array(row.doc_ids, "Int64"), "start": starts + row.first,
                    "n_tokens": n, "ids_crc32": [zlib.crc32(t) for t in texts], "part": row.part})
                yield made.assign(ids=texts) if with_ids else made

    shards = spark.read.parquet(out)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rows = shards.mapInPandas(
        expand, "doc_id long, start long, n_tokens long, ids_crc32 long, part int" + ", ids binary" * with_ids)
    return (rows.join(before, "part")
            .withColumn("start", F.col("start") + F.col("before")).drop("part", "before"))


def op2_grammar_ids(spark, sf_dir: str) -> DataFrame:
    """Write the ids of every whole document as grammar shards and read the files back."""
    out = f"{scratch_dir(spark, 'grammar-ids')}/shards"
    write(table(spark, sf_dir, "documents"), out)
    return read(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
