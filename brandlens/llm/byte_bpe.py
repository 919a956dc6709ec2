"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Method. Documents are packed into blocks of bounded size. Each block is split into words
with positions: a word is a run of visible characters with the white space before it, and
since no pre-token goes on from a visible character into white space, the pre-tokens of a
text are those of its words. The block keeps its position sequence as numbers of its own
distinct words. The distinct words of all blocks are exploded and shuffled by a hash of the
word, so that all uses of a word meet in one place; there each distinct word of the corpus
is split by the pattern and encoded once. Its ids are joined back to the blocks that use it,
and every document is reassembled from its positions. Decoding looks each id up in the
token-byte table (one entry per id of the vocabulary, which bounds its size) and joins the
bytes in order.

A block names a word once however often it occurs, so a very frequent word weighs no more
than one entry per block. The words that a block sends to one place travel as one packed
row, and so do their ids on the way back.

Defined cases: a null text counts as empty and has no ids; a null or repeated id is carried
through row by row; an empty table gives an empty result; other columns are ignored; a text
longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, documents, release_memory, table
from .ngrams import pieces
from .tokens import Slices

by_value(__name__)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary file: bytes of each token and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32: one byte each, 255 announcing that four planes of further bytes hold
    the rest."""
    first = np.minimum(numbers, 255).astype(np.uint8)
    rest = np.ascontiguousarray(numbers[numbers >= 255] - 255, "<u4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pack(first.tobytes() + np.ascontiguousarray(rest).tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    n, data = int.from_bytes(packed[:8], "little"), np.frombuffer(unpack(packed[8:]), np.uint8)
    numbers = data[:n].astype(np.uint32)
    rest = np.ascontiguousarray(data[n:].reshape(4, -1).T).view("<u4").ravel()
    numbers[numbers == 255] += rest
    return numbers


def pack_words(words: list[bytes]) -> bytes:
    """UTF-8 words in one string; the byte between them is in no UTF-8 text."""
    return pack(b"\xff".join(words)) if words else b""


def unpack_words(packed: bytes) -> list[bytes]:
    return unpack(packed).split(b"\xff") if packed else []


MARK = "\x01"
#: White space of the pattern, and a word: visible characters with the white space before.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Texts with other white space than single blanks, tabs and line ends, or with the mark.
UNEVEN = r"[\s\x0b\x{85}\pZ]{2}|[\x01\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The word numbers of all `texts` in order, how many belong to each, and the words."""
    texts = texts.cast(pa.large_string())
    marked = texts
    for blank in " \n\t\r":  # a word begins before every single blank
        marked = pc.replace_substring(marked, blank, MARK + blank)
    cut = pc.split_pattern(marked, MARK)
    uneven = pc.match_substring_regex(texts, UNEVEN)
    if pc.any(uneven).as_py():
        found = pa.array([WORD.findall(t) if u else None for t, u in
                          zip(texts.to_pylist(), uneven.to_pylist(), strict=True)], cut.type)
        cut = pc.if_else(uneven, found, cut)
    per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(cut).dictionary_encode()
    return coded.indices.to_numpy(), per_text, coded.dictionary


def split_blocks(docs: DataFrame, block_bytes: int, places: int, what: str) -> DataFrame:
    """Blocks of documents: block and mark (a checksum of its distinct words), and either

    words: the distinct words, packed by place, the most frequent ones of a place first, or
    codes: doc_ids, n_words (of each document) and the word codes in order. The code of the
    word of rank r in place p is r * places + p, so frequent words have small codes.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            codes, n, words = split_words(pa.concat_arrays([r["text"] for r in rows]))
            words = words.cast(pa.large_binary()).to_pylist()
            place = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % places
            order = np.lexsort([-np.bincount(codes, minlength=len(words)), place])
            cuts = np.searchsorted(place[order], np.arange(places + 1))
            row = (block, zlib.crc32(b"\xff".join(words)))
            if what == "words":
                row += ([pack_words([words[i] for i in order[a:b].tolist()])
                         for a, b in zip(cuts, cuts[1:], strict=False)],)
            else:
                code = np.empty(len(words), np.uint32)
                code[order] = (np.arange(len(words)) - cuts[place[order]]) * places + place[order]
                row += (pa.concat_arrays([r["doc_id"] for r in rows]).to_pylist(), n.tolist(),
                        pack_numbers(code[codes]))
            schema = SCHEMAS[what]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for piece in pieces(batch, block_bytes // 4):
                rows.append(piece)
                size += pc.sum(pc.binary_length(piece["text"])).as_py()
                if size >= block_bytes:
                    yield packed()
                    block, rows, size = block + 1, [], 0
                    release_memory()
        if rows:
            yield packed()
        release_memory()

    return documents(docs).mapInArrow(split, {
        "words": "block long, mark long, words array<binary>",
        "codes": "block long, mark long, doc_ids array<long>, n_words array<long>, codes binary"}[what])


SCHEMAS = {
    "words": pa.schema([("block", pa.int64()), ("mark", pa.int64()), ("words", pa.list_(pa.binary()))]),
    "codes": pa.schema([("block", pa.int64()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("n_words", pa.list_(pa.int64())), ("codes", pa.binary())])}


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every document."""
    return reassembled(docs, lambda ids: {"ids": ids}, "ids binary", path, pattern, block_bytes)


def reassembled(docs: DataFrame, shown: Callable[[list[bytes]], dict], schema: str, path: str = VOCABULARY,
                pattern: str = PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the columns that `shown` makes of the ids of some documents.

    `docs` is read twice, for the words of its blocks and for their order, so that the texts
    need not be kept in between; it must give the same rows in the same partitions, as tables
    do. A block that differs between the readings fails the job.
    """
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, at = encoding(path, pattern), {}, None
        for batch in batches:  # sorted by place; a place's words are encoded once
            for row in batch.to_pylist():
                if row["place"] != at:
                    known, at = {}, row["place"]
                words = unpack_words(row["words"])
                new = [w for w in words if w not in known]
                for word in new:
                    known[word] = np.array(enc.encode_ordinary(word.decode()), "<u4").tobytes()
                ids = [known[w] for w in words]
                n = np.fromiter(map(len, ids), "<u4", len(ids)) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["of_block"]]), pa.array([row["of_mark"]]), pa.array([at], pa.int32()),
                     pa.array([pack_numbers(n)]), pa.array([pack_numbers(np.frombuffer(b"".join(ids), "<u4"))])],
                    ["of_block", "of_mark", "place", "n", "ids"])
        release_memory()

    def reassemble(key, block: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if set(words["of_mark"]) - set(block["mark"]) or not len(block):
            raise ValueError("the documents changed between two readings; write them to a table first")
        starts = np.zeros(places, np.int64)  # number of the first word of each place
        flat, n, made = [], [], []
        for row in words.sort_values("place").itertuples():
            starts[row.place] = sum(map(len, n))
            flat.append(unpack_numbers(row.ids))
            n.append(unpack_numbers(row.n))
        ids = Slices.of_lengths(np.concatenate([*flat, np.zeros(0, "<u4")]), np.concatenate([*n, np.zeros(0, "<u4")]))
        for row in block.itertuples():
            codes, n_words = unpack_numbers(row.codes), np.asarray(row.n_words)
            ends = np.cumsum(n_words)
            for group in np.array_split(np.arange(len(ends)), len(codes) // (1 << 18) + 1):
                if len(group):  # a bounded part of the block at a time
                    lo, hi = ends[group[0]] - n_words[group[0]], ends[group[-1]]
                    own = starts[codes[lo:hi] % places] + codes[lo:hi] // places
                    joined = ids.join(own)
                    cut = np.concatenate(([0], np.cumsum(ids.lengths[own])))[np.concatenate(([0], ends[group] - lo))]
                    made += [joined[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        doc_ids = [x for row in block.itertuples() for x in row.doc_ids]
        release_memory()
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in doc_ids], "Int64"),
                             **shown(made)})

    words = split_blocks(docs, block_bytes, places, "words")
    used = (words.select(F.col("block").alias("of_block"), F.col("mark").alias("of_mark"),
                         F.posexplode("words").alias("place", "words"))
            .filter(F.octet_length("words") > 0))
    ids = (used.repartition(places, "place").sortWithinPartitions("place")
           .mapInArrow(encode_words, "of_block long, of_mark long, place int, n binary, ids binary"))
    return (split_blocks(docs, block_bytes, places, "codes").groupBy("block")
            .cogroup(ids.groupBy("of_block"))
            .applyInPandas(reassemble, f"doc_id long, {schema}"))


def token_bytes(path: str) -> Slices:
    """The token-byte table."""
    ranks = sorted((rank, token) for token, rank in ranks_of(path).items())
    tokens = [b""] * (ranks[-1][0] + 1)
    for rank, token in ranks:
        tokens[rank] = token
    return Slices(tokens, np.dtype(np.uint8))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`encoded` with the column decoded (the bytes of `ids`)."""

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = token_bytes(path)
        for ids in batches:
            yield ids.map(lambda x: tokens.join(np.frombuffer(x, "<u4")).tobytes())

    return encoded.withColumn("decoded", bytes_of("ids"))


def digests(docs: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to, and the ids.

    Decoding and digests follow where a document is put together, so a task needs one worker and
    the bytes go nowhere."""
    table_of: dict[str, Slices] = {}  # made once a task

    def shown(ids: list[bytes]) -> dict:
        if not table_of:
            table_of["tokens"] = token_bytes(VOCABULARY)
        tokens = table_of["tokens"]
        decoded = [hashlib.sha256(tokens.join(np.frombuffer(x, "<u4")).tobytes()).hexdigest() for x in ids]
        return ({"ids": ids} if with_ids else {}) | {
            "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": decoded}

    return reassembled(docs, shown, "ids binary, " * with_ids
                       + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the bytes they decode to."""
    return digests(table(spark, sf_dir, "documents"), with_ids=False)
