"""Hashed byte n-grams of many texts at once, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, crc_remainder, documents, materialise, release_memory, sized_broadcast

by_value(__name__)

#: Bytes of text looked at together.
SLICE_BYTES = 1 << 20
#: Estimated bytes of a label's or a sampled row's entry in a broadcast.
LABEL_BYTES = 64
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def pieces(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows with about `most` bytes of text, each copied to arrays of its own
    (string kernels of Arrow may misread arrays that begin inside another one)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.take(pa.array(np.arange(at, end)))
        at = end
    release_memory()


#: Letters and digits stay, as do all bytes of other scripts.
WORD_BYTES = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first `n` powers of an odd number modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x100000001B3
        _POWERS[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64))]
    return [x[:n] for x in _POWERS]


class Texts:
    """UTF-8 bytes of many texts in one buffer, each between two spaces.

    Letters become small (A-Z only if `ascii_only`) and bytes are mapped by `signs`; by default
    control characters count as spaces.
    """

    def __init__(self, texts: pa.Array, signs: np.ndarray | None = None, ascii_only: bool = False):
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        lower = pc.ascii_lower if ascii_only else pc.utf8_lower
        padded = pc.binary_join_element_wise(empty, lower(texts.cast(pa.large_string())), empty, space)
        offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset:padded.offset + len(padded) + 1]
        data = padded.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8))
        self.bytes = np.maximum(self.bytes, 32) if signs is None else signs[self.bytes]
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]

    def grams(self, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
        """(n, a 32-bit hash of the n bytes that begin at each byte) for rising n."""
        h = np.zeros(len(self.bytes), np.uint32)
        for n in range(1, max(orders) + 1):
            if n > len(self.bytes):
                return
            h = h[:len(self.bytes) - n + 1] * _STEP + self.bytes[n - 1:]
            if n in orders:
                x = (h + np.uint32(n)) * _MIX
                yield n, x ^ (x >> np.uint32(15))

    def words(self, bits: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each space-separated word, and the range of words of each text."""
        space = self.bytes == 32
        first = np.flatnonzero(~space[1:] & space[:-1]) + 1
        last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        # a word's hash is a difference of running sums, moved to a common power
        power, back = powers(len(self.bytes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * power)])
        h = (sums[last] - sums[first]) * back[first]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h >> np.uint64(32)).astype(np.uint32) if bits == 32 else h ^ (h >> np.uint64(32))
        return h, np.searchsorted(first, self.starts), np.searchsorted(first, self.ends)

    def range_of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places at which n-grams of each text begin."""
        return self.starts, np.maximum(self.ends - n + 1, self.starts)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `values` over each range."""
    running = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    last = len(values)
    return running[np.minimum(ends, last)] - running[np.minimum(starts, last)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                    per_class: int) -> DataFrame:
    """text and label of at most `per_class` labelled documents of each label.

    Rows whose crc32(doc_id) modulo `modulus` is `held_out` are never taken. The rows are
    those first in the order of a hash of their id, so the sample does not depend on how the
    tables are stored. A document labelled more than once takes its largest label.
    """
    known = materialise(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()
                & (crc_remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id").agg(F.max("label").alias("label")), "sample-labels")
    sizes = materialise(known.groupBy("label").agg(F.count("*").alias("n")), "sample-sizes")
    # a bound on the hash leaves a few more rows of each label than are taken; only these are ranked
    spare = per_class + 8 * int(per_class ** 0.5) + 8
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    few = (known.join(sized_broadcast(sizes, sizes.count(), LABEL_BYTES), "label").withColumn("h", h)
           .filter(F.col("h") * F.col("n") < F.lit(spare) * F.lit(1 << 31)))
    order = W.partitionBy("label").orderBy("h", "doc_id")
    taken = materialise(few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_class)
                        .select("doc_id", "label"), "sample")
    return (documents(docs).join(sized_broadcast(taken, taken.count(), LABEL_BYTES), "doc_id")
            .select("text", "label"))
