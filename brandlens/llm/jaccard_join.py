"""N-gram Jaccard join by T-occurrence search.

Method. A document is its set of distinct word shingles (hashed), and equal sets are one
node. Two nodes that reach the similarity share at least t of their shingles. In the order
of the hashes their prefixes of n - t + l shingles share at least l, so inverted lists are
kept for prefixes only and a pair is sought that occurs l times in them. As in DivideSkip the
lists are divided: short lists are merged and the occurrences of each pair counted, with the
threshold lowered by the number of long lists that a node is in; long lists are never merged.
A pair that reaches the lowered threshold is verified by probing the larger set, by binary
search, for the shingles of the smaller one.

Only nodes that are in so many long lists that the lowered threshold is zero can be similar
without meeting in a short list. They are large families of near copies. Of their long lists
only the rarest ones are needed, as many as the node has beyond the threshold. These are
searched by a pivot first: every node of a list is verified against one node of the list, and
linked nodes become one component. What is left are nodes of different components. They are
dealt into blocks of bounded size, every two blocks that share a list are compared in one
task by counting the shingles that their nodes have in common, and a task returns only links
that join components it has not joined yet. So no pair is ever a row, nothing inside a
component is looked at again, and no link between components is lost.

Links end as connected components, found by rounds of minimum labels in Spark. State between
rounds is written to the shared folder.

Defined cases: a null or empty text has an empty set (n_shingles 0) and is linked with nothing;
a text with fewer words than a shingle is one shingle; equal texts and equal sets are linked;
null ids pass through and never name a component unless all its ids are null; an empty table
gives an empty result; other columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_value, conf, documents, materialise, release_memory, sized_broadcast, table
from .ngrams import Texts, pieces

by_value(__name__)

#: Words of a shingle and similarity in hundredths of the query.
WORDS = 4
PERCENT = 85
#: A list of more nodes is long.
LONG = 32
#: Entries of the lists that are merged in one place.
PLACE_ENTRIES = 1_000_000
PIVOT_ROUNDS = 1
#: Nodes of a block, and shingles counted at once when two blocks are compared.
BLOCK_NODES = 512
COUNTED = 4096
#: Words are what stands between blanks and the control characters 9 to 13.
SIGNS = np.array([32 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint8)


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of `n` shares at least with any set similar to it."""
    return -(-n * percent // 100)


def wanted(n, percent: int = PERCENT):
    """Occurrences (l) that the prefix of a set of `n` is long enough for."""
    return np.minimum(least_overlap(n, percent), np.maximum(48, 1 + n // 8))


def lowest_wanted(n, percent: int = PERCENT):
    """The smallest `wanted` of any set that can be similar to one of `n`."""
    return wanted(least_overlap(n, percent), percent)  # `wanted` never falls as sets grow


def shingle_sets(texts: pa.Array, words: int, salt: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first, last = Texts(texts, SIGNS, ascii_only=True).words(64)
    step = np.uint64(0x100000001B3 + 2 * salt)
    whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        whole = whole * step + h[k:len(h) - words + 1 + k]
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    whole ^= whole >> np.uint64(29)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from longer shingles
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray, salt: int) -> int | None:
    """A 64-bit name of the set."""
    if not len(shingles):
        return None
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), salt))))


def sets_of(docs: DataFrame, words: int, percent: int, salt: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n, node, check (a second name) and prefix of every
    document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece["text"], words, salt)
                size = [int(len(s) - least_overlap(len(s), percent) + wanted(len(s), percent)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], piece["text_key"], pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([node_of(s, salt) for s in sets], pa.int64()),
                     pa.array([node_of(s, salt + 1) for s in sets], pa.int64()),
                     pa.array([s[:k].tobytes() for s, k in zip(sets, size, strict=True)], pa.binary())],
                    ["doc_id", "text_key", "n", "node", "check", "prefix"])

    return documents(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        rows, "doc_id long, text_key long, n int, node long, check long, prefix binary")


# ---- inverted lists ---------------------------------------------------------------------


def by_place(sets: DataFrame, places: int) -> DataFrame:
    """The prefixes cut by place: place, nodes, sizes, owner (of each shingle) and shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows = np.unique(batch["node"].to_numpy(), return_index=True)
            if not len(nodes):
                continue
            prefix = batch["prefix"].take(pa.array(rows)).to_pylist()
            count = np.array([len(p) // 8 for p in prefix])
            shingle = np.frombuffer(b"".join(prefix), np.uint64)
            owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), count)
            size = batch["n"].to_numpy()[rows].astype(np.uint32)
            # prefixes hold the smallest hashes, so places are dealt by another mix of the bits
            place = (((shingle * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
            order = np.argsort(place.astype(np.int32), kind="stable")
            cuts = np.searchsorted(place[order], np.arange(places + 1))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    own, number = np.unique(owner[order[a:b]], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                            nodes[own], size[own], number.astype(np.uint32), shingle[order[a:b]]))],
                        ["place", "nodes", "sizes", "owner", "shingles"])

    return sets.filter("node IS NOT NULL").select("node", "n", "prefix").mapInArrow(
        cut, "place int, nodes binary, sizes binary, owner binary, shingles binary")


def merge_lists(nodes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shingle: np.ndarray,
                percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the lists of one place: ((a, b) numbers of pairs in short lists, how many lists hold
    both, (shingle, node number) entries of long lists as indexes into `shingle`)."""
    order = np.argsort(owner, kind="stable")
    order = order[np.argsort(shingle[order], kind="stable")]
    s, o = shingle[order], owner[order]
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])))
    order, s, o = order[fresh], s[fresh], o[fresh]
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    length = np.diff(np.append(begin, len(s)))
    keys = []
    for m in range(2, LONG + 1):
        lists = o[begin[length == m][:, None] + np.arange(m)]  # sorted by node number
        if len(lists):
            i, j = np.triu_indices(m, 1)
            a, b = lists[:, i].ravel().astype(np.uint64), lists[:, j].ravel().astype(np.uint64)
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            near = 100 * low.astype(np.int64) >= percent * high.astype(np.int64)
            keys.append((a[near] << np.uint64(32)) | b[near])
    pair, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    long_entries = order[np.repeat(length > LONG, length)]
    return np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.int64), count, long_entries


def search_lists(sets: DataFrame, places: int, percent: int) -> DataFrame:
    """kind 'pair': nodes a and b, their sizes, and how many short lists of a place hold both;
    kind 'long': shingle a is in a long list that holds node b."""

    def merged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [[np.frombuffer(r[k], t) for r in rows] for k, t in (
            ("nodes", np.int64), ("sizes", np.uint32), ("owner", np.uint32), ("shingles", np.uint64))]
        before = np.cumsum([0] + [len(x) for x in parts[0]])[:-1]
        names, at = np.unique(np.concatenate(parts[0]), return_inverse=True)
        sizes = np.zeros(len(names), np.uint32)
        sizes[at] = np.concatenate(parts[1])
        owner = at[np.concatenate([x + b for x, b in zip(parts[2], before, strict=True)])]
        shingle = np.concatenate(parts[3])
        pair, count, entries = merge_lists(names, sizes, owner, shingle, percent)
        for kind, a, b, n_a, n_b, shared in (
                ("pair", names[pair[:, 0]], names[pair[:, 1]], sizes[pair[:, 0]], sizes[pair[:, 1]], count),
                ("long", shingle[entries].view(np.int64), names[owner[entries]], sizes[owner[entries]],
                 sizes[owner[entries]], np.ones(len(entries)))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(n_a.astype(np.int32)),
                 pa.array(n_b.astype(np.int32)), pa.array(shared.astype(np.int32))],
                ["kind", "a", "b", "n_a", "n_b", "shared"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:  # sorted by place
            for row in batch.to_pylist():
                if rows and row["place"] != rows[0]["place"]:
                    yield from merged(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from merged(rows)
        release_memory()

    return (by_place(sets, places).repartition(places, "place").sortWithinPartitions("place")
            .mapInArrow(merge, "kind string, a long, b long, n_a int, n_b int, shared int"))


def column_wanted(n, percent: int = PERCENT):
    """`wanted` as a column."""
    overlap = F.ceil(n * percent / 100).cast("int")
    return F.least(overlap, F.greatest(F.lit(48), F.lit(1) + F.floor(n / 8).cast("int")))


def column_lowest(n, percent: int = PERCENT):
    return column_wanted(F.ceil(n * percent / 100).cast("int"), percent)


# ---- verification -----------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity; the smaller one's shingles are looked up in
    the larger one, and the look-up ends when too many are missing."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    # 100 * x >= percent * (n + m - x)
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    missing, step = len(small) - need, 256
    for at in range(0, len(small), step):
        part = small[at:at + step]
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        missing -= int((large[place] != part).sum())
        if missing < 0:
            return False
    return missing >= 0


def full_sets(docs: DataFrame, nodes: DataFrame, words: int, salt: int) -> DataFrame:
    """node and shingles of the given nodes, from the texts."""
    n_nodes = nodes.count()
    few = n_nodes * 8 <= BROADCAST_BYTES
    wanted_nodes = np.sort(nodes.toPandas()["node"].to_numpy(np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(wanted_nodes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = shared.value, set()
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for shingles in shingle_sets(piece["text"], words, salt):
                    node = node_of(shingles, salt)
                    if node is None or node in sent:
                        continue
                    if known is not None:
                        at = np.searchsorted(known, node)
                        if at == len(known) or known[at] != node:
                            continue
                        sent.add(node)
                    out.append((node, shingles.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())],
                    ["node", "shingles"])

    made = documents(docs).mapInArrow(rows, "node long, shingles binary")
    return (made if few else made.join(nodes, "node", "left_semi")).dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of `pairs` whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                    for x, y in zip(batch["of_a"], batch["of_b"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that has a link."""
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "join-edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")),
                        "join-labels")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        # a label's own label is at least as small
        further = label.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = (label.join(near, "node").join(further, "component", "left")
               .select("node", F.col("component").alias("old"),
                       F.least("component", "near", "jump").alias("component")))
        new = materialise(new, "join-labels")
        if new.filter("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def classes_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component of all `nodes`; a node without a link is its own component."""
    return materialise(nodes.join(components(links), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")), "join-classes")


# ---- blocks of nodes in long lists ----------------------------------------------------------


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `a` has in common with each set of `b`."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return counts

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shingle = np.concatenate(sets)
        column = np.minimum(np.searchsorted(both, shingle), len(both) - 1)
        known = both[column] == shingle
        return row[known], column[known]

    (row_a, column_a), (row_b, column_b) = entries(a), entries(b)
    for first in range(0, len(both), COUNTED):  # a bounded number of shingles at a time
        held = []
        for row, column, n in ((row_a, column_a, len(a)), (row_b, column_b, len(b))):
            matrix = np.zeros((n, COUNTED), np.float32)
            some = (column >= first) & (column < first + COUNTED)
            matrix[row[some], column[some] - first] = 1
            held.append(matrix)
        counts += held[0] @ held[1].T
    return counts


def joining_links(a: list[dict], b: list[dict], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between nodes of two blocks, each of which joins two components that the links
    before it have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [[np.frombuffer(x["shingles"], np.uint64) for x in block] for block in (a, b)]
    n, m = (np.array([len(x) for x in s]) for s in sets)
    similar_to = 100 * (common := common_counts(*sets)) >= percent * (n[:, None] + m[None, :] - common)
    component = np.array([x["component"] for x in b])
    out = []
    for i, row in enumerate(similar_to):
        hits = np.flatnonzero(row & (component != a[i]["component"]))
        for j in hits[np.unique(component[hits], return_index=True)[1]].tolist():
            x, y = root(a[i]["component"]), root(b[j]["component"])
            if x != y:
                parent[x] = y
                out.append((a[i]["node"], b[j]["node"]))
    return out


def block_links(family: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different components that share a long list (a, b)."""
    # nodes with the same rarest list are neighbours; a large group of them is split
    group = family.filter("rank = 1").select("node", F.col("shingle").alias("home"))
    sizes = group.groupBy("home").agg(F.count("*").alias("size"))
    n_small = sizes.filter(F.col("size") < BLOCK_NODES).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("size") >= BLOCK_NODES
    split = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_NODES))
    shared = F.pmod(F.xxhash64("home"), F.lit(n_small // BLOCK_NODES + 1))
    placed = materialise(group.join(sizes, "home").join(label, "node").select(
        "node", "component", F.when(large, F.col("home")).otherwise(F.lit(0)).alias("home"),
        F.when(large, split).otherwise(shared).alias("part"), large.alias("large"))
        .withColumn("block", F.xxhash64("large", "home", "part")), "join-placed")
    pure = placed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = family.join(placed.select("node", "block"), "node").select("block", "shingle").distinct().join(pure, "block")
    other = held.select("shingle", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = (held.withColumnRenamed("block", "a").join(other, "shingle")
             # two blocks of one component have nothing to tell
             .filter("a <= b AND NOT (low = high AND low_b = high_b AND low = low_b)").select("a", "b").distinct())
    # about BLOCK_NODES nodes a row
    packed = materialise(placed.select("node", "component", "block").join(sets, "node").groupBy("block").agg(
        F.collect_list(F.struct("node", "component", "shingles")).alias("nodes")), "join-blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = joining_links(batch["of_a"][i].as_py(), batch["of_b"][i].as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                                  pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    rows = (materialise(pairs, "join-block-pairs")
            .join(packed.select(F.col("block").alias("a"), F.col("nodes").alias("of_a")), "a")
            .join(packed.select(F.col("block").alias("b"), F.col("nodes").alias("of_b")), "b"))
    with conf(family.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
        return materialise(rows.repartition("a", "b").select("of_a", "of_b").mapInArrow(compare, "a long, b long"),
                           "join-links")


def linked(docs: DataFrame, sets: DataFrame, words: int, percent: int, salt: int) -> DataFrame:
    """node and component of every node that is linked with another one."""
    spark = docs.sparkSession
    entries = sets.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    found = materialise(search_lists(sets, max(24, math.ceil(entries / PLACE_ENTRIES)), percent), "join-found")
    long_lists = found.filter("kind = 'long'").select(F.col("a").alias("shingle"), F.col("b").alias("node"),
                                                      F.col("n_b").alias("n"))
    in_long = materialise(long_lists.groupBy("node").agg(F.count("*").alias("long"), F.max("n").alias("n")), "join-long")
    counted = (found.filter("kind = 'pair'").groupBy("a", "b")
               .agg(F.sum("shared").alias("shared"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")))
    long_of = in_long.select("node", "long")
    short_pairs = materialise(
        counted.join(long_of.withColumnsRenamed({"node": "a", "long": "long_a"}), "a", "left")
        .join(long_of.withColumnsRenamed({"node": "b", "long": "long_b"}), "b", "left")
        .withColumn("skipped", F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))))
        .filter(F.col("shared") >= F.least(column_wanted(F.col("n_a"), percent), column_wanted(F.col("n_b"), percent))
                - F.col("skipped"))
        .select("a", "b"), "join-candidates")
    # Nodes that may have met a similar one in long lists only. The rarest shingle that a pair
    # shares is, in either node, among the rarest `long - l + 1` of its long lists: at least
    # l - 1 shared ones follow it. So a node is looked for in these lists alone.
    length = long_lists.groupBy("shingle").agg(F.count("*").alias("length"))
    spare = in_long.select("node", (F.col("long") - column_lowest(F.col("n"), percent) + 1).alias("spare")).filter("spare > 0")
    rarest = Window.partitionBy("node").orderBy("length", "shingle")
    family = materialise(long_lists.join(spare, "node").join(length, "shingle")
                         .withColumn("rank", F.row_number().over(rarest)).filter("rank <= spare")
                         .select("shingle", "node", "n", "rank"), "join-family")
    nodes = (short_pairs.select(F.col("a").alias("node")).unionByName(short_pairs.select(F.col("b").alias("node")))
             .unionByName(family.select("node")).distinct())
    nodes = materialise(nodes, "join-nodes")
    empty = spark.createDataFrame([], "a long, b long")
    if nodes.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    texts = materialise(full_sets(docs, nodes, words, salt), "join-sets")

    links, tested, label = empty, empty, nodes.withColumn("component", F.col("node"))
    for turn in range(PIVOT_ROUNDS + 1):
        label_a = label.withColumnsRenamed({"node": "a", "component": "at_a"})
        label_b = label.withColumnsRenamed({"node": "b", "component": "at_b"})

        def apart(pairs: DataFrame, label_a=label_a, label_b=label_b, tested=tested) -> DataFrame:
            """Pairs of different components that have not been verified."""
            return (pairs.join(label_a, "a").join(label_b, "b").filter("at_a <> at_b")
                    .select("a", "b").join(tested, ["a", "b"], "left_anti"))

        placed = family.join(label, "node")
        if turn < PIVOT_ROUNDS:
            # one partner for each node, and one pivot for each long list
            one = apart(short_pairs).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            pivot = placed.groupBy("shingle").agg(
                F.min_by(F.struct("node", "component", "n"), F.xxhash64("node", F.lit(turn))).alias("pivot"))
            with_pivot = (placed.join(pivot, "shingle")
                          .filter((F.col("component") != F.col("pivot.component"))
                                  & (100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")))
                          .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")))
            pairs = one.unionByName(with_pivot.distinct().join(tested, ["a", "b"], "left_anti"))
        else:
            pairs = apart(short_pairs)
        pairs = materialise(pairs.distinct(), "join-pairs")
        if not pairs.isEmpty():
            with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="100"):  # two sets a row
                links = links.unionByName(materialise(verify(pairs, texts, percent), "join-links"))
            tested = tested.unionByName(pairs)
            label = classes_of(nodes, links)
    more = block_links(family, texts, label, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        label = classes_of(nodes, links)
    return label.join(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
                      .distinct(), "node", "left_semi")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id (the smallest id reachable by links) of every
    row. Sets of shingles of `words` words are linked from a Jaccard similarity of `percent`
    hundredths on."""
    for salt in range(0, 100, 2):
        sets = materialise(sets_of(docs, words, percent, salt), "join-sets-of")
        nodes = materialise(sets.filter("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("rows"),
            (F.min("check") != F.max("check")).alias("mixed")), "join-nodes-of")
        if nodes.filter("mixed").isEmpty():  # two sets never share a name
            break
    classes = linked(docs, sets.select("node", "n", "prefix"), words, percent, salt)
    of_component = (classes.join(nodes.select("node", "first"), "node")
                    .groupBy("component").agg(F.min("first").alias("component_id")))
    named = materialise(classes.join(of_component, "component").select("node", "component_id"), "join-named")
    # nodes whose rows need another id than their own
    label = materialise(nodes.join(named, "node", "left").filter("rows > 1 OR component_id IS NOT NULL").select(
        "node", F.coalesce("component_id", "first").alias("component_id")), "join-label")
    return (sets.select("doc_id", "text_key", "n", "node")
            .join(sized_broadcast(label, label.count(), 64), "node", "left")
            .select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with their own columns, that stay when every component keeps the
    document that names it (the smallest id). Rows without an id stay if no row of their
    component has one."""
    dropped = materialise(join(docs, words, percent).filter("NOT doc_id <=> component_id").select(
        F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).distinct(), "join-dropped")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(sized_broadcast(dropped, dropped.count(), 64),
                     docs["doc_id"].cast("long").eqNullSafe(F.col("drop_id")) & (key == F.col("drop_key")),
                     "left_anti")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of similar documents over every whole text."""
    return join(table(spark, sf_dir, "documents")).drop("text_key")
