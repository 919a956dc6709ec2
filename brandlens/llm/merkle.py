"""Merkle manifest of a table over concatenated-level strings.

Method. A row's leaf is the SHA-256 of its fields. The leaves of a group stand in the order of
their ids and are cut into aligned blocks of `FAN ** BLOCK_LEVELS`. A block keeps each level of
its subtree as one string of hex digests behind each other: the level above is made by hashing
fixed-width substrings of it, one for each run of `FAN` nodes. What flanks a node inside its run
is the sibling segment of its proof. The roots of a group's blocks are the nodes of the next
round, until each group has one root left; the groups' roots, in the order of the groups, make
the root of the table in the same way. A proof is the list of segments from a leaf to the root,
and folding a leaf with it gives the root again, unless the row was changed.

Positions come from a range partition on (group, id), so a group that holds a third of all rows
is spread over many tasks; a task holds one block at a time. Texts are hashed where they are
read and never shuffled.

Defined cases: a null field is hashed as `-`, an empty one as `0:`; rows with a null id come
first in their group and repeated ids stand in the order of their leaves; repeated rows are
leaves of their own; rows with a null group make a group that comes first; a group of one row
has that row's leaf as its root, and a table of one group the root of that group; an empty
table has no leaves and gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.operators.reports import global_rank

from .common import materialise, sized_broadcast, table

#: Nodes that are hashed together, and levels of a block.
FAN = 2
BLOCK_LEVELS = 8
#: Hex digits of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Estimated bytes of a group's row (name, digests and a proof of the groups above it).
GROUP_BYTES = 4096
TAMPERED = 7
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbers(n: Column, most: int) -> Column:
    """0 to n - 1, for an n of at most `most`."""
    return F.slice(F.sequence(F.lit(0), F.lit(most)), F.lit(1), n.cast("int"))


def cut(level: Column, first: Column, n: Column) -> Column:
    """`n` digests of a level's string from number `first` on, or what there is of them."""
    return F.substr(level, (first * DIGEST + 1).cast("int"), (n * DIGEST).cast("int"))


def parents(level: Column, fan: int, block: int) -> Column:
    """The string of the level above."""
    runs = F.ceil(F.octet_length(level) / (DIGEST * fan))
    hashed = F.transform(numbers(runs, block), lambda i: F.sha2(cut(level, i * fan, F.lit(fan)), 256))
    return F.array_join(hashed, "").cast("binary")


def blocks_of(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """grp, block, total, members (pos, digest, row) and levels (one string each, the leaves'
    first) of every aligned block. `nodes` has grp, pos (from 0), digest, row and total, the
    nodes of the group."""
    size = fan ** depth
    packed = (nodes.withColumn("block", F.floor(F.col("pos") / size))
              .groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "row"))).alias("members"),
                                           F.max("total").alias("total"))
              .withColumn("first", F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")))

    def climb(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        more = (F.col("total") > size) | (F.octet_length(last) > DIGEST)
        return F.when(more, F.concat(levels, F.array(parents(last, fan, size)))).otherwise(levels)

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array("first"), climb)
    return materialise(packed.withColumn("levels", levels).drop("first"), "merkle-blocks")


def paths_of(blocks: DataFrame, fan: int, depth: int) -> DataFrame:
    """The members of `blocks` (grp, pos, digest, row), with `path`, their proof: their segments
    in the block and then those of the block's column `above`."""
    size = fan ** depth
    width = F.array(*[F.lit(fan ** j) for j in range(depth + 1)])

    def segments(i: Column) -> Column:
        def segment(j: Column) -> Column:
            at, level = F.floor(i / width[j]), F.col("levels")[j]
            run = F.floor(at / fan) * fan
            return F.struct(cut(level, run, at - run).alias("left"), cut(level, at + 1, run + fan - 1 - at).alias("right"))
        return F.transform(numbers(F.size("levels") - 1, depth), segment)

    member = F.transform("members", lambda m, i: F.struct(
        m["pos"].alias("pos"), m["digest"].alias("digest"), m["row"].alias("row"),
        F.concat(segments(i).cast(PATH), F.col("above")).alias("path")))
    kept = [c for c in blocks.columns if c not in ("members", "levels", "above", "block", "total")]
    return blocks.select(*kept, F.explode(member).alias("m")).select(*kept, "m.*")


def trees(nodes: DataFrame, fan: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of `nodes`, with `above` (the segments from the block's root to that of its
    group), and the root of each group (grp, digest)."""
    size = fan ** depth
    blocks = blocks_of(nodes, fan, depth)
    roots = blocks.select("grp", "block", "total", F.element_at("levels", -1).cast("string").alias("digest"))
    upper = roots.filter(F.col("total") > size).select(
        "grp", F.col("block").alias("pos"), "digest", F.lit(None).cast("string").alias("row"),
        F.ceil(F.col("total") / size).alias("total"))
    none = F.array().cast(PATH)
    done = roots.filter(F.col("total") <= size).select("grp", "digest")
    if upper.isEmpty():
        return blocks.withColumn("above", none), done
    higher, found = trees(upper, fan, depth)
    above = materialise(paths_of(higher, fan, depth).select("grp", F.col("pos").alias("block"), F.col("path").alias("above")),
                        "merkle-above")
    with_above = blocks.join(sized_broadcast(above, above.count(), GROUP_BYTES), ["grp", "block"], "left")
    return with_above.withColumn("above", F.coalesce("above", none)), done.unionByName(found)


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d.cast("binary"), s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, behind each other."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string")), ""), 256)


def manifest(rows: DataFrame, group: Column, order: list[Column], digest: Column, row: Column,
             fan: int = FAN, depth: int = BLOCK_LEVELS) -> DataFrame:
    """leaf, row, path (its proof up to the root of the table), subroot (of its group) and root
    of every row. `row` is carried along; `digest` is the leaf."""
    # of null and any text: null comes first, the others in the order of their bytes
    name = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    leaves = rows.select(name.alias("grp"), F.struct(*order).alias("key"), digest.alias("digest"), row.alias("row"),
                         F.monotonically_increasing_id().alias("at"))
    ranked = materialise(global_rank(leaves, [F.col(c) for c in ("grp", "key", "digest", "at")]).drop("key", "at"),
                         "merkle-leaves")
    groups = materialise(ranked.groupBy("grp").agg(F.min("rnk").alias("first"), F.count("*").alias("total")),
                         "merkle-groups")
    n_groups = groups.count()
    nodes = (ranked.join(sized_broadcast(groups, n_groups, GROUP_BYTES), "grp")
             .select("grp", (F.col("rnk") - F.col("first")).alias("pos"), "digest", "row", "total"))
    blocks, roots = trees(nodes, fan, depth)
    subroots = (global_rank(roots, [F.col("grp")])
                .select(F.lit("").alias("grp"), (F.col("rnk") - 1).alias("pos"), "digest", F.col("grp").alias("row"),
                        F.lit(n_groups).cast("long").alias("total")))
    top_blocks, top_root = trees(subroots, fan, depth)
    root = (top_root.first() or {"digest": None})["digest"]
    top = materialise(paths_of(top_blocks, fan, depth).select(
        F.col("row").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("top")), "merkle-top")
    return (paths_of(blocks.join(sized_broadcast(top, n_groups, GROUP_BYTES), "grp")
                     .withColumn("above", F.concat("above", "top")).drop("top"), fan, depth)
            .select(F.col("digest").alias("leaf"), "row", "path", "subroot", F.lit(root).alias("root")))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proof of every document, checked against a row that is changed where 7 divides crc32(doc_id)."""
    docs = table(spark, sf_dir, "documents")
    one_more = [F.col(c).cast("long") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    shown: Callable[[Column], Column] = lambda d: fold(d, F.col("path"))
    found = manifest(docs, F.col("lang"), [F.col("doc_id").cast("long").alias("doc_id")],
                     leaf(*[F.col(c) for c in FIELDS]),
                     F.struct(F.col("doc_id").cast("long").alias("doc_id"),
                              F.when(chosen, leaf(*one_more)).alias("tampered")))
    return (found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root",
                         proof_digest(F.col("path")).alias("proof_sha256"),
                         shown(F.coalesce("row.tampered", "leaf")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
