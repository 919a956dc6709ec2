"""Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brandlens.llm import merkle as X

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, grp int, pos int, digest string, path string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, fan):
    """All levels up to the one root."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i:i + fan])) for i in range(0, len(last), fan)])
    return levels


def proof(levels, at, fan):
    out = []
    for level in levels[:-1]:
        run = at // fan * fan
        out.append((level[run:at], level[at + 1:run + fan]))
        at //= fan
    return out


def plain(rows, fan):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]], fan)
    top = climb([trees[g][-1][0] for g in order], fan) if order else []
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            path = proof(trees[g], at, fan) + proof(top, k, fan)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for left, right in path:
                folded = h("".join(left) + folded + "".join(right))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0],
                        h("".join("".join(a) + "".join(b) for a, b in path)), folded))
    return out


def spark_rows(df, fan, depth):
    one_more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in X.FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = X.manifest(df, F.col("lang"), [F.col("doc_id")], X.leaf(*[F.col(c) for c in X.FIELDS]),
                       F.struct("doc_id", F.when(chosen, X.leaf(*one_more)).alias("t")), fan, depth)
    return [tuple(r) for r in found.select(
        "row.doc_id", "leaf", "subroot", "root", X.proof_digest(F.col("path")),
        X.fold(F.coalesce("row.t", "leaf"), F.col("path"))).collect()]


def documents(n):
    rng = random.Random(n)
    langs = [None, "", "a", "de", "é", "zz"]
    rows = [(i, rng.choice(["s", None, "quelle"]), langs[min(5, int(rng.expovariate(0.7)))], rng.choice([None, 0, 9, 99]),
             rng.choice([None, "", "text " * rng.randrange(9), "日本語", "1:2"])) for i in range(n)]
    return rows + rows[:3] + [(None, "s", "a", 1, "no id"), (None, "s", "a", 1, "no id either"), (7, "other", "a", 2, "x")]


@pytest.mark.parametrize("n, fan, depth", [(60, 2, 1), (300, 2, 2), (200, 3, 2), (300, 2, 8)])
def test_against_plain_version(spark, n, fan, depth):
    rows = documents(n)
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert sorted(spark_rows(df, fan, depth), key=repr) == sorted(plain(rows, fan), key=repr)


def test_one_row_and_no_rows(spark):
    df = spark.createDataFrame([(5, "s", "de", 1, "t", 1, 2, "x", "y")], SCHEMA)
    (found,) = spark_rows(df, 2, 8)
    own = leaf((5, "s", "de", 1, "t"))
    assert found == (5, own, own, own, h(""), own)
    assert spark_rows(df.limit(0), 2, 8) == []


def test_query_tells_changed_rows(spark, sf):
    rows = X.op12_merkle_manifest(spark, sf).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
    assert len({r.root for r in rows}) == 1
