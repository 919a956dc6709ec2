"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .contamination import op3_contamination
from .exact_dedup import op1_exact_dedup
from .grammar_ids import op2_grammar_ids
from .importance import op13_importance_resampling
from .jaccard_join import op8_jaccard_join
from .language import op6_language
from .main_text import op5_main_text
from .merkle import op12_merkle_manifest
from .pivot_index import op11_pivot_near_dedup
from .private_data import op7_private_data
from .quality import op4_quality
from .toxicity import op9_toxicity

_FOLD_SQL = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz')")

_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: CRC-32 of texts: a table of 256 values, then one byte a step over the hex digits of `crc_of`.
_CRC_SQL = """
    bits AS (SELECT i AS v, 0 AS k, i AS c FROM range(256) t(i) UNION ALL
        SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc_step AS (SELECT v, c FROM bits WHERE k = 8),
    crc_at AS (SELECT word, hex(encode(word)) AS x, 0 AS i, 4294967295::BIGINT AS c FROM crc_of UNION ALL
        SELECT word, x, i + 2, xor(s.c, a.c >> 8) FROM crc_at a JOIN crc_step s
            ON s.v = xor(a.c, ('0x' || x[i + 1:i + 2])::BIGINT) & 255 WHERE i < length(x)),
    crc AS (SELECT word, xor(c, 4294967295) AS crc FROM crc_at WHERE i = length(x))"""


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of each group at every level, from `leaves` (grp, pos, h, n)."""
    return f"""{name} AS (SELECT grp, 0 AS lvl, pos, h, n FROM {leaves} UNION ALL
        SELECT grp, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
        FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 2, n)"""


def _climb_sql(name: str, tree: str, start: str) -> str:
    """Proof (sib) and folded digest (f) of each row of `start` (id, grp, pos, f, sib, n) in `tree`."""
    return f"""{name} AS (SELECT id, grp, 0 AS lvl, pos, f, sib, n FROM {start} UNION ALL
        SELECT c.id, c.grp, c.lvl + 1, c.pos // 2,
            CASE WHEN t.h IS NULL THEN sha256(c.f) WHEN c.pos % 2 = 1 THEN sha256(t.h || c.f) ELSE sha256(c.f || t.h) END,
            c.sib || coalesce(t.h, ''), (c.n + 1) // 2
        FROM {name} c LEFT JOIN {tree} t ON t.grp = c.grp AND t.lvl = c.lvl AND t.pos = xor(c.pos, 1) WHERE c.n > 1)"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_grammar_ids": op2_grammar_ids,
    "op3_contamination": op3_contamination,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_language": op6_language,
    "op7_private_data": op7_private_data,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_pivot_near_dedup": op11_pivot_near_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD_SQL} AS folded FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY folded)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE crc_of AS (SELECT DISTINCT doc_id::VARCHAR AS word FROM documents), {_CRC_SQL},
        rows AS (SELECT doc_id, coalesce('1' || lang, '0') AS grp, {_leaf_sql("n_chars")} AS h,
            {_leaf_sql("n_chars + 1")} AS changed FROM documents),
        leaves AS (SELECT doc_id AS id, grp, h, changed, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos,
            count(*) OVER (PARTITION BY grp) AS n FROM rows),
        {_tree_sql("tree", "leaves")},
        subroots AS (SELECT '' AS grp, grp AS lang, h, row_number() OVER (ORDER BY grp) - 1 AS pos,
            count(*) OVER () AS n FROM tree WHERE n = 1),
        {_tree_sql("top", "subroots")},
        shown AS (SELECT id, grp, pos, CASE WHEN crc % 7 = 0 THEN changed ELSE h END AS f, '' AS sib, n
            FROM leaves JOIN crc ON word = id::VARCHAR),
        {_climb_sql("inner_path", "tree", "shown")},
        at_subroot AS (SELECT id, '' AS grp, s.pos, f, sib, s.n FROM inner_path p JOIN subroots s ON s.lang = p.grp
            WHERE p.n = 1),
        {_climb_sql("path", "top", "at_subroot")}
        SELECT l.id AS doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(p.sib) AS proof_sha256,
            p.f AS folded_root, p.f = r.h AS verified
        FROM leaves l JOIN subroots s ON s.lang = l.grp JOIN path p ON p.id = l.id AND p.n = 1
        JOIN top r ON r.n = 1""",
    "op13_importance_resampling": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD_SQL}, '{_WORD_SQL}') AS w FROM documents),
        target AS (SELECT unnest(regexp_extract_all({_FOLD_SQL}, '{_WORD_SQL}')) AS word FROM benchmark),
        each AS (SELECT doc_id, unnest(w) AS word FROM words),
        crc_of AS (SELECT word FROM each UNION SELECT word FROM target), {_CRC_SQL},
        corpus_n AS (SELECT crc % 10000 AS b, count(*) AS n FROM each JOIN crc USING (word) GROUP BY 1),
        target_n AS (SELECT crc % 10000 AS b, count(*) AS n FROM target JOIN crc USING (word) GROUP BY 1),
        totals AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM corpus_n) AS s,
            (SELECT coalesce(sum(n), 0)::DOUBLE FROM target_n) AS t),
        gains AS (SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (totals.s + 10000))
            / ((c.n + 1) * (totals.t + 10000))))::BIGINT AS gain
            FROM corpus_n c LEFT JOIN target_n t USING (b), totals),
        sums AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
            FROM each JOIN crc USING (word) JOIN gains ON b = crc % 10000 GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)
                / 4294967296::DOUBLE)))::BIGINT AS score
            FROM words LEFT JOIN sums USING (doc_id)),
        ranked AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place,
            10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked""",
}
