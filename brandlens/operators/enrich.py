"""Incremental enrichment run: cached rows pass through, only new rows do the work.

current rows --(J2 overlay with admitted cache)--> cached | new
new --> search enrichment (BM25 / near-dup / fuzzy over the new rows as corpus)
    --> batches of 5 --> prompts --> model (mapInPandas) --> parse --> zip --> sanitise
result = cached rows (whole) + enriched new rows; meta = counts and facts of the run.

The new-row slice feeds three branches (search, batching, result), so it is
written once to the shared checkpoint folder instead of being recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NEAR_DUP_THRESHOLD, BrandProfile
from ..session import ensure_checkpoint_dir, materialise, scratch_dir
from ..sources.sinks import meta_row
from .classify import (ANSWER_FIELDS, assign_batches, batch_prompts, incremental_overlay, parse_answers,
                       sanitise_answer, stored_answers, zip_batch_results, DEFAULT_PROMPT)
from .reports import global_rank, newest_first_order
from .search import search_enrich

SEARCH_FIELDS = ("bm25_score", "is_near_duplicate", "fuzzy_brand_match")


def enrich_incremental(current: DataFrame, previous: DataFrame | None, profile: BrandProfile,
                       model_fn: Callable[[list[str]], list[str]] | None,
                       keys: Sequence[str] = ("platform", "id"), prompt: str = DEFAULT_PROMPT,
                       threshold: float = NEAR_DUP_THRESHOLD,
                       prefix_s: float | None = None, search: bool = True,
                       refresh_cols: Sequence[str] = (), scan: Sequence[Column] | None = None,
                       answers: str | None = None, backend: str = "none") -> tuple[DataFrame, DataFrame]:
    """(enriched rows, one-row meta). `previous` is the last enriched output or None.

    `scan` is the order in which near-duplicates are looked for (the first copy stays); by
    default the arrival order. `answers` is the folder that keeps the model's answers: each
    prompt is asked once, for rows and meta together, and a run that was killed goes on from
    what it has; by default a folder of this run. `backend` is named in the meta row.

    `search=False` skips the BM25 / near-duplicate / fuzzy stage (its columns stay NULL),
    as the single-source variant of the original does; `refresh_cols` are taken from
    the current rows even for cached ones.
    """
    keys = list(keys)
    fields = ANSWER_FIELDS + SEARCH_FIELDS
    if previous is None:
        previous = current.limit(0).select(*keys, *[F.lit(None).alias(f) for f in fields])
    over = incremental_overlay(current, previous, keys, fields, refresh_cols)
    ensure_checkpoint_dir(current.sparkSession)
    base_cols = [c for c in current.columns]
    new = materialise(over.where(F.col("is_new")).select(*base_cols), "enrich-new")
    cached = over.where(~F.col("is_new"))

    if search:
        if scan is None:
            s = search_enrich(new, profile, keys, threshold=threshold, prefix_s=prefix_s)
        else:
            ranked = global_rank(new.select(*keys, "event_time", "seq"), scan, "_scan").select(*keys, "_scan")
            s = search_enrich(new.join(ranked, keys), profile, keys, order="_scan", threshold=threshold,
                              prefix_s=prefix_s).drop("_scan")
    else:
        s = new.select("*", *[F.lit(None).cast(t).alias(f) for f, t in
                              zip(SEARCH_FIELDS, ("double", "boolean", "boolean"))])
    if model_fn is not None:
        b = assign_batches(new, newest_first_order())
        store = answers or scratch_dir(new.sparkSession, "enrich-answers")
        resp = stored_answers(batch_prompts(b, prompt), model_fn, store)
        ans = resp.select("batch_id", parse_answers(F.col("response"), F.col("n")).alias("answers"))
        labels = zip_batch_results(b, ans).select(*keys, *sanitise_answer(F.col("answer")))
    else:  # no model: answer columns stay empty, as with no backend in the original
        labels = new.select(*keys, *[F.lit(None).alias(f) for f in ANSWER_FIELDS])
    enriched = s.join(labels, keys).withColumn("is_new", F.lit(True))
    out = cached.unionByName(enriched.select(*cached.columns))
    flag = F.coalesce(F.col("is_critical"), F.lit(False)).alias("is_critical")
    meta = meta_row(out.select("platform", "topic", flag)).select(
        "*", out.agg(F.count_if("is_new").cast("bigint")).scalar().alias("new_this_run"),
        F.lit(backend if model_fn is not None else "none").alias("llm_backend"),
        F.lit(model_fn is not None).alias("llm_enriched"), F.lit(search).alias("search_enriched"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_analyzed"))
    return out, meta
