"""Registered queries for sources and sinks (landed JSON -> mentions, envelope round trip)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import prepare, scratch_dir
from ..sources.driver import mentions, mentions_sql
from ..sources.landed import load_sources
from ..sources.sinks import meta_row, read_envelope, write_envelope
from .registry import query
from .stand_ins import write_landed

M = f"WITH mentions AS ({mentions_sql()})"


# --- S1-S6: read landed payloads (one path missing), flatten, normalise, union -----------
@query("normalise_mentions", f"""{M}
SELECT platform, id, coalesce(title, '') AS title, text, author, date_trunc('second', event_time) AS event_time, votes,
       NULL::INTEGER AS rating, NULL::BIGINT AS likes FROM mentions WHERE platform = 'reddit'
UNION ALL SELECT platform, id, NULL, text, author, event_time, NULL, NULL, votes FROM mentions WHERE platform = 'twitter'
UNION ALL SELECT platform, id, NULL, text, author, event_time, NULL, rating, NULL FROM mentions WHERE platform = 'playstore'
UNION ALL SELECT platform, 'ios_' || sha256(author || '-' || id || strftime(event_time, '%Y-%m-%d %H:%M:%S')),
       coalesce(title, ''), text, author || '-' || id, event_time, NULL, rating, NULL FROM mentions WHERE platform = 'appstore'""")
def q_normalise_mentions(spark, sf_dir):
    prepare(spark)
    paths = write_landed(mentions(spark, sf_dir))
    u = load_sources(spark, reddit=[paths["reddit"], paths["reddit"] + "-missing"], twitter=[paths["twitter"]],
                     playstore=[paths["playstore"]], appstore=[paths["appstore"]])
    plat = F.col("platform")
    return u.select(
        "platform", "id",
        F.when(plat.isin("reddit", "appstore"), F.col("title")).alias("title"), "text", "author",
        "event_time",
        F.when(plat == "reddit", F.col("votes")).alias("votes"),
        F.when(plat.isin("playstore", "appstore"), F.col("rating")).alias("rating"),
        F.when(plat == "twitter", F.col("likes")).alias("likes"))


# --- S2 JSON-path extraction on the event payloads --------------------------------------
@query("flatten_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_flatten_props(spark, sf_dir):
    prepare(spark)
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- S7 / S8 envelope write + read back --------------------------------------------------
@query("envelope_roundtrip", f"""{M}
SELECT platform, id, votes, (SELECT count(*) FROM mentions)::BIGINT AS meta_total FROM mentions""")
def q_envelope_roundtrip(spark, sf_dir):
    prepare(spark)
    m = mentions(spark, sf_dir).select("platform", "id", "votes", F.lit(False).alias("is_critical"),
                                        F.lit(None).cast("string").alias("topic"))
    out = scratch_dir(spark, "envelope")
    write_envelope(m, meta_row(m), out)
    recs, meta = read_envelope(spark, out)
    total = meta.select(F.col("total").cast("bigint")).scalar()
    return recs.select("platform", "id", "votes", total.alias("meta_total"))
