"""Lexicon sentiment as a Spark job.

Method (rule-based lexicon scoring in the style of Hutto & Gilbert 2014): every token
has a valence from a lexicon table; a booster word 1, 2 or 3 tokens before a scored
word moves it away from zero by 0.293 x (1, 0.95, 0.9); a negator within the 3 tokens
before flips and damps it (x -0.74). compound = s / sqrt(s^2 + 15) for the sum s;
pos / neg / neu are the shares of (v+1), |v-1| and the count of unscored tokens.

Plan: tokens are exploded with positions (one row per token, streamed, not stored),
joined to the lexicon (a parameter table; Spark chooses the join by its size),
and only scored/negator/booster tokens survive. The 1-3 token look-back is a range
window over positions inside one document (bounded by document length). A sentinel
row per document keeps documents without hits, so no join back to the input is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SENTIMENT_NEG_CUTOFF, SENTIMENT_POS_CUTOFF
from ..functions.text import py_strip, split_words

# Fixed values of the scoring method (published constants).
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
BOOSTER_DECAY = (1.0, 0.95, 0.9)
NORMALISER_ALPHA = 15.0

# A small default lexicon of our own (word -> valence on a -4..4 scale).
DEFAULT_LEXICON: dict[str, float] = {
    "good": 1.9, "great": 3.1, "love": 3.2, "like": 1.5, "nice": 1.8, "happy": 2.7,
    "excellent": 3.2, "awesome": 3.1, "fun": 2.3, "useful": 1.9, "fast": 1.1, "easy": 1.4,
    "bad": -2.5, "terrible": -3.1, "hate": -2.7, "awful": -3.0, "slow": -1.0, "crash": -1.9,
    "broken": -2.0, "bug": -1.2, "annoying": -2.2, "poor": -2.1, "worst": -3.1, "useless": -2.3,
}
DEFAULT_NEGATORS: tuple[str, ...] = (
    "not", "no", "never", "none", "nothing", "nobody", "neither", "nor", "without",
    "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "wasnt", "wont",
)
DEFAULT_BOOSTERS: dict[str, float] = {
    "very": BOOSTER_INCREMENT, "really": BOOSTER_INCREMENT, "extremely": BOOSTER_INCREMENT,
    "so": BOOSTER_INCREMENT, "absolutely": BOOSTER_INCREMENT,
    "slightly": -BOOSTER_INCREMENT, "barely": -BOOSTER_INCREMENT, "somewhat": -BOOSTER_INCREMENT,
}

def lexicon_table(spark: SparkSession, lexicon: Mapping[str, float] | None = None,
                  negators: Sequence[str] | None = None,
                  boosters: Mapping[str, float] | None = None) -> DataFrame:
    """word, valence, neg (0/1), boost. A word may be scored and a negator at once."""
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    negators = DEFAULT_NEGATORS if negators is None else negators
    boosters = DEFAULT_BOOSTERS if boosters is None else boosters
    words = sorted(set(lexicon) | set(negators) | set(boosters))
    rows = [(w, float(lexicon.get(w, 0.0)), 1 if w in negators else 0, float(boosters.get(w, 0.0)))
            for w in words]
    return spark.createDataFrame(rows, "word string, valence double, neg int, boost double")


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("platform", "id"),
                      text: Column | str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """keys + keep + label, compound, pos, neu, neg (rounded to 4).

    Blank text -> neutral 0/0/1/0. `keep` columns (per-document values) ride along on
    the sentinel row, so callers need no join back to `docs`.
    """
    keys = list(keys)
    keep = [c for c in keep if c not in keys]
    text_col = F.col(text) if isinstance(text, str) else text
    base = docs.select(*keys, text_col.alias("_t"), F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep")).select(
        *keys, "_keep", (py_strip(F.coalesce(F.col("_t"), F.lit(""))) == F.lit("")).alias("_blank"),
        split_words(F.col("_t")).alias("_tok"))
    # position 0 is a sentinel so every document reaches the aggregate
    ex = base.select(*keys, "_keep", "_blank", F.size("_tok").alias("_n"),
                     F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("_tok")))
                     .alias("pos", "word"))
    # carried values stay on the sentinel row only
    ex = ex.withColumn("_keep", F.when(F.col("pos") == 0, F.col("_keep")))
    lex = lexicon.select("word", "valence", "neg", "boost")
    hits = ex.join(lex, "word", "left").where((F.col("pos") == 0) | F.col("valence").isNotNull())

    w = Window.partitionBy(*keys).orderBy("pos")
    def at(d):  # value of the token exactly d positions earlier (range frame)
        return w.rangeBetween(-d, -d)
    boost = (F.coalesce(F.sum("boost").over(at(1)), F.lit(0.0)) * BOOSTER_DECAY[0]
             + F.coalesce(F.sum("boost").over(at(2)), F.lit(0.0)) * BOOSTER_DECAY[1]
             + F.coalesce(F.sum("boost").over(at(3)), F.lit(0.0)) * BOOSTER_DECAY[2])
    negated = F.coalesce(F.max("neg").over(w.rangeBetween(-3, -1)), F.lit(0)) > 0
    v = F.col("valence")
    v1 = F.when(v > 0, v + F.col("_b")).when(v < 0, v - F.col("_b")).otherwise(v)
    scored = (hits.withColumn("_b", boost)
              .withColumn("_v", F.when(F.col("pos") == 0, F.lit(None).cast("double"))
                          .otherwise(F.when(negated, v1 * NEGATION_SCALAR).otherwise(v1))))

    agg = scored.groupBy(*keys).agg(
        F.max(F.when(F.col("pos") == 0, F.col("_keep"))).alias("_keep"),
        F.first("_blank", ignorenulls=True).alias("_blank"),
        F.max("_n").alias("_n"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(F.when(F.col("_v") > 0, F.col("_v") + 1.0)), F.lit(0.0)).alias("_ps"),
        F.coalesce(F.sum(F.when(F.col("_v") < 0, F.col("_v") - 1.0)), F.lit(0.0)).alias("_ns"),
        F.count(F.when(F.col("_v") != 0, F.lit(1))).alias("_nz"),
    )
    neu_cnt = (F.col("_n") - F.col("_nz")).cast("double")
    total = F.col("_ps") + F.abs(F.col("_ns")) + neu_cnt
    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(NORMALISER_ALPHA))
    share = lambda x: F.when(total > 0, F.abs(x) / total).otherwise(F.lit(0.0))
    label = sentiment_label(compound)
    blank = F.col("_blank")
    return agg.select(
        *keys, *[F.col(f"_keep.{c}").alias(c) for c in keep],
        F.when(blank, F.lit("neutral")).otherwise(label).alias("label"),
        F.when(blank, F.lit(0.0)).otherwise(F.round(compound, 4)).alias("compound"),
        F.when(blank, F.lit(0.0)).otherwise(F.round(share(F.col("_ps")), 4)).alias("pos"),
        F.when(blank, F.lit(1.0)).otherwise(F.round(share(neu_cnt), 4)).alias("neu"),
        F.when(blank, F.lit(0.0)).otherwise(F.round(share(F.col("_ns")), 4)).alias("neg"),
    )


def sentiment_label(compound: Column) -> Column:
    return (F.when(compound >= SENTIMENT_POS_CUTOFF, F.lit("positive"))
            .when(compound <= SENTIMENT_NEG_CUTOFF, F.lit("negative"))
            .otherwise(F.lit("neutral")))
