"""Constants and parameter bundles.

Everything product-specific (brand name, spelling variants, block and keyword lists,
the reference query used for BM25, prompt text) is a *parameter* supplied by the caller
through :class:`BrandProfile`; the engine ships no product words of its own.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values of the system whose results we
# reproduce, otherwise scores, labels and flags differ. Kept together, in their
# natural order, as plain text.
# ---------------------------------------------------------------------------

# Stop words dropped by the search tokeniser (besides every 1-character token).
STOP_WORDS = (
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "for",
    "of", "and", "or", "but", "with", "this", "that", "are", "was",
    "be", "have", "has", "had", "not", "do", "does", "did", "will",
    "can", "i", "you", "he", "she", "we", "they", "my", "your",
    "its", "their", "so", "as", "by", "from", "up", "out", "if",
    "about", "than", "then", "just", "like", "more", "also",
)

# ASCII punctuation replaced by a blank before splitting (Python's string.punctuation).
PUNCTUATION = string.punctuation

# BM25 saturation and length normalisation.
BM25_K1 = 1.5
BM25_B = 0.75

# Cosine threshold above which a later record is a near duplicate of an earlier one.
NEAR_DUP_THRESHOLD = 0.85
# Added to the norm product in the cosine denominator.
COSINE_EPSILON = 1e-9

# Fuzzy brand match: words of at least this many letters, at most this many edits.
FUZZY_MIN_WORD = 4
FUZZY_MAX_DISTANCE = 1

# Word cloud: top N co-occurring tokens longer than this many characters.
WORD_CLOUD_TOP_N = 50
WORD_CLOUD_MIN_LEN = 4

# Lexicon sentiment label cut-offs on the compound score.
SENTIMENT_POS_CUTOFF = 0.05
SENTIMENT_NEG_CUTOFF = -0.05
SENTIMENT_LABELS = ("positive", "neutral", "negative")

# Model classification.
BATCH_SIZE = 5
MAX_PROMPT_TEXT = 400
RELEVANCE_MIN = 7
RELEVANCE_DEFAULT = 5
TOPICS = (
    "bug_report", "feature_request", "praise",
    "question", "competitor_comparison", "general", "irrelevant",
)
TOPIC_DEFAULT = "general"
TOPIC_IRRELEVANT = "irrelevant"
LLM_SENTIMENTS = (
    "very_negative", "negative", "mixed", "positive", "very_positive",
)
LLM_SENTIMENT_DEFAULT = "mixed"
MAX_KEY_PHRASES = 3

# Digest: look-back days, samples per bucket, snippet length.
DIGEST_DAYS = 7
DIGEST_SAMPLES = (("negative", 10), ("positive", 10), ("bug", 5), ("feature", 5))
DIGEST_SNIPPET = 120
REPORT_SNIPPET = 55

# Source order used for "first arrival wins" when several landed files are merged.
SOURCE_ORDER = ("reddit", "twitter", "playstore", "appstore")


@dataclass(frozen=True)
class BrandProfile:
    """What to look for. All word lists are matched as lower-case substrings."""

    brand: str
    variants: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    reference_query: str = ""
    stop_words: tuple[str, ...] = field(default=STOP_WORDS)


# Parameters used by the registered driver queries. The driver tables hold invented
# prose, so the "brand" is a frequent invented word; none of these is product text.
DRIVER_PROFILE = BrandProfile(
    brand="tion",
    variants=("thatin", "inoran", "ononst"),
    blocklist=("rewh", "thatin"),
    keywords=("ering", "lyre"),
    reference_query="rewh thatin orre tion ering hehely",
)

# Reference date for the look-back operators in tested queries (never now()).
DRIVER_AS_OF = "2024-01-15"
