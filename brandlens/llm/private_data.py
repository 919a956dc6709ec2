"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Method. Base patterns (email, ip, card, phone) give seed entities with their positions. Values
with a digit that are assigned to a key such as `password`, and words that begin as well-known
credentials do, are seeds too (`SEED_KEYS`, `SEED_AFFIXES`). Every seed, and every other word
that looks like no ordinary word, is an occurrence with lexical patterns:

* the word before it, and the word after it, each with the shape of its characters,
* the two words before it,
* the key that it is assigned to,
* its own signature: digits one by one for numbers, else its first four characters with the
  kinds and the number of its characters,
* its shape, where it stands alone on its line.

Patterns and instances form a graph that Spark scores in rounds. A pattern's confidence is the
mean weight of its distinct instances; an instance's weight is the best confidence of its trusted
patterns; seeds keep weight 1. An instance that is found so counts as support of its other
patterns in the next round, so identifiers that share no context with a seed are reached over
those that do. A pattern is trusted from `CONFIDENCE` and `SEEDS` supporting instances on; a
number's signature already from the share `SIGNATURE_SHARE` of seeds on, as a number that fails a
check digit is unlabelled rather than clean. Occurrences outside the base spans that are seeds or
that a trusted pattern points to are reported as kind `context`.

Positions need no Python: a text split by a pattern and the list of its matches together give
the length before every match. Context is read from the whole text around a match, whatever
other matches are in it. Edges are made distinct per (pattern, instance) before they are counted,
so a frequent word or a large group of copies weighs once per instance and task.

Base patterns are applied leftmost and non-overlapping per kind; a match that fails its check
is dropped and not retried. In the expressions below possessive quantifiers and the `\\G`
guards only spare the matcher hopeless starts; the matches are those of the plain patterns.

Defined cases: null and empty texts have no spans; rows are handled one by one, so repeated
rows and null ids keep rows of their own; an empty table gives an empty result; positions
count code points and ends are exclusive; other columns are ignored. A learned identifier has 2 to
256 characters (`LENGTHS`); longer runs are base spans or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, table

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word that is no ordinary one (with a digit, `@`, `_` or `=`) and up to seven words of digits and
#: signs that follow it after one blank each, or a word after an equals sign.
MARKED = (r"(?<!\S)(?:[^\s0-9@_=]*+[0-9@_=]\S*+(?:(?<![,;:!?])\x20[0-9(+][0-9().-]*+(?!\S)){0,7}+"
          r"(?:(?<![,;:!?])\x20[0-9(+][0-9().-]*+[,;:!?]++(?!\S))?+|(?<=[=]\x20)\S++)")
#: Key and delimiter of such a word, signs that open it and signs that close it.
KEY = r"^([\p{L}_][\p{L}0-9_.-]{0,40}[\"']?[=:]+)"
OPENING = r"^[\"'(\[{<]++"
CLOSING = r"(?<![\"')\]}>.,;:!?])[\"')\]}>.,;:!?]++$"
#: Characters around an occurrence in which its context words are looked for.
CONTEXT_CHARS = 48
#: Characters of a learned identifier.
LENGTHS = (2, 256)
ROUNDS = 3
#: A pattern is trusted from this confidence and this number of supporting instances on.
CONFIDENCE = 0.8
SEEDS = 5
#: Share of seeds among the instances of a number's signature: three times the share of random
#: numbers that pass a check digit.
SIGNATURE_SHARE = 0.3
#: Keys whose values are secrets, and first characters of well-known credentials.
SEED_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "access_token")
SEED_AFFIXES = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[0-9A-Za-z-]{10,})$"
#: Kinds of patterns, the first character of each.
BEFORE, TWO_BEFORE, AFTER, ASSIGNED, NUMBER, AFFIX, ALONE = "12nkdfl"


def tail(text: Column) -> Column:
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def front(text: Column) -> Column:
    return F.substring(text, 1, CONTEXT_CHARS)


def spans_of(text: Column, regex: str) -> Column:
    """Array of (start, end, match, before, after) of every match; `before` and `after` are the
    `CONTEXT_CHARS` characters of the text on either side."""
    between, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    rest = F.lit(2**31 - 1)
    next_ones = F.zip_with(F.slice(between, F.lit(2), rest), F.slice(found, F.lit(2), rest),
                           lambda b, m: front(F.concat(front(b), front(F.coalesce(m, F.lit(""))))))
    pairs = F.zip_with(between, found, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
    pairs = F.zip_with(pairs, next_ones, lambda p, n: F.struct(
        p["before"].alias("before"), p["match"].alias("match"), n.alias("after")))
    spans = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("seen"), spans.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + F.char_length(pair["before"])
        last = first + F.char_length(pair["match"])
        seen = tail(F.concat(state["seen"], tail(pair["before"])))
        span = F.struct(first.alias("start"), last.alias("end"), pair["match"].alias("match"),
                        seen.alias("before"), pair["after"].alias("after"))
        return F.struct(last.alias("at"), tail(F.concat(seen, tail(pair["match"]))).alias("seen"),
                        F.concat(state["spans"], F.array(span)).alias("spans"))

    matched = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.aggregate(matched, start, step, lambda state: state["spans"])


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(match: Column) -> Column:
    """16 to 19 digits whose Luhn sum ends in 0."""
    number = digits(match)

    def value(digit: Column, place: Column) -> Column:
        doubled = digit.cast("int") * F.when(place % 2 == 1, 2).otherwise(1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    values = F.transform(F.split(F.reverse(number), ""), value)
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.char_length(number).between(16, 19) & (total % 10 == 0)


def is_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def is_phone(match: Column) -> Column:
    return F.char_length(digits(match)).between(8, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """Checked spans of each kind. Texts without the kind's sign are not searched."""
    def search(guard: Column, regex: str, check: Callable[[Column], Column] | None = None) -> Column:
        found = spans_of(F.when(guard, text).otherwise(F.lit("")), regex)
        return F.filter(found, lambda s: check(s["match"])) if check else found

    digit = text.rlike("[0-9]")
    return {"email": search(F.contains(text, F.lit("@")), EMAIL), "ip": search(digit, IP, is_ip),
            "card": search(digit, CARD, passes_luhn),
            "phone": search(F.contains(text, F.lit("+")), PHONE, is_phone)}


def shape(core: Column) -> Column:
    """Runs of small letters, capitals and digits by one sign each, with the size of the length."""
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"),
                            "[0-9]+", "9")
    return F.concat(runs, F.lit("/"), F.floor(F.log2(F.char_length(core) + 1)).cast("string"))


def number_signature(core: Column) -> Column:
    """Every digit of a core without letters as 9; null for other cores."""
    return F.when(core.rlike(r"^[^\p{L}]+$"), F.regexp_replace(core, "[0-9]", "9"))


def affix_signature(core: Column) -> Column:
    """First four characters, kinds and number of the characters of a core with letters."""
    kinds = [F.when(core.rlike(kind), F.lit(sign)).otherwise(F.lit(""))
             for kind, sign in ((r"\p{Ll}", "a"), (r"\p{Lu}", "A"), ("[0-9]", "9"), (r"[^\p{L}0-9]", "."))]
    named = F.concat(F.substring(core, 1, 4), F.lit(" "), *kinds, F.lit(" "), F.char_length(core).cast("string"))
    return F.when(core.rlike(r"\p{L}") & (F.char_length(core) >= 8), named)


def patterns_of(core: Column, key: Column, before: Column, after: Column) -> Column:
    """Array of the patterns of an occurrence, each with the sign of its kind in front."""
    near = F.lower(F.regexp_replace(before, r"[\"'(\[{<]+$", ""))
    one = F.regexp_extract(near, r"(\S+)\s+$", 1)
    two = F.regexp_replace(F.regexp_extract(near, r"(\S+\s+\S+)\s+$", 1), r"\s+", " ")
    following = F.lower(F.regexp_extract(after, r"^[\"')\]}>.,;:!?]*\s+(\S+)", 1))
    alone = before.rlike(r"(?:^|\n)$") & after.rlike(r"^(?:$|[\r\n])")

    def pattern(kind: str, wanted: Column, *parts: Column) -> Column:
        return F.when(wanted, F.concat_ws(" ", F.lit(kind), *parts))

    given = [pattern(BEFORE, (key == "") & (one != ""), one, shape(core)),
             pattern(TWO_BEFORE, (key == "") & (two != ""), two),
             pattern(AFTER, following != "", following, shape(core)),
             pattern(ASSIGNED, key != "", key),
             pattern(NUMBER, number_signature(core).isNotNull(), number_signature(core)),
             pattern(AFFIX, affix_signature(core).isNotNull(), affix_signature(core)),
             pattern(ALONE, alone, shape(core))]
    return F.array_compact(F.array(*given))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per document: uid, doc_id, the base spans of each kind, and `others`, unusual words
    outside of them (start, end, core, key, before, after)."""
    text = F.col("text")
    rows = documents(docs).withColumn("uid", F.monotonically_increasing_id())
    found = rows.select("uid", "doc_id", "text", *[s.alias(k) for k, s in base_spans(text).items()])

    def split_word(span: Column) -> Column:
        key = F.regexp_extract(span["match"], KEY, 1)
        value = F.substr(span["match"], F.char_length(key) + 1)
        opened = F.regexp_replace(value, OPENING, "")
        core = F.regexp_replace(opened, CLOSING, "")
        start = span["start"] + F.char_length(span["match"]) - F.char_length(opened)
        return F.struct(start.alias("start"), (start + F.char_length(core)).alias("end"), core.alias("core"),
                        F.concat(F.when(key == "", span["before"]).otherwise(F.lit("")), key).alias("key"),
                        span["before"].alias("before"), span["after"].alias("after"))

    def outside(span: Column) -> Column:
        clear = F.char_length(span["core"]).between(*LENGTHS) & span["core"].rlike(r"[\p{L}0-9]")
        for kind in KINDS:
            clear = clear & ~F.exists(F.col(kind), lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))
        return clear

    unusual = F.when(text.rlike("[0-9@_=]"), text).otherwise(F.lit(""))
    words = F.transform(spans_of(unusual, MARKED), split_word)
    return materialise(found.select("uid", "doc_id", *KINDS, words.alias("others"))
                       .withColumn("others", F.filter("others", outside)), "private-occurrences")


def edges_of(found: DataFrame) -> DataFrame:
    """pattern, instance, seed, and for words outside the base spans uid, start, end."""
    seeds = F.flatten(F.array(*[F.transform(F.col(k), lambda s: F.struct(
        s["match"].alias("core"), s["before"].alias("key"), s["before"].alias("before"),
        s["after"].alias("after"))) for k in KINDS]))
    first = (found.select(F.explode(seeds).alias("o")).filter(F.char_length("o.core") <= LENGTHS[1])
             .select("o.*", F.lit(True).alias("seed"), F.lit(None).cast("long").alias("uid"),
                     F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    second = (found.select("uid", F.explode("others").alias("o"))
              .select("o.core", "o.key", "o.before", "o.after", F.lit(False).alias("seed"), "uid", "o.start", "o.end"))
    named = F.lower(F.regexp_extract("key", r"([\p{L}][\p{L}0-9_.-]{0,40})[\"']?\s*[=:]+\s*[\"']?$", 1))
    secret = (F.col("key").isin(*SEED_KEYS) & F.col("core").rlike("[0-9]") & (F.char_length("core") >= 6)
              ) | F.col("core").rlike(SEED_AFFIXES)
    return (first.unionByName(second).withColumn("key", named).withColumn("seed", F.col("seed") | secret)
            .withColumn("pattern", F.explode_outer(patterns_of(*map(F.col, ("core", "key", "before", "after")))))
            .select("pattern", F.col("core").alias("instance"), "seed", "uid", "start", "end"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
                       seeds: int = SEEDS, signature_share: float = SIGNATURE_SHARE) -> DataFrame:
    """pattern, confidence and support of the patterns that are trusted after `rounds` rounds."""
    graph = materialise(edges.filter("pattern IS NOT NULL").groupBy("pattern", "instance")
                        .agg(F.max("seed").alias("seed")), "private-graph")
    weights = materialise(graph.groupBy("instance").agg(F.max("seed").alias("seed"))
                          .select("instance", "seed", F.col("seed").cast("double").alias("weight")), "private-weights")
    sure = (F.col("weight") >= confidence).cast("int")
    number = F.startswith(F.col("pattern"), F.lit(NUMBER + " "))
    trusted = None
    for _ in range(rounds):
        scores = (graph.select("pattern", "instance").join(weights, "instance").groupBy("pattern")
                  .agg(F.avg("weight").alias("confidence"), F.sum(sure).alias("support"),
                       F.avg(F.col("seed").cast("int")).alias("share")))
        enough = (F.col("confidence") >= confidence) | (number & (F.col("share") >= signature_share))
        trusted = materialise(scores.filter(enough & (F.col("support") >= seeds)).drop("share"), "private-patterns")
        learned = (graph.select("pattern", "instance").join(trusted, "pattern").groupBy("instance")
                   .agg(F.max("confidence").alias("learned")))
        weights = materialise(weights.join(learned, "instance", "left").select(
            "instance", "seed",
            F.when(F.col("seed"), 1.0).otherwise(F.coalesce("learned", F.lit(0.0))).alias("weight")), "private-weights")
    return trusted


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, one array of (start, end, match, before, after) per base kind, and `context`, the
    array of (start, end) that seeds outside of the base kinds and learned patterns add."""
    found = occurrences(docs)
    edges = edges_of(found)
    trusted = confident_patterns(edges, rounds).select("pattern", F.lit(True).alias("trusted"))
    added = (edges.filter("uid IS NOT NULL").join(trusted, "pattern", "left")
             .filter(F.col("seed") | F.col("trusted"))
             .select("uid", "start", "end").distinct()
             .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(CONTEXT)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.drop("others").join(added, "uid", "left").withColumn(CONTEXT, F.coalesce(CONTEXT, none))


def op7_private_data(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole document."""
    found = find(table(spark, sf_dir, "documents"))

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(
            ":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[named(k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, named(CONTEXT)), ",").alias("spans"))
