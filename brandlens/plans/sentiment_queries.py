"""Registered query of the whole sentiment rule set, with its DuckDB oracle."""

from __future__ import annotations

from ..config import PUNCTUATION
from ..functions.text import WHITESPACE_RE, sentiment_text
from ..operators.rule_sentiment import CAPITALS_RE, SentimentRules, rule_sentiment
from ..session import prepare
from ..sources.driver import mentions, mentions_sql
from .mention_queries import DRIVER_BOOSTERS, DRIVER_LEXICON, DRIVER_NEGATORS, _strip_sql
from .registry import query

# Phrases and words of the driver text with our own valences.
RULES = SentimentRules(
    lexicon={**DRIVER_LEXICON, "of the": 0.7, "the and": 0.6, "the and the": -1.2, "orre orre orre": -0.4},
    negators=DRIVER_NEGATORS, boosters={**DRIVER_BOOSTERS, "is": 0.293, "to the": -0.293}, contrast=("for", "que"))


def _oracle(rules: SentimentRules) -> str:
    entries = sorted({*rules.lexicon, *rules.negators, *rules.boosters, *rules.contrast})
    table = ", ".join(f"('{w}', {float(rules.lexicon.get(w, 0.0))}, {float(rules.boosters.get(w, 0.0))}, "
                      f"{w in rules.negators}, {w in rules.contrast})" for w in entries)
    blank, white = PUNCTUATION.replace("'", "''"), WHITESPACE_RE.replace("\\x85", "\\x{85}")
    regex = "(?i) (" + "|".join(p.replace(" ", "  ") for p in rules.phrases()) + ") "
    text = (f"CASE WHEN platform = 'reddit' THEN {_strip_sql('''coalesce(title, '') || ' ' || coalesce(text, '')''')} "
            "ELSE coalesce(text, '') END")
    doc = "PARTITION BY platform, id"
    return f"""WITH mentions AS ({mentions_sql()}),
rule(word, value, boost, negator, contrast) AS (VALUES {table}),
tx AS (SELECT platform, id, {text} AS t FROM mentions),
sp AS (SELECT platform, id, t, ' ' || array_to_string(list_filter(regexp_split_to_array(
  translate(t, '{blank}', '{' ' * len(PUNCTUATION)}'), '{white}'), lambda x: x <> ''), '  ') || ' ' AS s FROM tx),
pt AS (SELECT platform, id, string_split_regex(s, '{regex}') AS between, regexp_extract_all(s, '{regex}') AS found FROM sp),
un AS (SELECT platform, id, flatten(list_transform(range(1, len(between) + 1), lambda i: list_concat(
  list_filter(string_split(between[i], ' '), lambda x: x <> ''),
  CASE WHEN i <= len(found) THEN [replace(trim(found[i]), '  ', ' ')] ELSE [] END))) AS units FROM pt),
ex AS (SELECT platform, id, unnest(units) AS unit, generate_subscripts(units, 1) AS pos FROM un),
fa AS (SELECT platform, id, pos, regexp_matches(unit, '{CAPITALS_RE}') AS capitals, coalesce(value, 0.0)::DOUBLE AS value,
  coalesce(boost, 0.0)::DOUBLE AS boost, coalesce(negator, false) AS negator, coalesce(contrast, false) AS contrast
  FROM ex LEFT JOIN rule ON rule.word = lower(ex.unit)),
mi AS (SELECT *, bool_or(capitals) OVER ({doc}) AND bool_or(NOT capitals) OVER ({doc}) AS mixed,
  min(CASE WHEN contrast THEN pos END) OVER ({doc}) AS turn FROM fa),
lo AS (SELECT *, CASE WHEN boost = 0 THEN 0.0 WHEN mixed AND capitals THEN boost + 0.733 ELSE boost END::DOUBLE AS loud FROM mi),
wd AS (SELECT *, CASE WHEN mixed AND capitals THEN 0.733 ELSE 0.0 END::DOUBLE
  + coalesce(lag(loud, 1) OVER w, 0.0) + coalesce(lag(loud, 2) OVER w, 0.0) * 0.95::DOUBLE
  + coalesce(lag(loud, 3) OVER w, 0.0) * 0.9::DOUBLE AS push,
  coalesce(lag(negator, 1) OVER w, false) OR coalesce(lag(negator, 2) OVER w, false)
  OR coalesce(lag(negator, 3) OVER w, false) AS negated FROM lo WINDOW w AS ({doc} ORDER BY pos)),
sc AS (SELECT platform, id, CASE WHEN value = 0 THEN 0.0 ELSE (value + sign(value) * push)
  * (CASE WHEN negated THEN -0.74 ELSE 1.0 END)::DOUBLE
  * (CASE WHEN pos < turn THEN 0.5 WHEN pos > turn THEN 1.5 ELSE 1.0 END)::DOUBLE END::DOUBLE AS v FROM wd),
ag AS (SELECT platform, id, sum(v) AS s, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0.0) AS p,
  coalesce(sum(1 - v) FILTER (WHERE v < 0), 0.0) AS n, count(*) FILTER (WHERE v = 0)::DOUBLE AS u FROM sc GROUP BY platform, id),
em AS (SELECT platform, id, {_strip_sql('t')} = '' AS blank, length(t) - length(replace(t, '!', '')) AS ex,
  length(t) - length(replace(t, '?', '')) AS qu FROM tx),
al AS (SELECT em.platform, em.id, blank, coalesce(s, 0.0) AS s, coalesce(p, 0.0) AS p, coalesce(n, 0.0) AS n,
  coalesce(u, 0.0) AS u, (least(ex, 4) * 0.292 + CASE WHEN qu > 3 THEN 0.96 WHEN qu > 1 THEN qu * 0.18 ELSE 0 END)::DOUBLE AS e
  FROM em LEFT JOIN ag USING (platform, id)),
li AS (SELECT platform, id, blank, s + sign(s) * e AS s, p + CASE WHEN p > n THEN e ELSE 0 END AS p,
  n + CASE WHEN p < n THEN e ELSE 0 END AS n, u FROM al),
co AS (SELECT *, s / sqrt(s * s + 15.0) AS c, p + n + u AS total FROM li)
SELECT platform, id,
  CASE WHEN blank THEN 'neutral' WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN blank THEN 0.0 ELSE round(c, 4) END::DOUBLE AS compound,
  CASE WHEN blank THEN 0.0 WHEN total > 0 THEN round(p / total, 4) ELSE 0.0 END::DOUBLE AS pos,
  CASE WHEN blank THEN 1.0 WHEN total > 0 THEN round(u / total, 4) ELSE 0.0 END::DOUBLE AS neu,
  CASE WHEN blank THEN 0.0 WHEN total > 0 THEN round(n / total, 4) ELSE 0.0 END::DOUBLE AS neg FROM co"""


@query("rule_sentiment", _oracle(RULES))
def q_rule_sentiment(spark, sf_dir):
    prepare(spark)
    return rule_sentiment(mentions(spark, sf_dir), RULES, sentiment_text())
