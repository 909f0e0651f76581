"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.llm import decontam, linededup, maxent, mixing, quality, sharding, simhash, tokencount, tokenfile, toxicity
from terrane.llm.common import table

SHARDS = 40


def op1_sharding(spark, sf_dir):
    """Law `rows`: shard counts differ by one at most."""
    placed = sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "rank")


def op3_simhash(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    """One row for each span of a document that holds a benchmark item."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start_byte", "end_byte")


def op5_token_file(spark, sf_dir):
    return tokenfile.written(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return linededup.summary(table(spark, sf_dir, "documents"))


def _fold_of(modulus: int):
    """True where crc32 of the key as text leaves 2: those rows are never learnt from."""
    return lambda key: F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op6_lm_scoring(spark, sf_dir):
    return maxent.scores(table(spark, sf_dir, "documents"), _fold_of(7))


def op8_toxicity(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), _fold_of(4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: ~held(key))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


def op9_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


_STOPS = ", ".join(f"'{w}'" for w in sorted({x for some in quality.STOP_WORDS.values() for x in some}))


def _op9_sql() -> str:
    rules = []
    for r in quality.RULES:
        if r.low is not None:
            rules.append(f"{r.over} >= {r.low} * {r.under}")
        if r.high is not None:
            rules.append(f"{r.over} <= {r.high} * {r.under}")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
p AS (SELECT k, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
g AS (SELECT k, i, string_agg(x, ' ') OVER o AS x8, count(*) OVER o AS n8 FROM p WINDOW o AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x8) AS c FROM g WHERE n8 = 8) WHERE c > 1),
runs AS (SELECT k, sum(CASE WHEN nxt IS NULL OR nxt - i > 8 THEN 8 ELSE nxt - i END) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(runs.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN runs USING (k)),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(rules)} AS kept FROM j"""


#: Production mix: domains by the source's number, whole-number weights, three quarters of all tokens, four epochs at most.
MIX = mixing.Mix(
    domains=(("crawl", "^src[0-9]$", 50), ("books", "^src1[0-4]$", 30)),
    other_domain=("reference", 20),
    languages={"en": 55, "de": 20, "fr": 15, "es": 10},
    other_language=5,
)


def op2_mixing(spark, sf_dir):
    return mixing.drawn(table(spark, sf_dir, "documents"), MIX)


def _op2_sql(mix: mixing.Mix = MIX) -> str:
    def case(value, weights, other):
        return "CASE " + " ".join(f"WHEN {value} = '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {other} END" if weights else str(other)

    def pour(name, nodes, group, child, weight):
        over = f"PARTITION BY {group}" if group else ""
        return f"""
{name}_w AS (SELECT * FROM (SELECT *, CAST({weight} AS BIGINT) AS w FROM ({nodes})) WHERE w > 0 AND cap > 0),
{name}_l AS (SELECT *, (budget - CAST(sum(cap) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / w, {child}) - cap AS DOUBLE))
    / CAST(sum(w) OVER ({over}) - sum(w) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / w, {child}) + w AS DOUBLE) AS level FROM {name}_w),
{name} AS (SELECT * EXCLUDE (level), CASE WHEN CAST(cap AS DOUBLE) / w <= level THEN CAST(cap AS DOUBLE)
    ELSE max(CASE WHEN NOT CAST(cap AS DOUBLE) / w <= level THEN level END) OVER ({over}) * w END AS given FROM {name}_l)"""

    domain = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p, _ in mix.domains) + f" ELSE '{mix.other_domain[0]}' END"
    weights = {n: w for n, _, w in mix.domains}
    return rf"""
WITH r AS (SELECT doc_id, {domain} AS domain, lang, source, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, l, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {mix.epochs} AS BIGINT) AS cap FROM r GROUP BY ALL),
lng AS (SELECT domain, l, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS DOUBLE) * {mix.share} FROM leaf) AS budget FROM lng GROUP BY ALL),
{pour("pd", "SELECT * FROM dom", "", "domain", case("domain", weights, mix.other_domain[1]))},
{pour("pl", "SELECT lng.*, given AS budget FROM lng JOIN pd USING (domain)", "domain", "l", case("l", {f"={k}": w for k, w in mix.languages.items()}, mix.other_language))},
{pour("ps", "SELECT leaf.*, given AS budget FROM leaf JOIN pl USING (domain, l)", "domain, l", "s", case("s", {f"={k}": w for k, w in mix.sources.items()}, mix.other_source))},
q AS (SELECT domain, l, s, quota, quota // tokens AS whole, quota % tokens AS rest FROM (SELECT *, CAST(floor(given) AS BIGINT) AS quota FROM ps)),
h AS (SELECT r.*, quota, whole, rest, CAST('0x' || substr(md5(concat_ws(':', '{mix.seed}', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS hash FROM r JOIN q USING (domain, l, s)),
c AS (SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY hash) <= rest THEN 1 ELSE 0 END AS n FROM h)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, CAST(n AS BIGINT))) AS epoch, quota FROM c"""


def op10_token_counts(spark, sf_dir):
    return tokencount.with_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding, "op2_mixing": op2_mixing, "op3_simhash": op3_simhash, "op4_decontamination": op4_decontamination, "op5_token_file": op5_token_file, "op6_lm_scoring": op6_lm_scoring, "op7_line_dedup": op7_line_dedup, "op8_toxicity": op8_toxicity, "op9_quality_rules": op9_quality_rules, "op10_token_counts": op10_token_counts}
ORACLES = {"op2_mixing": _op2_sql(), "op9_quality_rules": _op9_sql()}
