"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, language, lm, near_dedup, packing, quality, tokens, toxicity, url_filters
from .common import table


def op1_toxicity(spark, sf_dir):
    """Toxicity of every whole text of ``documents``, learnt from labels outside the held-out fold: doc_id, held_out, score, predicted."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark, sf_dir):
    """Exact token counts of every whole text: doc_id, n_bytes, n_tokens, over_limit."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    """Log probability of every whole text under the language model and under word counts alone, learnt outside the held-out fold."""
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    """Figures of every whole text, whether the base rules fail it, and the label model's verdict."""
    judged = quality.quality(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op5_bpe_round_trip(spark, sf_dir):
    """Digests of every text's token ids and of what they decode to."""
    return tokens.round_trip_digests(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark, sf_dir):
    """Shingle set sizes and components of near duplicates of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    """Predicted language of every whole text, learnt outside the held-out fold."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_exact_dedup(spark, sf_dir):
    """Groups of equal texts of all rows: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page's url."""
    return url_filters.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_lm_scoring, op4_quality_rules, op5_bpe_round_trip, op6_best_fit_packing, op7_ngram_jaccard_join, op8_language_id, op9_exact_dedup, op10_url_filters)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
}


def _own_case() -> str:
    """The method's own rules, in SQL: their expressions, by longest label and then order."""
    own = sorted(url_filters.OWN, key=lambda r: (-len(r.label), r.label))
    return " ".join(f"WHEN regexp_matches(host || path, '{r.pattern.replace(chr(92) + 'z', '$')}') THEN '{r.verdict}'" for r in own)


def _listed() -> str:
    rows = []
    for r in url_filters.LISTED:
        host, _, path = r.label.partition("/")
        rows.append(f"('{r.label}', '{host}', '/{path}', '{r.verdict}')")
    return ", ".join(rows)


ORACLE_SQL["op10_url_filters"] = f"""
    WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r(label, rhost, rpath, rverdict) AS (VALUES {_listed()}),
    best AS (SELECT page_id, host, path, first(label ORDER BY length(label) DESC, label) AS rule, first(rverdict ORDER BY length(label) DESC, label) AS listed
        FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
    SELECT page_id, host, path, rule, coalesce(listed, CASE {_own_case()} ELSE 'allow' END) AS verdict FROM best
"""
