"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers

from wayfare.llm import (decontamination, html_extraction, language_id, mixing, periodic_runs, pii, piece_encoding,
                         quality_bands, simhash, spelling_variants, suffix_repeats, token_counts, url_filter)
from wayfare.llm.common import table


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_bands(spark, sf_dir):
    return quality_bands.quality(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_repeats.removed(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark, sf_dir):
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op7_poisson_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), rewrite=periodic_runs.digest_rewrite)


def op12_piece_encoding(spark, sf_dir):
    return piece_encoding.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), rewrite=spelling_variants.digest_rewrite)


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_quality_bands, op3_decontamination, op4_suffix_dedup, op5_pii_pseudonyms,
    op6_html_extraction, op7_poisson_mixing, op8_language_id, op9_token_counts, op10_url_filter,
    op11_periodic_runs, op12_piece_encoding, op13_spelling_variants)}
