"""The queries of this package and the SQL that states their results."""

from __future__ import annotations

from . import byte_repeats, contamination, languages, merkle, mixing, near_copies, near_vectors, quality, toxicity, url_filter, warc, whitening, word_repeats

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_warc": warc.query,
    "op3_byte_repeats": byte_repeats.query,
    "op4_word_repeats": word_repeats.query,
    "op5_languages": languages.query,
    "op6_url_filter": url_filter.query,
    "op7_near_copies": near_copies.query,
    "op8_quality": quality.query,
    "op9_contamination": contamination.query,
    "op10_toxicity": toxicity.query,
    "op11_merkle_manifest": merkle.query,
    "op12_whitening": whitening.query,
    "op13_near_vectors": near_vectors.query,
}
SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_warc": warc.SQL,
    "op3_byte_repeats": byte_repeats.SQL,
    "op4_word_repeats": word_repeats.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_near_copies": near_copies.SQL,
    "op9_contamination": contamination.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_near_vectors": near_vectors.SQL,
}
