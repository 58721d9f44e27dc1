"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, exact_dedup, license_scan, mixing, packing, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_license_scan": license_scan.query,
    "op3_chat_format": chat.query,
    "op4_toxicity": toxicity.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_best_fit_packing": packing.query,
    "op7_simhash_dedup": simhash.query,
    "op8_url_filter": url_filter.query,
    "op9_mix_sources": mixing.query,
    "op10_embedding_dedup": embedding_dedup.query,
}

SQL = {"op1_exact_dedup": exact_dedup.SQL, "op8_url_filter": url_filter.SQL}
