"""Registered queries of the document operators, each over its whole table."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, oracle name or None); the function has the query's name.
_QUERIES = {
    "op1_substring_dedup": ("substrings", None),
    "op2_token_counts": ("token_counts", None),
    "op3_quality_resampling": ("resampling", None),
    "op4_quality_rules": ("quality_rules", None),
    "op5_jaccard_join": ("jaccard", None),
    "op6_toxicity": ("toxicity", None),
    "op7_packing": ("packing", None),
    "op8_warc_revisits": ("revisits", "OP8_SQL"),
    "op9_fingerprints": ("fingerprints", None),
    "op10_source_mix": ("mixing", "OP10_SQL"),
    "op11_collocations": ("collocations", None),
    "op12_suffix_dedup": ("suffixes", None),
    "op13_merkle_manifest": ("merkle", None),
}


def all_queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, (module, _) in _QUERIES.items()}


def all_oracles():
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
