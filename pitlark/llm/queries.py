"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_decontaminate": "decontaminate",
    "op2_licenses": "licenses",
    "op3_pii": "pii",
    "op4_toxicity": "toxicity",
    "op5_simhash": "simhash",
    "op6_lm_score": "language_model",
    "op7_quality": "quality",
    "op8_embedding_dedup": "vectors",
    "op9_html": "pages",
    "op10_packing": "packing",
    "op11_vector_codes": "codes",
    "op12_periodic_runs": "periods",
    "op13_substring_dedup": "substrings",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .codes import sql_vector_codes
    from .licenses import sql_licenses
    from .periods import sql_periodic_runs
    from .substrings import sql_substring_dedup

    return {
        "op2_licenses": sql_licenses(),
        "op11_vector_codes": sql_vector_codes(),
        "op12_periodic_runs": sql_periodic_runs(),
        "op13_substring_dedup": sql_substring_dedup(),
    }
