"""The queries of this subpackage and their SQL."""

import importlib

#: operator number and name -> module
OPERATORS = {
    "op1_sentencepiece": "sentencepiece_codec",
    "op2_mixing": "mixing",
    "op3_minhash": "minhash",
    "op4_toxicity": "toxicity",
    "op5_sharding": "sharding",
    "op6_pii": "pii",
    "op7_url_filter": "url_filter",
    "op8_html_extraction": "html_text",
    "op9_vector_dedup": "vector_dedup",
    "op10_hamming_search": "hamming",
    "op11_packing": "packing",
    "op12_spelling": "spelling",
    "op13_filter_audit": "filter_audit",
}


def queries():
    found = {name: getattr(importlib.import_module(f"quire.llm.{module}"), name) for name, module in OPERATORS.items()}
    # The pipeline lies beside the package and counts as part of this subpackage.
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql():
    found = {name: getattr(importlib.import_module(f"quire.llm.{module}"), "oracle", None) for name, module in OPERATORS.items()}
    return {name: sql() for name, sql in found.items() if sql}
