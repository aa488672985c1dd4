"""The training-data queries by name, and their SQL where there is any."""

from __future__ import annotations

import importlib

_WHERE = {
    "op1_packing": "packing",
    "op2_toxicity": "toxicity",
    "op3_neardup": "neardup",
    "op4_wavelet": "wavelet",
    "op5_pii": "pii",
    "op6_substrings": "substrings",
    "op7_language": "language",
    "op8_decontamination": "decontamination",
    "op9_quantisation": "quantisation",
    "op10_sharding": "sharding",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lexarium.llm.{m}"), name) for name, m in _WHERE.items()}


def oracle_sql() -> dict:
    from lexarium.llm.decontamination import OP8_SQL
    from lexarium.llm.substrings import OP6_SQL

    return {"op6_substrings": OP6_SQL, "op8_decontamination": OP8_SQL}
