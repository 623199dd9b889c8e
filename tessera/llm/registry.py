"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query, its module.
NAMES = {
    "op1_toxicity": "toxicity",
    "op2_pii_surrogates": "surrogates",
    "op3_topk_kdtree": "topk",
    "op4_warc_zip": "warc",
    "op5_pack_differencing": "packing",
    "op6_hyperminhash": "hyperminhash",
    "op7_line_runs": "linededup",
    "op8_vector_collisions": "vecdedup",
    "op9_mix_sources": "mixing",
    "op10_id_store": "idstore",
}
#: Query, the name of its SQL in that module.
SQL = {"op3_topk_kdtree": "OP3_SQL", "op4_warc_zip": "OP4_SQL", "op7_line_runs": "OP7_SQL"}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f".{NAMES[name]}", __package__), sql) for name, sql in SQL.items()}
