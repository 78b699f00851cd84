"""The subpackage's queries by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, hostrules, lexical, media, mixing, neighbours, pii, preference, prefixtrie, repeats, simhash, warc

QUERIES = {
    "op1_gif": media.op1_gif,
    "op2_pii": pii.op2_pii,
    "op3_preference": preference.op3_preference,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_warc": warc.op7_warc,
    "op8_host_rules": hostrules.op8_host_rules,
    "op9_repeats": repeats.op9_repeats,
    "op10_bpe": bpe.op10_bpe,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_lexical": lexical.op12_lexical,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}

ORACLE = {
    "op3_preference": preference.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_host_rules": hostrules.OP8_SQL,
    "op11_decontaminate": decontaminate.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
