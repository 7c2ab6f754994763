"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .op1_toxicity import op1_toxicity
from .op2_decontaminate import OP2_SQL, op2_benchmark_leaks
from .op3_merkle import op3_merkle_fingerprints
from .op4_suffixes import op4_suffix_dedup
from .op5_minhash import OP5_SQL, op5_minhash_components
from .op6_warc import OP6_SQL, op6_warc_transactions
from .op7_bpe import op7_bpe_round_trip
from .op8_pii import op8_personal_data
from .op9_secrets import op9_secret_ledger
from .op10_tokens import op10_token_counts
from .op11_language import op11_language_id
from .op12_trie import OP12_SQL, op12_prefix_trie
from .op13_repair import OP13_SQL, op13_structure_repair

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_benchmark_leaks, op3_merkle_fingerprints, op4_suffix_dedup, op5_minhash_components,
        op6_warc_transactions, op7_bpe_round_trip, op8_personal_data, op9_secret_ledger, op10_token_counts, op11_language_id,
        op12_prefix_trie, op13_structure_repair,
    )
}

SQL = {
    "op2_benchmark_leaks": OP2_SQL, "op5_minhash_components": OP5_SQL, "op6_warc_transactions": OP6_SQL,
    "op12_prefix_trie": OP12_SQL, "op13_structure_repair": OP13_SQL,
}
