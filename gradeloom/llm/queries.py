"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .bin_slack import op11_bin_slack
from .decontaminate import OP9_SQL, op9_decontamination, op9_proximity
from .filter_audit import OP13_SQL, op13_filter_audit
from .jaccard_join import OP1_SQL, op1_jaccard_join
from .language_id import op2_language_id
from .minhash import op8_fingerprints
from .packing import op4_best_fit_packing
from .pii import op3_pii
from .sharding import op6_balanced_sharding
from .spelling import op12_spelling_variants
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_balanced_sharding": op6_balanced_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontamination": op9_decontamination,
    "op9_proximity": op9_proximity,
    "op10_warc": op10_warc,
    "op11_bin_slack": op11_bin_slack,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op1_jaccard_join": OP1_SQL, "op9_decontamination": OP9_SQL, "op10_warc": OP10_SQL, "op13_filter_audit": OP13_SQL}
