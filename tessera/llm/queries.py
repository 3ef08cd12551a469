"""The registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from tessera.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tessera.llm.fingerprints import op7_fingerprints
from tessera.llm.language_id import language_id_pages, op3_language_id
from tessera.llm.line_dedup import OP1_SQL, op1_line_dedup
from tessera.llm.minhash_dedup import OP9_SQL, op9_minhash_dedup
from tessera.llm.mixing import op8_mixing
from tessera.llm.packing import op4_packing
from tessera.llm.quality import op2_quality
from tessera.llm.secrets import op10_secret_scans
from tessera.llm.url_filters import OP5_SQL, op5_url_filters

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_language_id, op4_packing, op5_url_filters, op6_exact_dedup, op7_fingerprints, op8_mixing, op9_minhash_dedup, op10_secret_scans, language_id_pages)}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op5_url_filters": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_minhash_dedup": OP9_SQL}
