"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from dqspark.llm.alignment import op13_tokenizer_alignment
from dqspark.llm.bpe import op9_bpe_round_trip
from dqspark.llm.cuckoo import OP10_SQL, op10_exact_dedup
from dqspark.llm.fixity import OP5_SQL, op5_warc_fixity
from dqspark.llm.line_dedup import OP8_SQL, op8_line_dedup
from dqspark.llm.packing import op3_packing
from dqspark.llm.quality import op11_quality_rules
from dqspark.llm.simhash import op4_simhash_near_dedup
from dqspark.llm.sketch import op2_document_fingerprints
from dqspark.llm.spelling import op12_spelling_variants
from dqspark.llm.token_counts import op7_token_counts
from dqspark.llm.toxicity import op6_toxicity
from dqspark.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    f.__name__: f for f in (
        op1_url_filter, op2_document_fingerprints, op3_packing, op4_simhash_near_dedup, op5_warc_fixity,
        op6_toxicity, op7_token_counts, op8_line_dedup, op9_bpe_round_trip, op10_exact_dedup,
        op11_quality_rules, op12_spelling_variants, op13_tokenizer_alignment,
    )
}
ORACLES = {
    "op1_url_filter": OP1_SQL.strip(),
    "op5_warc_fixity": OP5_SQL.strip(),
    "op8_line_dedup": OP8_SQL.strip(),
    "op10_exact_dedup": OP10_SQL.strip(),
}
