"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from kinfabric.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from kinfabric.llm.media import op5_media_columns
from kinfabric.llm.minhash_dedup import op7_minhash_near_dedup
from kinfabric.llm.mixing import OP10_SQL, op10_mixing
from kinfabric.llm.packing import op9_packing
from kinfabric.llm.quality import op4_quality_classifier
from kinfabric.llm.secrets import op3_secret_scan
from kinfabric.llm.substring_dedup import op8_substring_dedup
from kinfabric.llm.suffix_dedup import op1_suffix_dedup
from kinfabric.llm.tokens import op6_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_exact_dedup,
        op3_secret_scan,
        op4_quality_classifier,
        op5_media_columns,
        op6_token_counts,
        op7_minhash_near_dedup,
        op8_substring_dedup,
        op9_packing,
        op10_mixing,
    )
}

ORACLES = {"op2_exact_dedup": OP2_SQL, "op10_mixing": OP10_SQL}
