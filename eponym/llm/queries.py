"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from .op1_packing import op1_packing
from .op2_simple8b import op2_simple8b
from .op4_bpe import op4_bpe
from .op3_toxicity import op3_toxicity
from .op7_quality import op7_quality
from .op8_licenses import op8_licenses
from .op9_urls import op9_urls
from .op10_fingerprints import op10_fingerprints
from .op5_jaccard import op5_jaccard
from . import op6_quality_rules as op6

QUERIES = {
    "op1_packing": op1_packing,
    "op2_simple8b": op2_simple8b,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_jaccard": op5_jaccard,
    "op6_quality_rules": op6.op6_quality_rules,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_urls": op9_urls,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": op6.ORACLE,
}
