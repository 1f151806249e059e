"""Queries of the ten operators over the driver's tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import oracles
from .bpe import op10_bpe
from .html import op7_html
from .jaccard import op4_jaccard
from .licenses import op6_licenses
from .media import op2_media
from .mixing import OP8_SQL, op8_mixing
from .pii import op3_pii
from .quality import op9_quality
from .secrets import op1_secrets
from .toxicity import op5_toxicity

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_media": op2_media,
    "op3_pii": op3_pii,
    "op4_jaccard": op4_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}
SQL = {"op1_secrets": oracles.op1(), "op3_pii": oracles.op3(), "op4_jaccard": oracles.op4(), "op6_licenses": oracles.op6(), "op8_mixing": OP8_SQL}
