"""Queries of the training-data operators, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op6_decontamination
from .divergence import OP12_SQL, op12_divergence
from .fingerprints import op1_fingerprints
from .language_model import op9_language_model
from .languages import op10_languages
from .licenses import OP13_SQL, op13_licenses
from .mixing import op5_mixing
from .negatives import OP11_SQL, op11_hard_negatives
from .passages import op3_passages
from .quality import op4_quality
from .shingle_join import op7_shingle_join
from .token_files import op2_token_files
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_files": op2_token_files,
    "op3_passages": op3_passages,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_shingle_join": op7_shingle_join,
    "op8_warc": op8_warc,
    "op9_language_model": op9_language_model,
    "op10_languages": op10_languages,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_divergence": op12_divergence,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_licenses": OP13_SQL,
}
