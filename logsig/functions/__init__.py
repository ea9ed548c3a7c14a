"""Column expressions: every function here maps columns to a column."""

from .fields import (
    categorize_fields,
    extract_fields,
    select_fields_dual,
    select_fields_unified,
    token_kinds,
)
from .shallow import shallow_reconstruct
from .signature import pattern_signature, split_symbols, symbol_skeleton
from .text import is_blank, keyword_flags, join_fields, signature_hash, strip, text_preview

__all__ = [
    "categorize_fields",
    "extract_fields",
    "is_blank",
    "join_fields",
    "keyword_flags",
    "pattern_signature",
    "select_fields_dual",
    "select_fields_unified",
    "shallow_reconstruct",
    "signature_hash",
    "split_symbols",
    "strip",
    "symbol_skeleton",
    "text_preview",
    "token_kinds",
]
