from ledgerline.functions.columns import is_missing, known, select_except, typed_projection
from ledgerline.functions.hashing import hash_draw, split_bucket
from ledgerline.functions.text import (
    array_item,
    bucket_other,
    last_segment,
    segment_count,
    token_after_comma,
)

__all__ = [
    "array_item",
    "bucket_other",
    "hash_draw",
    "is_missing",
    "known",
    "last_segment",
    "segment_count",
    "select_except",
    "split_bucket",
    "token_after_comma",
    "typed_projection",
]
