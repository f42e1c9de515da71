"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import sql
from ledgerline.llm.bpe import op6_bpe
from ledgerline.llm.context_mixing import op12_context_mixing
from ledgerline.llm.decontaminate import op3_decontaminate
from ledgerline.llm.ngram_join import op1_ngram_join
from ledgerline.llm.pii import op4_pii
from ledgerline.llm.quality_gam import op9_quality_gam
from ledgerline.llm.quality_rules import op7_line_rules
from ledgerline.llm.quote_links import op5_quote_links
from ledgerline.llm.suffix_dedup import op8_suffix_dedup
from ledgerline.llm.token_align import op13_token_align
from ledgerline.llm.vector_codes import op11_vector_codes
from ledgerline.llm.warc import op2_warc
from ledgerline.llm.window_dedup import op10_window_dedup

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_quote_links": op5_quote_links,
    "op6_bpe": op6_bpe,
    "op7_line_rules": op7_line_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_gam": op9_quality_gam,
    "op10_window_dedup": op10_window_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_context_mixing": op12_context_mixing,
    "op13_token_align": op13_token_align,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql.ORACLE[name] for name in QUERIES if name in sql.ORACLE}
