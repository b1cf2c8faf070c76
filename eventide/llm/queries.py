"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_text, jaccard_join, line_dedup, lloyd, matroska, packing, part_codes, quality, sharding, token_counts, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_bpe_codec": bpe.op3_bpe_codec,
    "op4_media_columns": matroska.op4_media_columns,
    "op5_sharding": sharding.op5_sharding,
    "op6_nearest": ann.op6_nearest,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_packing": packing.op10_packing,
    "op11_centroids": lloyd.op11_centroids,
    "op12_part_codes": part_codes.op12_part_codes,
    "op13_word_bpe": word_bpe.op13_word_bpe,
}

SQL: dict[str, str] = {
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_centroids": lloyd.OP11_SQL,
    "op12_part_codes": part_codes.OP12_SQL,
}
