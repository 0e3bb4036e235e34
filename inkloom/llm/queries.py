"""The queries of this subpackage: name -> function(spark, sf_dir), and their SQL."""

from __future__ import annotations

from . import arrow_tokens, bpe_monoid, count_rtree, html_layout, langmix, phrase_index, quality_lines, radix_suffix, rlz_dedup, suffix_tree_lm


def queries() -> dict:
    return {
        "op1_quality_lines": quality_lines.query,
        "op2_arrow_tokens": arrow_tokens.query,
        "op3_rlz_dedup": rlz_dedup.query,
        "op4_count_rtree": count_rtree.query,
        "op5_html_layout": html_layout.query,
        "op6_suffix_tree_lm": suffix_tree_lm.query,
        "op7_langmix": langmix.query,
        "op8_radix_suffix": radix_suffix.query,
        "op9_bpe_monoid": bpe_monoid.query,
        "op10_phrase_index": phrase_index.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_lines": quality_lines.SQL, "op3_rlz_dedup": rlz_dedup.SQL, "op4_count_rtree": count_rtree.SQL, "op8_radix_suffix": radix_suffix.SQL, "op10_phrase_index": phrase_index.SQL}
