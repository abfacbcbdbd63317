"""Queries of the numbered operators, with production parameters over whole tables."""

from . import alignment, bpe, lang_id, line_dedup, lm_score, media, merkle, mixing, near_dups, secret_scan, substrings, url_filter, winnow
from .common import documents


def op9(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


QUERIES = {
    "op1_language_id": lang_id.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_minhash_near_dedup": near_dups.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_media_columns": media.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_lm_score": lm_score.op8,
    "op9_source_mix": op9,
    "op10_winnowing": winnow.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_url_filter": url_filter.op12,
    "op13_token_alignment": alignment.op13,
}
ORACLES = {"op3_minhash_near_dedup": near_dups.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op9_source_mix": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_url_filter": url_filter.ORACLE}
