"""The opN queries of this subpackage and the SQL that checks them."""

from . import byte_bpe, chat_format, conversation_repair, cross_polytope, exact_dedup, html_extract, importance, language_id, license_scan, mixing, ngram_join, pitman_yor, unigram_counts

_QUERIES = [
    exact_dedup.op1_exact_dedup,
    html_extract.op2_html_extract,
    language_id.op3_language_id,
    cross_polytope.op4_cross_polytope,
    license_scan.op5_license_scan,
    chat_format.op6_chat_format,
    byte_bpe.op7_byte_bpe,
    mixing.op8_mixing,
    unigram_counts.op9_unigram_counts,
    ngram_join.op10_ngram_join,
    conversation_repair.op11_conversation_repair,
    importance.op12_importance_resampling,
    pitman_yor.op13_lm_scoring,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
    }
