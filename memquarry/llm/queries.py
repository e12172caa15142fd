"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import conversation_repair, embedding_dedup, fingerprints, language_id, mixing, ngram_join, packing, quality, suffix_dedup, token_alignment, token_counts, topk_search, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        ngram_join.op1_ngram_jaccard_join,
        packing.op2_best_fit_packing,
        toxicity.op3_toxicity,
        suffix_dedup.op4_suffix_array_dedup,
        quality.op5_quality_classifier,
        language_id.op6_language_id,
        token_counts.op7_token_counts,
        topk_search.op8_topk_search,
        mixing.op9_source_mixing,
        embedding_dedup.op10_embedding_dedup,
        fingerprints.op11_document_fingerprints,
        token_alignment.op12_token_alignment,
        conversation_repair.op13_conversation_repair,
    )
}
ORACLE_SQL = {"op8_topk_search": topk_search.OP8_SQL, "op13_conversation_repair": conversation_repair.OP13_SQL}
