"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seagrid.llm import crosspolytope, fst, jaccardjoin, knnquality, linededup, mergereplay, packing, suffixdedup, vafile, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_approximation_topk": vafile.op1_vector_approximation_topk,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_warc_transactions": warc.op3_warc_transactions,
    "op4_line_similarity_dedup": linededup.op4_line_similarity_dedup,
    "op5_nearest_neighbour_quality": knnquality.op5_nearest_neighbour_quality,
    "op6_finite_state_token_counts": fst.op6_finite_state_token_counts,
    "op7_merge_replay_bpe": mergereplay.op7_merge_replay_bpe,
    "op8_cross_polytope_ann": crosspolytope.op8_cross_polytope_ann,
    "op9_suffix_array_dedup": suffixdedup.op9_suffix_array_dedup,
    "op10_ngram_jaccard_join": jaccardjoin.op10_ngram_jaccard_join,
}

#: Only where SQL can express the query over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_vector_approximation_topk": vafile.OP1_SQL,
    "op3_warc_transactions": warc.OP3_SQL,
}
