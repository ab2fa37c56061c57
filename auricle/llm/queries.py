"""Registered corpus queries and their SQL."""

from auricle.llm import lexical, merkle, mixing, nearvec, packing, pii, secrets, simhash, sql, substring, toxicity, unigram, vafile

QUERIES = {
    "op1_mix_sources": mixing.mix_query,
    "op2_token_counts": unigram.token_count_query,
    "op3_personal_data": pii.pii_query,
    "op4_substring_dedup": substring.substring_query,
    "op5_secrets": secrets.secrets_query,
    "op6_near_vectors": nearvec.near_vector_query,
    "op7_toxicity": toxicity.toxicity_query,
    "op8_top_k": vafile.top_k_query,
    "op9_simhash": simhash.simhash_query,
    "op10_sentencepiece": unigram.encode_query,
    "op11_lexical_search": lexical.search_query,
    "op12_packing": packing.pack_query,
    "op13_merkle_manifest": merkle.manifest_query,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op4_substring_dedup": sql.SUBSTRING,
    "op6_near_vectors": sql.NEAR_VECTORS,
    "op8_top_k": sql.TOP_K,
    "op11_lexical_search": sql.LEXICAL,
    "op13_merkle_manifest": sql.MERKLE,
}
