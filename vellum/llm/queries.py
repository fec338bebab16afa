"""The queries of the corpus operators, and their SQL where SQL can express them."""

from vellum.llm import decontamination, language_model, lexical_search, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash_dedup, substring_dedup, url_filters, vector_codes

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_decontamination": decontamination.op3,
    "op4_url_filters": url_filters.op4,
    "op5_mixing": mixing.op5,
    "op6_language_model": language_model.op6,
    "op7_simhash_dedup": simhash_dedup.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_sharding": sharding.op9,
    "op10_pii": pii.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_packing": packing.op13,
}
ORACLE_SQL = {"op3_decontamination": decontamination.SQL, "op4_url_filters": url_filters.SQL, "op11_vector_codes": vector_codes.SQL, "op12_lexical_search": lexical_search.SQL}
