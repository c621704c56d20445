"""The corpus operators' queries and their SQL."""

from noteforge.llm import audit, decontaminate, dedup, html, langid, licenses, packing, quality, repeats, sharding, toxicity, urls, variants

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_language_id": langid.op2_language_id,
    "op3_ordinal_toxicity": toxicity.op3_ordinal_toxicity,
    "op4_tag_path_ratios": html.op4_tag_path_ratios,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_hyperminhash": dedup.op6_hyperminhash,
    "op7_digest_array": urls.op7_digest_array,
    "op8_column_generation": packing.op8_column_generation,
    "op9_hilbert_shards": sharding.op9_hilbert_shards,
    "op10_suffix_automaton": decontaminate.op10_suffix_automaton,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_transposition_walk": audit.op12_transposition_walk,
    "op13_suffix_merge": repeats.op13_suffix_merge,
}
ORACLE_SQL = {
    "op1_license_scan": licenses.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_hyperminhash": dedup.ORACLE,
    "op7_digest_array": urls.ORACLE,
    "op9_hilbert_shards": sharding.ORACLE,
    "op10_suffix_automaton": decontaminate.ORACLE,
    "op11_spelling_variants": variants.ORACLE,
    "op12_transposition_walk": audit.ORACLE,
    "op13_suffix_merge": repeats.ORACLE,
}
