"""Registered queries of this folder and their SQL, where SQL can express them."""

from maskloom.llm import approximation_search, collocations, hard_negatives, license_scan, line_dedup, mixing, multiset_hash, near_dedup, one_bit_search, packing, quality, repeats, url_rules

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_packing": packing.op3_packing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_one_bit_search": one_bit_search.op5_one_bit_search,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_multiset_hash": multiset_hash.op8_multiset_hash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_approximation_search": approximation_search.op11_approximation_search,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op2_license_scan": license_scan.SQL,
    "op7_url_rules": url_rules.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_approximation_search": approximation_search.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_collocations": collocations.SQL,
}
