"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import count_vectors, decontaminate, edit_counts, fill_middle, filter_audit, grammar_shards, host_rules, langid, licenses, mixture, repeats, tree_bpe, url_lists

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language_id": langid.op2_language_id,
    "op3_host_rules": host_rules.op3_host_rules,
    "op4_jaccard_components": count_vectors.op4_jaccard_components,
    "op5_grammar_shards": grammar_shards.op5_grammar_shards,
    "op6_url_lists": url_lists.op6_url_lists,
    "op7_edit_counts": edit_counts.op7_edit_counts,
    "op8_mixture": mixture.op8_mixture,
    "op9_licenses": licenses.op9_licenses,
    "op10_repeats": repeats.op10_repeats,
    "op11_byte_bpe": tree_bpe.op11_byte_bpe,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_host_rules": host_rules.OP3_SQL,
    "op6_url_lists": url_lists.OP6_SQL,
    "op8_mixture": mixture.OP8_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
