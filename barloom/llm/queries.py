"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import katz, langid, media, mix, pack, quality, quality_sql, shard, shard_sql, simhash, spelling, spelling_sql, suffix, tokenfile, toxicity, trie, trie_sql

QUERIES = {
    "op1_katz_backoff": katz.op1,
    "op2_mcd_quality": quality.op2,
    "op3_media_columns": media.op3,
    "op4_suffix_dedup": suffix.op4,
    "op5_bm25_packing": pack.op5,
    "op6_cross_parsing": langid.op6,
    "op7_hash_tree": shard.op7,
    "op8_simhash_pivots": simhash.op8,
    "op9_subword_toxicity": toxicity.op9,
    "op10_cube_mix": mix.op10,
    "op11_heavy_path_trie": trie.op11,
    "op12_elias_fano_files": tokenfile.op12,
    "op13_spelling_ranges": spelling.op13,
}

ORACLES = {
    "op2_mcd_quality": quality_sql.oracle(),
    "op7_hash_tree": shard_sql.oracle(),
    "op11_heavy_path_trie": trie_sql.oracle(),
    "op13_spelling_ranges": spelling_sql.oracle(),
}
