"""The queries of this subpackage by name, and SQL where it can express them."""

from . import html_extract, language_id, line_dedup, minhash, nearest, packing, sentencepiece_codec, sharding, simhash, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_nearest_neighbours": nearest.op3_nearest_neighbours,
    "op4_simhash_dedup": simhash.op4_simhash_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_document_fingerprints": minhash.op7_document_fingerprints,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE_SQL}
