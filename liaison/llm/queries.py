"""The queries of this package."""

from . import byte_bpe, decontamination, merkle, mixing, pii, pitman_yor, quality, sentence_dedup, simhash, token_output, toxicity, vector_codes, webp

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_webp": webp.op5_webp,
    "op6_sentence_spans": sentence_dedup.op6_sentence_spans,
    "op7_pseudonyms": pii.op7_pseudonyms,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_ids": token_output.op10_token_ids,
    "op11_merkle": merkle.op11_merkle,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle": merkle.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
}
