"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from tessera.llm import chat_format, exact_dedup, lm_scoring, minhash, mixing, packing, quality, secrets, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality, packing.op2_packing, lm_scoring.op3_lm_scoring, lm_scoring.op3_lm_scoring_trigrams, chat_format.op4_chat_format, secrets.op5_secrets,
        mixing.op6_mixing, token_files.op7_token_files, minhash.op8_minhash, toxicity.op9_toxicity, exact_dedup.op10_exact_dedup,
    )
}
ORACLE_SQL = {"op3_lm_scoring": lm_scoring.SQL, "op4_chat_format": chat_format.SQL, "op10_exact_dedup": exact_dedup.SQL}
