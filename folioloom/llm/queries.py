"""Queries of this subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

import corpus_pipeline
from folioloom.llm import chat, decontaminate, lm, mixing, quality, rules, simhash, tokencount, tokenfiles, warc

QUERIES = {
    "op1_token_files": tokenfiles.op1_token_files,
    "op2_rules": rules.op2_rules,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_preference": chat.op6_preference,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_lm": lm.op8_lm,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
    "pipeline": corpus_pipeline.run,
    "rule_ablation": rules.rule_ablation,
}

SQL = {"op2_rules": rules.OP2_SQL, "rule_ablation": rules.ABLATION_SQL, "op3_warc": warc.OP3_SQL, "op6_preference": chat.OP6_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
