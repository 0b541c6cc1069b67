"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from riskspark.llm.ann import op8_ann
from riskspark.llm.bpe import op6_bpe
from riskspark.llm.chat import OP1_SQL, op1_chat
from riskspark.llm.decontaminate import OP4_SQL, op4_decontaminate
from riskspark.llm.licenses import OP9_SQL, op9_licenses
from riskspark.llm.line_dedup import OP5_SQL, op5_line_dedup
from riskspark.llm.minhash import OP3_SQL, op3_minhash
from riskspark.llm.secrets import op2_secrets
from riskspark.llm.toxicity import op7_toxicity
from riskspark.llm.urls import OP10_SQL, op10_urls

QUERIES = {
    "op1_chat": op1_chat,
    "op2_secrets": op2_secrets,
    "op3_minhash": op3_minhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_ann": op8_ann,
    "op9_licenses": op9_licenses,
    "op10_urls": op10_urls,
}
SQL = {
    "op1_chat": OP1_SQL,
    "op3_minhash": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_licenses": OP9_SQL,
    "op10_urls": OP10_SQL,
}
