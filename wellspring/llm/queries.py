"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from wellspring.llm.decontaminate import OP3_SQL, op3_decontaminate
from wellspring.llm.divergence import OP13_SQL, op13_divergence
from wellspring.llm.embedding_dedup import op5_embeddings
from wellspring.llm.langid import op9_langid
from wellspring.llm.licenses import op4_licenses
from wellspring.llm.line_dedup import OP1_SQL, op1_line_dedup
from wellspring.llm.minhash import op6_minhash
from wellspring.llm.lm_score import op12_lm_score
from wellspring.llm.mixing import OP7_SQL, op7_mixing
from wellspring.llm.suffix_dedup import op10_suffix_dedup
from wellspring.llm.toxicity import op8_toxicity
from wellspring.llm.warc import OP2_SQL, op2_warc
from wellspring.llm.whitening import op11_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_licenses": op4_licenses,
    "op5_embeddings": op5_embeddings,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_lm_score": op12_lm_score,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op13_divergence": OP13_SQL,
}
