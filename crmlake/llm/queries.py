"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from crmlake.llm import chat_format, exact_dedup, line_dedup, merkle, ngram_join
from crmlake.llm.bpe import op3_bpe
from crmlake.llm.chat_format import op11_chat_format
from crmlake.llm.decontaminate import op1_decontamination
from crmlake.llm.exact_dedup import op5_exact_dedup
from crmlake.llm.line_dedup import op9_line_dedup
from crmlake.llm.merkle import op12_merkle
from crmlake.llm.ngram_join import op7_ngram_join
from crmlake.llm.pii import op6_pii
from crmlake.llm.quality import op4_quality
from crmlake.llm.suffix_dedup import op8_suffix_dedup
from crmlake.llm.token_orc import op10_token_orc
from crmlake.llm.toxicity import op2_toxicity
from crmlake.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_toxicity, op3_bpe, op4_quality, op5_exact_dedup, op6_pii, op7_ngram_join,
    op8_suffix_dedup, op9_line_dedup, op10_token_orc, op11_chat_format, op12_merkle,
    op13_whitening)}

# the others have no SQL that runs over whole tables; tests hold them against brute force
ORACLE_SQL = {"op5_exact_dedup": exact_dedup.OP5_SQL, "op7_ngram_join": ngram_join.OP7_SQL,
              "op9_line_dedup": line_dedup.OP9_SQL, "op11_chat_format": chat_format.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
