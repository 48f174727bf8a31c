"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lumispark.llm.bitslice import SQL_BITSLICE, op11_bitslice
from lumispark.llm.chat import SQL_CHAT, op10_chat
from lumispark.llm.divergence import SQL_DIVERGENCE, op12_divergence
from lumispark.llm.fingerprint import op5_fingerprint
from lumispark.llm.infill import SQL_INFILL, op13_infill
from lumispark.llm.lm_scoring import op9_lm_scoring
from lumispark.llm.mixing import op1_mixing
from lumispark.llm.neighbours import op4_neighbours
from lumispark.llm.packing import op3_packing, op6_binary
from lumispark.llm.secrets import op7_secrets
from lumispark.llm.simhash import op2_simhash
from lumispark.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_neighbours": op4_neighbours,
    "op5_fingerprint": op5_fingerprint,
    "op6_binary": op6_binary,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_chat": op10_chat,
    "op11_bitslice": op11_bitslice,
    "op12_divergence": op12_divergence,
    "op13_infill": op13_infill,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op10_chat": SQL_CHAT, "op11_bitslice": SQL_BITSLICE, "op12_divergence": SQL_DIVERGENCE, "op13_infill": SQL_INFILL}
