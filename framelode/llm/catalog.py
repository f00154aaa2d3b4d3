"""The registered queries of the corpus operators, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from framelode.llm import lexical
from framelode.llm.bpe import op2_bpe
from framelode.llm.decontaminate import op9_decontaminate
from framelode.llm.lexical import op12_lexical_search
from framelode.llm.near_dedup import op10_near_dedup
from framelode.llm.neighbours import op3_neighbours
from framelode.llm.pii import op8_pii
from framelode.llm.quality import op6_quality
from framelode.llm.sharding import op1_sharding
from framelode.llm.simhash import op13_simhash
from framelode.llm.token_output import op4_token_output
from framelode.llm.runs import op11_periodic_runs
from framelode.llm.toxicity import op5_toxicity
from framelode.llm.warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sharding, op2_bpe, op3_neighbours, op4_token_output, op5_toxicity, op6_quality, op7_warc, op8_pii, op9_decontaminate, op10_near_dedup, op11_periodic_runs, op12_lexical_search, op13_simhash)
    return {q.__name__: q for q in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op12_lexical_search": lexical.SQL}
