"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import backoff, decontaminate, embedding_groups, fill_middle, jaccard_join, line_dedup, mixing, spelling, warc_store
from factgraph.llm.backoff import op5_backoff
from factgraph.llm.decontaminate import op10_decontamination
from factgraph.llm.embedding_groups import op8_embedding_groups
from factgraph.llm.fill_middle import op12_fill_middle
from factgraph.llm.jaccard_join import op2_jaccard_join
from factgraph.llm.language import op7_language
from factgraph.llm.line_dedup import op11_line_dedup
from factgraph.llm.main_text import op3_main_text
from factgraph.llm.mixing import op4_mixing
from factgraph.llm.quality_rules import op6_quality_rules
from factgraph.llm.spelling import op13_spelling
from factgraph.llm.token_blocks import op1_token_blocks
from factgraph.llm.warc_store import op9_warc_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_blocks": op1_token_blocks,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_main_text": op3_main_text,
        "op4_mixing": op4_mixing,
        "op5_backoff": op5_backoff,
        "op6_quality_rules": op6_quality_rules,
        "op7_language": op7_language,
        "op8_embedding_groups": op8_embedding_groups,
        "op9_warc_store": op9_warc_store,
        "op10_decontamination": op10_decontamination,
        "op11_line_dedup": op11_line_dedup,
        "op12_fill_middle": op12_fill_middle,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.ORACLE_SQL,
        "op4_mixing": mixing.ORACLE_SQL,
        "op5_backoff": backoff.ORACLE_SQL,
        "op8_embedding_groups": embedding_groups.ORACLE_SQL,
        "op9_warc_store": warc_store.ORACLE_SQL,
        "op10_decontamination": decontaminate.ORACLE_SQL,
        "op11_line_dedup": line_dedup.ORACLE_SQL,
        "op12_fill_middle": fill_middle.ORACLE_SQL,
        "op13_spelling": spelling.ORACLE_SQL,
    }
