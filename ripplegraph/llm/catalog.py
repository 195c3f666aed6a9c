"""Queries of the operators for training-data pipelines, and the SQL that states the same result where SQL can."""

from __future__ import annotations

import corpus_pipeline
from ripplegraph.llm import chat_format, decontaminate, graph_ann, html_extract, jaccard_join, language_id, packing, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_language_id": language_id.op2_language_id,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_packing": packing.op4_packing,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_warc": warc.op6_warc,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_graph_ann": graph_ann.op9_graph_ann,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict:
    return {
        "op1_chat_format": chat_format.ORACLE,
        "op5_jaccard_join": jaccard_join.ORACLE,
        "op6_warc": warc.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
    }
