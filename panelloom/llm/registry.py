"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, chat, jaccard, langid, licenses, linedup, mixing, neardup, packing, quality, resample, toxicity, urlgraph
from .common import ship


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    made = {
        "op1_langid": langid.op1_langid,
        "op2_embeddings": neardup.op2_embeddings,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat": chat.op5_chat,
        "op6_packing": packing.op6_packing,
        "op7_licenses": licenses.op7_licenses,
        "op8_urls": urlgraph.op8_urls,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality.op10_quality,
        "op11_lines": linedup.op11_lines,
        "op12_resampling": resample.op12_resampling,
        "op13_filters": audit.op13_filters,
    }
    return {k: _shipped(f) for k, f in made.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embeddings": neardup.SQL,
        "op3_jaccard": jaccard.SQL,
        "op5_chat": chat.SQL,
        "op8_urls": urlgraph.SQL,
        "op9_mixing": mixing.SQL,
        "op10_quality": quality.SQL,
        "op11_lines": linedup.SQL,
        "op12_resampling": resample.SQL,
        "op13_filters": audit.SQL,
    }
