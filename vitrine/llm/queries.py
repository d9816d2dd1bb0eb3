"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    decontaminate,
    fingerprint,
    guesscost,
    infill,
    jaccard,
    language,
    lmscore,
    mincut,
    packing,
    phrases,
    substring,
    toxicity,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_fingerprints": fingerprint.op3,
        "op4_substring_dedup": substring.op4,
        "op5_language_id": language.op5,
        "op6_jaccard_join": jaccard.op6,
        "op7_stupid_backoff": lmscore.op7,
        "op8_html_extraction": mincut.op8,
        "op9_warc": warc.op9,
        "op10_harmonic_packing": packing.op10,
        "op11_phrases": phrases.op11,
        "op12_guess_cost": guesscost.op12,
        "op13_fill_in_middle": infill.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op9_warc": warc.OP9_SQL, "op11_phrases": phrases.OP11_SQL,
           "op13_fill_in_middle": infill.OP13_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
