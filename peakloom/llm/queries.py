"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm.decontam import op9_decontam
from peakloom.llm.html import op8_html
from peakloom.llm.minhash import OP1_SQL, op1_minhash
from peakloom.llm.mixing import OP2_SQL, op2_mix
from peakloom.llm.quality import OP4_SQL, op4_quality
from peakloom.llm.scoring import op11_interpolation
from peakloom.llm.secrets import op6_secrets
from peakloom.llm.suffixes import op3_suffixes
from peakloom.llm.tokens import op7_tokens
from peakloom.llm.toxicity import op5_toxicity
from peakloom.llm.variants import op12_variants
from peakloom.llm.vectors import OP13_SQL, op13_codes
from peakloom.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_mix": op2_mix,
    "op3_suffixes": op3_suffixes,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_tokens": op7_tokens,
    "op8_html": op8_html,
    "op9_decontam": op9_decontam,
    "op10_warc": op10_warc,
    "op11_interpolation": op11_interpolation,
    "op12_variants": op12_variants,
    "op13_codes": op13_codes,
}
SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_mix": OP2_SQL, "op4_quality": OP4_SQL, "op10_warc": OP10_SQL, "op13_codes": OP13_SQL}
