"""Training examples from failure-mode chunks (TXT-23, TXT-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def sft_rows(chunks: DataFrame, manual: DataFrame | None = None, refusals: DataFrame | None = None, cap: int = 5000, order: str = "chunk_id") -> DataFrame:
    """TXT-23: ``instruction, input, output``: chunks, then manual pairs, then refusals ``(tag, reason)``, cut at ``cap``.

    The cap is the feature: the first rows in that order.
    """
    text = F.lit(fixed.SFT_INSTRUCTION)
    made = chunks.select(F.lit(0).alias("__part"), F.col(order).cast("long").alias("__at"), text.alias("instruction"), F.format_string(fixed.SFT_INPUT, F.coalesce("tag", F.lit("UNKNOWN")), F.coalesce("system", F.lit("Unknown"))).alias("input"), F.coalesce("page_content", F.lit("")).alias("output"))
    if manual is not None:
        made = made.unionByName(manual.select(F.lit(1).alias("__part"), F.col(order).cast("long").alias("__at"), "instruction", "input", "output"))
    if refusals is not None:
        made = made.unionByName(refusals.select(F.lit(2).alias("__part"), F.col(order).cast("long").alias("__at"), text.alias("instruction"), F.format_string(fixed.SFT_REFUSAL_INPUT, "tag").alias("input"), F.format_string(fixed.SFT_REFUSAL, "tag", "reason").alias("output")))
    return made.orderBy("__part", "__at").limit(cap).select("instruction", "input", "output")


def dpo_rows(chunks: DataFrame, cap: int = 2000, order: str = "chunk_id", refusal: tuple[str, str, str, str] | None = fixed.DPO_REFUSAL) -> DataFrame:
    """TXT-24: ``prompt, chosen, rejected`` per chunk, then one refusal pair, cut at ``cap``."""
    tag = F.coalesce("tag", F.lit("N/A"))
    prompt = F.format_string(fixed.DPO_PROMPT, tag, F.coalesce("system", F.lit("Unknown")))
    chosen = F.format_string(fixed.DPO_CHOSEN, F.coalesce("source", F.lit("fmea_XXX")), F.coalesce("page_content", F.lit("")), F.coalesce("recommended_action", F.lit("Manual inspection.")), F.coalesce("confidence", F.lit(0.75)))
    made = chunks.select(F.lit(0).alias("__part"), F.col(order).cast("long").alias("__at"), prompt.alias("prompt"), chosen.alias("chosen"), F.format_string(fixed.DPO_REJECTED, tag).alias("rejected"))
    if refusal:
        name, scenario, good, bad = refusal
        row = [(1, 0, fixed.DPO_REFUSAL_PROMPT % (name, scenario), good, bad)]
        made = made.unionByName(chunks.sparkSession.createDataFrame(row, "__part int, __at long, prompt string, chosen string, rejected string"))
    return made.orderBy("__part", "__at").limit(cap).select("prompt", "chosen", "rejected")
