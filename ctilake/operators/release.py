"""Governed release: what of a text may leave, by the policy of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTER = "metadata_or_pointer_only"
# Release mode and artifact by source layer of the test tables; a layer without a policy is pointer-only.
POLICIES = {
    "vulnerability_reference": ("redistributable_text", "text"),
    "advisory_reference": ("redistributable_text", "text"),
    "bug_bounty_disclosure": ("research_text_with_terms", "research_text"),
    "exploit_archive": ("research_text_with_terms", "research_text"),
    "hacker_community": (POINTER, "pointer"),
}


def apply_policy(df: DataFrame, source: str, text: str, policies: dict[str, tuple[str, str]] = POLICIES) -> DataFrame:
    """``df`` with release columns; pointer-only texts become null, with their hash and length.

    The policy table is a literal, so this is one projection. A null or unknown source is
    pointer-only; a null or empty redacted text has an empty hash and length 0.
    """
    look = F.create_map(*[F.lit(x) for k, (m, a) in policies.items() for x in (k, f"{m}|{a}")])
    policy = F.coalesce(F.try_element_at(look, F.coalesce(F.col(source), F.lit(""))), F.lit(f"{POINTER}|pointer"))
    mode, artifact = F.substring_index(policy, "|", 1), F.substring_index(policy, "|", -1)
    pointer = (mode == POINTER) | (artifact == "pointer")
    t = F.coalesce(text, F.lit(""))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, mode.alias("release_mode"), artifact.alias("released_artifact"), F.when(~pointer, F.col(text)).alias(text), F.when(pointer, F.when(t == "", "").otherwise(F.sha2(t, 256))).alias("text_sha256"), F.when(pointer, F.length(t)).alias("text_length"), F.when(pointer, "metadata_or_pointer_only_release_mode").alias("redaction_reason"))


def violations(released: DataFrame, text: str = "text") -> DataFrame:
    """Rows, redacted rows and redacted rows that still hold text, by release mode."""
    redacted = F.col("text_sha256").isNotNull()
    return released.groupBy("release_mode").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(redacted).alias("redacted"), F.count_if(redacted & F.col(text).isNotNull()).alias("violations"))
