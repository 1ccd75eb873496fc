"""The queries of the training-data problems, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import credentials, encoding, leakage, packing, pairs, personal, repetition, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": repetition.p1_found,
        "p1_shares": repetition.p1_shares,
        "p2_found": credentials.p2_found,
        "p2_redacted": credentials.p2_redacted,
        "p3_containers": packing.p3_containers,
        "p3_utilisation": packing.p3_utilisation,
        "p4_found": truncation.p4_found,
        "p4_rates": truncation.p4_rates,
        "p5_found": pairs.p5_found,
        "p6_ids": encoding.p6_ids,
        "p7_found": leakage.p7_found,
        "p8_found": personal.p8_found,
        "p8_redacted": personal.p8_redacted,
    }


def oracle_sql() -> dict[str, str]:
    return {}
