"""The dealt operators' queries and their SQL, for the entry module to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, archive, decontaminate, licenses, linededup, neardup, packing, quality, secrets, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_ann": ann.op2_ann,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_urlfilter": urlfilter.op4_urlfilter,
        "op5_neardup": neardup.op5_neardup,
        "op6_secrets": secrets.op6_secrets,
        "op7_linededup": linededup.op7_linededup,
        "op8_quality": quality.op8_quality,
        "op9_warc": archive.op9_warc,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.ORACLE,
        "op3_decontaminate": decontaminate.ORACLE,
        "op4_urlfilter": urlfilter.ORACLE,
        "op5_neardup": neardup.ORACLE,
        "op9_warc": archive.ORACLE,
    }
