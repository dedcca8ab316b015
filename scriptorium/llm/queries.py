"""Queries of the corpus operators over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, html_extract, langid, license_scan, manifest, media, minhash, mixing, oracles, packing, secret_scan, simhash, suffix_dedup, topk
from .common import table


def _over(name: str, report):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(table(spark, sf_dir, name))

    return run


QUERIES = {
    "op1_secret_scan": _over("documents", secret_scan.secret_report),
    "op2_simhash": _over("documents", simhash.simhash_report),
    "op3_mixing": _over("documents", mixing.mix_report),
    "op4_topk": _over("embeddings", topk.top_k),
    "op5_license_scan": _over("documents", license_scan.scan_licenses),
    "op6_suffix_dedup": _over("documents", suffix_dedup.repeat_report),
    "op7_media": _over("documents", media.media_report),
    "op8_packing": _over("documents", packing.pack),
    "op9_language_id": _over("documents", langid.language_report),
    "op10_html_extraction": _over("pages", html_extract.extract_main_text),
    "op11_minhash": _over("documents", minhash.minhash_report),
    "op12_manifest": _over("documents", manifest.manifest_report),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

ORACLES = {
    "op1_secret_scan": oracles.secrets(), "op3_mixing": oracles.mixing(), "op4_topk": oracles.top_k(), "op5_license_scan": oracles.licenses(), "op6_suffix_dedup": oracles.repeats(), "op11_minhash": oracles.near_duplicates(),
    "op12_manifest": oracles.manifest(), "op13_filter_audit": oracles.filter_audit(),
}
