"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from measurekit.llm import align, ann, bpe, embedding_dedup, html_text, langid, licenses, merkle, mixing, near_dup, quality, suffix_dedup, urls
from measurekit.llm.shared import tune

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_url_filter": urls.op2_url_filter,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_language_id": langid.op4_language_id,
    "op5_embedding_neardup": embedding_dedup.op5_embedding_neardup,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_minhash_neardup": near_dup.op7_minhash_neardup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_bpe_codec": bpe.op9_bpe_codec,
    "op10_ann_search": ann.op10_ann_search,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality_classifier": quality.op12_quality_classifier,
    "op13_token_alignment": align.op13_token_alignment,
}

SQL: dict[str, str] = {
    "op3_source_mixing": mixing.SQL,
    "op5_embedding_neardup": embedding_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
}


def _tuned(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(tune(spark), sf_dir)


QUERIES = {name: _tuned(fn) for name, fn in _QUERIES.items()}
