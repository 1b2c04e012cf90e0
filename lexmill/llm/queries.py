"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontam, embed_dedup, html_text, license_scan, minhash_dedup, packing, secrets, sharding, toxicity


def pipeline(spark, sf_dir):
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_html_text": html_text.query,
    "op3_packing": packing.query,
    "op4_sharding": sharding.query,
    "op5_chat_format": chat_format.query,
    "op6_secret_scan": secrets.query,
    "op7_decontamination": decontam.query,
    "op8_toxicity": toxicity.query,
    "op9_embedding_dedup": embed_dedup.query,
    "op10_minhash_dedup": minhash_dedup.query,
    "pipeline": pipeline,
}

SQL = {
    "op1_license_scan": license_scan.SQL,
    "op4_sharding": sharding.SQL,
    "op5_chat_format": chat_format.SQL,
}
