"""The queries of this package, by the names the entry module registers."""

from __future__ import annotations

from docspend.llm import decontaminate, divergence, exact_dedup, html_extract, line_dedup, manifest, mixing, near_dedup, packing, quality, repetition, token_counts, warc
from docspend.llm.common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_dedup.groups(table(spark, sf_dir, "documents"), shingle=2)


def op4_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.document_counts(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    return repetition.judged(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents"))


def op11_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op12_merkle_manifest(spark, sf_dir):
    return manifest.audit(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    return divergence.report(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_exact_dedup, op2_best_fit_packing, op3_minhash_near_dedup, op4_line_dedup, op5_token_counts, op6_quality_classifier, op7_warc,
    op8_html_extraction, op9_quality_rules, op10_mixing, op11_decontamination, op12_merkle_manifest, op13_source_divergence
)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_warc": warc.ORACLE, "op11_decontamination": decontaminate.ORACLE, "op12_merkle_manifest": manifest.ORACLE, "op13_source_divergence": divergence.ORACLE}
