"""One query for each operator, and the pipeline, on the driver's tables."""

from __future__ import annotations

from gleaner.llm import decontamination, license_scan, mixing, oracles, packing, ppm, quality_classifier, quality_rules, ranked_search, sharding, simhash_dedup, substring_dedup, warc, whitening
from gleaner.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def rule_ablations(spark, sf_dir):
    return quality_rules.ablations(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup.report(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontamination.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ppm(spark, sf_dir):
    return ppm.report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    import public_tokenizers

    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"rule_ablations": rule_ablations, "pipeline": pipeline}


def oracle_sql():
    import corpus_pipeline

    return oracles.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
