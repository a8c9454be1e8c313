"""The registered queries of this folder: each operator with production parameters over its whole table."""

from __future__ import annotations

from gopmill.llm import collocations, decontamination, langid, licenses, line_dedup, lm, merkle, packing, pii, quality, simhash, suffix_dedup, warc
from gopmill.llm.common import documents

QUERIES = {
    "op1_benchmark_decontamination": lambda spark, folder: decontamination.op1(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")),
    "op2_packing": lambda spark, folder: packing.pack(documents(spark, folder)),
    "op3_license_scans": lambda spark, folder: licenses.op3(documents(spark, folder)),
    "op4_line_dedup": lambda spark, folder: line_dedup.op4(documents(spark, folder)),
    "op5_simhash_near_dedup": lambda spark, folder: simhash.op5(documents(spark, folder)),
    "op6_language_id": lambda spark, folder: langid.op6(documents(spark, folder)),
    "op7_pii": lambda spark, folder: pii.op7(documents(spark, folder)),
    "op8_suffix_array_dedup": lambda spark, folder: suffix_dedup.op8(documents(spark, folder)),
    "op9_quality_rules": lambda spark, folder: quality.op9(documents(spark, folder)),
    "op10_lm_scoring": lambda spark, folder: lm.op10(documents(spark, folder)),
    "op11_merkle_manifest": lambda spark, folder: merkle.op11(documents(spark, folder)),
    "op12_phrase_collocations": lambda spark, folder: collocations.op12(documents(spark, folder)),
    "op13_warc_archives": lambda spark, folder: warc.op13(spark.read.parquet(f"{folder}/pages.parquet")),
}
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontamination.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_warc_archives": warc.ORACLE,
}
