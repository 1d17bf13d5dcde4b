"""A training-data pipeline of five stages, each one operator of loomgrid.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet below ``spark.checkpoint.dir`` and read again, so
no stage is recomputed when executors are lost. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.bpe import stage_encode
from loomgrid.llm.common import shared_folder
from loomgrid.llm.cube_mixing import stage_mix
from loomgrid.llm.exact_dedup import stage_exact_dedup
from loomgrid.llm.language_id import stage_language
from loomgrid.llm.simhash import stage_near_dedup

STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_near_dedup),
    ("cube_mixing", stage_mix),
    ("bpe_encode", stage_encode),
]

#: Language model, fingerprints, balanced sampling and BPE have no SQL form;
#: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    at = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{n}_{name}")
            docs = spark.read.parquet(f"{at}/{n}_{name}")
    return docs
