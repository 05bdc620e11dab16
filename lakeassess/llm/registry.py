"""Registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .bpe import op2_byte_bpe
from .conversations import op11_conversations
from .elias_fano import op7_token_files
from .embeddings import op13_embeddings
from .fingerprints import op1_fingerprints
from .packing import op6_packing
from .quality import op10_quality
from .secret_scan import op4_secrets
from .simhash import op5_simhash
from .store import ship
from .substrings import op9_substrings
from .toxicity import op8_toxicity
from .warc import op3_warc


def _query(run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {run.__name__: _query(run) for run in (
        op1_fingerprints, op2_byte_bpe, op3_warc, op4_secrets, op5_simhash, op6_packing, op7_token_files, op8_toxicity, op9_substrings, op10_quality, op11_conversations, op12_alignment, op13_embeddings)}
SQL: dict[str, str] = {}
