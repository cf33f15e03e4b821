"""Loads every module that registers queries."""

import importlib

from .registry import ORACLES, QUERIES

for _name in ("mixing", "bpe", "cotraining", "quality_rules", "metric_tree", "line_dedup", "ngram_join", "suffix_dedup", "secret_ledger", "sharding", "fill_middle", "periodic_runs", "warc"):
    importlib.import_module(f"heldout.llm.{_name}")

corpus_pipeline = importlib.import_module("corpus_pipeline")
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
