"""All queries of this subpackage, and the pipeline over them."""

from importlib import import_module

from assay.llm.registry import ORACLES, QUERIES

MODULES = ["benchmark_q", "repeats_q", "dedup_q", "toxicity_q", "language_q", "pages_q", "tokens_q", "phrases_q", "conversations_q", "personal_q"]


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"assay.llm.{name}")
    pipeline = import_module("corpus_pipeline")
    sql = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": pipeline.run}, {**ORACLES, **sql}
