"""Repair of all conversations."""

from __future__ import annotations

from assay.llm import conversations
from assay.llm.registry import query, table


@query("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    return conversations.repaired(table(spark, sf_dir, "conversations"))
