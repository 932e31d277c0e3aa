"""Personal data of all documents."""

from __future__ import annotations

from assay.llm import personal
from assay.llm.registry import query, table


@query("op13_personal_data")
def op13_personal_data(spark, sf_dir):
    return personal.personal(table(spark, sf_dir, "documents"))
