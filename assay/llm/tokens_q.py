"""Token encoding and counting over all documents."""

from __future__ import annotations

import public_tokenizers

from assay.llm import byte_bpe, token_counts
from assay.llm.registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), TOKEN_LIMIT)
