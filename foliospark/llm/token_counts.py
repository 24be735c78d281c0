"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm import bpe
from foliospark.llm.common import map_batches, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: UTF-8 bytes, tokens, and whether these exceed ``limit``.

    tokenizer: file name of a BPE vocabulary with word ends. Counts equal the
    library's: initial symbols of each word less the merges done. A null or
    empty text has 0 tokens; rows that repeat are counted each; null ids stay.
    No shuffle: each row is counted where it is read.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = bpe.token_counter(bpe.tokenizer_path(tokenizer))
        texts = batch.column(1).to_pylist()
        tokens = [int(x.sum()) for x in counter.of(texts)]
        sizes = [len(t.encode("utf-8")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(texts_of(docs, id_col, text_col), count, SCHEMA, keeps=bpe.OWNER)
