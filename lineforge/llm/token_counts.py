"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lineforge.llm.arrow import by_bytes
from lineforge.llm.names import narrowed
from lineforge.llm.tokens import BATCH_BYTES, encoder

LIMIT = 512


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_tokens and over_limit in place of their text.

    Batches hold about as many bytes each, however the lengths are spread; texts are cut
    where the tokens on either side can't depend on each other, so long ones are encoded
    in parts. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids
    stay as they are; an empty table gives an empty result. Columns not named in ``keep``
    are left out, and a kept column called like a result loses to the result.
    """
    narrow, kept, body, schema = narrowed(docs, keep, text, "n_bytes long, n_tokens long, over_limit boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, body, BATCH_BYTES):
                texts = part.column(body).fill_null("")
                n = pa.array(tokens.counts(texts.to_pylist()), type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept]
                    + [pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)],
                    names=schema.names,
                )

    return narrow.mapInArrow(count, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
