"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import shipped

#: The rank file of a byte-level BPE; a parameter wherever it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this tokenizer's merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the text replaced by its number of tokens; null texts have none.

    The rank file is read on the driver (about 1 MB, whatever the data) and sent
    to the workers."""
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = shipped(docs.sparkSession, ranks)
    kept = [c for c in docs.columns if c != text]

    def run(batches):
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=held(), special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], names=[*kept, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col(text)).mapInArrow(run, f"{kinds}, {name} BIGINT")
