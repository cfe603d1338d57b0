"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of a byte-level BPE for many languages; every executor needs it under this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that this tokenizer splits text by before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_open: dict = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file; loaded once a process."""
    if vocabulary not in _open:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _open[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[vocabulary]


def token_counts(docs: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns and n_tokens of every document; the text itself stays behind. Null text has null tokens, empty text 0."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(text).alias("t"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([None if x is None else len(count(x)) for x in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], sizes], names=[*names, "n_tokens"])

    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "n_tokens")
