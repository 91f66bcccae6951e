"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabularies cut a text before merging (fixed value of these vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The vocabulary for many languages among the public ones: /opt/tokenizers, or the installed package of the same files."""
    name = "byte_bpe_multi_50k.tiktoken"
    place = Path("/opt/tokenizers") / name
    if not place.exists() and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        place = Path(spec.origin).parent / name
    return str(place)


@cache
def encoding(vocabulary: str):
    """Loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, vocabulary: str, piece: int = 1 << 16) -> int:
    """Tokens of a text. Beyond `piece` characters it is encoded in parts cut before a space that follows a letter
    or digit, where the pattern always cuts, so the sum is exact and memory bounded unless no such place comes."""
    if not text:
        return 0
    encode = encoding(vocabulary).encode_ordinary
    if len(text) <= piece:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            while True:
                end = text.find(" ", end)
                if end < 0:
                    end = len(text)
                    break
                if text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum():
                    break
                end += 1
        total += len(encode(text[at:end]))
        at = end
    return total


def _count_batches(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(t, vocabulary) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return run


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The kept columns and `tokens`; a null or empty text has none."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(_count_batches(vocabulary or default_vocabulary()), schema)
