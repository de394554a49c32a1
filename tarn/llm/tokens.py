"""Token counts of whole texts with a public byte-level BPE vocabulary.

The pre-tokeniser never joins characters across the start of a blank-led word or
a run of white space, so a text's count is the sum over such chunks.  Chunks
repeat heavily in real text; their counts are cached per worker (up to a bounded
number of entries) and only new chunks reach the tokeniser.  The result equals
encoding the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: white space as the vocabulary's pattern understands it (fixed values)
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: entries of a worker's cache, and the longest chunk kept in it
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The tokeniser of a ``.tiktoken`` rank file; by default the installed public one."""
    import public_tokenizers
    import tiktoken

    file = Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read_bytes().splitlines())}
    return tiktoken.Encoding(file.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts(dict):
    """Chunk to token count, filled on demand and bounded."""

    def __init__(self, path: str | None) -> None:
        super().__init__()
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(chunk))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str | None) -> _Counts:
    return _Counts(path)


def count_tokens(text: str | None, path: str | None = None) -> int:
    """Tokens of the whole text; null and empty texts have none; lone surrogates count as their replacement."""
    if not text:
        return 0
    counts = _counts(path)
    try:
        return sum(map(counts.__getitem__, _CHUNKS.findall(text)))
    except UnicodeEncodeError:
        return count_tokens(text.encode("utf-8", "replace").decode(), path)


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the token count of ``text`` as ``out`` (int), keeping the columns ``keep`` (default all but the text)."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([count_tokens(t, tokenizer) for t in b], dtype="int32")

    kept = [c for c in df.columns if c != text] if keep is None else keep
    return df.select(*[F.col(f"`{c}`") for c in kept], count(F.col(f"`{text}`")).alias(out))


__all__ = ["count_tokens", "encoding", "with_token_counts"]
