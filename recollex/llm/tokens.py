"""Token counts with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZER_DIR = os.environ.get("RECOLLEX_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
