"""Token counts by a public byte-level tokenizer. Its vocabulary file is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files, unless a path is given.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    try:
        import public_tokenizers

        return str(public_tokenizers.path(VOCABULARY))
    except ImportError:
        return os.path.join(FOLDER, VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer, made once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str) -> int:
    return len(encoder(path).encode_ordinary(text))
