"""Where the tokenizer vocabulary comes from; its path is a parameter."""

from __future__ import annotations

import public_tokenizers

from windrow.llm.bpe import Vocabulary


def vocabulary(spark, path: str | None = None) -> Vocabulary:
    return Vocabulary(spark, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
