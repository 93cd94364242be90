"""Token ids of a public byte-level vocabulary, inside tasks.

The ids are those of the `tokenizers` file; its rank table, read by `tiktoken`, gives the
same ids about four times faster and is used for every text that holds no special token and
no very long run of blanks, on which its pattern would run out of stack.
The files' places are parameters; nothing is copied into the repository.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

SPECIAL = "<|endoftext|>"
#: Blanks from which a run is very long; about a tenth of what the fast pattern bears.
LONG_RUN = 10_000
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


@cache
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _plain(name: str, ordinary: bool = False):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = ordinary
    return plain


def encode(text: str, vocabulary: str = "byte_bpe_50k", ordinary: bool = False) -> np.ndarray:
    """Ids as unsigned 32-bit numbers; a special token in the text is one id, unless all text is ordinary."""
    if SPECIAL in text and not ordinary or len(text) >= LONG_RUN and _BLANKS.search(text):
        return np.array(_plain(f"{vocabulary}.json", ordinary).encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(_fast(f"{vocabulary}.tiktoken").encode_ordinary(text), "<u4")
