"""Token ids of a public byte-level BPE vocabulary, for whole texts.

The vocabulary file is a parameter and is never copied or trained.  The fast
route hands the same ranks to ``tiktoken``; a text that spells one of the
file's special tokens goes to the ``tokenizers`` library itself, which gives
such a token its own id.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, symbols = spec["model"]["vocab"], _byte_of_symbol()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact = Tokenizer.from_file(path)
        self._exact.no_truncation()
        self._exact.no_padding()
        self.size = max(self._exact.get_vocab_size(with_added_tokens=True), max(ranks.values()) + 1)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in self.special):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One vocabulary per Python worker."""
    return ByteBpe(path)
