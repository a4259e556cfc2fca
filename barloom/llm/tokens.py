"""Token ids of whole texts by a public byte-level vocabulary, inside tasks."""
from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids as ``tokenizers`` gives them for ``<name>.json`` without special tokens added.

    ``tiktoken`` reads the same vocabulary as ranks, gives the same ids (see the tests) and is some four times faster;
    a text that its pattern engine refuses goes to ``tokenizers``.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.json, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        size = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for piece, k in [*ranks.items(), *((s.encode(), k) for s, k in special.items())]:
            size[k] = len(piece)
        self.n_bytes = size

    @property
    def slow(self):
        return _slow(self.json)

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # the engine's own panics are BaseExceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(name)


@lru_cache(maxsize=4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
