"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is the one of the ``tokenizers`` library. If its merges come in
the order of their ids (checked), the same vocabulary is given to ``tiktoken``, which
yields the same ids several times faster. Texts that hold a special token's string go
through ``tokenizers`` itself, which gives that token's id for it, and so do texts with
very long runs of white space.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

# The split pattern of byte-level BPE vocabularies of this kind (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others
    as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def rank_encoder(path: str):
    """The vocabulary as ranks, or None if its merges are in another order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(p)] for p in pairs]
    letters = byte_of_letter()
    single = [i for t, i in model["vocab"].items() if len(t) == 1 and t in letters]
    if made != sorted(made) or len(set(made)) != len(made) or max(single) >= made[0]:
        return None
    kept = {*made, *single}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i in kept}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


# The pattern's look-ahead backtracks over a run of white space, and the fast path's
# stack ends at somewhat below a million of it. Texts with such a run go the other way.
LONG_BLANK = re.compile(r"\s{50000}")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = rank_encoder(path)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers; none for null."""
        if not text:
            ids = []
        elif self.ranks is None or any(s in text for s in self.special) or LONG_BLANK.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
