"""Byte-level BPE ids of whole texts as the ``tokenizers`` library gives them.

The library alone needs about twice the CPU time that token files may take.
Where a vocabulary file's ids are in the order of its merges, the same merges
can be done by ``tiktoken`` with ranks read from that file: both join the pair
of the earliest merge first.  ``ByteBpe`` checks this when it loads the file
and encodes such texts that way; all others are encoded by the library:
those with a special token's string, and those with characters from U+0500 on,
whose classes, and so the words, depend on the Unicode version of either.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

_LATER = re.compile("[^\x00-ӿ]")
#: The settings under which words are cut by ``public_tokenizers.PATTERN`` alone.
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class ByteBpe:
    """Encoder of one worker; ``special_as_text``: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = special_as_text
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special = None if special_as_text or not added else re.compile("|".join(map(re.escape, added)))
        back = {c: b for b, c in enumerate(_byte_chars())}
        #: The bytes of every id: its entry, byte-level decoded; special tokens' strings as they are.
        self.token_bytes = [b""] * (max([*spec["model"]["vocab"].values(), *added.values()]) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self._fast = _by_ranks(spec, self.token_bytes, set(added.values()))
        #: Ids as bytes take two bytes each where they fit.
        self.dtype = np.dtype("<u2") if len(self.token_bytes) <= 1 << 16 else np.dtype("<u4")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of every text, serialised as little-endian ``dtype`` values."""
        out: list[bytes] = [b""] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self._fast is None or _LATER.search(text) or (self._special and self._special.search(text)):
                slow.append(k)
            else:
                out[k] = self._fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()
        done = self._library.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)
        for k, e in zip(slow, done, strict=True):
            out[k] = np.array(e.ids, self.dtype).tobytes()
        return out


def _by_ranks(spec: dict, token_bytes: list[bytes], special: set[int]) -> tiktoken.Encoding | None:
    """The same merges by rank, if the ids of the file follow the order of its merges; else None."""
    model = spec["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    plain = spec["pre_tokenizer"] == _PLAIN and spec["normalizer"] is None and not model.get("ignore_merges")
    plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    ordered = all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges))
    whole = len(set(vocab.values()) - special) == 256 + len(merges) and all(vocab.get(c, 256) < 256 for c in _byte_chars())
    if not (plain and ordered and whole):
        return None
    ranks = {token_bytes[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("ranks of a vocabulary file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
