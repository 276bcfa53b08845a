"""Ids of public tokenizers. Their files are a parameter and are read where they lie."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level BPE of this family parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_LATIN = "\x1c\x1d\x1e\x1f\x85\xa0"
LONGEST_WORD = 400


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, those that `tokenizers` gives with the file at `path`.

    For a byte-level file whose ids follow its merges, texts of Latin-1 characters are encoded with the same vocabulary by
    `tiktoken`, which is several times faster. Texts where the two could part ways (special tokens, white space that
    engines class differently, other scripts, very long words) go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: One more than the greatest id.
        self.size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.fast = self._same_vocabulary(spec)

    def _same_vocabulary(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain:
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocab) != 256 + len(pairs):
            return None
        import tiktoken

        # the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 onwards
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in shown} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def id_bytes(self, n: int) -> np.ndarray:
        """UTF-8 bytes that each id from 0 to n - 1 stands for."""
        byte_level = self.fast is not None
        out = np.zeros(n, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if i < n:
                out[i] = len(token) if byte_level and token not in self.special else len(token.encode())
        return out

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(t in text for t in self.special) or any(c in text for c in _ODD_LATIN):
            return self._slow(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._slow(text)
        if max(map(len, text.split()), default=0) > LONGEST_WORD:
            return self._slow(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def _read(path: str, size: int, changed: int) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The Encoder of the file at `path`; a worker reads the file once for all its tasks, and again when it has changed."""
    now = os.stat(path)
    return _read(path, now.st_size, now.st_mtime_ns)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
