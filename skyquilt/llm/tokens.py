"""Byte-level BPE ids of whole texts, for a vocabulary file of the `tokenizers` library.

`library(path)` is that library's own tokenizer. It encodes about 2 MB of this corpus a second and core, so
`Encoder` reads vocabulary and merges through it once and runs them in tiktoken's merge loop, five times as fast;
for a byte-level BPE whose merges are in id order both give the same ids (`tests/llm/test_tokens_packing_pfor.py` compares
them on whole tables and on random strings). The library itself encodes texts with the string of an added token in them,
texts that tiktoken gives up on (runs of a million white spaces), and for any other tokenizer file all texts.
"""

from __future__ import annotations

import json

import numpy as np

_encoders: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library(path: str):
    """The `tokenizers` library's tokenizer as the file has it, but for truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        self.path, self.fast, self.slow = path, None, None
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type", "BPE") == "BPE" and byte_level and not spec.get("normalizer") and not model.get("dropout"):
            special = {t["content"] for t in spec.get("added_tokens") or ()}
            self.added = tuple(special)
            of = _byte_of()
            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
            made = [model["vocab"]["".join(p)] for p in pairs]
            if made == sorted(made) and {bytes([b]) for b in range(256)} <= ranks.keys():
                import public_tokenizers
                import tiktoken

                self.fast = tiktoken.Encoding("of-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library_ids(self, text: str) -> np.ndarray:
        if not self.slow:
            self.slow = library(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian uint32 ids of the whole text; null counts as empty."""
        if not text:
            return np.empty(0, "<u4")
        if self.fast and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its regular expression has run out of stack
                pass
        return self._library_ids(text)


def encoder(path: str) -> Encoder:
    """The process's encoder of this file, made once and used for all batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def sentence_ends(path: str) -> np.ndarray:
    """For each id whether a sentence may end after it: its text ends in a line feed or a closing mark."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 2, bool)
    for text, i in vocab.items():
        ends[i] = text.endswith("Ċ") or text.rstrip("\"')]")[-1:] in (".", "!", "?")
    return ends
