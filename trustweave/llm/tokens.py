"""Token ids of whole texts, for byte-level BPE tokenizers in the ``tokenizers`` JSON format.

Texts are cut at single spaces into units whose ids don't depend on what stands around them: a unit begins with its
space and ends in a character that is no white space. Equal units of a batch are encoded once, and frequent ones stay
in a bounded cache, so that the merges run over new words only. Texts with runs of white space that such cuts would
split go to the tokenizer as they are. The ids are those that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenizer pattern of byte-level BPE. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, if this is a plain byte-level BPE whose ids ascend in the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    if not plain:
        return None
    byte = _byte_of()
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    at = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in at or any(a >= b for a, b in zip(at, at[1:])):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}


class Encoder:
    def __init__(self, path: str, cached: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        #: The empty word stands for a run of spaces; texts with those go another way.
        self.cache = {"": b""}
        ranks = _ranks(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.widths[i] = len(token)
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def units(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it: one run over all of them, cut where the bytes of each end."""
        ids = np.array(self.fast("".join([" " + w for w in words])), np.uint32)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 if w else 1 for w in words), np.int64, len(words)))
        at = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
        return [ids[a:b].tobytes() for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)] if words else []

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers; nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.fast is None:
            return [np.array(self.whole(t), np.uint32) for t in texts.to_pylist()]
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        spaced = pc.not_equal(pc.utf8_rtrim_whitespace(coded.dictionary), coded.dictionary).to_numpy(zero_copy_only=False)
        odd = (empty | spaced)[code]
        odd[ends - 1] = empty[code[ends - 1]]
        odd[starts] = spaced[code[starts]] & (ends - starts > 1)
        slow = np.logical_or.reduceat(odd, starts) if len(starts) else np.zeros(0, bool)
        for s in self.special:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        found = list(map(self.cache.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self.units([words[k] for k in new]), strict=True):
            found[k] = ids
            if len(self.cache) < self.cached and len(ids) < 48:
                self.cache[words[k]] = ids
        first = {}
        for c in set(code[starts].tolist()):
            first[c] = len(found)
            found.append(np.array(self.fast(words[c]), np.uint32).tobytes())
        code[starts] = np.fromiter((first[c] for c in code[starts].tolist()), np.int64, len(starts))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begins = np.cumsum(lengths) - lengths
        n = lengths[code]
        stops = np.cumsum(n)
        ids = flat[np.repeat(begins[code] - (stops - n), n) + np.arange(int(stops[-1]) if len(stops) else 0)]
        upto = np.concatenate([[0], stops])
        bounds = upto[ends].tolist()
        made = [ids[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)] if bounds else []
        for i in np.flatnonzero(slow).tolist():
            made[i] = np.array(self.whole(texts[i].as_py()), np.uint32)
        return made


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
