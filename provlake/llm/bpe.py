"""Exact byte-level BPE ids by the tokenizers library, encoding each distinct piece of text once.

The library cuts a text into pre-tokens before it merges. `PIECE` cuts at a subset of those places, so the ids of a
text are the ids of its pieces, joined. That holds for the characters up to U+024F (tests/llm/test_tokens.py tries
each of them); a text with any other character, or with the special string, goes to the library whole.

`Ranked` gives the same ids by byte-pair ranks and keeps nothing from text to text. Merging the pair of the least rank
is what the library does if the vocabulary numbers its strings in the order of its merges and every string, merged
alone, comes to exactly its own token: both are proven for the vocabulary at hand before ranks are used.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = r"\t-\r \x85\xa0"
PIECE = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[^\W_]+| ?[^\w{
        _SPACE
    }_]+(?:_+[^\w{_SPACE}]*)*| ?_[^{_SPACE}0-9A-Za-zª-ɏ]*|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OUTSIDE = re.compile("[^\x00-ɏ‐-‧]")
_CACHE: dict[tuple[str, bool], "Pieces"] = {}
_RANKED: dict[str, "Ranked"] = {}
# Fixed value: how byte-level BPE of this kind cuts a text before it merges.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept by a worker beside the proven whole tokens; beyond it the memory starts anew.
KEPT = 900_000


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary spells each byte, inverted."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """The ids (little-endian unsigned 32-bit, as bytes) or the number of ids of each piece."""

    def __init__(self, path: str, as_bytes: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_bytes = as_bytes
        self.proven = self._prove()
        self.known = dict(self.proven)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _value(self, ids: list[int]):
        return np.array(ids, "<u4").tobytes() if self.as_bytes else len(ids)

    def _values(self, pieces: list[str]) -> list:
        """Many pieces in one call: the special string stands between them, which the library always cuts at."""
        if not self.special:
            return list(map(self._value, self._ids(pieces)))
        mark = self.tokenizer.token_to_id(self.special[0])
        ids = np.array(self._ids([self.special[0].join(pieces)])[0], "<u4")
        ends = np.append(np.flatnonzero(ids == mark), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        if not self.as_bytes:
            return (ends - starts).tolist()
        held = ids.tobytes()
        return [held[x:y] for x, y in zip((starts * 4).tolist(), (ends * 4).tolist())]

    def _prove(self) -> dict:
        """Vocabulary strings that are one piece and that the library encodes alone as exactly their one token."""
        letters, strings = _byte_letters(), []
        for spelled, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(x in letters for x in spelled):
                try:
                    text = bytes(letters[x] for x in spelled).decode()
                except UnicodeDecodeError:
                    continue
                if not _OUTSIDE.search(text) and (m := PIECE.match(text)) and m.end() == len(text):
                    strings.append((text, i))
        return {t: self._value(ids) for (t, i), ids in zip(strings, self._ids([t for t, _ in strings])) if ids == [i]}

    def whole(self, text: str) -> bool:
        return _OUTSIDE.search(text) is not None or any(s in text for s in self.special)

    def batch(self, texts: list[str]) -> list:
        """For each text the ids or their number. Proven whole tokens and known pieces are looked up; only the rest is merged."""
        cut = [None if self.whole(t) else PIECE.findall(t) for t in texts]
        if len(self.known) > KEPT + len(self.proven):
            self.known = dict(self.proven)
        known = self.known
        fresh = [p for p in set().union(*filter(None, cut)) if p not in known]
        for k in range(0, len(fresh), 5_000):
            part = fresh[k : k + 5_000]
            known.update(zip(part, self._values(part)))
        out = []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self._value(self._ids([text])[0]))
            elif self.as_bytes:
                out.append(b"".join(map(known.__getitem__, pieces)))
            else:
                out.append(sum(map(known.__getitem__, pieces)))
        return out


class Ranked:
    """The ids of whole texts (little-endian unsigned 32-bit, as bytes)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._prove()

    def _prove(self):
        """An encoder by ranks, or None where it is not proven to agree with the library."""
        import tiktoken

        made = json.loads(self.tokenizer.to_str(pretty=False))
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] is not None or cut.get("type") != "ByteLevel" or cut.get(
            "add_prefix_space"
        ) or not cut.get("use_regex", True):
            return None
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        letters, vocab = _byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        special = set(self.special)
        strings = {s: i for s, i in vocab.items() if s not in special}
        merged = [strings.get(x.replace(" ", "") if isinstance(x, str) else "".join(x), -1) for x in model["merges"]]
        alone = {i for s, i in strings.items() if len(s) == 1}
        if not all(x in letters for s in strings for x in s) or len(alone) != len(letters):
            return None
        if [max(alone), *merged] != sorted({max(alone), *merged}) or len(alone) + len(merged) != len(strings):
            return None
        if any([t.id for t in self.tokenizer.model.tokenize(s)] != [i] for s, i in strings.items()):
            return None
        return tiktoken.Encoding(
            "ranked",
            pat_str=PRE_TOKEN,
            mergeable_ranks={bytes(letters[x] for x in s): i for s, i in strings.items()},
            special_tokens={},
        )

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.ranks is None or _OUTSIDE.search(text) or any(s in text for s in self.special):
            return self._library(text)
        try:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # white space by the million is too much for its pattern
            return self._library(text)


def _path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(name: str, as_bytes: bool) -> Pieces:
    """One for each worker process. name: a file of the public tokenizers, or a path."""
    if (key := (name, as_bytes)) not in _CACHE:
        _CACHE[key] = Pieces(_path(name), as_bytes)
    return _CACHE[key]


def ranked(name: str) -> Ranked:
    """One for each worker process. name: a file of the public tokenizers, or a path."""
    if name not in _RANKED:
        _RANKED[name] = Ranked(_path(name))
    return _RANKED[name]
