"""Whole-text encoding with public tokenizer files.

The authority is the tokenizers library with its defaults and
``add_special_tokens=False``: a text that spells an added token gets its id.
Byte-pair merging of most texts runs on a faster core, tiktoken's, over the
same file's vocabulary.  That core joins the neighbours whose joined bytes have
the lowest id, the library those whose merge comes first.  Both are the same
wherever every entry of the vocabulary encodes to itself, as then the last merge
within an entry's bytes is always the listed one; ``unreachable`` names entries
for which that fails, and the tests hold it empty.

What else could differ goes to the library itself: texts with an added token,
control and other unprintable characters, letters whose lower case or normal form
isn't plain, and stretches of over ``LONGEST`` characters without a space, for
which the core's time is quadratic.  One text of every run is encoded both ways,
and a difference raises.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a stretch without a space that the fast core still takes.
LONGEST = 1000
#: Texts of a run are encoded together; the first is also held against the library.
RUN = 500
#: Characters up to which that text is compared.
HELD = 20_000

# fixed values: the cutting rules of the two kinds of files
_BYTE_CUT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

# without neighbouring white space, the rule that looks ahead says nothing new
_BYTE_CUT_PLAIN = _BYTE_CUT.replace(r"|\s+(?!\S)", "")
_NOT_LETTERS = regex.compile(r"('(?:[stmd]|re|ve|ll)|\p{N}|[^\s\p{L}\p{N}]+)").split
_NOT_LATIN_LETTERS = re.compile("('(?:[stmd]|re|ve|ll)|[0-9]|[^ a-z0-9ªµºß-öø-ſ]+)").split
_LATIN = re.compile("[ -~À-ÖØ-öø-įı-ſ‘’“”–—…«»¿¡]*+").fullmatch
_SPACES = re.compile(r"\s{%d}" % LONGEST).search


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    Latin-1 for itself, the rest in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # 4 bytes, little-endian on all platforms Spark runs on


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        spec = json.loads(self.library.to_str())
        self.vocabulary = spec["model"]["vocab"]
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.size = max([*self.vocabulary.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self._fast = self._core(spec)

    def _core(self, spec: dict):
        """The fast way for a file's kind, or None for kinds it isn't made for."""
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec["post_processor"]:
            return None
        if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"] and not self.suffix:
            plain, full = self._ranks(_BYTE_CUT_PLAIN), self._ranks(_BYTE_CUT)
            return lambda t: self._bytes(t, plain, full)
        steps, cuts = (spec["normalizer"] or {}).get("normalizers"), cut.get("pretokenizers", [{}, {}])
        if steps == _WORD_STEPS and self.suffix == "</w>" and cuts[0].get("pattern") == {"Regex": _WORD_CUT} and cuts[0].get("invert") and cuts[1].get("type") == "ByteLevel":
            core = self._ranks("[^ ]+ ")  # no piece holds a space, so one stands for the word's end
            return lambda t: self._words(t, core)
        return None

    def _ranks(self, cut: str):
        import tiktoken

        byte, end = _byte_of(), self.suffix
        ranks = {}
        for token, i in self.vocabulary.items():
            last = end and token.endswith(end)
            ranks[bytes(byte[c] for c in (token[: -len(end)] if last else token)) + (b" " if last else b"")] = i
        core = tiktoken.Encoding(f"own-{len(ranks)}-{cut}", pat_str=cut, mergeable_ranks=ranks, special_tokens={})._core_bpe
        nothing: set[str] = set()
        return lambda t: bytes(memoryview(core.encode_to_tiktoken_buffer(t, nothing)).cast("B"))

    def unreachable(self) -> list[str]:
        """Entries that the library doesn't encode to themselves."""
        tokenize = self.library.model.tokenize
        out = []
        for token, i in self.vocabulary.items():
            inner = bool(self.suffix) and not token.endswith(self.suffix)
            word = token if inner or not self.suffix else token[: -len(self.suffix)]
            got = [x.id for x in tokenize(word)]
            # inside a word: the last piece carries the suffix, so a letter follows
            if inner:
                got = [x.id for x in tokenize(word + "Ā")][:-1]
            if got != [i]:
                out.append(token)
        return out

    # the two fast ways; None where the library has to say

    def _bytes(self, t: str, plain, full) -> bytes | None:
        if not t.replace("\n", "").isprintable():
            return None
        if "  " in t or "\n\n" in t or " \n" in t or "\n " in t:
            return None if _long(t) or _SPACES(t) else full(t)
        return None if _long(t) else plain(t)

    def _words(self, t: str, core) -> bytes | None:
        t = t.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not t.isprintable() or _long(t):
            return None
        if t.isascii() or _LATIN(t):
            return core(" ".join(_NOT_LATIN_LETTERS(t.lower())) + " ")
        if "Σ" in t or "İ" in t or not unicodedata.is_normalized("NFC", t):
            return None
        return core(" ".join(_NOT_LETTERS(t.lower())) + " ")

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library."""
        return [_ids(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), RUN):
            run = [t or "" for t in texts[at : at + RUN]]
            found = [self._one(t) for t in run]
            odd = [k for k, ids in enumerate(found) if ids is None]
            for k in odd:  # one at a time: a long text's encoding is freed before the next
                found[k] = self.whole([run[k]])[0]
            if 0 not in odd and len(run[0]) <= HELD and self.whole(run[:1]) != found[:1]:
                raise ValueError(f"the fast core differs from the library for {run[0][:200]!r}")
            out += found
        return out

    def _one(self, t: str) -> bytes | None:
        if not t:
            return b""
        if self._fast is None or any(a in t for a in self.added):
            return None
        return self._fast(t)


def _long(t: str) -> bool:
    """Whether ``t`` has a stretch of over LONGEST characters without a space."""
    at, end = 0, len(t)  # at: just after a space
    while end - at > LONGEST:
        space = max(t.rfind(" ", at, at + LONGEST), t.rfind("\n", at, at + LONGEST))
        if space < 0:
            return True
        at = space + 1
    return False


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a process and file."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
