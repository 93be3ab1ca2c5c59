"""Token ids of whole texts with the tokenizers library, each distinct chunk encoded once a worker.

Both supported pre-tokenizers always cut before a space that a non-space
follows, so the ids of a text are the ids of its chunks behind each other.  A
worker keeps the ids of the chunks it has met; a chunk it hasn't met goes to
the library.  Texts that hold an added token or a NUL, and tokenizers of other
kinds, are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

#: Chunks whose ids a worker keeps, for each of two generations, by mode. Results don't depend on it.
KEEP = {"spaced": 1_200_000, "bare": 600_000}
_LONGEST = 64
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]+)")
_SPACE = re.compile(r"\s")
#: The normaliser and the split for which a text's ids are known to follow from those of its chunks; files with others are encoded whole.
_BARE_NORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BARE_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        with open(path) as f:
            spec = json.load(f)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.mode = "whole"
        names = [x["type"] for x in pre.get("pretokenizers", [pre])]
        if names == ["ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.mode = "spaced"  # a chunk's first id holds the space before it
        elif names == ["Split", "ByteLevel"] and pre["pretokenizers"][0] == _BARE_SPLIT and norm == _BARE_NORM and spec["model"].get("end_of_word_suffix"):
            self.mode = "bare"  # spaces vanish; each word's last id holds the word's end
        vocab = self.lib.get_vocab()
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, k in vocab.items():
            self.edge[k] = token.startswith("Ġ") if self.mode == "spaced" else token.endswith("</w>")
        self.ends: dict[str, bool] = {}
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that hold no space, encoded as one text and cut again at word edges."""
        if not chunks:
            return []
        lead = " " if self.mode == "spaced" else ""
        ids = np.array(self.lib.encode_batch_fast([lead + " ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(chunks):
            return self._whole([lead + c for c in chunks])
        at = [*at.tolist(), len(ids)] if self.mode == "spaced" else [0, *(at + 1).tolist()]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]

    def _ends_word(self, letter: str) -> bool:
        """Whether the library cuts between this letter and a sign; the normaliser may turn a letter into one with a mark, which joins the signs."""
        have = self.ends.get(letter)
        if have is None:
            text = f"a{letter}!"
            if self.lib.normalizer is not None:
                text = self.lib.normalizer.normalize_str(text)
            have = self.ends[letter] = self.lib.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "!"
        return have

    def _atoms(self, c: str) -> list[str]:
        """Parts of a chunk whose ids, behind each other, are its ids: a word, the signs after it, a line break.

        Where spaces count, a chunk that none precedes carries a NUL in front.
        """
        bare = self.mode == "bare"
        lead = "\0" if not bare and c[:1] == "\0" else ""
        body = c[len(lead) :]
        if not bare and body.count("\n") == 1:
            a, b = body.split("\n")
            if a and b and not _SPACE.search(a) and not _SPACE.search(b):
                return [*self._atoms(lead + a), "\0\n", *self._atoms("\0" + b)]
        m = _WORD_AND_SIGNS.fullmatch(body)
        if m and m[1].isalpha() and self._ends_word(m[1][-1]):
            return [lead + m[1], m[2] if bare else "\0" + m[2]]
        return [c]

    def _learn(self, need: set[str]) -> None:
        """Put the ids of all chunks in need into now."""
        now, old = self.now, self.old
        fresh = []
        for c in need:
            if (have := old.get(c)) is not None:
                now[c] = have
            else:
                fresh.append(c)
        made = {c: self._atoms(c) for c in fresh if not c.isalpha()}
        atoms = {a for parts in made.values() for a in parts}
        atoms.update(c for c in fresh if c.isalpha())
        atoms = [a for a in atoms if a not in now]
        spaced, tokenize = self.mode == "spaced", self.lib.model.tokenize
        words, odd = [], []
        for a in atoms:
            bare = a[1:] if spaced and a[:1] == "\0" else a
            if bare.isascii() and bare.isalpha():  # one word: the model alone, past normaliser and pre-tokenizer
                now[a] = np.array([t.id for t in tokenize((bare if a is not bare else f"Ġ{a}") if spaced else a.lower())], "<u4").tobytes()
            elif bare is a and a.isalpha():
                words.append(a)
            else:
                odd.append(a)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            now.update(zip(part, self._joined(part), strict=True))
        texts = [c[1:] if c[:1] == "\0" else f" {c}" for c in odd] if spaced else odd
        now.update(zip(odd, self._whole(texts), strict=True))
        for c, parts in made.items():
            if len(parts) > 1:
                now[c] = b"".join([now[a] for a in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self._whole(texts)
        out: list = [None] * len(texts)
        whole = [k for k, t in enumerate(texts) if "\0" in t or (self.added and "<" in t and self.added.search(t))]
        for k, x in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = x
        parts = []
        for k, t in enumerate(texts):
            if out[k] is not None:
                continue
            if self.mode == "bare":
                t = t.replace("\n", " ")
                try:
                    t.encode("latin-1")  # here lower case is what the normaliser makes of a letter
                    t = t.lower()
                except UnicodeEncodeError:
                    pass
                c = t.split(" ")
            elif not _ODD.search(t):
                c = t.split(" ")
            else:
                c = _CUT.split(t)
            if self.mode == "spaced":
                c[0] = "\0" + c[0]
            parts.append((k, c))
        if len(self.now) > KEEP[self.mode]:
            self.old, self.now = self.now, {}
        now, need, long = self.now, set(), {}
        for _, c in parts:
            need.update(c)
        need -= now.keys()
        big = [c for c in need if len(c) > _LONGEST]
        if big:
            need.difference_update(big)
            lead = self.mode == "spaced"
            long = dict(zip(big, self._whole([c[1:] if lead and c[0] == "\0" else " " + c if lead else c for c in big]), strict=True))
        self._learn(need)
        for k, c in parts:
            out[k] = b"".join([now[x] if x in now else long[x] for x in c]) if long else b"".join([now[x] for x in c])
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; its chunks outlive a task."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def slices(texts: list[str], most: int = 1 << 21):
    """Ranges of texts that hold about `most` characters, so that memory stays bounded."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
