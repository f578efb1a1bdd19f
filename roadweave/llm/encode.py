"""Whole-text encoding with a public tokenizer, one word at a time.

A text is cut where the tokenizer cuts it for certain, each piece is encoded
once per worker and its ids are remembered; the ids of the text are the pieces'
ids in order. Words are drawn from a long-tailed distribution, so that most
pieces are found in memory. The ids equal those of encoding the text whole.

``byte``: byte-level BPE that keeps white space. It always cuts before a space
between two visible characters, and around a line break between two of them.
``word``: BPE over words, white space dropped. It always cuts at ASCII white space.

The string of a special token in a text becomes that token's id, as it does in the
tokenizers library by default; with ``special=False`` it is ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of pieces, their ids and the dictionary's own that a worker remembers in each of
#: two generations; the older one goes when the newer is full. Tails and folded words have a quarter each.
REMEMBERED, ENTRY_BYTES = 112 << 20, 210
#: Words of letters only that are encoded in one call and split by their word marks.
JOINED = 256
_DOUBLE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_TAIL = ".,;:!?"

_encoders: dict[tuple[str, str, bool], PieceEncoder] = {}


class _Recent:
    """A dictionary of bounded size that keeps what is used."""

    def __init__(self, most: int):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most // ENTRY_BYTES

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that aren't held; the others are held in ``new`` afterwards."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        out, new, old = [], self.new, self.old
        for key in [k for k in keys if k not in new]:
            if (value := old.get(key)) is None:
                out.append(key)
            else:
                new[key] = value
        return out


class PieceEncoder:
    def __init__(self, path: str, kind: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        strings = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        #: Texts with the string of an added token are encoded whole.
        self.whole = re.compile("|".join(strings)) if strings else None
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.kind = kind
        self.spaced, self.bare, self.lowered = _Recent(REMEMBERED), _Recent(REMEMBERED // 4), _Recent(REMEMBERED // 4)
        marks = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            marks[i] = token.startswith("Ġ") if kind == "byte" else token.endswith("</w>")
        self.marks = marks

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of words of letters only, many in a call."""
        if self.kind == "byte" and not spaced:
            return self._ids(words)
        chunks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        lead = " " if self.kind == "byte" else ""
        out: list[bytes] = []
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([lead + " ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.marks[ids])
            if len(at) != len(chunk):
                out += self._ids([lead + w for w in chunk])
                continue
            cuts = np.append(at, len(ids)) if lead else np.append(0, at + 1)
            raw, width = ids.tobytes(), self.dtype.itemsize
            out += [raw[a * width : b * width] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out

    def _fill(self, held: _Recent, words: set[str], spaced: bool) -> dict[str, bytes]:
        """Ids of every word; ``spaced`` words follow a space."""
        new = held.new if len(held.new) <= held.most else {}
        missing = held.missing(words)
        new = held.new
        split: dict[str, tuple[str, str]] = {}
        whole: list[str] = []
        for word in missing:
            root = word.rstrip(_TAIL)
            if root and root.isalpha() and root.lower().isalpha():
                split[word] = (root, word[len(root) :])
            else:
                whole.append(word)
        if whole:
            lead = " " if spaced and self.kind == "byte" else ""
            new.update(zip(whole, self._ids([lead + w for w in whole]), strict=True))
        if split:
            fold = (lambda r: r.lower() if r.isascii() else r) if self.kind == "word" else (lambda r: r)
            roots = {fold(r) for r, _ in split.values()}
            known = self.lowered if self.kind == "word" else held
            lacking = known.missing(roots)
            known.new.update(zip(lacking, self._letters(lacking, spaced), strict=True))
            tails = {t for _, t in split.values() if t}
            bare = self.bare
            unknown = bare.missing(tails)
            bare.new.update(zip(unknown, self._ids(unknown), strict=True))
            for word, (root, tail) in split.items():
                new[word] = known.new[fold(root)] + bare.new[tail] if tail else known.new[fold(root)]
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        run = self._words if self.kind == "word" else self._bytes
        odd = [k for k, t in enumerate(texts) if self.whole.search(t)] if self.whole else []
        if not odd:
            return run(texts)
        out, apart = [b""] * len(texts), set(odd)
        rest = [k for k in range(len(texts)) if k not in apart]
        for at, found in ((odd, self._ids([texts[k] for k in odd])), (rest, run([texts[k] for k in rest]))):
            for k, raw in zip(at, found, strict=True):
                out[k] = raw
        return out

    def _words(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        ids = self._fill(self.spaced, set().union(*parts), False)
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        lines: list[list[list[str]]] = []
        first: set[str] = set()
        later: set[str] = set()
        for text in texts:
            own = [_SAFE.split(text)] if _DOUBLE.search(text) else [line.split(" ") for line in text.split("\n")]
            for words in own:
                first.add(words[0])
                later.update(words[1:])
            lines.append(own)
        first.add("\n")
        bare = self._fill(self.bare, first, False)
        bare[""] = b""
        spaced = self._fill(self.spaced, later, True)
        out, after = [], spaced.__getitem__
        for own in lines:
            done = []
            for words in own:
                done.append(bare[words[0]] + b"".join(map(after, words[1:])))
            out.append(bare["\n"].join(done))
        return out


def encoder(path: str, kind: str, special: bool = True) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if (path, kind, special) not in _encoders:
        _encoders[path, kind, special] = PieceEncoder(path, kind, special)
    return _encoders[path, kind, special]
