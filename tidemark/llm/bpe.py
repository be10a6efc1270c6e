"""Byte-level BPE by pieces: pre-token splitting, ids of distinct pieces, and token counts at every prefix.

The tokenizers library encodes a text piece by piece: special strings first, then pre-tokens, then merges inside
each. So ids and counts of a text follow from those of its distinct pieces, which are kept for each Python worker.
Parts whose characters are all known to ``PATTERN`` are split with it, as it agrees there with the library's
pre-tokenizer; all other parts are split by that pre-tokenizer itself, long ones between words. What is done with the
pieces is the same. Only files whose pre-tokenizer is no byte-level one are left to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain, islice

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores

#: Letters, and other characters that are neither letters, numbers nor white space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я一-龥ぁ-ゖァ-ヺ가-힣"
SIGNS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€"
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+")
NOT_PLAIN = re.compile(f"[^{LETTERS}{SIGNS}0-9 \\t\\n\\r]")
#: The white space of the library's patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a long text may be cut without cutting a piece: before a blank with other characters at both sides.
BETWEEN = re.compile(f"(?<=[^{WHITE}\x1c-\x1f]) (?=[^{WHITE}\x1c-\x1f])")
#: Characters that the library's pre-tokenizer gets at a time, about.
LENGTH = 100_000
#: Pieces kept for each worker; the store is emptied when it is full.
KEPT = 400_000
#: Pieces of a long text that are held at a time.
STRIDE = 200_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of this kind: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Pieces:
    """A tokenizer file, read once for each worker."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        plain = all(not (t.single_word or t.lstrip or t.rstrip) for t in added.values())
        split = self.whole.pre_tokenizer
        self.splits = plain and self.whole.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.width, self.code = ("<u2", "H") if self.whole.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.ids: dict[str, bytes] = {}
        self.counts: dict[str, tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}
        self.model, self.vocabulary = self.whole.model, set(self.whole.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.vocabulary), default=1)
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.table = str.maketrans(self.letters)
        self.fits: dict[tuple[str, str], bool] = {}

    def parts(self, text: str):
        """The special strings and what lies between, in order: (is special, part)."""
        if self.cut is None or not any(m in text for m in self.special):
            yield False, text
            return
        for k, part in enumerate(self.cut.split(text)):
            if part:
                yield k % 2 == 1, part

    def pieces(self, part: str):
        """Lists of the part's pieces, in order."""
        if NOT_PLAIN.search(part) is not None:
            for some in self._between(part):
                yield [some[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(some)]
        elif len(part) <= 4 * STRIDE:
            yield PATTERN.findall(part)
        else:
            found = PATTERN.finditer(part)
            while some := [m.group() for m in islice(found, STRIDE)]:
                yield some

    @staticmethod
    def _between(part: str):
        """The part in lengths of about ``LENGTH`` that end between words."""
        at = 0
        while len(part) - at > LENGTH and (cut := BETWEEN.search(part, at + LENGTH)):
            yield part[at : cut.start()]
            at = cut.start()
        yield part[at:]

    # ids

    def _learn(self, pieces: list[str]) -> None:
        new = list({p for p in pieces if p not in self.ids})
        if len(self.ids) + len(new) > KEPT:
            self.ids.clear()
            new = list(set(pieces))
        for p in new:
            found = self.model.tokenize(p.encode().decode("latin-1").translate(self.table))
            self.ids[p] = struct.pack(f"<{len(found)}{self.code}", *[t.id for t in found])

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian numbers of ``width``."""
        if not self.splits:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()
        out = []
        for special, part in self.parts(text):
            if special:
                out.append(np.array([self.special[part]], dtype=self.width).tobytes())
                continue
            for some in self.pieces(part):
                try:
                    out.append(b"".join(map(self.ids.__getitem__, some)))
                except KeyError:
                    self._learn(some)
                    out.append(b"".join(map(self.ids.__getitem__, some)))
        return b"".join(out)

    # counts at prefixes

    def _follows(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when encoded together."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 2 * KEPT:
                self.fits.clear()
            found = self.fits[left, right] = [t.value for t in self.model.tokenize(left + right)] == [left, right]
        return found

    def _prefixes(self, mapped: str) -> list[int]:
        """Token counts of all prefixes of a piece, in bytes written as letters.

        The encoding of a prefix ends in the one token that is a suffix of it and can follow the encoding of the
        rest; so counts go from left to right, each from an earlier one.
        """
        last, count = [""], [0]
        for i in range(1, len(mapped) + 1):
            for j in range(max(0, i - self.longest), i):
                token = mapped[j:i]
                if token in self.vocabulary and (j == 0 or self._follows(last[j], token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {mapped[:i]!r}")
        return count

    def prefix_counts(self, piece: str) -> tuple[int, ...]:
        """Token counts of the piece's prefixes of 0, 1, ... characters, as encoded on their own."""
        found = self.counts.get(piece)
        if found is None:
            if len(self.counts) >= KEPT:
                self.counts.clear()
            raw = piece.encode()
            by_byte = self._prefixes(raw.decode("latin-1").translate(self.table))
            ends = [0]
            for c in piece:
                ends.append(ends[-1] + len(c.encode()))
            by_char = [by_byte[e] for e in ends]
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):  # "'r" alone is two pre-tokens
                by_char[2] = by_byte[1] + self._prefixes(piece[1])[1]
            found = self.counts[piece] = tuple(by_char)
        return found

    def table_of(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text, by characters: entry p is the count of ``text[:p]``.

        A prefix that ends in white space has the whole run of it as its last piece, and one that ends inside a
        special string has that beginning as ordinary text; elsewhere pieces of prefixes are those of the text.
        """
        if not self.splits:
            return np.array([len(self.whole.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)], dtype=np.int32)
        out, base = [0], 0
        run, run_base = "", 0  # the white space that the text so far ends in, and the count before it
        tail, tail_base = "", 0  # the last piece or run, and the count before it
        for special, part in self.parts(text):
            if special:
                out += [tail_base + len(self.whole.encode(tail + part[:k], add_special_tokens=False).ids) for k in range(1, len(part))]
                base += 1
                out.append(base)
                run = tail = ""
                run_base = tail_base = base
                continue
            for piece in chain.from_iterable(self.pieces(part)):
                counts = self.prefix_counts(piece)
                if not piece.strip(WHITE):
                    run_base = run_base if run else base
                    out += [run_base + c for c in self.prefix_counts(run + piece)[len(run) + 1 :]]
                    run += piece
                    tail, tail_base = run, run_base
                else:
                    here = [base + c for c in counts[1:]]
                    if run and piece[0] == " ":
                        here[0] = run_base + self.prefix_counts(run + " ")[-1]
                    out += here
                    run, tail, tail_base = "", piece, base
                base += counts[-1]
        return np.array(out, dtype=np.int32)

    def count(self, text: str) -> int:
        """The last entry of ``table_of``, summed over the pieces' tables without spelling them out."""
        if not self.splits:
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        total, known = 0, self.totals
        for special, part in self.parts(text):
            if special:
                total += 1
                continue
            for some in self.pieces(part):
                try:
                    total += sum(map(known.__getitem__, some))
                except KeyError:
                    if len(known) + len(some) > KEPT:
                        known.clear()
                    known.update((p, self.prefix_counts(p)[-1]) for p in set(some) if p not in known)
                    total += sum(map(known.__getitem__, some))
        return total


_read: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _read:
        _read[path] = Pieces(path)
    return _read[path]
