"""Token ids of whole texts by a tokenizers file, with a memo of pieces.

The library is asked for every distinct piece once per worker. A piece is a
stretch of text at whose ends the tokenizer's own pre-tokenizer always cuts, so
the ids of a text are those of its pieces in a row:

* ``word``: pieces between ASCII white space, for a pre-tokenizer that drops
  white space (composition to NFC never crosses it either);
* ``byte``: byte-level BPE, where one blank belongs to the word after it.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from itertools import islice

from .common import resident

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that need no composition and whose lower case is one letter, in any context.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
_PIECES = {
    "word": re.compile(rf"[{_LATIN}]+(?=[,.;:!?\x20\x09-\x0D]|\Z)|[^\x20\x09-\x0D]+"),
    "byte": re.compile(f" ?[{_LATIN}]+(?=[,.;:!?{_WHITE}]|\\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"),
}
#: In Arrow: a word of plain letters, and what follows from the first mark on, are two pieces; any other word is one.
_HEAD_AND_TAIL = rf"\A(?P<head> ?[{_LATIN}]+)(?P<tail>(?s:[,.;:!?].*))?\z"
#: What a cut before every blank, for ``byte``, does not fit: white space that goes on behind a blank that is not its first.
_INNER_BLANK = rf"[{_WHITE}] (?:[{_WHITE}]|\z)"
_OTHER_WHITE = f"[{_WHITE.replace(' ', '')}]"
_plain = re.compile(f" ?[{_LATIN}]+").fullmatch
#: Pieces in each of a worker's two generations of memo, and the longest remembered, in characters.
MEMO_PIECES, MEMO_CHARS = 250_000, 64


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins for bytes: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """texts -> ids as little-endian unsigned 32-bit integers, as the library gives them.

    Like the library, it reads strings of special tokens in a text as those tokens,
    and what is between them as texts of their own.
    """

    def __init__(self, path: str, kind: str, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must stand for their exact string")
        self.special = {t.content: struct.pack("<I", k) for k, t in added.items()}
        # Of tokens that begin at one place the longest counts.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else None
        self.kind, self.memo_pieces = kind, memo_pieces
        self.find = _PIECES[kind].findall
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces of plain Latin letters go to the library's BPE model at once; the others through its whole chain."""
        out, rest = {}, []
        for p in pieces:
            if not _plain(p):
                rest.append(p)
                continue
            word = p.lower() if self.kind == "word" else p
            word = "".join(map(self.letters.__getitem__, word.encode()))
            out[p] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            out[p] = array("I", e.ids).tobytes()
        return out

    def parts(self, text: str) -> list[str | int]:
        """The text between special tokens, and 1 for each of these."""
        for mark in self.special:
            if mark in text:
                return [1 if t in self.special else t for t in self.cut(text) if t]
        return [text]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for mark in self.special:
            if mark in text:
                return b"".join([self.special[t] if t in self.special else self._plain(t) for t in self.cut(text) if t])
        return self._plain(text)

    def encode_column(self, texts) -> list[bytes]:
        """encode() of every text of an Arrow array of strings.

        Arrow does the cutting and the joining of ids, and only distinct pieces of all the
        texts together are looked up. Texts with special tokens, and for ``byte`` those
        that a cut before every blank does not fit, are encoded one by one.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        byte, texts = self.kind == "byte", pc.fill_null(texts, "")
        found = [pc.match_substring(texts, mark) for mark in self.special] + ([pc.match_substring_regex(texts, _INNER_BLANK)] if byte else [])
        apart = {k: self.encode(texts[k].as_py()) for k in {k for f in found for k in np.flatnonzero(f).tolist()}}
        if apart:
            texts = pc.if_else(pa.array([k in apart for k in range(len(texts))]), "", texts)
        split = pc.split_pattern(texts, " ") if byte else pc.ascii_split_whitespace(texts)
        starts = np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))
        words = split.flatten().dictionary_encode()
        codes, words = words.indices, words.dictionary
        if byte:  # a word has the blank before it, but for the first of a text
            codes = codes.to_numpy().copy()
            first, own = np.unique(codes[starts[:-1]], return_inverse=True)
            codes[starts[:-1]] = len(words) + own
            words = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type)), words.take(pa.array(first))])
        ids = self._ids(words).take(pa.array(codes))
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(ids).to_numpy())))
        ends = sizes[starts].tolist()
        joined = memoryview(ids.buffers()[2] or b"")
        return [apart[k] if k in apart else bytes(joined[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:]))]

    def _ids(self, words):
        """Ids of distinct words, which hold no blank but a leading one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n, none = len(words), pa.scalar("", words.type)
        head, tail = pc.extract_regex(words, _HEAD_AND_TAIL).flatten()  # null where it does not match
        heads, tails, cut = pc.coalesce(head, words), pc.fill_null(tail, none), []
        if self.kind == "byte":
            white = pc.match_substring_regex(words, _OTHER_WHITE)
            cut = [self.find(w) for w in words.filter(white).to_pylist()]
            heads, tails = (pc.if_else(white, none, x) for x in (heads, tails))
        pieces = pa.concat_arrays([heads, tails, pa.array([p for c in cut for p in c], words.type)]).dictionary_encode()
        # Offsets of 64 bits: ids are longer than their text.
        ids = pa.array(self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        out = pc.binary_join_element_wise(ids[:n], ids[n : 2 * n], pa.scalar(b"", pa.large_binary()))
        if cut:
            rest = iter(ids[2 * n :].to_pylist())
            out = pc.replace_with_mask(out, white, pa.array([b"".join(islice(rest, len(c))) for c in cut], pa.large_binary()))
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those that the memo lacks are learned, and remembered."""
        out, old, lacking = list(map(self.memo.get, pieces)), self.old, []
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = ids = old.get(pieces[k])
                if ids is None:
                    lacking.append(k)
                else:
                    self.memo[pieces[k]] = ids
        got = self.learn([pieces[k] for k in lacking])
        for k in lacking:
            out[k] = got[pieces[k]]
        self._remember(got)
        return out

    def _remember(self, got: dict[str, bytes]) -> None:
        self.memo.update((p, b) for p, b in got.items() if len(p) <= MEMO_CHARS)
        if len(self.memo) > self.memo_pieces:
            self.old, self.memo = self.memo, {}

    def _plain(self, text: str) -> bytes:
        pieces, memo = self.find(text), self.memo
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            pass
        lacking = {p for p in pieces if p not in memo}
        got = {p: self.old[p] for p in lacking if p in self.old}
        got |= self.learn([p for p in lacking if p not in got])
        out = b"".join([memo[p] if p in memo else got[p] for p in pieces])
        self._remember(got)
        return out


def encoder(path: str, kind: str, memo_pieces: int = MEMO_PIECES) -> Encoder:
    """The worker's encoder of this file; it outlives tasks."""
    return resident(f"tokenizer {kind} {path} {memo_pieces}", lambda: Encoder(path, kind, memo_pieces))
