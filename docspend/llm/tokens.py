"""Token ids of whole texts under a byte-level BPE file of the tokenizers library.

The library splits a text by a fixed pattern and encodes each piece on its own, so a piece has
the same ids wherever it stands.  `Encoder` finds the pieces of a batch with numpy, asks the
library only for pieces that are not in a bounded table, and gathers the ids.  A piece is taken
for one of the table only where their bytes are equal.  Documents with
characters beyond Latin, or with the string of a special token, go through the library whole.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from docspend.llm.bytesops import SpanHash, same_spans, span_ids

LATIN = 0x250
LETTER, NUMBER, OTHER, BLANK = range(4)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(LATIN, OTHER, np.uint8)
    for i in range(LATIN):
        kind = unicodedata.category(chr(i))[0]
        out[i] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = BLANK
    return out


def _visible_bytes() -> dict[int, str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others in order for those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    SLOTS = 1 << 21
    ARENA = 8_000_000

    def __init__(self, path: str | None = None, special_as_text: bool = False):
        """special_as_text: a special token's string in a text is ordinary text (else it is that token)."""
        from tokenizers import Tokenizer

        path = path or vocabulary()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.model, self.visible = self.library.model, _visible_bytes()
        self.classes, self.hash = _classes(), SpanHash()
        self._emptied()

    def _emptied(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.arena, self.used = np.zeros(1 << 20, np.int32), 0
        # the bytes of the piece of each slot
        self.place = np.zeros(self.SLOTS, np.int64)
        self.length = np.full(self.SLOTS, -1, np.int32)
        self.letters, self.filled = np.zeros(1 << 20, np.uint8), 0

    def _kept(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        n = int(sizes.sum())
        if self.used + n > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(n, len(self.arena)), np.int32)])
        at = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        self.arena[self.used : self.used + n] = np.fromiter((x for y in ids for x in y), np.int32, n)
        self.used += n
        return at, sizes

    def _kept_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        upto = np.cumsum(size)
        n = int(upto[-1])
        if self.filled + n > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(n, len(self.letters)), np.uint8)])
        self.letters[self.filled : self.filled + n] = data[np.repeat(starts - (upto - size), size) + np.arange(n)]
        at = self.filled + upto - size
        self.filled += n
        return at

    def _piece(self, piece: bytes) -> list[int]:
        """The library's model alone: a piece needs no splitting."""
        return [x.id for x in self.model.tokenize(piece.decode("latin-1").translate(self.visible))]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in a chunk of bytes, one after the other, and the n+1 bounds of each."""
        raw = data.tobytes()
        text = raw.decode("utf-8")
        n = len(offsets) - 1
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts_cp = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=starts_cp[1:])
        bounds = starts_cp[offsets]
        far = np.flatnonzero(points >= LATIN)
        slow = np.zeros(n, bool)
        slow[np.searchsorted(bounds, far, "right") - 1] = True
        for word in self.special:
            if word in text:
                slow |= np.fromiter((word in text[a:b] for a, b in zip(bounds[:-1], bounds[1:])), bool, n)
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ids, sizes = self._pieces(data, at_byte, points, bounds)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not slow.any():
            return ids, ends
        parts = [self.whole(text[bounds[i] : bounds[i + 1]]) if slow[i] else ids[ends[i] : ends[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _pieces(self, data: np.ndarray, at_byte: np.ndarray, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(points)
        if m == 0:
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        kind = self.classes[np.minimum(points, LATIN - 1)]
        first = np.zeros(m + 1, bool)
        first[bounds] = True
        begin = first[:m].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # the last blank before a word is a piece of its own, or starts the word's piece if it is U+0020
        last = np.flatnonzero(begin[1:] & ~first[1:m] & (kind[:-1] == BLANK) & (kind[1:] != BLANK))
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False
        self._contractions(points, kind, begin, first)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], m)
        s, e = at_byte[starts], at_byte[ends]
        h = self.hash(data, s, e)
        slot = (h >> np.uint64(43)).astype(np.int64)
        hit = (self.keys[slot] == h) & (self.length[slot] == e - s)
        hit[hit] = same_spans(data, s[hit], self.place[slot[hit]], (e - s)[hit], self.letters)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if max(self.used, self.filled) > self.ARENA:
                self._emptied()
                miss = np.arange(len(h))
            ids, where, new = span_ids(data, s[miss], e[miss], self.hash)
            s, e = s[miss[where]], e[miss[where]]
            raw = data.tobytes()
            new_at, new_size = self._kept([self._piece(raw[a:b]) for a, b in zip(s.tolist(), e.tolist())])
            at[miss], size[miss] = new_at[ids], new_size[ids]
            slots = (new >> np.uint64(43)).astype(np.int64)
            # two new pieces may share a slot: the later one stays, in all arrays alike
            _, keep = np.unique(slots[::-1], return_index=True)
            keep = len(slots) - 1 - keep
            to = slots[keep]
            self.keys[to], self.at[to], self.size[to] = new[keep], new_at[keep], new_size[keep]
            self.place[to], self.length[to] = self._kept_bytes(data, s[keep], e[keep]), e[keep] - s[keep]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.arena[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        piece = np.searchsorted(starts, bounds)
        return ids, np.diff(total[piece])

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, begin: np.ndarray, first: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll directly after a piece's end are pieces."""
        m = len(points)
        for a in np.flatnonzero((points == 0x27) & begin).tolist():
            for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
                b = a + 1 + len(tail)
                if b <= m and not first[a + 1 : b].any() and points[a + 1 : b].tolist() == [ord(c) for c in tail]:
                    begin[a + 1] = False
                    if b < m and kind[b] == LETTER and not first[b]:
                        begin[b] = True
                    break
