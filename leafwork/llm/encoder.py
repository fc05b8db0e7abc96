"""Exact, memoised encoding with a file of the tokenizers library."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from leafwork.llm.textbytes import buffers

#: The contractions that the split pattern of byte-level BPE takes off, and Unicode's white space.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _SPACE, _UNSURE = range(5)
#: The byte alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = np.arange(256, dtype="<u4")
_LETTERS[[b for b in range(256) if b not in _PLAIN]] = np.arange(256, 256 + 256 - len(_PLAIN))
_HELD: dict = {}


def encoder(path: str, added: bool = False) -> "Encoder":
    """One encoder per worker process, file and treatment of added tokens."""
    if (path, added) not in _HELD:
        _HELD[path, added] = Encoder(path, added)
    return _HELD[path, added]


def _classes() -> np.ndarray:
    """The class of every code point in the split pattern; those that this Unicode version doesn't know are unsure."""
    if "classes" not in _HELD:
        first = {"L": _LETTER, "N": _NUMBER}
        kind = [_UNSURE if (c := unicodedata.category(chr(k))) == "Cn" else first.get(c[0], _OTHER) for k in range(0x110000)]
        table = np.array(kind, np.uint8)
        table[list(_WHITE)] = _SPACE
        _HELD["classes"] = table
    return _HELD["classes"]


def token_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the split pattern of byte-level BPE starts a token, for code points and their classes; first: where a text starts.

    Runs of one class are tokens, with a blank before them if there is one. Of white space before something solid the
    last character stands apart, and joins what follows if it is a blank. A lone apostrophe takes a contraction's
    letters, unless it has a blank itself.
    """
    n = len(points)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    follows = np.zeros(n, bool)  # white space with something solid after it in the same text
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    at = np.flatnonzero(follows)
    start[at] = True
    start[at[points[at] == 32] + 1] = False
    quote = np.flatnonzero((points[:-2] == 39) & start[:-2]) if n > 2 else np.zeros(0, np.int64)
    if n > 1 and points[n - 2] == 39 and start[n - 2]:
        quote = np.append(quote, n - 2)
    for q in quote.tolist():  # starts at the apostrophe itself: no blank is joined to it
        if start[q + 1] and not first[q + 1]:
            for c in _CONTRACTIONS:
                m = len(c)
                if q + m <= n and points[q + 1] == ord(c[1]) and (m == 2 or points[q + 2] == ord(c[2])) and not first[q + 1 : q + m].any():
                    start[q + 1 : q + m] = False
                    if q + m < n:
                        start[q + m] = True
                    break
    return start


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Texts are split by the library's pattern in whole arrays, the different tokens of a batch are found by Arrow's
    dictionary encoding of their bytes, and each goes through the library's model once; known ones are looked up. The
    memo is bounded and starts anew when full. Texts that hold a code point of unsure class go to the library whole.
    With `added`, so do those that hold the string of an added token, which the library then gives its id; without,
    such strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False, tokens: int = 900_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in names)) if added and names else None
        if self.tok.normalizer is not None or "ByteLevel" not in str(self.tok.pre_tokenizer):
            raise ValueError("memoised encoding is exact for byte-level BPE without a normalizer")
        self.vocab = self.tok.get_vocab_size()
        self.most = tokens
        self._clear()

    def _clear(self):
        self.memo: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, fresh: list[bytes]):
        """Encodes tokens that the memo lacks and adds them to it."""
        tokenize, mapped = self.tok.model.tokenize, _LETTERS[np.frombuffer(b"".join(fresh), np.uint8)].tobytes().decode("utf-32-le")
        upto = [0, *accumulate(map(len, fresh))]
        known = [[x.id for x in tokenize(mapped[a:b])] for a, b in pairwise(upto)]
        size = np.fromiter(map(len, known), np.int64, len(known))
        n, more = len(self.memo), int(size.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(fresh) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty_like(self.begin)])
        self.flat[self.used : self.used + more] = np.fromiter((i for ids in known for i in ids), np.uint32, more)
        self.begin[n + 1 : n + 1 + len(fresh)] = self.used + np.cumsum(size)
        self.used += more
        self.memo.update(zip(fresh, range(n, n + len(fresh))))

    def _whole(self, raw: np.ndarray, offsets: np.ndarray, unsure: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of the rows that hold unsure characters (at those bytes) or an added token, by the library alone."""
        rows = set((np.searchsorted(offsets, unsure, side="right") - 1).tolist())
        data = raw.tobytes() if self.added or rows else b""
        if self.added:
            for m in self.added.finditer(data):
                a = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                if m.end() <= offsets[a + 1]:
                    rows.add(a)
                else:  # it began in one text and ended in another: look again in both
                    b = int(np.searchsorted(offsets, m.end() - 1, side="right")) - 1
                    rows |= {k for k in (a, b) if self.added.search(data[offsets[k] : offsets[k + 1]])}
        whole = {}
        for k in rows:
            text = data[offsets[k] : offsets[k + 1]].decode()
            whole[k] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return whole

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow string array or a list) in a row and each text's offsets among them; null is empty."""
        raw, offsets = buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        rows = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(self.memo) > self.most:
            self._clear()
        lead = (raw & 0xC0) != 0x80
        points = raw if lead.all() else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.arange(len(raw) + 1) if points is raw else np.append(np.flatnonzero(lead), len(raw))
        kind = _classes()[points]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        start = token_starts(points, kind, first[at[:-1]])
        whole = self._whole(raw, offsets, at[:-1][kind == _UNSURE])
        begins = np.append(at[:-1][start], len(raw))
        tokens = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        found = tokens.dictionary_encode()
        data, ends = buffers(found.dictionary)
        data, ends = data.tobytes(), ends.tolist()
        different = [data[a:b] for a, b in pairwise(ends)]
        places = list(map(self.memo.get, different))
        if None in places:
            self._learn([t for t, p in zip(different, places) if p is None])
            places = list(map(self.memo.get, different))
        k = np.array(places, np.int64)[found.indices.to_numpy()]
        size = self.begin[k + 1] - self.begin[k]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[k] - (ends - size), size) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(begins[:-1], offsets)]
        if whole:
            own = [whole[i] if i in whole else ids[upto[i] : upto[i + 1]] for i in range(rows)]
            ids, upto = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ids, upto
