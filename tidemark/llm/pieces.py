"""Byte-level BPE by pre-token: splitting, encoding with a worker cache, and exact joins of encodings."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: The splitting rule of byte-level BPE, for the characters that COMMON lists.
_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that Python's character classes and the library's put in the same class. Any other sends a text to the library's own splitter.
_UNCOMMON = re.compile(
    "[^\t-\r -~¡-±´-¸º»¿-ɏͰ-֏‐-⁞"
    "₠-₿℀-⅏぀-ゖァ-ヿ一-龥가-힣]"
)
#: No alternative of the splitting rule looks further than this past the end of what it takes.
LOOKAHEAD = 8


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """Token ids of the pieces met, as the bytes of int32, encoded when first asked for; it starts anew when it holds ``most``.

    Bytes are smaller than tuples and no work for the garbage collector, which would walk a large cache again and again.
    """

    def __init__(self, coder: PieceCoder, most: int):
        super().__init__()
        self.coder, self.most = coder, most

    def __missing__(self, piece: str) -> bytes:
        special = self.coder.special.get(piece)
        got = array("i", self.coder.raw(piece.encode()) if special is None else (special,)).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got


class PieceCoder:
    """Encodes single pre-tokens of one tokenizer file and keeps the results in a bounded cache.

    ``cache_size`` bounds the cache: when full, it starts anew, so memory stays flat however many distinct words come.
    """

    def __init__(self, path: str, cache_size: int = 200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(names) + ")") if names else None
        alphabet = _byte_alphabet()
        self._shown = {b: c for b, c in alphabet.items() if chr(b) != c}
        back = {c: b for b, c in alphabet.items()}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.token_bytes = [b""] * size
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.cache = _Cache(self, cache_size)
        #: Token ids of one piece, as the bytes of int32.
        self.packed = self.cache.__getitem__

    def split(self, text: str) -> list[str]:
        """The pre-tokens of ``text``, in order; special strings are pieces of their own. Joined, they give ``text``."""
        if (self._special is None or not self._special.search(text)) and not _UNCOMMON.search(text):
            return _PIECE.findall(text)
        out: list[str] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for a, b in _char_spans(self.tok.pre_tokenizer.pre_tokenize_str(part))]
        return out

    def raw(self, data: bytes) -> tuple[int, ...]:
        """Token ids of bytes that are not split any further."""
        return tuple(t.id for t in self.model.tokenize(data.decode("latin-1").translate(self._shown)))

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        return np.frombuffer(b"".join(map(self.packed, self.split(text))), np.int32)

    def decode(self, ids) -> str:
        """The bytes of the tokens as text; bytes that are not UTF-8 become U+FFFD, as the library does."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    # -- exact joins ---------------------------------------------------------------------------------------------

    def join_raw(self, left: tuple[int, ...], right: tuple[int, ...], window: int = 8) -> tuple[int, ...]:
        """The encoding of unsplit left + right, from the encodings of both.

        A window of tokens around the join is encoded anew and grows until it agrees with what remains on either side.
        Two sides agree if the two tokens that meet encode to themselves when put together; a sequence of which all
        neighbours agree is the encoding of its bytes.
        """
        while True:
            a, b = left[:-window], right[window:]
            mid = self.raw(b"".join(map(self.token_bytes.__getitem__, left[len(a) :] + right[:window])))
            if (not a or self._agree(a[-1], mid[0])) and (not b or self._agree(mid[-1], b[0])):
                return a + mid + b
            window *= 2

    def _agree(self, x: int, y: int) -> bool:
        return self.raw(self.token_bytes[x] + self.token_bytes[y]) == (x, y)


def _char_spans(pairs) -> list[tuple[int, int]]:
    """Character spans; pre-tokens that start inside a character would share it, so spans are made to follow each other."""
    out, at = [], 0
    for _, (_, end) in pairs:
        if end > at:
            out.append((at, end))
            at = end
    return out


class Encoded:
    """A text in runs, each with the ends of its pieces (in characters), the ends of their tokens, and the token ids, as arrays.

    Joining two texts replaces the pieces around the join by a new run and keeps views of the others, so it costs what the window
    costs, however long the texts are.
    """

    __slots__ = ("runs",)

    def __init__(self, runs: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]):
        self.runs = runs

    @classmethod
    def of(cls, coder: PieceCoder, text: str) -> Encoded:
        return cls([_run(text, pieces := coder.split(text), list(map(coder.packed, pieces)))] if text else [])

    @property
    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(r[3] for r in self.runs)])


def _run(text: str, pieces: list[str], packed: list[bytes]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    ends, cuts = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (pieces, packed))
    return text, ends.astype(np.int32), (cuts // 4).astype(np.int32), np.frombuffer(b"".join(packed), np.int32)


def _cut(run: tuple, n: int) -> tuple[tuple, tuple]:
    """A run before and from its ``n``-th piece on."""
    text, ends, cuts, ids = run
    at, token = (int(ends[n - 1]), int(cuts[n - 1])) if n else (0, 0)
    return (text[:at], ends[:n], cuts[:n], ids[:token]), (text[at:], ends[n:] - at, cuts[n:] - token, ids[token:])


def _tail(runs: list, chars: int) -> tuple[list, list]:
    """The runs before, and those that hold the last pieces, of ``chars`` characters or more, and one piece at least."""
    keep, last = list(runs), []
    while keep and sum(len(r[0]) for r in last) < chars:
        run = keep.pop()
        start = len(run[0]) - (chars - sum(len(r[0]) for r in last))
        a, b = _cut(run, int(np.searchsorted(run[1], start, side="right")) if start > 0 else 0)
        last.insert(0, b)
        if len(a[1]):
            keep.append(a)
    return keep, last


def join(coder: PieceCoder, left: Encoded, right: Encoded, window: int = 64) -> Encoded:
    """The encoding of the text of ``left`` followed by that of ``right``.

    Pieces of the left side that end well before the join stay as they are, since the splitting rule looks ahead only a few
    characters. From the last of them on, a window is split anew; it grows to the right until one of its boundaries past
    the join is a boundary of the right side too, from where both sides agree. A long piece that is the last of the left and the
    first of the right is joined token by token.
    """
    if not left.runs or not right.runs:
        return left if left.runs else right
    keep, last = _tail(left.runs, max(window, LOOKAHEAD))
    before = "".join(r[0] for r in last)
    length = sum(len(r[0]) for r in right.runs)
    reach = window
    while True:
        taken, after, ends, chars = 0, [], set(), 0
        for run in right.runs:
            if chars >= reach:
                break
            after.append(run[0])
            ends.update((run[1][: int(np.searchsorted(run[1], reach - chars)) + 1] + chars).tolist())
            chars += len(run[0])
            taken += 1
        whole = reach >= length
        pieces, at, found, mid = coder.split(before + "".join(after)[:reach]), -len(before), None, []
        for p in pieces:
            if at >= 0 and (whole or at <= reach - LOOKAHEAD) and (at == 0 or at in ends):
                found = at
                break
            at += len(p)
            mid.append(p)
        if found is not None or whole:
            break
        reach *= 2
    rest, skipped = list(right.runs), length if found is None else found
    while rest and skipped >= len(rest[0][0]):
        skipped -= len(rest.pop(0)[0])
    if skipped:
        rest[0] = _cut(rest[0], int(np.searchsorted(rest[0][1], skipped, side="right")))[1]
    if not mid:
        return Encoded(keep + rest)
    ids, at = [], -len(before)
    for p in mid:
        ids.append(_straddle(coder, left, right, p, at))
        at += len(p)
    return Encoded([*keep, _run("".join(mid), mid, ids), *rest])


def _straddle(coder: PieceCoder, left: Encoded, right: Encoded, piece: str, at: int) -> bytes:
    """Token ids of one piece of the window, which begins ``-at`` characters before the join; a long one made of the last piece of
    the left and the first of the right is joined from their tokens."""
    if len(piece) > 512 and at < 0 < at + len(piece):
        (a, b), (c, d) = (_edge(left.runs[-1], -1), _edge(right.runs[0], 0))
        if a == -at and c == at + len(piece):
            return array("i", coder.join_raw(b, d)).tobytes()
    return coder.packed(piece)


def _edge(run: tuple, i: int) -> tuple[int, tuple[int, ...]]:
    """Characters and token ids of a run's first (0) or last (-1) piece."""
    _, ends, cuts, ids = run
    n = len(ends) + i if i else 0
    start, token = (int(ends[n - 1]), int(cuts[n - 1])) if n else (0, 0)
    return int(ends[n]) - start, tuple(ids[token : int(cuts[n])].tolist())


def join_tree(coder: PieceCoder, parts: list[Encoded]) -> Encoded:
    """Joins neighbours pairwise, level by level."""
    while len(parts) > 1:
        parts = [join(coder, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(maxsize=4)
def coder(path: str, cache_size: int = 200_000) -> PieceCoder:
    """One coder for each file and worker process."""
    return PieceCoder(path, cache_size)
