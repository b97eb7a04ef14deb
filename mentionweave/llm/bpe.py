"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

Encoding. A token sequence is the encoding of its text exactly if every token encodes to itself
and every two neighbours encode to just those two. That makes a non-deterministic transducer whose
states are (token before, place in the trie of tokens): a byte moves down the trie, and at a token
that may follow the one before it may also end there, emitting it. Subset states are built when
first met; each keeps the tokens its branches still disagree on, and emits the prefix on which all
agree. The lookahead is bounded, as branches start at most one longest token back.

Decoding. Token ids become bytes by table; a UTF-8 state machine carries the unfinished tail of
one block of ids over to the next, so text comes out while ids still arrive.

Defined results: null and empty texts have no tokens; bytes that are no UTF-8 are read as U+FFFD, as Python's own
replacement does, and decode to it; ids outside the vocabulary raise KeyError in `decode`; repeated rows are encoded row
by row; an empty table gives no rows; columns beyond doc_id and text are ignored by `digests` and carried along by
`encode_column` and `decode_column`, whose result takes the place of a column of its name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched, chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields_of, replacing, set_apart, task

#: Transitions and remembered pieces that one worker keeps before it starts anew.
MAX_TRANSITIONS, MAX_PIECES = 500_000, 350_000
#: Pieces of more characters are not remembered.
LONG = 64
#: Ids that the decoder takes at a time.
DECODE_BLOCK = 4096


#: Code points that this regex library counts as letters or numbers and the tiktoken
#: library (Unicode 16) does not. Texts below the first of them need no thought of it.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class Utf8Machine:
    """Incremental UTF-8: `feed` returns the text that is complete, and keeps the started character.

    States are (bytes still due, least and greatest value of the next byte). What can't be
    UTF-8 becomes U+FFFD as in Python's own replacement.
    """

    #: First byte ranges: (from, to, bytes due, least next, greatest next). Fixed values of UTF-8.
    STARTS = (
        (0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )
    FIRST = {b: (due, lo, hi) for a, z, due, lo, hi in STARTS for b in range(a, z + 1)}

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, data: bytes) -> str:
        if not self.tail and data.isascii():
            return data.decode("ascii")
        data = self.tail + data
        self.tail = data[len(data) - self._open(data) :]
        return data[: len(data) - len(self.tail)].decode("utf-8", "replace")

    def _open(self, data: bytes) -> int:
        """Number of bytes at the end that start a character without finishing it."""
        for n in range(1, min(3, len(data)) + 1):
            first = data[-n]
            if first & 0xC0 == 0x80:
                continue
            due, lo, hi = self.FIRST.get(first, (0, 0, 0))
            if due < n:
                return 0
            for b in data[len(data) - n + 1 :]:
                if not lo <= b <= hi:
                    return 0
                lo, hi = 0x80, 0xBF
            return n
        return 0

    def close(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


class Transducer:
    """Encoder and decoder for one rank table and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        # White space as in Unicode's White_Space, which the pattern's \s stands for.
        plain = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        later = "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in LATER)
        exact = plain.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{later}]]")
        exact = regex.sub(r"(?<!\{White_Space\})\\p\{([LN])\}(?!\\p|\])", lambda m: rf"[\p{{{m[1]}}}--[{later}]]", exact)
        self._plain, self._exact = regex.compile(plain), regex.compile(exact, regex.V1)
        self.children: dict[int, int] = {}  # by node * 256 + byte
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children.get(node << 8 | b)
                if nxt is None:
                    nxt = self.children[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        inner = {k >> 8 for k in self.children}
        self._leaf = [node not in inner for node in range(len(self.token_at))]
        self._valid: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}  # by token before << 32 | token
        self._last: dict[int, tuple[bytes, bytes] | None] = {}
        self._clear()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Transducer:
        lines = Path(path).read_bytes().split(b"\n")
        return cls({base64.b64decode(a): int(r) for a, r in (x.split() for x in lines if x)}, pattern)

    def _clear(self) -> None:
        self._states: dict[tuple, int] = {}
        self._members: list[tuple] = []
        self._next: dict[int, int | tuple] = {}  # by state << 8 | byte: the state reached, or with it what is emitted
        self._ends: list[tuple[int, ...] | None] = []
        self.start = self._state(((-1, 0, ()),))

    def _state(self, members: tuple) -> int:
        n = self._states.get(members)
        if n is None:
            n = self._states[members] = len(self._members)
            self._members.append(members)
            self._ends.append(members[-1][2] if members[-1][1] == 0 else None)
        return n

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves, lowest rank first: decides which tokens may be neighbours."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _reached(self, token: int) -> bool:
        """Whether the merges make the token out of its bytes."""
        ok = self._valid.get(token)
        if ok is None:
            ok = self._valid[token] = self.merged(self.bytes_of[token]) == [token]
        return ok

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts of the token's last merge; None of a single byte."""
        found = self._last.get(token, self)
        if found is self:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self._last[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether the merges of the two tokens' bytes together end with these two.

        Undo the merges at the seam, the latest first. While two parts lay side by side there, they must not have
        merged: neither at the end, nor before the merge that is undone, of equal ranks the one further left being first.
        """
        if not self._reached(token):
            return False
        if before < 0:
            return True
        pair = self._pairs.get(before << 32 | token)
        if pair is None:
            if len(self._pairs) > 2 * MAX_TRANSITIONS:
                self._pairs.clear()
            pair = self._pairs[before << 32 | token] = self._apart(before, token)
        return pair

    def _apart(self, left: int, right: int) -> bool:
        ranks, bytes_of, until = self.ranks, self.bytes_of, 1 << 62
        while True:
            together = ranks.get(bytes_of[left] + bytes_of[right])
            if together is not None and together < until:
                return False
            ends, begins = self._halves(left), self._halves(right)
            if ends is None and begins is None:
                return True
            if begins is None or (ends is not None and left > right):
                until, left = left, ranks[ends[1]]
            else:
                until, right = right + 1, ranks[begins[0]]

    def _step(self, state: int, byte: int) -> int | tuple:
        """Determinise one transition: the subset reached and the tokens all its branches agree on."""
        found, ended = [], None
        children, token_at, leaf, pairs = self.children, self.token_at, self._leaf, self._pairs
        for before, node, out in self._members[state]:
            nxt = children.get(node << 8 | byte)
            if nxt is None:
                continue
            if not leaf[nxt]:
                found.append((before, nxt, out))
            token = token_at[nxt]
            if token >= 0 and ended is None:  # no more than one branch may end here
                ok = pairs.get(before << 32 | token)
                if ok or (ok is None and self._may_follow(before, token)):
                    ended = (token, 0, (*out, token))
        emitted = ended[2]
        for _, _, out in found:
            if not out or out[0] != emitted[0]:
                emitted = ()
                break
        n = min([len(emitted), *[len(out) for _, _, out in found]]) if emitted else 0
        for _, _, out in found if n else ():
            while emitted[:n] != out[:n]:
                n -= 1
        found.append(ended)
        reached = self._state(tuple([(b, node, out[n:]) for b, node, out in found] if n else found))
        hit = self._next[state << 8 | byte] = (reached, emitted[:n]) if n else reached
        return hit

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None and not self._reached(whole):  # a token that no merges make stands for itself alone
            return [whole]
        out: list[int] = []
        state, step = self.start, self._next.get
        for b in data:
            hit = step(state << 8 | b)
            if hit is None:
                if len(self._next) > MAX_TRANSITIONS:  # start anew, from where the piece is
                    members = self._members[state]
                    self._clear()
                    state, step = self._state(members), self._next.get
                hit = self._step(state, b)
            if hit.__class__ is int:
                state = hit
            else:
                state = hit[0]
                out += hit[1]
        return out + list(self._ends[state])

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        return (self._plain if text.isascii() or max(text) < chr(LATER[0][0]) else self._exact).findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.piece(p.encode())]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Stream of text, a block of ids at a time."""
        machine = Utf8Machine()
        for block in batched(ids, DECODE_BLOCK):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, block)))
        yield machine.close()


_loaded: dict[tuple[str, str], tuple[Transducer, dict]] = {}


def transducer(path: str, pattern: str) -> tuple[Transducer, dict[str, tuple[int, ...]]]:
    """The worker's transducer, built once, with its memory of pieces met before."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Transducer.from_file(path, pattern), {}
    return _loaded[path, pattern]


def forget_pieces(path: str, pattern: str) -> None:
    """At a task's end: the worker keeps its transitions, and not the pieces, as it may idle beside other stages."""
    transducer(path, pattern)[1].clear()


def encoded(path: str, pattern: str, texts: Iterable[str | None]) -> Iterator[list[tuple[int, ...]]]:
    """For each text the ids of its pieces."""
    t, known = transducer(path, pattern)
    for text in texts:
        pieces = t.split(text or "")
        fresh = {p: tuple(t.piece(p.encode())) for p in set(pieces).difference(known)}
        if any(len(p) > LONG for p in fresh):
            yield [fresh[p] if p in fresh else known[p] for p in pieces]
            continue
        known.update(fresh)
        yield list(map(known.__getitem__, pieces))
        if len(known) > MAX_PIECES:
            known.clear()


def texts_of(array: pa.Array) -> Iterator[str]:
    """The texts of a string column; null is empty, and what is no UTF-8 becomes U+FFFD."""
    for x in array.cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, through encode and decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = transducer(path, pattern)
        names = {i: b"%d" % i for i in t.bytes_of}
        for batch in batches:
            count, ids_hash, text_hash = [], [], []
            for pieces in encoded(path, pattern, texts_of(batch["text"])):
                ids = list(chain.from_iterable(pieces))
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                h = hashlib.sha256()
                for part in t.decode(ids):
                    h.update(part.encode())
                text_hash.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        forget_pieces(path, pattern)

    return documents.select("doc_id", "text").mapInArrow(task(run), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`documents` with an array of token ids appended, in place of a column of that name."""
    apart, own = set_apart(documents, F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [list(chain.from_iterable(pieces)) for pieces in encoded(path, pattern, texts_of(batch["text"]))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own.values()), pa.array(out, pa.list_(pa.int32()))], [*own.values(), "ids"])
        forget_pieces(path, pattern)

    done = apart.mapInArrow(task(run), f"{fields_of(apart.drop('text'))}, ids array<int>")
    return replacing(done.withColumnRenamed("ids", ids), own, [ids])


def decode_column(encoded_rows: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded_rows` with the text of an array of ids appended, in place of a column of that name."""
    apart, own = set_apart(encoded_rows, F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = transducer(path, pattern)
        for batch in batches:
            out = ["".join(t.decode(x.as_py() or ())) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own.values()), pa.array(out, pa.string())], [*own.values(), "decoded"])

    done = apart.mapInArrow(task(run), f"{fields_of(apart.drop('ids'))}, decoded string")
    return replacing(done.withColumnRenamed("decoded", text), own, [text])
