"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if each token encodes to itself and each two
neighbours, joined, encode to those two. That condition is local, so the merges compile into a
transducer over bytes: each prefix of the input has one segmentation, whose last token is settled by
the tokens that end here and the token closed before each of them. The part that follows the bytes is an
automaton on the tokens' trie (its state: the longest suffix of the input that may still grow into a token);
its moves are determinised when first met, and so are the verdicts on (token before, token). A future
token can begin only inside that suffix, so tokens before the point where all its places agree are
emitted; the lookahead is bounded by the longest token, and the input is read once in linear time.

Decoding goes token by token through a UTF-8 state machine: what a token completes is emitted, the rest
(at most three bytes) is the state.

Defined cases: a null or empty text has no tokens and decodes to empty bytes; special strings are
ordinary text; ids outside the vocabulary are an error; repeated rows, empty tables and further
columns need nothing special.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow

# Entries kept per Python worker. When the newer half of the pieces is full, it replaces the older half; the
# tables of the machines are emptied when full and grow again. Results do not depend on these.
CACHE_PIECES = 600_000
CACHE_STATES = 200_000
# Bytes of a piece after which settled tokens are emitted.
EMIT_BYTES = 4096
_NEVER = 1 << 60
_ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte, by the trie
        self.depth = [0]
        ends = {}
        for token, i in ranks.items():
            node = _ROOT
            for b in token:
                step = node << 8 | b
                if step not in self.child:
                    self.child[step] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]
            ends[node] = i
        self.follows: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[bytes, int, int]]] = {}
        self._suffixes(ends)
        self.moves: dict[int, tuple[int, tuple]] = {}

    def _suffixes(self, ends: dict[int, int]) -> None:
        """For each node its longest proper suffix in the trie, and (token, length) of the tokens that end there,
        longest first, if they encode to themselves."""
        self.shorter = [_ROOT] * len(self.depth)
        self.closing: list[tuple[tuple[int, int], ...]] = [()] * len(self.depth)
        for step, node in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            parent, byte = step >> 8, step & 255
            if parent != _ROOT:
                self.shorter[node] = self._go(self.shorter[parent], byte)
            token = ends.get(node)
            own = ((token, self.depth[node]),) if token is not None and len(self.merged(self.bytes_of[token])) == 1 else ()
            self.closing[node] = own + self.closing[self.shorter[node]]

    def _go(self, node: int, byte: int) -> int:
        while True:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                return to
            if node == _ROOT:
                return _ROOT
            node = self.shorter[node]

    def merged(self, data: bytes, below: int = _NEVER) -> list[bytes]:
        """The symbols after all merges with a rank under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The symbols that stand at a token's left (side 0) or right (1) end while it is merged on its own:
        bytes, rank of their own making and rank of the merge that consumes them, latest first."""
        key = token << 1 | side
        found = self.edges.get(key)
        if found is None:
            data, consumed, found = self.bytes_of[token], _NEVER, []
            while True:
                rank = self.ranks[data]
                found.append((data, -1 if len(data) == 1 else rank, consumed))
                if len(data) == 1:
                    break
                data, consumed = self._halves(rank)[side], rank
            self.edges[key] = found
        return found

    def _halves(self, token: int) -> tuple[bytes, bytes]:
        """The two symbols whose merge makes the token."""
        data = self.bytes_of[token]
        left, *rest = self.merged(data, token)
        return left, b"".join(rest)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay apart: no merge across their border has its turn while both its
        symbols are there; of equal ranks the left place comes first."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while i < len(left) and j < len(right):
            (x, made_x, gone_x), (y, made_y, gone_y) = left[i], right[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < gone_x and rank <= gone_y:
                return False
            if made_x >= made_y:
                i += 1
            else:
                j += 1
        return True

    def _settled(self, closed: list[int], suffix: int) -> int:
        """The last place that the segmentations of all places in the open suffix share."""
        places = set(range(len(closed) - 1 - suffix, len(closed)))
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - len(self.bytes_of[closed[last]]))
        return places.pop()

    def _path(self, closed: list[int], place: int) -> list[int]:
        out = []
        while place > 0:
            out.append(closed[place])
            place -= len(self.bytes_of[closed[place]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece, which is merged on its own."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) + len(self.follows) >= CACHE_STATES:
            self.moves, self.follows = {}, {}
        moves, follows = self.moves, self.follows
        closed, node, place, out = [-1], _ROOT, 0, []  # closed[i]: the last token of the first i bytes
        for byte in piece:
            step = node << 8 | byte
            move = moves.get(step)
            if move is None:
                node = self._go(node, byte)
                move = moves[step] = (node, self.closing[node])
            node, closing = move
            place += 1
            for token, length in closing:
                if length > place:
                    continue  # begins before what is already emitted
                before = closed[place - length]
                if before >= 0:
                    fits = follows.get(before << 20 | token)
                    if fits is None:
                        fits = follows[before << 20 | token] = self.may_follow(before, token)
                    if not fits:
                        continue
                closed.append(token)
                break
            if place >= EMIT_BYTES:
                at = self._settled(closed, self.depth[node])
                if at > 0:
                    out += self._path(closed, at)
                    closed = closed[at:]
                    place -= at
        return out + self._path(closed, len(closed) - 1)


class _Pieces(dict):
    """Packed ids of pieces, made when first asked for; long pieces are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Splits texts into pieces and encodes each; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.cache = _Pieces(self.transducer.encode)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))


# UTF-8 by lead byte: how many bytes follow, and the range of the first of them (the others: 80 to BF).
_LEADS = [
    (0x00, 0x7F, 0, 0x80, 0xBF),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
]
_BY_LEAD = {b: (more, low, high) for first, last, more, low, high in _LEADS for b in range(first, last + 1)}


def utf8_step(held: bytes, data: bytes) -> tuple[str, bytes]:
    """Feed bytes to the state ``held`` (an incomplete character): the text that is complete now and the
    next state. A byte that cannot go on yields U+FFFD, and reading starts again at it."""
    out: list[str] = []
    for byte in data:
        if held:
            more, low, high = _BY_LEAD[held[0]]
            if (low <= byte <= high) if len(held) == 1 else (0x80 <= byte <= 0xBF):
                held += bytes([byte])
                if len(held) == more + 1:
                    out.append(held.decode("utf-8"))
                    held = b""
                continue
            out.append("�")
            held = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif byte in _BY_LEAD:
            held = bytes([byte])
        else:
            out.append("�")
    return "".join(out), held


class StreamDecoder:
    """Ids to text in blocks; the machine's moves by (state, token) are kept when first met."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        # What each token yields in the empty state, if it ends there too.
        first = {i: utf8_step(b"", data) for i, data in bytes_of.items()}
        self.whole = {i: text for i, (text, held) in first.items() if not held}

    def text(self, ids: list[int]) -> str:
        held, out, moves, whole = b"", [], self.moves, self.whole.get
        if len(moves) >= CACHE_STATES:
            moves.clear()
        for at in range(0, len(ids), 64):
            block = ids[at : at + 64]
            if not held:
                try:
                    out.append("".join(map(whole, block)))
                    continue
                except TypeError:  # a token that ends inside a character yields no whole text
                    pass
            for i in block:
                move = moves.get((held, i))
                if move is None:
                    move = moves[held, i] = utf8_step(held, self.bytes_of[i])
                out.append(move[0])
                held = move[1]
        return "".join(out) + ("\ufffd" if held else "")


def _ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit integers) of each whole text. The rank
    file is read by the driver and broadcast; rows are not shuffled."""
    encoder = PerWorker(docs.sparkSession, read_ranks(path), lambda ranks: Encoder(ranks, pattern))

    def run(batch):
        packed = encoder.get().packed
        ids = [packed(x or "") for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, decoded from the packed ``ids``."""
    decoder = PerWorker(encoded.sparkSession, {i: t for t, i in read_ranks(path).items()}, StreamDecoder)
    names = encoded.columns

    def run(batch):
        decode = decoder.get().text
        packed = batch.column(names.index("ids")).to_pylist()
        texts = [decode(_ids(x or b"")) for x in packed]
        return {**{c: batch.column(k) for k, c in enumerate(names)}, "text": texts}

    return map_arrow(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests (lowercase hex of SHA-256) of the packed ids and of the bytes that decoding those ids
    gives. Text is encoded, decoded and digested in one pass, so neither ids nor decoded text leave the task."""

    def make(ranks):
        return Encoder(ranks, pattern), StreamDecoder({i: t for t, i in ranks.items()})

    both = PerWorker(docs.sparkSession, read_ranks(path), make)

    def run(batch):
        encoder, decoder = both.get()
        counts, coded, decoded = [], [], []
        for value in batch.column(1).to_pylist():
            ids = encoder.packed(value or "")
            counts.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(decoder.text(_ids(ids)).encode("utf-8")).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded}

    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, schema)
