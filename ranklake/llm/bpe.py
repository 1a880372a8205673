"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merge ranks define which neighbouring token pairs can stand side by side (a pair can if merging
its bytes gives the pair back), and a sequence is the BPE result exactly if all its neighbours can.
So every prefix of a piece has one last token, and the transducer reads a piece byte by byte.  Its
state holds, for each position from which a longer token may still start, the tokens not emitted
yet; tokens that all of these share are emitted, so the lookahead is bounded by the longest token.
Transitions are worked out when first met and kept, up to ``max_transitions``, after which the
cache starts anew: memory is bounded and results do not depend on it.  Ids of short pieces are kept in two
generations: the older one goes when the younger is full, and pieces met again move to the younger.

Decoding streams ids through an incremental UTF-8 state machine.

Defined results: a null text is empty and has no tokens; repeated rows stay repeated; an empty table
gives an empty result; lone surrogates cannot occur in Spark strings; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank of pairs that no merge joins.
NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes pieces of bytes; ``ranks`` must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = 400_000):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.max_transitions = max_transitions
        self.histories: dict[bytes, list | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: ((bytes read since a live position, tokens pending up to it), ...), the longest tail first
        self.numbers: dict[tuple, int] = {((b"", ()),): 0}
        self.states: list[tuple] = [((b"", ()),)]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def history(self, token: bytes) -> list[tuple[int, bytes, bytes]] | None:
        """Merges of a token on its own, lowest rank and leftmost first: each one's rank, with the first and the last part before it.

        The end has the rank ``NEVER``.  None if the merges do not make the token.
        """
        if token not in self.histories:
            if len(self.histories) > self.max_transitions:
                self.histories.clear()
            parts, seen = [token[i : i + 1] for i in range(len(token))], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(x + y, NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                seen.append((rank, parts[0], parts[-1]))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.histories[token] = [*seen, (NEVER, token, token)] if len(parts) == 1 else None
        return self.histories[token]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens can be neighbours; an empty ``left`` is the start of the piece.

        They can unless, with both sides merging side by side in rank order, a merge across their border comes first.
        """
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > self.max_transitions:
                self.pairs.clear()
            self.pairs[key] = self.apart(self.history(left), self.history(right)) if left else self.history(right) is not None
        return self.pairs[key]

    def apart(self, left: list | None, right: list | None) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (x, _, end), (y, start, _) = left[i], right[j]
            border = self.ranks.get(end + start, NEVER)
            if border < x and border <= y:  # of equal ranks the leftmost goes first
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Follow ``byte``: the next state and the ids emitted."""
        tail_byte, live, here = bytes([byte]), [], None
        for tail, pending in self.states[state]:
            token = tail + tail_byte
            if here is None and token in self.ranks and self.fits(pending[-1] if pending else b"", token):
                here = (*pending, token)
            if token in self.prefixes:
                live.append((token, pending))
        if here is None:
            raise ValueError("the ranks do not hold every byte")
        live.append((b"", here))
        # emit what all hypotheses share, but for the last token, which the next pair check needs
        shared, most = 0, min([len(p) for _, p in live]) - 1
        while shared < most and all([p[shared] == here[shared] for _, p in live]):
            shared += 1
        # ``shared`` tokens are agreed on; an agreed last token stays as context
        out = tuple(self.ranks[t] for t in here[:shared])
        key = tuple((tail, p[shared:]) for tail, p in live)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key], out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is a token itself is that token."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(self.moves) > self.max_transitions:
            self.reset()
        state, ids, moves = 0, [], self.moves
        for n, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if len(moves) > self.max_transitions:  # only inside one very long piece
                    held = self.states[state]
                    self.reset()
                    moves = self.moves
                    state = self.numbers.setdefault(held, len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                    key = state << 8 | byte
                move = moves[key] = self.step(state, byte)
            state = move[0]
            if move[1]:
                ids.extend(move[1])
        if state not in self.ends:
            self.ends[state] = tuple(self.ranks[t] for t in self.states[state][-1][1])
        ids.extend(self.ends[state])
        return tuple(ids)


class Tokenizer:
    """Splits text by ``pattern`` and encodes each match; keeps the ids of up to ``max_pieces`` short pieces, and those of one text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 250_000, max_transitions: int = 400_000):
        self.pattern, self.transducer = regex.compile(pattern), Transducer(ranks, max_transitions)
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_pieces = max_pieces

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if 2 * len(self.pieces) >= self.max_pieces:
            self.older, self.pieces = self.pieces, {}
        found, pieces, older = self.pattern.findall(text), self.pieces, self.older
        long: dict[str, bytes] = {}
        for piece in set(found).difference(pieces):
            if piece in older:
                pieces[piece] = older.pop(piece)
                continue
            held = pieces if len(piece) <= 64 else long
            ids = self.transducer.encode(piece.encode())
            held[piece] = struct.pack(f"<{len(ids)}I", *ids)
        if long:
            return np.frombuffer(b"".join([pieces[p] if p in pieces else long[p] for p in found]), "<u4")
        return np.frombuffer(b"".join(map(pieces.__getitem__, found)), "<u4")

    def decode(self, ids: np.ndarray, block: int = 8192) -> Iterator[str]:
        """Text as it becomes complete, ``block`` ids at a time: bytes of a character that spans blocks wait for its end."""
        machine, token = codecs.getincrementaldecoder("utf-8")("strict"), self.tokens.__getitem__
        for i in range(0, len(ids), block):
            text = machine.decode(b"".join(map(token, ids[i : i + block].tolist())))
            if text:
                yield text
        machine.decode(b"", True)


@functools.lru_cache(maxsize=1)
def tokenizer_of(ranks: bytes, pattern: str, max_pieces: int, max_transitions: int) -> Tokenizer:
    """One tokenizer for all tasks that a worker process runs: transitions are worked out once."""
    return Tokenizer(read_ranks(ranks), pattern, max_pieces, max_transitions)


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, max_pieces: int = 250_000, max_transitions: int = 400_000) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every row; ``with_ids`` adds ``token_ids``.

    ``ranks`` is the content of a rank file, read by the driver: a vocabulary of fixed size.  A worker's caches take about
    200 bytes a piece and 600 a transition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<bigint>" if with_ids else "")

    def run(batches):
        tokenizer = tokenizer_of(shared.value, pattern, max_pieces, max_transitions)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py() or "")
                digest = hashlib.sha256()
                for part in tokenizer.decode(ids):
                    digest.update(part.encode())
                row = {id_col: key, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": digest.hexdigest()}
                if with_ids:
                    row["token_ids"] = ids.tolist()
                rows.append(row)
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    arrow = pa.schema(fields + ([("token_ids", pa.list_(pa.int64()))] if with_ids else []))
    return source.mapInArrow(run, schema)
