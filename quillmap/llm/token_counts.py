"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are compiled from the tokenizer file.

* The pre-tokenizer has 8 states and reads character classes (with the one or two characters of lookahead that the
  pattern needs folded into the class); a transition says whether a piece begins. A chunk of characters is a map from
  states to states. The maps of all chunks compose in a parallel prefix scan, which gives every chunk its entry state;
  then all chunks are read side by side.
* The piece transducer reads the bytes of a piece; each transition is annotated with the change in emitted tokens. A
  state is what the rest of the piece can depend on: for each suffix that may still grow into a token, its place in the
  vocabulary's trie, the token that ends before it and the count up to there. Greedy merges give each prefix one last
  token, and a token may follow another where the two encode to themselves side by side, so the transitions are exact.
  States are compiled when first reached (and dropped together when `max_states` are held), and all pieces of a batch
  advance together, one byte each, as array look-ups.

Texts with characters outside the stable classes (see tokenizer.SAFE) are counted by the library itself; special
strings inside texts are one token each and split the text, as the library does by default.

Defined results: null and empty texts have no tokens. Ids may repeat or be null. No rows give no rows. Only id and text
are read. Texts are counted whole; a long piece costs time, not states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

L, N, O, A2, A3, WM, WS, WN, STOP = range(9)  # noqa: E741
#: States: a piece has ended; letters; numbers; others; white space; a space that joins what follows; 1 or 2 more
#: characters of a contraction.
E_, L_, N_, O_, W_, S_, C1, C2 = range(8)
CHUNK = 256


def _pre_tokenizer() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, (state, joins) in {L: (L_, (L_, S_)), N: (N_, (N_, S_)), O: (O_, (O_, S_)), A2: (C1, ()), A3: (C2, ()), WM: (W_, (W_,)), WS: (S_, ()), WN: (E_, ()), STOP: (E_, ())}.items():
        to[symbol] = state
        begins[symbol, list(joins)] = False
    for symbol in (A2, A3):  # an apostrophe inside a run of others, or after a joining space, starts no contraction
        to[symbol, [O_, S_]], begins[symbol, [O_, S_]] = O_, False
    to[:, C1], begins[:, C1] = E_, False
    to[:, C2], begins[:, C2] = C1, False
    to[STOP], begins[STOP] = E_, True
    return to, begins


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the chunk maps [chunk, state]: log2(chunks) rounds, each of all chunks at once."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


class PieceTransducer:
    """Lazily determinised transducer from the bytes of a piece to changes of the token count."""

    SHIFT = 16

    def __init__(self, vocabulary, max_states: int = 200_000):
        self.bytes_of = {v: k for k, v in vocabulary.tokens.items()}
        self.encode = vocabulary.piece._encode_single_piece
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, ident in vocabulary.tokens.items():
            node = 0
            for b in token:
                if (nxt := self.children[node].get(b)) is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = ident
        self.max_states, self.follows_ = max_states, {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        # rows are states, columns the bytes met so far; entry: next state << 6 | (change + SHIFT), -1 if not compiled
        self.column, self.byte, self.bits = np.full(256, -1, np.int64), [], 7
        self.table = np.full((1024, 1 << self.bits), -1, np.int32)
        self.state(((0, -1, 0),))

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Table columns of the bytes."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = len(self.byte)
            self.byte.append(b)
            if len(self.byte) > 1 << self.bits:
                self.bits += 1
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
        return self.column[data]

    def state(self, key: tuple) -> int:
        if (k := self.states.get(key)) is None:
            k = self.states[key] = len(self.keys)
            self.keys.append(key)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return k

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: nothing before)."""
        pair = (a, b)
        if (ok := self.follows_.get(pair)) is None:
            if len(self.follows_) > 1_000_000:
                self.follows_.clear()
            both = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            ok = self.follows_[pair] = self.encode(both) == ([a, b] if a >= 0 else [b])
        return ok

    def compile(self, state: int, column: int) -> int:
        live, last, byte = [], None, self.byte[column]
        for node, token, count in self.keys[state]:
            if (child := self.children[node].get(byte)) is not None:
                if self.children[child]:
                    live.append((child, token, count))
                if last is None and (t := self.token_at[child]) >= 0 and self.follows(token, t):
                    last = (t, count + 1)
        if last is None:
            raise ValueError(f"no token of the vocabulary ends with byte {byte}")
        token, change = last
        key = tuple(sorted((n, t, c - change) for n, t, c in live)) + ((0, token, 0),)
        if not -self.SHIFT <= change < 64 - self.SHIFT:
            raise ValueError("a change of the token count is out of range")
        out = self.table[state, column] = self.state(key) << 6 | (change + self.SHIFT)
        return int(out)

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start : start + length]."""
        if len(self.keys) > self.max_states:
            self.reset()
        data = self.columns(data)
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order].astype(np.int64), lengths[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        width = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
        for j, k in enumerate(width):
            if k < 8:  # a few long pieces: one after the other
                for i in range(k):
                    total[i] += self._one(data[at[i] + j : at[i] + left[i]], int(state[i])) + self.SHIFT * (left[i] - j)
                break
            key = (state[:k] << self.bits) | data[at[:k] + j]
            got = self.table.reshape(-1)[key]
            if (missing := np.flatnonzero(got < 0)).size:
                for x in np.unique(key[missing]).tolist():
                    self.compile(x >> self.bits, x & ((1 << self.bits) - 1))
                got = self.table.reshape(-1)[key]
            total[:k] += got & 63
            state[:k] = got >> 6
        out = np.empty_like(total)
        out[order] = total - self.SHIFT * left
        return out

    def _one(self, columns: np.ndarray, state: int) -> int:
        n = 0
        for b in columns.tolist():
            got = int(self.table[state, b])
            if got < 0:
                got = self.compile(state, b)
            n += (got & 63) - self.SHIFT
            state = got >> 6
        return n


class Counter:
    def __init__(self, path: str | None = None, max_states: int = 200_000):
        import regex

        from .tokenizer import SAFE, UNSAFE, Vocabulary

        self.vocabulary, self.unsafe = Vocabulary(path), UNSAFE
        self.pieces = PieceTransducer(self.vocabulary, max_states)
        self.to, self.begins = _pre_tokenizer()
        self.kind = np.full(0x110000, O, np.uint8)
        for a, b in SAFE:
            text = "".join(map(chr, range(a, b + 1)))
            for pattern, kind in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", WM)):
                for m in regex.finditer(pattern, text):
                    self.kind[a + m.start()] = kind

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain, owner, strange = [], [], []
        for k, text in enumerate(texts):
            if self.unsafe.search(text):
                strange.append(k)
            elif self.vocabulary.specials is not None and any(s in text for s in self.vocabulary.special):
                parts = self.vocabulary.specials.split(text)
                out[k] += len(parts) // 2
                plain += parts[::2]
                owner += [k] * len(parts[::2])
            else:
                plain.append(text)
                owner.append(k)
        for k, ids in zip(strange, self.vocabulary.library_ids([texts[k] for k in strange])):
            out[k] = len(ids)
        np.add.at(out, np.array(owner, np.int64), self._plain(plain))
        return out

    def _symbols(self, code: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Class of each character, lookahead included."""
        kind = self.kind[code]
        kind[stops] = STOP
        ahead = np.append(kind[1:], STOP)
        space = kind == WM
        last = space & (ahead != WM) & (ahead != STOP)
        kind[last] = WN
        kind[last & (code == 32)] = WS
        quote = np.flatnonzero(code == 39)
        quote = quote[kind[quote] == O]
        if quote.size:
            wide = np.append(code, [0, 0])
            wide[stops] = 0
            one, two = wide[quote + 1], wide[quote + 2]
            is_ = lambda x, s: np.isin(x, [ord(c) for c in s])
            kind[quote[is_(one, "stmd")]] = A2
            kind[quote[(is_(one, "rv") & (two == 101)) | ((one == 108) & (two == 108))]] = A3
        return kind

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        lanes = np.full(chunks * CHUNK, STOP, np.uint8)
        lanes[:n] = symbols
        columns = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
        flat, begins = self.to.reshape(-1), self.begins.reshape(-1)
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (chunks, 8))
        for column in columns:
            maps = flat[maps + (column * np.uint8(8))[:, None]]
        state = np.zeros(chunks, np.uint8)
        state[1:] = scan_maps(maps)[:-1, E_]
        out = np.empty((CHUNK, chunks), bool)
        for j, column in enumerate(columns):
            key = state + column * np.uint8(8)
            out[j] = begins[key]
            state = flat[key]
        return out.T.reshape(-1)[:n]

    def _plain(self, texts: list[str]) -> np.ndarray:
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        begin = np.flatnonzero(self.boundaries(self._symbols(code, stops)))
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.cumsum(size) - size
        starts = at[begin]
        lengths = np.diff(np.append(starts, at[-1] + 1))
        real = ~np.isin(begin, stops, assume_unique=True)
        tokens = np.zeros(len(begin), np.int64)
        tokens[real] = self.pieces.count(np.frombuffer(joined.encode(), np.uint8), starts[real], lengths[real])
        upto = np.append(0, np.cumsum(tokens))
        ends = np.searchsorted(begin, stops)
        return upto[ends] - upto[np.append(0, ends[:-1])]


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024,
    batch_chars: int = 1 << 20, max_states: int = 200_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path, max_states)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts, first, chars = [], 0, 0
            for k, text in enumerate(texts, 1):
                chars += len(text)
                if chars >= batch_chars or k == len(texts):
                    counts.append(counter.counts(texts[first:k]))
                    first, chars = k, 0
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(f"`{text_col}`")
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
