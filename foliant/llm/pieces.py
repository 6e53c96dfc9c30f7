"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback and white-space markers.

No piece holds a white-space marker after another character, so a text's best path is the best paths of its chunks (a run of
spaces with the word after it), one after the other. A task finds the best path of each distinct chunk once, many chunks in step
with one another in numpy, and texts are put together from those.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import lean, row_slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_CHUNK = re.compile(r" *[^ \n\t]+| +|[\n\t]")
#: Bytes of chunks whose paths are found together; chunks longer than LONG are cut where no piece crosses; chunks, and their characters,
#: that a task remembers.
_TOGETHER, _LONG, _MEMO, _MEMO_CHARS = 1 << 17, 4096, 200_000, 8 << 20
_UNIGRAM, _NORMAL, _UNKNOWN, _USER, _BYTE = 1, 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers, 4- and 8-byte values raw, strings and messages as bytes."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces as bytes with the marker as a space, their log scores, and the double-array trie over them.

    A state s goes by byte c to t = base[s] + c if check[t] = s; value[t] is the piece that ends there, or -1.
    """

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    prefix: bool
    unknown_score: float


def _double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, piece in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = piece
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    check[0] = 0
    place, queue, low = {0: 0}, [0], 1
    for node in queue:
        state, kids = place[node], children[node]
        if not kids:
            continue
        codes = np.array(sorted(kids))
        while not free[low]:
            low += 1
        b, at = 0, max(low, int(codes[0]) + 1)
        while not b:  # the first free cell from which all children fit
            cells = at + np.flatnonzero(free[at : at + 4096])
            if len(codes) > 1:
                cells = cells[cells - codes[0] + codes[-1] < size]
                cells = cells[free[(cells - codes[0])[:, None] + codes[None, :]].all(axis=1)]
            b = int(cells[0] - codes[0]) if len(cells) else 0
            at += 4096
        base[state] = b
        free[b + codes] = False
        check[b + codes] = state
        for c in codes.tolist():
            value[b + c] = ends[kids[c]]
            place[kids[c]] = b + c
            queue.append(kids[c])
    return base, check, value


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a .model file on the driver. A unigram model's scores are taken as they are. Another kind has merge ranks only; a
    piece of rank r then has the log probability of Zipf and Mandelbrot's law, -log(r + 2.7) less the log of the sum over all. Texts
    are encoded as they stand, without the model's normaliser, so that decoding gives them back; a model with user-defined pieces,
    which would be cut out before the search, is refused."""
    pieces, scores, kinds, model, prefix = [], [], [], _UNIGRAM, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
    score, kind = np.array(scores, float), np.array(kinds)
    if (kind == _USER).any():
        raise ValueError("user-defined pieces")
    normal = kind == _NORMAL
    if model != _UNIGRAM:
        rank = np.empty(int(normal.sum()))
        rank[np.argsort(-score[normal], kind="stable")] = np.arange(len(rank))
        weight = 1 / (rank + 2.7)
        score[normal] = np.log(weight / weight.sum())
    byte_ids = np.full(256, -1, np.int32)
    for i in np.flatnonzero(kind == _BYTE):
        byte_ids[int(pieces[i][3:-1], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("a vocabulary with byte pieces is needed")
    plain = [p.replace(_MARK, " ").encode() if n else (bytes([int(p[3:-1], 16)]) if k == _BYTE else b"") for p, n, k in zip(pieces, normal, kinds)]
    if any(re.search(r"[^ ] |[\n\t]", p.decode()) for p, n in zip(plain, normal) if n):
        raise ValueError("pieces across white space")
    return Vocabulary(plain, score, byte_ids, *_double_array([(p, i) for i, (p, n) in enumerate(zip(plain, normal)) if n and p]), prefix, float(score[normal].min()) - 10)


class Encoder:
    """Token ids of texts, with a memory of chunks. The best path has the highest sum of scores; on a tie, the earliest start, hence
    the longest piece, wins at every position. Characters without a piece cost unknown_score each and give their bytes' pieces."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.byte_table = [v.byte_ids[b] for b in range(256)]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.pending: list[str] = []
        self.pool = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _paths(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, number of ids of each)."""
        v = self.v
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        buf = np.frombuffer(b"".join(chunks), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        stop = (first + sizes)[chunk]
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        after = np.concatenate((lead[1:], [len(buf)]))
        # All pieces from each character, one byte further at a time.
        at, state, n = lead, np.zeros(len(lead), np.int64), 0
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            inside = at + n < stop[at]
            at, state = at[inside], state[inside]
            step = v.base[state].astype(np.int64) + buf[at + n]
            ok = (v.check[step] == state) & (step > 0)
            at, state = at[ok], step[ok]
            n += 1
            piece = v.value[state]
            hit = piece >= 0
            edges.append((at[hit], at[hit] + n, piece[hit]))
        covered = np.zeros(len(buf) + 1, bool)
        width = np.zeros(len(buf), np.int64)
        width[lead] = after - lead
        for s, e, _ in edges:
            covered[s[e - s == width[s]]] = True
        lost = ~covered[lead]
        edges.append((lead[lost], after[lost], np.full(int(lost.sum()), -1, np.int32)))
        start, end, piece = (np.concatenate([e[i] for e in edges]) for i in range(3))
        score = np.where(piece >= 0, v.scores[piece], v.unknown_score)
        # Node of a byte position: shifted by the chunk's number, so that each chunk has its own end.
        own = chunk[start]
        a, b = start + own, end + own
        far = end - first[own]
        order = np.lexsort((start, b, far))
        a, b, piece, score, far = a[order], b[order], piece[order], score[order], far[order]
        best = np.full(len(buf) + len(chunks) + 1, -np.inf)
        best[first + np.arange(len(chunks))] = 0.0
        back = np.full(len(best), -1, np.int64)
        levels = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))) if len(far) else np.empty(0, np.int64)
        for lo, hi in zip(levels.tolist(), [*levels[1:].tolist(), len(far)]):
            total = best[a[lo:hi]] + score[lo:hi]
            target = b[lo:hi]
            heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            top = np.maximum.reduceat(total, heads)
            won = np.flatnonzero(total == np.repeat(top, np.diff(np.concatenate((heads, [hi - lo])))))
            node, place = np.unique(target[won], return_index=True)
            best[node] = total[won[place]]
            back[node] = lo + won[place]
        # Walk back from all ends in step.
        node, who = first + sizes + np.arange(len(chunks)), np.arange(len(chunks))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(node):
            edge = back[node]
            live = edge >= 0
            node, who, edge = node[live], who[live], edge[live]
            steps.append((who, edge))
            node = a[edge]
        who, edge = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps]), who))
        who, edge = who[order], edge[order]
        ids, lens = piece[edge], np.ones(len(edge), np.int64)
        unknown = ids < 0
        if unknown.any():
            lens[unknown] = b[edge[unknown]] - a[edge[unknown]]
            out = np.repeat(ids, lens)
            spot = np.repeat(a[edge] - who, lens) + np.arange(len(out)) - np.repeat(np.cumsum(lens) - lens, lens)
            raw = out < 0
            out[raw] = v.byte_ids[buf[spot[raw]]]
            ids, who = out, np.repeat(who, lens)
        return ids.astype(np.int32), np.bincount(who, minlength=len(chunks))

    def _stretches(self, data: bytes) -> Iterator[bytes]:
        """A long chunk in parts that every path goes through: cut before characters that no piece from an earlier one reaches over."""
        v, n, start, reach = self.v, len(data), 0, 0
        buf = np.frombuffer(data, np.uint8)
        for lo in range(0, n, _TOGETHER):
            lead = lo + np.flatnonzero((buf[lo : lo + _TOGETHER] & 0xC0) != 0x80)
            far = np.append(lead[1:], min(n, lo + _TOGETHER))
            at, state, who = lead, np.zeros(len(lead), np.int64), np.arange(len(lead))
            while len(at):
                inside = at < n
                at, state, who = at[inside], state[inside], who[inside]
                step = v.base[state].astype(np.int64) + buf[at]
                ok = (v.check[step] == state) & (step > 0)
                at, state, who = at[ok] + 1, step[ok], who[ok]
                hit = v.value[state] >= 0
                far[who[hit]] = np.maximum(far[who[hit]], at[hit])
            before = np.maximum.accumulate(np.concatenate(([reach], far)))
            for cut in lead[before[:-1] <= lead].tolist():
                if cut - start >= 32:
                    yield data[start:cut]
                    start = cut
            reach = int(before[-1])
        yield data[start:]

    def _long(self, data: bytes) -> list[int]:
        """The path of one long chunk that can't be cut, position by position: memory in proportion to its length."""
        v, n = self.v, len(data)
        base, check, value, scores = v.base, v.check, v.value, v.scores
        best, came, by = [float("-inf")] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            width = 1
            while i + width < n and data[i + width] & 0xC0 == 0x80:
                width += 1
            state, j, single, here = 0, i, False, best[i]
            while j < n:
                step = int(base[state]) + data[j]
                if step <= 0 or check[step] != state:
                    break
                state, j = step, j + 1
                piece = int(value[state])
                if piece >= 0:
                    single = single or j - i == width
                    total = here + float(scores[piece])
                    if total > best[j]:
                        best[j], came[j], by[j] = total, i, piece
            if not single and here + v.unknown_score > best[i + width]:
                best[i + width], came[i + width], by[i + width] = here + v.unknown_score, i, -1
            i += width
        out: list[int] = []
        while n > 0:
            out.extend([by[n]] if by[n] >= 0 else [int(v.byte_ids[c]) for c in reversed(data[came[n] : n])])
            n = came[n]
        return out[::-1]

    def _settle(self) -> None:
        """Paths of the chunks met since the last call."""
        ids, counts = [self.pool], []
        group: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                got, n = self._paths(group)
                ids.append(got)
                counts.append(n)
                group, size = [], 0

        def add(data: bytes) -> None:
            nonlocal size
            group.append(data)
            size += len(data)
            if size > _TOGETHER:
                flush()

        for c in self.pending:
            data = c.encode("utf-8", "surrogatepass")
            if len(data) > _LONG:
                flush()
                before = len(counts)
                for part in self._stretches(data):
                    if len(part) <= _LONG:
                        add(part)
                        continue
                    flush()
                    ids.append(np.array(self._long(part), np.int32))
                    counts.append(np.array([len(ids[-1])], np.int64))
                flush()
                counts[before:] = [np.array([sum(int(n.sum()) for n in counts[before:])], np.int64)]
                continue
            add(data)
        flush()
        self.pending = []
        self.pool = np.concatenate(ids)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts)))) if counts else self.starts

    def _chunks(self, text: str) -> Iterator[list[str]]:
        text = " " + text if self.v.prefix and text else text
        at = 0
        while len(text) - at > 1 << 20:
            end = text.find(" ", at + (1 << 20))
            while end > 0 and text[end - 1] == " ":
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield _CHUNK.findall(text, at, end)
            at = end
        yield _CHUNK.findall(text, at)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; of a null or empty one, none."""
        if len(self.memo) > _MEMO or self.chars > _MEMO_CHARS:
            self.forget()
        memo, pending = self.memo, self.pending
        found: list[list[np.ndarray]] = []
        for text in texts:
            parts = []
            for chunks in self._chunks(text or ""):
                try:
                    parts.append(np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks)))
                except KeyError:
                    for c in chunks:
                        if c not in memo:
                            memo[c] = len(memo)
                            self.chars += len(c)
                            pending.append(c)
                    parts.append(np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks)))
            found.append(parts)
        self._settle()
        out = []
        for parts in found:
            of = np.concatenate(parts) if parts else np.empty(0, np.int64)
            lens = self.starts[of + 1] - self.starts[of]
            ends = np.cumsum(lens)
            spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[of] - ends + lens, lens)
            out.append(self.pool[spots])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as bytes, markers as spaces, the dummy prefix dropped. Broken UTF-8 becomes
        U+FFFD; control pieces give nothing."""
        data = b"".join(map(self.v.pieces.__getitem__, ids.tolist()))
        if self.v.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, verify: bool = True) -> DataFrame:
    """Adds ids array<int>, n_tokens int and, where `verify`, round_trip boolean (the ids decode to the very text) to docs(.., text).

    Every row is kept with its columns; columns of those names are replaced. A null text encodes as empty. The vocabulary (some
    hundred kilobytes, by the file) goes to the tasks as a broadcast of plain values.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(vars(vocabulary(path)).values()))
    keep = docs.drop("ids", "n_tokens", "round_trip")
    columns = keep.columns
    added = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.IntegerType())] + ([("round_trip", T.BooleanType())] if verify else [])
    result = keep.schema
    for name, kind in added:
        result = T.StructType([*result.fields, T.StructField(name, kind)])
    at = columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for whole in batches:
            for b in row_slices(whole, 1000):
                texts = b.column(at).to_pylist()
                ids = encoder.encode(texts)
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))), pa.array(np.diff(ends), pa.int32())]
                if verify:
                    new.append(pa.array([encoder.decode(i) == (t or "") for i, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*columns, *(a[0] for a in added)])

    return keep.mapInArrow(lean(work), result)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """Adds text, decoded from tokens(.., ids array<int>), in place of a column of that name. Null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(tuple(vars(vocabulary(path)).values()))
    keep = tokens.drop("text")
    columns = keep.columns
    at = columns.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for b in batches:
            texts = [encoder.decode(np.array(i.as_py() or [], np.int32)) for i in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, "text"])

    return keep.mapInArrow(lean(work), T.StructType([*keep.schema.fields, T.StructField("text", T.StringType())]))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
