"""Offset-preserving SentencePiece encoding (BPE models) and decoding, from the model file alone.

Normalisation follows the model's compiled character map: at each place the longest entry that the
rest of the text starts with is replaced, a character without entry stays, and every byte that comes
out remembers the byte of the source it came from.  The pieces of the normalised text are projected
through this alignment, so that each has the span of source bytes that it stands for.  Encoding merges
the adjacent pair of best score, leftmost first; characters outside the vocabulary become byte pieces
(where the model has them) or the unknown id.

No piece of such a model has the space mark behind another character (checked; else a text is one
chunk), so a text is cut before each run of space marks, and each distinct chunk is merged once per
worker.  Decoding looks up the bytes of each id and drops the space that stands for the start of the text.
Nothing is shuffled: Spark deals out the rows, a task holds one batch.

Defined cases: null and empty texts have no ids (and decode to an empty text).  Very long texts are
encoded whole.  Repeated rows and rows without id are encoded each for itself.  Ties of the merge score go to the leftmost pair.
Extra columns, whatever their names, don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C

MARK = "▁"
#: Chunks a worker remembers, and the longest of them in characters.
CACHE_CHUNKS = 400_000
CHUNK_CHARS = 64
#: Texts whose new chunks are merged together.
BATCH_TEXTS = 250
_TRIPLE = struct.Struct("3i")
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys whose values are places of NUL-ended replacements."""

    def __init__(self, compiled: bytes):
        self.entries: dict[str, bytes] = {}
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4)
            self.replacements = compiled[4 + size :]
            self._collect()
        self.longest = max(map(len, self.entries), default=0)
        self.heads = {k[0] for k in self.entries}

    def _collect(self) -> None:
        """Walk the trie: a node's unit holds the offset of its children, and each child the byte that leads to it."""
        units = self.units.tolist()
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        waiting = [(offset(units[0]), b"")]
        while waiting:
            base, key = waiting.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at < len(units) and units[at] & 0x800000FF == byte:
                    unit = units[at]
                    below = at ^ offset(unit)
                    if unit & 0x100:  # a value ends here
                        start = units[below] & 0x7FFFFFFF
                        word = key + bytes([byte])
                        self.entries[word.decode("utf-8")] = self.replacements[start : self.replacements.index(0, start)]
                    waiting.append((below, key + bytes([byte])))

    def prefix(self, text: str, at: int) -> str | None:
        """The longest entry at this place."""
        if text[at] in self.heads:
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if text[at : at + n] in self.entries:
                    return text[at : at + n]
        return None


def _few_merged(chunk: str, rank: dict[str, float]) -> list[str]:
    """Join the best pair, leftmost first, until no pair is a piece: all ranks are scanned each time."""
    symbols = list(chunk)
    get, none = rank.get, float("inf")
    ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        joined = symbols[i] + symbols[i + 1]
        symbols[i : i + 2] = [joined]
        del ranks[i]
        if i:
            ranks[i - 1] = get(symbols[i - 1] + joined, none)
        if i < len(ranks):
            ranks[i] = get(joined + symbols[i + 1], none)
    return symbols


def _many_merged(chunk: str, rank: dict[str, float]) -> list[str]:
    """The same with a heap of pairs, for long chunks."""
    symbols = list(chunk)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def pair(left: int, right: int) -> None:
        if left >= 0 and right < len(symbols):
            joined = symbols[left] + symbols[right]
            if joined in rank:
                heapq.heappush(heap, (rank[joined], left, right, joined))

    for i in range(len(symbols) - 1):
        pair(i, i + 1)
    while heap:
        _, left, right, joined = heapq.heappop(heap)
        if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined):
            continue
        symbols[left], symbols[right] = joined, ""
        after[left] = after[right]
        if after[right] < len(symbols):
            before[after[right]] = left
        pair(before[left], left)
        pair(left, after[left])
    return [s for s in symbols if s]


class PairTable:
    """Which two pieces join to which: an open-addressed table, so that many words merge at once in numpy."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, rank: dict[str, float], id_of: dict[str, int]):
        self.size = max(id_of.values(), default=0) + 1
        letters = sorted({c for p in id_of for c in p})
        #: Characters that are no piece but part of one follow the pieces.
        number = dict(id_of)
        for c in letters:
            number.setdefault(c, self.size + len(number) - len(id_of))
        self.character = np.full(0x110000, -1, dtype=np.int32)
        for c in letters:
            self.character[ord(c)] = number[c]
        place = {r: i for i, r in enumerate(sorted(set(rank.values())))}
        found = [(number[p[:i]], number[p[i:]], place[rank[p]], id_of[p]) for p in id_of for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        self.base = len(number) + self.size
        self.bits = max(len(found), 1).bit_length() + 2
        self.key, self.rank, self.joined = (np.full(1 << self.bits, x, dtype=t) for x, t in ((-1, np.int64), (self.NONE, np.int32), (-1, np.int32)))
        for a, b, r, i in found:
            at = int(self._slot(np.array([a * self.base + b]))[0])
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.rank[at], self.joined[at] = a * self.base + b, r, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * C.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each joined pair; rank NONE where it is no piece."""
        key = a.astype(np.int64) * self.base + b
        at = self._slot(key)
        waiting = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(waiting):
            at[waiting] = (at[waiting] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[waiting]]
            waiting = waiting[(held != key[waiting]) & (held >= 0)]
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], self.NONE), self.joined[at]

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of character numbers, filled up with -1: join the best pair of every row, leftmost first, until none
        is a piece.  The pieces stay where their first character was, the others become -1."""
        n, width = symbols.shape
        s = np.concatenate([symbols, np.full((n, 1), -1, dtype=np.int32)], axis=1)
        rank, joined = (np.full((n, width + 1), x, dtype=np.int32) for x in (self.NONE, -1))
        row, col = np.nonzero(s[:, 1:] >= 0)
        rank[row, col], joined[row, col] = self.pairs(s[row, col], s[row, col + 1])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(axis=1)
            going = rank[live, at] < self.NONE
            live, at = live[going], at[going]
            right = after[live, at]
            far = np.minimum(after[live, right], width)
            s[live, at], s[live, right] = joined[live, at], -1
            rank[live, right] = self.NONE
            after[live, at], before[live, far] = far, at
            for left, other in ((at, far), (before[live, at], at)):
                a, b = s[live, left], s[live, other]
                real = (left >= 0) & (a >= 0) & (b >= 0)
                r, j = self.pairs(np.where(real, a, 0), np.where(real, b, 0))
                keep = left >= 0
                rank[live[keep], left[keep]] = np.where(real, r, self.NONE)[keep]
                joined[live[keep], left[keep]] = j[keep]
        return s[:, :width]


class PieceModel:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        trainer, normal = model.trainer_spec, model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if trainer.model_type != pb.TrainerSpec.BPE or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that mark the space before a word")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharacterMap(normal.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces
        self.fallback = trainer.byte_fallback
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.rank = {p: -model.pieces[i].score for p, i in self.id_of.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        surface = {kinds.CONTROL: b"", kinds.UNKNOWN: trainer.unk_surface.encode()}
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else surface.get(p.type, p.piece.replace(MARK, " ").encode())
            for p in model.pieces
        ]
        self.whole = any(MARK in p.lstrip(MARK) for p in self.id_of)
        #: Without entries and squeezing each character stands for itself.
        self.plain = not self.map.entries and not self.squeeze
        self.table = PairTable(self.rank, self.id_of)
        self.spare = (len(MARK.encode()) - 1) * self.escape
        self.sizes = np.zeros((self.table.size, 3), dtype=np.int32)
        for p, i in self.id_of.items():
            self.sizes[i] = i, *self._sizes(p)
        self.literal = {self.unknown, *self.byte_id.values()}
        self.cache: dict[str, bytes] = {}

    # Normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The text to encode and, per byte of it and for its end, the byte of the source it came from (None where
        it is that of ``plain`` models, which ``_plain_alignment`` gives)."""
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        if self.plain:
            marked = text.replace(" ", MARK) if self.escape else text
            return (MARK if self.escape else " ") * self.dummy + marked, None
        space = MARK if self.escape else " "
        parts: list[str] = []
        sizes: list[int] = []  # bytes of each part, its source byte
        sources: list[int] = []
        pieces = list(self._replaced(text))
        begin = 0
        if self.squeeze:
            while begin < len(pieces) and pieces[begin][0] == " ":
                begin += 1
        if begin == len(pieces):
            return "", np.zeros(1, dtype=np.int64)
        source = pieces[begin][1]

        def put(part: str, origin: int) -> None:
            parts.append(part)
            sizes.append(len(part.encode("utf-8", "surrogatepass")))
            sources.append(origin)

        if self.dummy:
            put(space, source)
        blank = self.squeeze
        for out, origin, end in pieces[begin:]:
            if blank:
                out = out.lstrip(" ")
            if out:
                for c in out:
                    put(space if c == " " else c, origin)
                blank = out.endswith(" ")
            source = end
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while parts and parts[-1] == space:
                source = sources.pop()
                parts.pop()
                sizes.pop()
        return "".join(parts), np.append(np.repeat(sources, sizes), source).astype(np.int64)

    def _replaced(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Normalised prefixes with their first source byte and the byte behind them."""
        at, byte = 0, 0
        while at < len(text):
            found = self.map.prefix(text, at)
            taken = found or text[at]
            end = byte + len(taken.encode("utf-8", "surrogatepass"))
            yield (self.map.entries[found].decode("utf-8") if found else taken), byte, end
            at, byte = at + len(taken), end

    def _plain_alignment(self, text: str) -> np.ndarray:
        """Of each byte of the normalised text: the mark before the text stands at 0, a mark for a space has three bytes."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        width = np.where(raw == 0x20, len(MARK.encode()), 1) if self.escape else np.ones(len(raw), dtype=np.int64)
        head = [0] * (self.dummy * (len(MARK.encode()) if self.escape else 1))
        return np.concatenate([head, np.repeat(np.arange(len(raw)), width), [len(raw)]]).astype(np.int64)

    # Encoding

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes from ``start`` to ``end`` of each.

        Of the byte pieces of one character the last has its span, as in the library."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each; chunks that are not in the cache are merged together."""
        normal = [self.normalised(t or "") for t in texts]
        chunks = [[n] if self.whole else _CHUNKS.findall(n) for n, _ in normal]
        known = self.cache
        new = list({c for row in chunks for c in row if c not in known})
        local = dict(zip(new, self._merge(new), strict=True))
        out = []
        for text, (_, source), row in zip(texts, normal, chunks, strict=True):
            packed = b"".join([known.get(c) or local[c] for c in row])
            out.append(self._spans(text or "", source, np.frombuffer(packed, dtype=np.int32).reshape(-1, 3)))
        if len(known) + len(new) > CACHE_CHUNKS:
            known.clear()
        known.update((c, p) for c, p in local.items() if len(c) <= CHUNK_CHARS)
        return out

    def _spans(self, text: str, source: np.ndarray | None, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = packed[:, 0]
        if not len(ids):
            return ids, ids, ids
        if source is None and MARK not in text:  # each mark stands for a space, but for the one before the text
            end = np.cumsum(packed[:, 2]) - self.dummy
            return ids, np.maximum(end - packed[:, 2], 0).astype(np.int32), end.astype(np.int32)
        if source is None:
            source = self._plain_alignment(text)
        end = np.cumsum(packed[:, 1])
        begin = end - packed[:, 1]
        return ids, source[begin].astype(np.int32), np.where(end > begin, source[end], source[begin]).astype(np.int32)

    def _merge(self, chunks: list[str]) -> list[bytes]:
        """Of each chunk its pieces as (id, bytes, bytes with one for each mark), packed."""
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.table.character[codes]
        starts = np.cumsum(sizes) - sizes
        odd = sizes > 32
        if len(codes):
            odd |= np.minimum.reduceat(symbols, starts) < 0
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 32)):  # little filling up
            rows = np.flatnonzero(~odd & (sizes > low) & (sizes <= high))
            for first in range(0, len(rows), 1 << 15):
                part = rows[first : first + (1 << 15)]
                at = np.arange(high)[None, :]
                inside = at < sizes[part][:, None]
                filled = np.where(inside, symbols[np.minimum(starts[part][:, None] + at, len(codes) - 1)], -1).astype(np.int32)
                merged = self.table.merged(filled)
                odd[part[(merged >= self.table.size).any(axis=1)]] = True
                held = merged >= 0
                data = self.sizes[np.minimum(merged[held], self.table.size - 1)].tobytes()
                ends = np.cumsum(held.sum(axis=1)) * _TRIPLE.size
                for i, a, b in zip(part.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = data[a:b]
        for i in np.flatnonzero(odd).tolist():
            pieces = _few_merged(chunks[i], self.rank) if sizes[i] <= 32 else _many_merged(chunks[i], self.rank)
            out[i] = b"".join([_TRIPLE.pack(*piece) for piece in self._pieces(pieces)])
        return out

    def _sizes(self, symbol: str) -> tuple[int, int]:
        size = len(symbol.encode("utf-8", "surrogatepass"))
        return size, size - self.spare * symbol.count(MARK)

    def _pieces(self, symbols: list[str]) -> list[tuple[int, int, int]]:
        """Of each piece the id, its bytes, and its bytes with one for each mark; all but the last byte piece of a character have none."""
        out: list[tuple[int, int, int]] = []
        unknown = False
        for s in symbols:
            found, raw = self.id_of.get(s), s.encode("utf-8", "surrogatepass")
            size, short = self._sizes(s)
            if found is None and self.fallback:
                out += [(self.byte_id[b], 0, 0) for b in raw[:-1]] + [(self.byte_id[raw[-1]], size, short)]
            elif found is None and unknown:
                out[-1] = (self.unknown, out[-1][1] + size, out[-1][2] + short)
            else:
                out.append((self.unknown if found is None else found, size, short))
            unknown = found is None
        return out

    # Decoding

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        raw = list(map(surface.__getitem__, ids))
        for k, piece in enumerate(ids if self.dummy or self.squeeze else ()):
            if raw[k]:
                if piece in self.literal or not raw[k].startswith(b" "):
                    break
                raw[k] = raw[k][1:]
                if raw[k] or not self.squeeze:
                    break
        return b"".join(raw).decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


_INTS = pa.list_(pa.int32())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``ids``, and the source bytes (of the text in UTF-8) from ``starts`` to ``ends`` of each piece."""
    C.prepare(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids, starts, ends = [], [], []
            texts = batch.column("text").to_pylist()
            for first in range(0, len(texts), BATCH_TEXTS):
                for i, a, b in m.encode_many(texts[first : first + BATCH_TEXTS]):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(ids), _lists(starts), _lists(ends)], names=["doc", "ids", "starts", "ends"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    rows = rows.mapInArrow(encoded, f"doc {kind}, ids array<int>, starts array<int>, ends array<int>")
    return rows.select(F.col("doc").alias(key), "ids", "starts", "ends")


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for."""
    C.prepare(rows.sparkSession)
    names = rows.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(ids)
            at, flat = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).tolist()  # null lists are empty ones
            texts = [m.decode(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text])

    return rows.mapInArrow(decoded, StructType([*rows.schema.fields, StructField(text, StringType())]))


def piece_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of ids, digests of the ids and of the text decoded from them, and the source bytes that the spans cover."""
    found = decode_ids(encode_texts(docs, path, key, text), path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (total("ends") - total("starts")).alias("covered_bytes"),
    )
