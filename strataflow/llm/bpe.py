"""Operator 1: byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. A text is read in chunks; a pre-token that is still open at the end of a chunk is carried on. Inside a
pre-token, bytes enter a buffer, and a token leaves as soon as it is stable. ``sufficient_lookahead`` computes from the
merge list how many bytes right of a boundary can decide whether some merge removes that boundary; tokens that end at
least so far before the end of the buffer can't change any more. Tokens right of a lasting boundary are the
tokens of the rest alone, so the buffer restarts there. Memory is a chunk, the lookahead and a bounded cache of short
pre-tokens, whatever the length of the text or of one pre-token.

Decoding. Token bytes run through an incremental UTF-8 state machine; a sequence cut between tokens waits for its
rest, and malformed bytes become U+FFFD, one for each maximal ill-formed part.

Cases: null text counts as the empty text (no tokens); very long texts and very long pre-tokens stream; equal rows give
equal rows; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Characters read at a time, pre-tokens (characters) that are cached, and entries of one half of the cache.
CHUNK, CACHED_LEN, CACHED = 1 << 16, 48, 1 << 18
#: Bytes that a pre-token's buffer takes in beyond the lookahead before stable tokens leave it.
STEP = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, ids = byte_alphabet(), spec["model"]["vocab"]
        plain = {k: bytes(to_byte[c] for c in k) for k in ids if all(c in to_byte for c in k)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for k, i in ids.items():
            self.bytes_of[i] = plain.get(k, k.encode())
        for k, i in self.added.items():
            self.bytes_of[i] = k.encode()
        self.byte_id = [ids[c] for c, b in sorted(to_byte.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}

    def sufficient_lookahead(self) -> int:
        """Bytes right of a boundary that suffice to tell whether any merge removes the boundary.

        For a merge (x, y) to happen at a boundary, y must stand right of it. y forms as it would alone unless a
        merge across y's own right end takes part of y first; that part is a token on the right edge of y's
        derivation, still whole, so that merge ranks below the one that would take the part up. This gives
        need(x, y) = len(y) + max need of those merges, by rank; the answer is the largest need."""
        born: dict[int, tuple[int, int]] = {}  # token -> (rank, right part) of the merge that makes it
        left: dict[int, tuple[list[int], list[int]]] = {}  # left part -> ranks and running maxima of need
        most = 0
        for (a, b), (rank, new) in self.merges.items():
            need, part, until = 0, b, rank
            while True:
                ranks, maxima = left.get(part, ((), ()))
                k = bisect_left(ranks, until)
                need = max(need, maxima[k - 1] if k else 0)
                if part not in born:
                    break
                until, part = born[part]
            need += len(self.bytes_of[b])
            ranks, maxima = left.setdefault(a, ([], []))
            ranks.append(rank)
            maxima.append(max(need, maxima[-1] if maxima else 0))
            born.setdefault(new, (rank, b))
            most = max(most, need)
        return most


def merge(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """Token ids of data taken as one pre-token: least rank first, leftmost first."""
    ids, merges = [vocabulary.byte_id[b] for b in data], vocabulary.merges
    if len(ids) <= 24:  # short: rescans are cheaper than a queue
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                m = merges.get((ids[k], ids[k + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids
    after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
    queue = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := merges.get((ids[k], ids[k + 1])))]
    heapq.heapify(queue)
    while queue:
        _, k, new, a, b = heapq.heappop(queue)
        if ids[k] != a or (j := after[k]) < 0 or ids[j] != b:
            continue
        ids[k], ids[j] = new, -1
        after[k] = after[j]
        if after[j] >= 0:
            before[after[j]] = k
            if m := merges.get((new, ids[after[j]])):
                heapq.heappush(queue, (m[0], k, m[1], new, ids[after[j]]))
        if before[k] >= 0 and (m := merges.get((ids[before[k]], new))):
            heapq.heappush(queue, (m[0], before[k], m[1], ids[before[k]], new))
    return [i for i in ids if i >= 0]


class PieceTransducer:
    """Encodes one pre-token whose bytes arrive in parts."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int):
        self.vocabulary, self.lookahead, self.buffer = vocabulary, lookahead, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), STEP):
            self.buffer += data[k : k + STEP]
            if len(self.buffer) < self.lookahead + STEP:
                continue
            at = 0
            for i in merge(self.vocabulary, self.buffer):
                end = at + len(self.vocabulary.bytes_of[i])
                if end > len(self.buffer) - self.lookahead:
                    break
                out.append(i)
                at = end
            self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[int]:
        out, self.buffer = merge(self.vocabulary, self.buffer), b""
        return out


class _Cache(dict):
    """Pre-token -> ids. What is used again in a while stays; memory is bounded by two halves of CACHED entries."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > CACHED_LEN:
            return self.encode(piece)
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Texts to ids. ``stream`` takes a text in parts and yields lists of ids as they become stable."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.lookahead = vocabulary, vocabulary.sufficient_lookahead()
        # The pre-token pattern of this vocabulary's byte-level family.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.runs = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
        self.space = regex.compile(r"\s")
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.keep = max([1, *map(len, vocabulary.added)]) - 1  # characters that may begin an added token
        self.cache = _Cache(self._piece)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) <= self.lookahead + STEP:
            return tuple(merge(self.vocabulary, data))
        t = PieceTransducer(self.vocabulary, self.lookahead)
        return (*t.feed(data), *t.finish())

    def _ids(self, pieces: list[str]) -> list[int]:
        return [i for ids in map(self.cache.__getitem__, pieces) for i in ids]

    def _cut(self, text: str) -> int:
        """A late place before white space that follows other text: always a boundary of pre-tokens."""
        for k in range(len(text) - 2, max(0, len(text) - 4096), -1):
            if text[k].isspace() and not text[k - 1].isspace() and self.space.match(text[k]) and not self.space.match(text[k - 1]):
                return k
        return 0

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        rest, segment = "", _Segment(self)
        for part in parts:
            rest += part
            while self.added and (m := self.added.search(rest)):
                yield segment.push(rest[: m.start()], True)
                yield [self.vocabulary.added[m[0]]]
                rest, segment = rest[m.end() :], _Segment(self)
            hold = max(0, len(rest) - self.keep) if self.added else len(rest)
            yield segment.push(rest[:hold], False)
            rest = rest[hold:]
        yield segment.push(rest, True)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= CHUNK and not (self.added and self.added.search(text)):
            return self._ids(self.pattern.findall(text))
        return [i for ids in self.stream(text[k : k + CHUNK] for k in range(0, len(text), CHUNK)) for i in ids]


class _Segment:
    """Text without added tokens, in parts: what is still open, and the transducer of a pre-token longer than a chunk."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.rest, self.run, self.piece = encoder, "", None, None

    def push(self, part: str, last: bool) -> list[int]:
        e, text, out = self.encoder, self.rest + part, []
        self.rest = ""
        spaces = e.runs[3]
        if self.run is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            if self.run is spaces and not (last and end == len(text)):
                end = max(0, end - 1)  # the last space may begin the next pre-token
            out += self.piece.feed(text[:end].encode())
            text = text[end:]
            if not last and (not text or (self.run is spaces and len(text) == 1 and spaces.match(text))):
                self.rest = text
                return out
            out += self.piece.finish()
            self.run = self.piece = None
        if last:
            return out + e._ids(e.pattern.findall(text))
        if cut := e._cut(text):
            self.rest = text[cut:]
            return out + e._ids(e.pattern.findall(text[:cut]))
        if len(text) < CHUNK:
            self.rest = text
            return out
        pieces, at = e.pattern.findall(text), len(text)  # no gap in a whole chunk
        while pieces and at > len(text) - 3:  # these may still change
            at -= len(pieces.pop())
        out += e._ids(pieces)
        self.rest = text[at:]
        if len(self.rest) > CACHED_LEN:
            body = self.rest[1:] if self.rest[0] == " " and not spaces.match(self.rest[1]) else self.rest
            run = next(r for r in e.runs if r.match(body))
            if run.match(body).end() == len(body):
                self.run, self.piece = run, PieceTransducer(e.vocabulary, e.lookahead)
                hold = len(self.rest) - (run is spaces)
                out += self.piece.feed(self.rest[:hold].encode())
                self.rest = self.rest[hold:]
        return out


class Decoder:
    """Ids to text, in parts: bytes that don't end a character yet wait in the state machine."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of, self.state = vocabulary.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One for each worker and vocabulary."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>: one row for each row of docs."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = pa.array([e.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for b in batches:
            texts = pa.array([Decoder(v).feed(ids or (), True) for ids in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids are hashed and decoded as they leave the transducer."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        names = [f",{i}" for i in range(len(e.vocabulary.bytes_of))]

        def one(t: str | None) -> tuple[int, str, str]:
            n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.vocabulary)
            t = t or ""
            for ids in e.stream(t[k : k + CHUNK] for k in range(0, len(t), CHUNK)):
                listed = "".join(map(names.__getitem__, ids))
                of_ids.update((listed if n else listed[1:]).encode())
                of_text.update(decoder.feed(ids).encode())
                n += len(ids)
            of_text.update(decoder.feed((), True).encode())
            return n, of_ids.hexdigest(), of_text.hexdigest()

        for b in batches:
            n, i, d = zip(*map(one, b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return round_trip(read(spark, sf_dir, "documents"))
