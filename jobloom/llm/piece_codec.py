"""Encoding to SentencePiece ids with byte offsets, and decoding.

Three steps in each task. Normalisation takes, at each place, the longest prefix that the model's
compiled character map knows and records from which source byte each normalised byte came.
The normalised text falls into segments that start with word marks; where no vocabulary piece
has a mark after another character, no merge can cross a segment's start, so that each distinct segment is
encoded once and its ids are reused. Each piece's normalised length then projects it to the
bytes of the source. Decoding goes from ids alone.

Edge cases: a null text counts as empty (begin and end ids only); rows and ids may repeat or be null,
each row gives one row; an empty table gives none; very long texts are one row's memory, a few times their bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
#: Distinct segments that one worker remembers before it starts anew (about 100 MB).
REMEMBERED = 400_000
#: Rows taken at a time, so that a batch's memory is bounded by its longest texts.
ROWS = 128


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, message[at : at + size]
            at += size


class CharMap:
    """The compiled character map: a double-array trie of source prefixes, and what replaces each."""

    def __init__(self, compiled: bytes):
        self.replace: dict[bytes, bytes] = {}
        self.longest = 0
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            units, blob = struct.unpack_from(f"<{size // 4}I", compiled, 4), compiled[4 + size :]
            self._walk(units, blob)
            self.longest = max(map(len, self.replace), default=0)

    def _walk(self, units: tuple[int, ...], blob: bytes) -> None:
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        todo = [(offset(units[0]), b"")]
        while todo:
            base, prefix = todo.pop()
            for byte in range(1, 256):
                node = base ^ byte
                if node >= len(units) or (units[node] & ((1 << 31) | 0xFF)) != byte:
                    continue
                below, key = node ^ offset(units[node]), prefix + bytes([byte])
                if units[node] & (1 << 8):
                    start = units[below] & ((1 << 31) - 1)
                    self.replace[key] = blob[start : blob.index(b"\0", start)]
                todo.append((below, key))

    def prefix(self, source: bytes, at: int) -> tuple[bytes, int]:
        """What replaces the longest known prefix at a place, else its one character; and the bytes taken."""
        for n in range(min(self.longest, len(source) - at), 0, -1):
            found = self.replace.get(source[at : at + n])
            if found is not None:
                return found, n
        lead = source[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return source[at : at + n], n


class Codec:
    """One model, as a worker holds it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = next((dict(_fields(v)) for k, v in _fields(model) if k == 3), {})
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.tidy, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.apart = self.dummy and self.escape and not self.tidy and not any(MARK in pieces[i].lstrip(MARK) for i in plain)
        surface = [b""] * n
        length = np.ones(n, np.int64)
        for i in plain:
            length[i] = len(pieces[i].encode())
            surface[i] = pieces[i].replace(MARK, " ").encode()
        for i in range(n):
            if self.library.is_byte(i):
                surface[i] = bytes([int(pieces[i][3:5], 16)])
            elif self.library.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif self.library.is_control(i):
                length[i] = 0
        self.length = length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(s) for s in surface], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.control = np.array([self.library.is_control(i) for i in range(n)])
        self.marked = np.array([pieces[i].startswith(MARK) for i in range(n)])
        self.begin, self.end = (np.uint32(x).tobytes() for x in (self.library.bos_id(), self.library.eos_id()))
        self.known: dict[str, bytes] = {}
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes, and its end, the source byte it came from."""
        source = text.encode()
        if not source:
            return "", np.zeros(1, np.int64)
        if not self.map.replace and not self.tidy and self.escape:
            raw = np.frombuffer(source, np.uint8)
            origin = np.repeat(np.arange(len(raw), dtype=np.int64), np.where(raw == 32, 3, 1))
            mark = [np.zeros(3 * self.dummy, np.int64)]
            return MARK * self.dummy + text.replace(" ", MARK), np.concatenate([*mark, origin, [len(raw)]])
        out, origin, at = bytearray(), [], 0
        mark = MARK.encode() if self.escape else b" "
        if self.tidy:
            while at < len(source):
                found, n = self.map.prefix(source, at)
                if found != b" ":
                    break
                at += n
            if at == len(source):
                return "", np.array([at], np.int64)
        if self.dummy:
            out += mark
            origin += [at] * len(mark)
        after_space = self.tidy
        while at < len(source):
            found, n = self.map.prefix(source, at)
            if after_space:
                found = found.lstrip(b" ")
            if found:
                new = found.replace(b" ", mark)
                out += new
                origin += [at] * len(new)
                after_space = found.endswith(b" ")
            after_space = after_space and self.tidy
            at += n
        if self.tidy:
            while out.endswith(mark):
                del out[-len(mark) :]
                at = origin[-len(mark)]
                del origin[-len(mark) :]
        return out.decode(), np.array([*origin, at], np.int64)

    def ids(self, text: str, normal: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, with begin and end."""
        if not self.apart:
            return self.begin + np.array(self.library.encode(text), np.uint32).tobytes() + self.end
        segments = self.cut.findall(normal)
        known = self.known
        new = list(set(segments).difference(known))
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(segments))
            # the library puts the first mark of a segment back
            for s, found in zip(new, self.library.encode([s[1:] for s in new], num_threads=1), strict=True):
                # of a lone mark there is nothing left to encode but the mark itself
                known[s] = np.array(found if len(s) > 1 else [self.library.piece_to_id(MARK)], np.uint32).tobytes()
        return self.begin + b"".join(map(known.__getitem__, segments)) + self.end

    def spans(self, ids: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """Begin and end of each id in the bytes of the source, as an array of pairs."""
        ends = np.cumsum(self.length[ids])
        return np.stack([origin[ends - self.length[ids]], origin[ends]], axis=1).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8."""
        ids = ids[~self.control[ids]]
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1])
        text = self.surface[where].tobytes()
        if (self.dummy or self.tidy) and self.marked[ids[0]]:
            text = text[1:]
        return text.decode("utf-8", "replace").encode()


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec for a model, kept between tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _load(spark: SparkSession, path: str):
    """The model's bytes, broadcast: a vocabulary file of fixed size, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _sliced(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (with begin and end), and begins and ends: each id's span in the text's UTF-8 bytes."""
    model = _load(docs.sparkSession, model_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model.value)
        for b in _sliced(batches):
            ids, spans = [], []
            for text in b.column(1).to_pylist():
                normal, origin = c.normalise(text or "")
                ids.append(np.frombuffer(c.ids(text or "", normal), np.uint32))
                spans.append(c.spans(ids[-1], origin))
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in ([i.astype(np.int32) for i in ids], [s[:, 0] for s in spans], [s[:, 1] for s in spans])]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["id", "ids", "begins", "ends"])

    out = f"id {kind}, ids array<int>, begins array<int>, ends array<int>"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text that the ids stand for (null ids: null)."""
    model = _load(df.sparkSession, model_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model.value)
        for b in _sliced(batches):
            texts = [None if x is None else c.decode(np.array(x, np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """What encode() and decode() give for each document, as counts and SHA-256 digests: id, n_tokens, ids_sha256,
    decoded_sha256, spans_sha256 (begin and end of each id as little-endian 32-bit integers), source_bytes,
    then the columns to keep.
    """
    model = _load(docs.sparkSession, model_path)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "source_bytes", *keep]

    def run(batches):
        c = codec(model.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in _sliced(batches):
            rows = []
            for text in b.column(1).to_pylist():
                normal, origin = c.normalise(text or "")
                raw = c.ids(text or "", normal)
                ids = np.frombuffer(raw, np.uint32)
                rows.append((len(ids), sha(raw), sha(c.decode(ids)), sha(c.spans(ids, origin).tobytes()), int(origin[-1])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], *b.columns[2:]], names)

    out = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, source_bytes bigint"
    out += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(docs[id_col], docs[text_col], *[docs[c] for c in keep]).mapInArrow(run, out).withColumnRenamed("id", id_col)


MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read

    return digests(read(spark, sf_dir, "documents"), default_model())
