"""SentencePiece encoding that keeps, for every piece, the byte span of the original text.

The model's compiled character map is read as it is stored: a double-array trie over source strings, whose leaves point at
replacements.  Normalisation takes, at each place, the longest source string that the trie holds, and records for each
normalised byte the byte it came from.  Pieces tile the normalised text, so that record projects each to original bytes.
The ids themselves are the library's, by contract; the alignment is this module's.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()


class CharacterMap:
    """Longest-prefix lookup in a compiled character map (the published double-array format)."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the source string, replacement) of the longest entry that starts at ``at``."""
        if not self.units:
            return None

        def step(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        pos, found = step(self.units[0]), None
        for i in range(at, len(data)):
            pos ^= data[i]
            if pos >= len(self.units) or self.units[pos] & 0x800000FF != data[i]:
                break
            unit = self.units[pos]
            pos ^= step(unit)
            if unit >> 8 & 1:
                start = self.units[pos] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


def _character(data: bytes, at: int) -> tuple[int, bytes]:
    """The UTF-8 character at ``at`` as it is: its bytes and itself."""
    n = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
    return n, data[at : at + n]


class Normaliser:
    """A model's normalisation, with the source of every byte.  ``symbols`` (user-defined pieces) pass as they are."""

    def __init__(self, spec, symbols: tuple[bytes, ...] = (), suffix: bool = False):
        self.spec, self.suffix = spec, suffix
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.space = MARK if spec.escape_whitespaces else b" "

    def _parts(self, data: bytes):
        """(output, first byte, past-the-last byte) of the longest sources, left to right."""
        at = 0
        while at < len(data):
            symbol = next((s for s in self.symbols if data.startswith(s, at)), None)
            n, out = (len(symbol), symbol) if symbol else self.map.longest(data, at) or _character(data, at)
            yield out, at, at + n
            at += n

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and their end, the original byte it stands for."""
        space, strip, mark = self.space, self.spec.remove_extra_whitespaces, self.spec.add_dummy_prefix
        if not (self.map.units or self.symbols or strip):  # only spaces change
            raw, front, back = np.frombuffer(data, np.uint8), bool(mark and data and not self.suffix), bool(mark and data and self.suffix)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
            ends = [np.full(len(space) * on, at, np.int64) for on, at in ((front, 0), (back, len(raw)))]
            return space * front + data.replace(b" ", space) + space * back, np.concatenate([ends[0], source, ends[1], [len(raw)]])
        parts = list(self._parts(data))
        while strip and parts and parts[0][0] == b" ":
            del parts[0]
        if not parts:
            return b"", np.zeros(1, np.int64)
        out, source = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        if mark and not self.suffix:
            put(space, parts[0][1])
        blank = strip  # what came before ended in a space
        for text, at, _ in parts:
            text = text.lstrip(b" ") if blank else text
            put(text.replace(b" ", space), at)
            blank = strip and (text.endswith(b" ") if text else blank)
        end = parts[-1][2]
        while strip and out.endswith(space):
            end = source[-len(space)]
            del out[-len(space) :], source[-len(space) :]
        if mark and self.suffix:
            put(space, end)
        return bytes(out), np.array([*source, end], np.int64)


class SpanEncoder:
    """One model: ids, spans and texts."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        kind = proto.SentencePiece
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == kind.USER_DEFINED)
        self.normalise = Normaliser(proto.normalizer_spec, symbols, proto.trainer_spec.treat_whitespace_as_suffix)
        self.eos, self.unk = self.sp.eos_id(), self.sp.unk_id()
        self.sizes = np.array([{kind.BYTE: 1, kind.CONTROL: 0}.get(p.type, len(p.piece.encode())) for p in proto.pieces], np.int64)
        self.names = [str(i) for i in range(len(proto.pieces))]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.sp.encode([x or "" for x in texts], add_bos=False, add_eos=True, num_threads=1)

    def spans(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last original byte of every id; control ids such as the end take no bytes."""
        cuts = self.cuts(text, ids)
        return cuts[:-1], cuts[1:]

    def cuts(self, text: str | None, ids: list[int]) -> np.ndarray:
        """Where the spans of ``ids`` begin, and where the last one ends: pieces tile the text, so each begins where the one before ends.

        Unknown pieces are as long as the library says.  Should pieces and normalised text differ in length, all pieces
        are, and none goes past the text.
        """
        normal, source = self.normalise((text or "").encode())
        sizes = self.sizes[ids]
        if self.unk in ids or sizes.sum() != len(normal):
            surfaces = np.array([len(x.encode()) for x in self.sp.encode(text or "", out_type=str)], np.int64)
            own = np.array(ids[: len(surfaces)])
            odd = own == self.unk if sizes.sum() - sizes[: len(own)][own == self.unk].sum() + surfaces[own == self.unk].sum() == len(normal) else np.ones(len(own), bool)
            sizes[: len(surfaces)] = np.where(odd, surfaces, sizes[: len(surfaces)])
        ends = np.minimum(np.cumsum(sizes), len(normal))
        return source[np.concatenate([[0], ends]).astype(np.int64)]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _digest(numbers) -> str:
    return hashlib.sha256(" ".join(numbers).encode()).hexdigest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends, decoded: one row per row of ``docs``; spans count bytes of the original UTF-8 text.

    Null and empty texts give the end id alone, with the span (0, 0).  Texts of any length are encoded whole.  Repeated
    rows repeat; other columns, whatever their names, are not read.  ``model_file`` must exist on the executors.
    """
    rows = _rows(docs, id_col, text_col)
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches):
        coder = SpanEncoder(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = coder.encode(texts)
            starts, ends = zip(*map(coder.spans, texts, ids)) if ids else ((), ())
            columns = [pa.array(c, t) for c, t in zip((ids, starts, ends, [coder.decode(x) for x in ids]), schema.types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *schema.names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`encode` gives, as counts and digests: the same encoder per row, but the arrays stay in the task.

    n_tokens, ids_sha256 (ids in decimal, joined by a space), decoded_sha256, n_span_bytes, the original bytes that the
    spans cover, and spans_sha256: of the first and the past-the-last byte of every id in decimal, all joined by a space.
    """
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        coder = SpanEncoder(model_file)
        name = coder.names.__getitem__
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                for text, ids in zip(part, coder.encode(part)):
                    cuts = coder.cuts(text, ids).tolist()
                    covered = cuts[-1] - cuts[0] if ids else 0
                    shown = list(map(str, cuts))  # each once, though it ends one span and begins the next
                    both = [""] * (2 * len(ids))
                    both[::2], both[1::2] = shown[:-1], shown[1:]
                    out.append((len(ids), _digest(map(name, ids)), hashlib.sha256(coder.decode(ids).encode()).hexdigest(), covered, _digest(both)))
            columns = zip(*out) if out else ((), (), (), (), ())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", "spans_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long, spans_sha256 string")


def token_items(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, cluster and ids (the end id last) of every row: what :func:`packing.sequences` packs.

    A cluster is one text, ASCII case and white space aside.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        coder = SpanEncoder(model_file)
        for batch in batches:
            for at in range(0, len(batch), 64):  # ids are many times their text while they are Python's
                part = batch.slice(at, 64)
                texts = part.column(2).to_pylist()
                cluster = [xxhash.xxh64_hexdigest(b" ".join((x or "").encode().lower().split())) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.string()), pa.array(coder.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "source", "cluster", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, cluster string, ids array<int>")
