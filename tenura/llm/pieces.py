"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by taking, again and again, the longest prefix that the model's compiled
character map knows (else one character), and for each byte written the source byte it came from is
recorded. The pieces of a text spell its normalised form, so their lengths are their places in it, and
the record projects these to byte spans of the source. Segmentation into pieces is the library's, ids
therefore equal its own; that the pieces spell what was normalised here is checked for every text.

Ids and spans are packed little-endian unsigned 32-bit integers (spans: begin, end of each piece).
Begin and end ids have empty spans at the text's ends.

Defined cases: null is read as empty; an empty text has the begin and the end id; a model without
byte fallback gives its unknown id, whose length is read from the piece's surface.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_proto

from tenura.llm.texts import chunks, clear_of, small_batches

MARK = "▁".encode()
BATCH_CHARS = 1 << 19
USER_DEFINED, BYTE, UNKNOWN = 4, 6, 2


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes]] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:], and its replacement."""
        units = self.units
        if not units:
            return None
        place = (units[0] >> 10) << ((units[0] & 512) >> 6)
        best = None
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


def character_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """The normalisation of a model, with the source byte of every byte written."""

    def __init__(self, spec, user_symbols: list[bytes] = (), suffix: bool = False) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.user = sorted(user_symbols, key=len, reverse=True)
        self.trim, self.prefix, self.suffix = spec.remove_extra_whitespaces, spec.add_dummy_prefix, suffix
        self.space = MARK if spec.escape_whitespaces else b" "

    def run(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source offset."""
        if not self.map.units and not self.trim and not self.suffix and not self.user:
            return self.plain(data)
        return self.general(data)

    def plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only blanks change: one pass of numpy."""
        if not data:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((source & 0xC0) != 0x80)
        begin = np.repeat(lead, np.diff(np.append(lead, len(source))))
        width = np.where(source == 32, len(self.space), 1)
        align = np.append(np.repeat(begin, width), len(source))
        text = data.replace(b" ", self.space)
        if self.prefix:
            text, align = self.space + text, np.concatenate((np.zeros(len(self.space), np.int64), align))
        return text, align

    def prefix_of(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.user:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        found = self.map.longest(data, at)
        if found:
            return found
        length = character_length(data[at])
        return length, data[at : at + length]

    def general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, out, align = 0, bytearray(), []
        if self.trim:
            while at < len(data):
                length, text = self.prefix_of(data, at)
                if text != b" ":
                    break
                at += length
        if at == len(data):
            return b"", np.zeros(1, np.int64)
        if self.prefix and not self.suffix:
            out += self.space
            align += [at] * len(self.space)
        blank = self.trim
        while at < len(data):
            length, text = self.prefix_of(data, at)
            while blank and text.startswith(b" "):
                text = text[1:]
            if text:
                written = text.replace(b" ", self.space)
                out += written
                align += [at] * len(written)
                blank = text.endswith(b" ") and self.trim
            at += length
        end = len(data)
        if self.trim:
            while out.endswith(self.space):
                end = align[len(out) - len(self.space)]
                del out[len(out) - len(self.space) :], align[len(out) :]
        if self.prefix and self.suffix:
            out += self.space
            align += [end] * len(self.space)
        return bytes(out), np.array([*align, end], np.int64)


class Encoder:
    def __init__(self, model: bytes) -> None:
        proto = model_proto.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        user = [p.piece.encode() for p in proto.pieces if p.type == USER_DEFINED]
        self.normaliser = Normaliser(proto.normalizer_spec, user, proto.trainer_spec.treat_whitespace_as_suffix)
        self.spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() for p in proto.pieces]
        self.lengths = np.array([len(s) for s in self.spelled])
        self.unknown = self.library.unk_id()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, and its pieces' byte spans (n x 2)."""
        out = []
        for text, ids in zip(texts, self.library.encode(texts, num_threads=1)):
            normal, align = self.normaliser.run(text.encode())
            known = np.array(ids, np.int64)
            lengths = self.lengths[known] if len(ids) else np.zeros(0, np.int64)
            spelled = [self.spelled[i] for i in ids]
            if self.unknown in ids:
                surface = [p.encode() for p in self.library.encode(text, out_type=str)]
                spelled = [s if i == self.unknown else p for i, s, p in zip(ids, surface, spelled)]
                lengths = np.array([len(s) for s in spelled])
            if b"".join(spelled) != normal:
                raise ValueError("the pieces do not spell the normalised text")
            ends = np.cumsum(lengths)
            spans = np.zeros((len(ids) + 2, 2), "<u4")
            spans[1:-1, 0], spans[1:-1, 1] = align[ends - lengths], align[ends]
            spans[-1] = align[-1]
            out.append((np.concatenate(([self.library.bos_id()], known, [self.library.eos_id()])).astype("<u4"), spans))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


@lru_cache(maxsize=4)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, n_tokens, ids, spans (packed), decoded, and the columns in `keep`
    (with `_input` appended where a name is taken).
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    carried = clear_of(keep, {"key", "n_tokens", "ids", "spans", "decoded", "text"})
    names = ["key", "n_tokens", "ids", "spans", "decoded", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            own = encoder(shared.value)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], BATCH_CHARS):
                rows = own.encode(texts[a:b])
                decoded = own.decode([ids.tolist() for ids, _ in rows])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i, _ in rows], pa.int64()), pa.array([i.tobytes() for i, _ in rows], pa.binary()),
                     pa.array([s.tobytes() for _, s in rows], pa.binary()), pa.array(decoded, pa.string()), *part.columns[2:]],
                    names,
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(a) for c, a in zip(keep, carried)))
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, n_tokens long, ids binary, spans binary, decoded string" + "".join(f", `{c}` {kinds[c]}" for c in carried)
    return rows.mapInArrow(run, schema)
