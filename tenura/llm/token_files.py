"""Token ids of a corpus as Parquet files with a list column, in document order.

`write` cuts the documents into ranges of the key (Spark's own sampled splitters; rows of one key are
dealt out by a hash of their text), sorts inside each range, encodes the texts and writes one file for
each range. A file has

    key       the document's id
    slice     number of the range, in key order
    begin     ids of the documents before it in the same file
    n_tokens  ids of this document, with the end id
    ids       list<int>

and the columns named in `keep`. Ids are dictionary-encoded (a vocabulary's width in bits for each) or, if
asked, delta-encoded; key, begin and n_tokens, which hardly repeat, are delta-encoded. Row groups and pages
have bounded sizes, and each column has its page index (column index and offset index), so a reader that
wants a few documents or no ids touches only their pages: `metadata` never reads ids, `tokens` reads the pages
of a key range.

`positions` gives each document's place in the whole corpus: begin, plus the ids of all earlier files,
which is a running sum over one row for each file.

Defined cases: null and empty texts have the end id alone; rows with one key stand next to each other in
the order of their text's hash, then of the text; null keys come first; an empty table gives files without
rows; columns named in `keep` that clash with a column of the files come back with `_input` appended.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.llm.texts import chunks, clear_of, small_batches

END = 0
FILE_BYTES = 32 << 20  # of text, about
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
ENCODINGS = ("dictionary", "delta")
KNOWN_PIECES = 1 << 20  # beyond, a worker forgets the pieces it has met once
BATCH_BYTES = 1 << 20  # of texts encoded together
INNER_BLANK = r"[\t-\r \x{85}\x{a0}] ([\t-\r \x{85}\x{a0}]|\z)"  # a blank between white space, or at its end
STRETCH = r"\A[^\t-\r \x{85}\x{a0}]"
_LOADED: dict = {}


def _latin_pieces() -> re.Pattern:
    """The byte-level split for texts below U+0250, whose letters and numbers are the same in every library."""
    kinds: dict[str, str] = {"L": "", "N": "", "O": ""}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        if not c.isspace():
            kinds[kind if kind in "LN" else "O"] += re.escape(c)
    runs = "|".join(f" ?[{chars}]+" for chars in kinds.values())
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{runs}|\s+(?!\S)|\s+")


class _Numbers(dict):
    """Numbers of pieces, in the order in which they are met; `fresh` has those that are not encoded yet."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(zip(names, range(len(names))))
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        number = self[piece] = len(self)
        return number


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with zeros after it, up to `size` at least; it grows by a quarter, so many small additions cost little."""
    if size <= len(array):
        return array
    return np.concatenate((array, np.zeros(max(size, len(array) * 5 // 4) - len(array), array.dtype)))


class Encoder:
    """The library's tokenizer, with the ids of the pieces it has met.

    A byte-level tokenizer without normaliser cuts a text into pieces (words with the blank before them, numbers,
    punctuation, white space) and encodes each by itself. So a text of Latin letters is cut here, equal pieces are
    encoded once by the library, and the ids are laid out by numpy. Any other text (other letters, separators of
    ASCII, special tokens), and all texts of other tokenizers, are encoded whole.

    A piece also begins wherever a blank follows anything but white space, or comes before anything but it. Texts in which
    this holds for each blank are first split at blanks by Arrow, and only the different stretches of a batch are cut.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        self.by_pieces = (
            made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and (made.get("model") or {}).get("dropout") is None
        )
        self.marks = [t["content"] for t in made.get("added_tokens") or []]
        self.foreign = re.compile("[^\0-\x1b -\u024f]").search
        self.cut = _latin_pieces().findall
        self.word = re.compile(" [^\\W\\d_]+")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a byte-level token has one character a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.numbers = _Numbers([])
        self.starts, self.sizes, self.met = (np.zeros(0, np.int32) for _ in range(3))  # by number, with room
        self.values, self.filled = np.zeros(0, np.int32), 0

    def _forget(self) -> None:
        """Keep the pieces met in two batches or more; all go if that does not help."""
        n = len(self.numbers)
        often = self.met[:n] > 1
        keep = np.flatnonzero(often) if often.sum() < KNOWN_PIECES // 2 else np.zeros(0, np.int64)
        names, sizes = list(self.numbers), self.sizes[keep]
        self.values = self.values[_spans(self.starts[keep], sizes)]
        self.filled = len(self.values)
        self.numbers = _Numbers([names[i] for i in keep.tolist()])
        self.starts, self.sizes, self.met = np.cumsum(sizes, dtype=np.int32) - sizes, sizes, np.zeros(len(keep), np.int32)

    def _is_foreign(self, text: str) -> bool:
        return not self.by_pieces or self.foreign(text) is not None or any(m in text for m in self.marks)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Words go to the library together: each keeps its blank, so the ids part where the bytes do."""
        pieces, self.numbers.fresh = self.numbers.fresh, []
        first = len(self.numbers) - len(pieces)
        is_word = np.fromiter((self.word.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        words, others = np.flatnonzero(is_word), np.flatnonzero(~is_word)
        sizes, values = [], []
        for a in range(0, len(words), 10_000):
            part = [pieces[i] for i in words[a : a + 10_000].tolist()]
            ids = np.array(self._encode(["".join(part)])[0], np.int32)
            ends = np.cumsum([len(w.encode()) for w in part])
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends)
            sizes.append(np.diff(at, prepend=-1).astype(np.int32))
            values.append(ids)
        for a in range(0, len(others), 10_000):
            found = self._encode([pieces[i] for i in others[a : a + 10_000].tolist()])
            sizes.append(np.array([len(f) for f in found], np.int32))
            values.append(np.array([i for f in found for i in f], np.int32))
        own, ids = np.concatenate(sizes), np.concatenate(values)
        at = first + np.concatenate((words, others))
        self.starts, self.sizes, self.met = (_with_room(x, len(self.numbers)) for x in (self.starts, self.sizes, self.met))
        self.values = _with_room(self.values, self.filled + len(ids))
        self.starts[at], self.sizes[at] = self.filled + np.cumsum(own, dtype=np.int32) - own, own
        self.met[at] = 0
        self.values[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        latin = []
        for i, text in enumerate(texts):
            if self._is_foreign(text):
                out[i] = np.array(self._encode([text])[0], np.int32)  # one at a time: it may be long
            else:
                latin.append(i)
        if len(self.numbers) > KNOWN_PIECES:
            self._forget()
        if latin:
            for i, own in zip(latin, self._laid_out([texts[i] for i in latin])):
                out[i] = own
        return out

    def _laid_out(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of Latin texts. A text is a sequence of stretches, a stretch one of pieces, a piece one of ids."""
        column = pa.array(texts, pa.string())
        whole = pc.match_substring_regex(column, INNER_BLANK).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pa.array(~whole)), " ")
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        later = np.ones(len(flat), bool)
        later[bounds[:-1]] = False  # the first stretch of a text has no blank before it
        coded = flat.filter(pa.array(later)).dictionary_encode()
        known = coded.dictionary
        regular = pc.match_substring_regex(known, STRETCH)
        joined = known.filter(regular)
        alone = [" " + w for w in known.filter(pc.invert(regular)).to_pylist()]
        alone += [*flat.filter(pa.array(~later)).to_pylist(), *(t for t, w in zip(texts, whole.tolist()) if w)]

        pieces = self.cut(" ".join(["", *joined.to_numpy(zero_copy_only=False).tolist()]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        lasts = np.cumsum(pc.utf8_length(joined).to_numpy().astype(np.int64) + 1)
        counts = np.diff(np.searchsorted(ends, lasts, "right"), prepend=0)
        cuts = [self.cut(t) for t in alone]
        pieces += [p for c in cuts for p in c]
        counts = np.concatenate((counts, np.array([len(c) for c in cuts], np.int64)))
        number = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if self.numbers.fresh:
            self._learn()
        self.met[number] += 1  # once for each batch
        sizes = self.sizes[number]
        values = self.values[_spans(self.starts[number], sizes)]

        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        place = np.zeros(len(known), np.int64)  # of each known stretch among all: first the joined ones
        regular = regular.to_numpy(zero_copy_only=False)
        place[regular], place[~regular] = np.arange(len(joined)), np.arange(len(joined), len(known))
        order = np.zeros(len(flat) + int(whole.sum()), np.int64)
        order[: len(flat)][later] = place[coded.indices.to_numpy()]
        order[: len(flat)][~later] = len(known) + np.arange(len(bounds) - 1)
        order[len(flat) :] = np.arange(len(ends) - 1 - int(whole.sum()), len(ends) - 1)
        starts, sizes = ends[:-1].astype(np.int32), np.diff(ends).astype(np.int32)
        laid = values[_spans(starts[order], sizes[order])]
        at = np.concatenate(([0], np.cumsum(sizes[order])))
        parts = np.split(laid, at[np.concatenate((bounds[1:], np.arange(len(flat) + 1, len(order) + 1)))][:-1])
        source = np.concatenate((np.flatnonzero(~whole), np.flatnonzero(whole))).tolist()
        return [own for _, own in sorted(zip(source, parts), key=lambda x: x[0])]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of consecutive spans, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int32) + np.repeat((starts - ends + sizes).astype(np.int32), sizes)


def _encoder(path: str) -> Encoder:
    """Read once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def sized_batches(batches, rows: int = 1_000):
    """The record batches in pieces of at most `rows` rows and BATCH_BYTES of text, or one row."""
    for batch in small_batches(batches, rows):
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
        for a, b in chunks(sizes, BATCH_BYTES):
            yield batch.slice(a, b - a)


def _encoded(path: str, end: int, keep: tuple[str, ...]):
    def run(batches):
        encoder = _encoder(path)
        number, begin = TaskContext.get().partitionId(), 0
        for batch in sized_batches(batches):
            lists = encoder.ids([t or "" for t in batch.column("text").to_pylist()])
            sizes = np.array([len(x) + 1 for x in lists], np.int64)
            ends = np.cumsum(sizes)
            last = np.array([end], np.int32)
            values = np.concatenate([part for own in lists for part in (own, last)])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values))
            out = [batch.column("key"), pa.array(np.full(len(lists), number, np.int32)), pa.array(begin + ends - sizes), pa.array(sizes), ids]
            yield pa.RecordBatch.from_arrays(out + [batch.column(c) for c in keep], ["key", "slice", "begin", "n_tokens", "ids", *keep])
            begin += int(ends[-1])

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    end: int = END, ids: str = "dictionary", file_bytes: int = FILE_BYTES, row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every text with the tokenizer file and write the ids to `folder`, one file a range of keys."""
    if ids not in ENCODINGS:
        raise ValueError(f"ids are written with one of {ENCODINGS}")
    names = clear_of(keep, {"key", "slice", "begin", "n_tokens", "ids", "text", "_tie"})
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"), *(F.col(c).alias(a) for c, a in zip(keep, names)))
    order = [F.col("key"), F.col("_tie"), F.col("text")]
    rows = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order[:2]).sortWithinPartitions(*order)
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, slice int, begin long, n_tokens long, ids array<int>" + "".join(f", `{c}` {kinds[c]}" for c in names)
    encoded = rows.mapInArrow(_encoded(tokenizer, end, tuple(names)), schema)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # whole numbers without a dictionary are delta-encoded
        "parquet.enable.dictionary#ids.list.element": str(ids == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
    }
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("key", "begin", "n_tokens")}
    encoded.write.options(**options).parquet(folder)


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """All columns but the ids."""
    return spark.read.parquet(folder).drop("ids")


def tokens(spark: SparkSession, folder: str, low=None, high=None) -> DataFrame:
    """Rows with ids, of keys from `low` to `high` where given; the bounds reach the pages' indexes."""
    rows = spark.read.parquet(folder)
    rows = rows if low is None else rows.where(F.col("key") >= low)
    return rows if high is None else rows.where(F.col("key") <= high)


def positions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` of the files (slice, begin, ...) with `start`: ids of all documents before each. `files` is their
    `metadata`, which gives the files' sizes.
    """
    sizes = files.groupBy("slice").agg(F.max(F.col("begin") + F.col("n_tokens")).alias("_size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = sizes.select("slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "slice").withColumn("start", F.col("_before") + F.col("begin")).drop("_before")


def _digests(batches):
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        out = [batch.column(c) for c in ("key", "slice", "begin")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["key", "slice", "begin", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: key, slice, begin, n_tokens (counted in the list), ids_crc32 of the ids as unsigned 32-bit."""
    rows = tokens(spark, folder).select("key", "slice", "begin", "ids")
    return rows.mapInArrow(_digests, f"key {dict(rows.dtypes)['key']}, slice int, begin long, n_tokens long, ids_crc32 long")
