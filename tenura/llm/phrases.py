"""Collocations from stripes: each prefix keys an associative counter of the words that follow it.

Words are runs of bytes other than blank and tab inside pieces; pieces end at `.,;:!?` and line ends; A-Z are
lower-cased. A stripe is (lang, prefix) -> {next word: count}; what ends a piece, or is passed over as too
rare, counts under the empty word, so a stripe's total is how often its prefix occurs. There are three rounds,
for prefixes of no word, one word and two words:

    stripe of no word     extensions f(x), total n of the language
    stripe of x           extensions f(x y), total f(x)
    stripe of x y         extensions f(x y z), total f(x y), and its maximum subsumes x y

A task counts about two million words (a longer text whole), then sends its stripes, one row each, to the bucket of
(lang, prefix), where they are added element by element. A prefix with a 1024th of all words or more (so
there are fewer than 1024 of them, known from the round before) is cut by its next words over all
buckets; its total is the sum over the buckets. A bucket is about 2 MB of text.

A phrase that occurs `least` (10) times consists of shorter ones that do. Each round passes over prefixes and
next words that the round before found rarer, through a blocked Bloom filter: 16 bits a phrase, at most
2^28 bits (32 MB) broadcast; a false hit, also in a full filter, costs time and changes no result.

Scores are exact: the products are 38-digit decimals, which holds for counts up to 10^15.

Defined cases: null and empty texts have no pieces; a null language is `und`; a language without a
phrase that often, and an empty table, give no rows; repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.storage import materialise
from tenura.llm.texts import mixed, small_batches, word_hashes

LEAST = 10  # occurrences of a phrase
SUBSUMED = 50  # percent of a phrase's occurrences that a longer one may take before the phrase goes
BEST = 2_000  # phrases reported for each language
SCALE = 1_000_000
FLUSH_WORDS = 1 << 21
BUCKET_BYTES = 2 << 20
HEAVY = 1 << 10
FILTER_BITS, SEGMENT_BITS = 28, 16
SALTS = 64

# Upper case to lower case, piece ends to a full stop, tab to blank.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text with b"." after each piece."""
    return text.translate(PLAIN).replace(b".", b" . ").split()


class Numbers(dict):
    """Words to consecutive numbers; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# ---- which phrases are frequent -------------------------------------------------------------------
def phrase_hashes(lang: bytes, *words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of (lang, words) from the hashes of the words."""
    out = np.full(len(words[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for w in words:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def word_hash(words: list[bytes]) -> np.ndarray:
    """Hashes of words, which hold no white space and are not empty."""
    return word_hashes([b"\n".join(words)])[0]


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of one segment for each hash."""
    inner = min(bits, SEGMENT_BITS)
    base = (hashes >> np.uint64(64 - (bits - inner))) << np.uint64(inner) if bits > inner else np.zeros(len(hashes), np.uint64)
    mask = np.uint64((1 << inner) - 1)
    return base + (hashes & mask), base + (hashes >> np.uint64(20) & mask)


class Filter:
    """A set of hashes that may say yes wrongly, never no."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _segments(bits: int):
    inner = min(bits, SEGMENT_BITS)

    def run(batches):
        for batch in small_batches(batches, 10_000):
            lang = np.array(batch.column("lang").to_pylist(), object)
            rows = [(b.split(b" ") if b else []) + [c] for b, c in zip(batch.column("prefix").to_pylist(), batch.column("next").to_pylist())]
            sizes = np.array([len(r) for r in rows])
            flat, first = word_hash([w for r in rows for w in r]), np.cumsum(sizes) - sizes
            hashes = np.empty(len(rows), np.uint64)
            for of in set(lang):
                for size in np.unique(sizes[lang == of]).tolist():
                    own = np.flatnonzero((lang == of) & (sizes == size))
                    hashes[own] = phrase_hashes(of, *(flat[first[own] + k] for k in range(size)))
            at = np.unique(np.concatenate(_places(hashes, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(inner)).astype(np.int32)), pa.array(at.astype(np.int64))], ["segment", "bit"])

    return run


def _filled(inner: int):
    def run(key, table):
        data = np.zeros(1 << inner, np.uint8)
        data[table.column("bit").to_numpy() & ((1 << inner) - 1)] = 1
        packed = np.packbits(data, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    return run


def frequent(entries: DataFrame) -> Filter:
    """The filter over (lang, prefix, next) of a round; built in tasks, at most 32 MB reach the driver."""
    n = entries.count()
    bits = min(FILTER_BITS, max(6, (16 * n).bit_length()))
    inner = min(bits, SEGMENT_BITS)
    marked = entries.select("lang", "prefix", "next").mapInArrow(_segments(bits), "segment int, bit long").distinct()
    pieces = marked.groupBy("segment").applyInArrow(_filled(inner), "segment int, bits binary").collect()
    data = np.zeros(max(1, 1 << (bits - 3)), np.uint8)
    width = max(1, 1 << (inner - 3))
    for row in pieces:
        own = np.frombuffer(row.bits, np.uint8)
        data[row.segment * width : row.segment * width + len(own)] = own
    return Filter(bits, data)


# ---- one round of stripes -------------------------------------------------------------------------
STRIPE = "bucket int, lang binary, prefix binary, words binary, counts array<int>"  # words joined by a blank


def _counted(lang: bytes, codes: np.ndarray, hashes: np.ndarray, order: int, known) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(prefix, next, columns of the prefixes' word numbers, counts), sorted by prefix, then next."""
    width = len(hashes)
    if order == 0:
        counts = np.bincount(codes, minlength=width)
        nexts = np.flatnonzero(counts[1:]) + 1
        return np.zeros(len(nexts), np.int64), nexts, [], counts[nexts]
    follow = np.append(codes[1:], 0)
    if order == 1:
        fine = known.has(phrase_hashes(lang, hashes))
        fine[0] = False
        at = np.flatnonzero(fine[codes])
        nexts = np.where(fine[follow[at]], follow[at], 0)
        keys, counts = np.unique(codes[at].astype(np.int64) * width + nexts, return_counts=True)
        prefix, nexts = np.divmod(keys, width)
        heads, prefix = np.unique(prefix, return_inverse=True)
        return prefix, nexts, [heads], counts
    at = np.flatnonzero((codes > 0) & (follow > 0))
    pairs, number = np.unique(codes[at].astype(np.int64) * width + follow[at], return_inverse=True)
    first, second = np.divmod(pairs, width)
    fine = known.has(phrase_hashes(lang, hashes[first], hashes[second]))
    pair = np.full(len(codes) + 1, -1, np.int32)  # the number of the frequent pair that begins at each place
    pair[at] = np.where(fine[number], number, -1)
    at = at[fine[number]]
    nexts = np.where(pair[at + 1] >= 0, codes[np.minimum(at + 2, len(codes) - 1)], 0)
    keys, counts = np.unique(pair[at].astype(np.int64) * width + nexts, return_counts=True)
    prefix, nexts = np.divmod(keys, width)
    heads, prefix = np.unique(prefix, return_inverse=True)
    return prefix, nexts, [first[heads], second[heads]], counts


def _buckets(
    lang: bytes, prefix: np.ndarray, nexts: np.ndarray, heads: list[np.ndarray], words: list[bytes], hashes: np.ndarray, heavy: set, many: int
) -> np.ndarray:
    if heads:
        own = phrase_hashes(lang, *(hashes[h] for h in heads))
        wide = np.array([(lang, b" ".join(words[k] for k in h)) in heavy for h in zip(*(h.tolist() for h in heads))], bool)
    else:
        own, wide = np.array([xxhash.xxh64_intdigest(lang)], np.uint64), np.ones(1, bool)
    whole = own[prefix]
    if wide.any():
        whole = np.where(wide[prefix], phrase_hashes(lang, whole, hashes[nexts]), whole)
    return (mixed(whole) % np.uint64(many)).astype(np.int32)


def _stripes(lang: bytes, codes: np.ndarray, words: list[bytes], order: int, known, heavy: set, many: int) -> pa.RecordBatch | None:
    hashes = word_hash(words)
    prefix, nexts, heads, counts = _counted(lang, codes, hashes, order, known)
    if not len(nexts):
        return None
    bucket = _buckets(lang, prefix, nexts, heads, words, hashes, heavy, many)
    sort = np.lexsort((nexts, bucket, prefix))
    prefix, nexts, counts, bucket = prefix[sort], nexts[sort], counts[sort], bucket[sort]
    start = np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    offsets = pa.array(np.append(start, len(nexts)).astype(np.int32))
    words[0] = b""
    named = pa.array(words, pa.binary())
    if heads:
        columns = [named.take(pa.array(h[prefix[start]])) for h in heads]
        text = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" ")
    else:
        text = pa.array([b""] * len(start), pa.binary())
    out = [
        pa.array(bucket[start]), pa.array([lang] * len(start), pa.binary()), text,
        pc.binary_join(pa.ListArray.from_arrays(offsets, named.take(pa.array(nexts))), b" "),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(out, ["bucket", "lang", "prefix", "words", "counts"])


def _mapped(order: int, known, heavy: set, many: int, flush_words: int = FLUSH_WORDS):
    def run(batches):
        numbers: dict[bytes, Numbers] = {}
        held: dict[bytes, list[np.ndarray]] = {}  # only numbers of words are held
        total = 0

        def flush():
            for lang, codes in held.items():
                rows = _stripes(lang, np.concatenate(codes), list(numbers[lang]), order, known and known.value, heavy, many)
                if rows is not None:
                    yield from small_batches([rows], 20_000)
            held.clear()
            numbers.clear()
            pa.default_memory_pool().release_unused()

        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    found = tokens_of(text)
                    found.append(b".")
                    of = numbers[lang] if lang in numbers else numbers.setdefault(lang, Numbers())
                    held.setdefault(lang, []).append(np.fromiter(map(of.__getitem__, found), np.int32, len(found)))
                    total += len(found)
                if total >= flush_words:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


ENTRY = "lang binary, prefix binary, next binary, n long, total long"
KEYS = ["lang", "prefix"]


def _merged(order_of_prefix: int, heavy: dict[tuple[bytes, bytes], int], least: int):
    """Stripes of one bucket, added element by element: the entries that are frequent, each with its
    prefix's total. Round 0 also gives the total under the empty word.
    """

    def run(key, table):
        table = table.combine_chunks()
        words, counts = (table.column(c).combine_chunks() for c in ("words", "counts"))
        stripe = pc.list_parent_indices(counts).to_numpy()
        heads = pc.binary_join_element_wise(table.column("prefix"), table.column("lang"), b"\n").combine_chunks().dictionary_encode()
        nexts = pc.split_pattern(words, b" ").flatten().dictionary_encode()  # a word has no blank, a prefix no line feed
        width = len(nexts.dictionary)
        keys = heads.indices.to_numpy()[stripe].astype(np.int64) * width + nexts.indices.to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(counts.flatten().to_numpy()[order].astype(np.int64), start)
        head, word = np.divmod(keys[start], width)
        first = np.flatnonzero(np.diff(head, prepend=-1))
        total = np.zeros(len(heads.dictionary), np.int64)
        total[head[first]] = np.add.reduceat(sums, first)
        names = [h.split(b"\n", 1) for h in heads.dictionary.to_pylist()]
        if order_of_prefix:  # the total of a stripe that is cut over the buckets is known
            for i, (prefix, lang) in enumerate(names):
                total[i] = heavy.get((lang, prefix), total[i])
        empty = pc.equal(pc.binary_length(nexts.dictionary), 0).to_numpy(zero_copy_only=False)
        found = np.flatnonzero((sums >= least) & ~empty[word])
        head, word, sums = head[found], nexts.dictionary.take(pa.array(word[found])), sums[found]
        if not order_of_prefix:
            head = np.concatenate((head, np.arange(len(names))))
            word = pa.concat_arrays([word, pa.array([b""] * len(names), word.type)])
            sums = np.concatenate((sums, total))
        langs, prefixes = (pa.array([n[k] for n in names], pa.binary()).take(pa.array(head)) for k in (1, 0))
        pa.default_memory_pool().release_unused()
        return pa.table([langs, prefixes, word, pa.array(sums), pa.array(total[head])], [*KEYS, "next", "n", "total"])

    return run


def _round(rows: DataFrame, order: int, many: int, least: int, known: Filter | None, heavy: dict) -> DataFrame:
    sent = known and rows.sparkSession.sparkContext.broadcast(known)
    stripes = rows.mapInArrow(_mapped(order, sent, set(heavy), many), STRIPE)
    return materialise(stripes.groupBy("bucket").applyInArrow(_merged(order, heavy, least), ENTRY), f"stripes-{order}")


def _joined(*words: str) -> Column:
    return F.concat_ws(" ", *(F.col(w).cast("string") for w in words)).cast("binary")


# ---- candidates -----------------------------------------------------------------------------------
def _looked_up(rows: DataFrame, phrase: str, counts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """Add the count of the phrase in column `phrase`. Heavy phrases, fewer than 1024, are looked up in a
    broadcast, so that no key of the join has many rows.
    """
    both = rows.join(F.broadcast(hot.select("lang", F.col("p").alias(phrase), F.col("n").alias(name))), ["lang", phrase], "left")
    cold = both.where(F.col(name).isNull()).drop(name).join(counts.select("lang", F.col("p").alias(phrase), F.col("n").alias(name)), ["lang", phrase])
    return both.where(F.col(name).isNotNull()).unionByName(cold)


def score_of(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly."""
    wide = [f"CAST({c} AS DECIMAL(15,0))" for c in (a, a, left, right)]
    return F.expr(f"({wide[0]} * {wide[1]} * CAST({SCALE} AS DECIMAL(7,0))) div ({wide[2]} * {wide[3]})")


def _best(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each language, ranked; chosen in parts of each language before."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).drop("_salt", "_place")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED, most: int | None = BEST
) -> DataFrame:
    """Phrases of two and three words: lang, phrase, a (its count), l and r (counts of the two parts of its
    lowest-scoring cut), n (words of the language), score; the first `most` of each language with their rank,
    or all of them without a rank.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    many = max(1, -(-size // BUCKET_BYTES))

    ones = _round(rows, 0, many, least, None, {})
    sizes = ones.where(F.col("next") == b"").groupBy("lang").agg(F.sum("n").alias("n"))
    words = ones.where(F.col("next") != b"").select("lang", F.col("next").alias("p"), "n")
    share = max(1, (sizes.agg(F.sum("n").alias("n")).first().n or 0) // HEAVY + 1)

    def heaviest(counts: DataFrame) -> dict:
        return {(bytes(r.lang), bytes(r.p)): r.n for r in counts.where(F.col("n") >= share).collect()}  # fewer than HEAVY

    def hot(heavy: dict) -> DataFrame:
        return spark.createDataFrame([(*k, n) for k, n in heavy.items()], "lang binary, p binary, n long")

    heavy_words = heaviest(words)
    twos = _round(rows, 1, many, least, frequent(ones.where(F.col("next") != b"")), heavy_words)
    pairs = twos.select("lang", _joined("prefix", "next").alias("p"), "n")
    heavy_pairs = heaviest(pairs)
    threes = _round(rows, 2, many, least, frequent(twos), heavy_pairs)

    short = twos.select("lang", _joined("prefix", "next").alias("p"), F.col("next").alias("y"), F.col("n").alias("a"), F.col("total").alias("l"))
    short = _looked_up(short, "y", words, hot(heavy_words), "r").withColumn("score", score_of("a", "l", "r"))

    halves = F.split(F.col("prefix").cast("string"), " ")
    long = threes.select(
        "lang", F.col("prefix").alias("xy"), halves[0].cast("binary").alias("x"), F.col("next").alias("z"),
        _joined("prefix", "next").alias("p"), F.concat_ws(" ", halves[1], F.col("next").cast("string")).cast("binary").alias("yz"),
        F.col("n").alias("a"), F.col("total").alias("l2"),
    )
    for phrase, counts, heavy, name in (("x", words, heavy_words, "l1"), ("z", words, heavy_words, "r2"), ("yz", pairs, heavy_pairs, "r1")):
        long = _looked_up(long, phrase, counts, hot(heavy), name)
    long = materialise(long.withColumns({"s1": score_of("a", "l1", "r1"), "s2": score_of("a", "l2", "r2")}), "three-words")
    lower = F.col("s2") < F.col("s1")
    cut = lambda b, a: F.when(lower, F.col(b)).otherwise(F.col(a))

    held = long.select("lang", F.col("xy").alias("p"), "a").unionAll(long.select("lang", F.col("yz").alias("p"), "a"))
    held = held.groupBy("lang", "p").agg(F.max("a").alias("_longer"))
    short = short.join(held, ["lang", "p"], "left").where(~F.coalesce(100 * F.col("_longer") >= subsumed * F.col("a"), F.lit(False)))
    found = short.select("lang", "p", "a", "l", "r", "score").unionAll(
        long.select("lang", "p", "a", cut("l2", "l1").alias("l"), cut("r2", "r1").alias("r"), F.least("s1", "s2").alias("score"))
    )
    found = found.withColumn("phrase", F.col("p").cast("string")).drop("p")
    found = (found if most is None else _best(found, most)).join(sizes, "lang")
    return found.withColumn("lang", F.col("lang").cast("string"))
