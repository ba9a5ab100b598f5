"""Token files, periodic runs and collocations: brute force, the SQL twin, odd rows, file layout."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenura.llm import fuzzy, html, licenses, phrases, queries, runs, storage, substrings, texts, token_files

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, slice int, begin string, key string, runs string, n string, total string"
VOCABULARY = public_tokenizers.path(queries.TOKENS)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "b", "k", "r", "n", "t") for i, t, lang in rows], SCHEMA)


ODD = [
    (None, "a b a b a b a b", "en"), (None, "a b a b a b a b", "en"), (1, None, "en"), (2, "", None), (3, " \t\n", "de"), (-(2**63), "x " * 9, "en"),
    (2**63 - 1, "x y " * 4, None), (5, "No. It is. It is.", "en"), (5, "another text", "en"), (5, "another text", "en"), (6, "la " * 40_000, "fr"),
    (7, "É à la une<|endoftext|>", "fr"),
]


# ---- token files ---------------------------------------------------------------------------------
def brute_tokens(rows):
    tokenizer, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_against_one_pass(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 18)
    write = token_files.write
    monkeypatch.setattr(token_files, "write", lambda *a, **k: write(*a, **k, file_bytes=1 << 18))
    got = [tuple(r) for r in queries.QUERIES["op11_token_files"](spark, SF_CHECK).collect()]
    assert sorted(got) == brute_tokens(rows)


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 300)
    encoder, library = token_files.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert encoder.by_pieces
    rng = random.Random(11)
    parts = ["a", "²", "½", "ª", "_", "don", "\xa0", "ʼ", "ŭ", "-", "'ll", "foo", "don't", "'s", "\n", "\t", " ", "  ", "é", "12", "...", "<|endoftext|>", "!", "\r\n", "x1y", "\x85", "日本", "\x1c", "\u200b", "\u180e"]
    for _ in range(40):
        words = [f"q{rng.choice('abcdef')}{'xyz'[rng.randrange(3)] * rng.randrange(9)}" for _ in range(60)]
        texts = ["".join(rng.choice(parts + words) for _ in range(rng.randrange(14))) for _ in range(100)]
        assert [x.tolist() for x in encoder.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.numbers) < 2_000


def test_each_stretch_of_a_batch_is_cut_once():
    encoder, library = token_files.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    found, real = [], encoder.cut
    encoder.cut = lambda text: found.append(real(text)) or found[-1]
    rng = random.Random(6)
    words = [f"wörd{i}," for i in range(200)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(50)]
    odd = ["", " ", "  ", "a  b", "a   b", "x  ", " x", "\n x", "x\n y", "x \ny", "x \n y", "x\xa0 y", "x \xa0y", "x \x85 ", "a\t b", " \n", "don't  you'll"]
    got = encoder.ids(texts + odd)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts + odd, add_special_tokens=False)]
    assert sum(map(len, found)) < 3 * 50 * 200 / 10


@pytest.mark.parametrize("ids", token_files.ENCODINGS)
def test_token_files_of_odd_rows(spark, ids):
    folder = storage.new_folder(spark, "odd")
    odd = table(spark, ODD)
    token_files.write(odd, folder, VOCABULARY, keep=("lang", "slice", "begin"), ids=ids, file_bytes=4_000, page_rows=3)
    rows = token_files.positions(token_files.tokens(spark, folder), token_files.metadata(spark, folder)).orderBy("start").collect()
    assert [r.key for r in rows] == sorted((r[0] for r in ODD), key=lambda k: (k is not None, k))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t, _ in ODD)
    assert Counter((r.key, tuple(r.ids)) for r in rows) == expected
    assert {r.slice_input for r in rows} == {1} and {r.begin_input for r in rows} == {"b"}
    digests = {(r.key, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, folder).collect()}
    assert digests == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in expected}
    empty = storage.new_folder(spark, "empty")
    token_files.write(odd.limit(0), empty, VOCABULARY)
    assert token_files.positions(token_files.digests(spark, empty), token_files.metadata(spark, empty)).count() == 0
    with pytest.raises(ValueError):
        token_files.write(odd, folder + "-x", VOCABULARY, ids="plain")


def test_token_files_are_read_selectively(spark):
    folder = storage.new_folder(spark, "layout")
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    token_files.write(docs, folder, VOCABULARY, file_bytes=1 << 20, row_group_bytes=1 << 18, page_rows=50)
    files = sorted(Path(folder).glob("*.parquet"))
    assert len(files) > 1
    groups, last = 0, None
    for path in files:
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            groups += 1
            assert all(c.has_offset_index for c in columns.values()) and columns["key"].has_column_index
            assert "DELTA_BINARY_PACKED" in columns["key"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            low, high = columns["key"].statistics.min, columns["key"].statistics.max
            assert last is None or low > last
            last = high
    assert groups > len(files)
    plan = token_files.tokens(spark, folder, 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,10)" in plan and "LessThanOrEqual(key,20)" in plan
    assert [r.key for r in token_files.tokens(spark, folder, 10, 20).collect()] == list(range(10, 21))
    scan = token_files.metadata(spark, folder).select("key", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in scan.split("ReadSchema:")[-1]


# ---- periodic runs -------------------------------------------------------------------------------
def brute_runs(words, least=4, length=6):
    out = {}
    for p in range(1, len(words) // least + 1):
        i = 0
        while i + p < len(words):
            a = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > a and i + p - a >= max(length, least * p):
                out.setdefault((a, i + p - a), p)
            i += 1
    return sorted(((a, n, p) for (a, n), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words)
    gone = {k for a, m, p in found for k in range(a + p, a + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    text = "".join(f"{a},{m},{p}\n" for a, m, p in found).encode()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (i, len(found), *best, milli, hashlib.sha256(text).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_difference_cover():
    assert {(a - b) % runs.CYCLE for a in runs.COVER for b in runs.COVER} == set(range(runs.CYCLE))
    for a in range(runs.CYCLE):
        for b in range(runs.CYCLE):
            assert {(a + runs.SHIFT[a, b]) % runs.CYCLE, (b + runs.SHIFT[a, b]) % runs.CYCLE} <= set(runs.COVER.tolist())


def made(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 30, 100, 300]), rng.choice([1, 2, 3, 40])
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


@pytest.mark.parametrize(("least", "length"), [(4, 6), (2, 2), (3, 10)])
def test_runs_of_random_words(least, length):
    rng = random.Random(least)
    for _ in range(80):
        docs = [made(rng) for _ in range(rng.randint(1, 6))]
        codes = np.array([w for d in docs for w in d], np.int64)
        got = runs.found_runs(codes, np.cumsum([0, *map(len, docs)]), least, length)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(docs) for r in brute_runs(w, least, length)]


def test_common_extensions():
    rng = random.Random(3)
    for size, letters in ((400, 1), (700, 2), (2_000, 3)):
        codes = np.array([rng.randrange(letters) for _ in range(size)] * 2 + [letters])
        i = np.array([rng.randrange(2 * size - 1) for _ in range(500)])
        j = np.array([rng.randrange(k + 1, 2 * size) for k in i.tolist()])
        expected = [next(t for t in range(len(codes)) if codes[a + t] != codes[b + t]) for a, b in zip(i.tolist(), j.tolist())]
        assert runs.Extensions(codes).common(i, j).tolist() == expected


def test_periodic_runs_query(spark):
    got = {tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF_CHECK).collect()}
    rows = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if len(WORD.findall((r.text or "").encode())) <= 1_500]
    assert len(got) == len(rows) and len(short) > 900
    assert {brute_row(*r) for r in short} <= got
    assert sum(r[1] for r in got) > 20


def test_runs_of_odd_rows(spark):
    odd = table(spark, ODD)
    rows = runs.runs(odd, keep=("key", "runs", "slice")).collect()
    expected = Counter((i, tuple(brute_runs(WORD.findall((t or "").encode())))) for i, t, _ in ODD if i != 6)
    assert Counter((r.key, tuple(map(tuple, r.runs))) for r in rows if r.key != 6) == expected
    (long,) = (r for r in rows if r.key == 6)
    assert [tuple(r) for r in long.runs] == [(0, 40_000, 1)] and long.kept == b"la"
    assert {(r.key_input, r.runs_input, r.slice) for r in rows} == {("k", "r", 1)}
    assert runs.runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.runs(odd, least=1)


def test_strongest_run_is_compared_exactly(spark):
    big = 2**28
    given = [[(0, 4 * big + 3, big), (9, 4 * big + 4, big), (12, 8 * big + 8, 2 * big)], []]
    df = spark.createDataFrame([(r,) for r in given], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and r[0].start for r in df.select(runs.strongest()).collect()] == [9, None]


# ---- collocations --------------------------------------------------------------------------------
def brute_phrases(rows, least=10, subsumed=50, most=2_000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    longer = Counter()
    for (lang, *w), a in f.items():
        if len(w) == 3 and a >= least:
            for part in (w[:2], w[1:]):
                longer[lang, *part] = max(longer[lang, *part], a)
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least or (len(w) == 2 and longer[lang, *w] and 100 * longer[lang, *w] >= subsumed * a):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    ranked = {lang: sorted(x)[:most] for lang, x in out.items()}
    return {(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, x in ranked.items() for i, (s, a, p, left, r) in enumerate(x)}


def spoken(seed, size):
    rng = random.Random(seed)
    words = ["the", "The", "of", "house", "Rat", "é", "a b", "x", "of the"] + [f"w{i}" for i in range(30)]
    ends = [" ", " ", " ", "\t ", ". ", ", ", "\n", "  "]
    return [(i, "".join(rng.choice(words[: rng.choice([4, 9, 39])]) + rng.choice(ends) for _ in range(rng.randrange(80))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(size)]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("heavy", "flush"), [(1 << 10, 1 << 20), (4, 300), (60, 1)])
def test_collocations_against_brute_force(spark, monkeypatch, heavy, flush):
    """With many heavy prefixes, split stripes and small flushes; the constants travel in the closures' module."""
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 2_000)
    rows = spoken(heavy, 300) + ODD
    docs = table(spark, rows).repartition(3)
    mapped = phrases._mapped
    monkeypatch.setattr(phrases, "_mapped", lambda *a, **k: mapped(*a, **k, flush_words=flush))
    for most in (7, 2_000):
        got = {tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, most=most).collect()}
        assert got == brute_phrases(rows, most=most)


def test_collocations_of_odd_rows(spark):
    odd = table(spark, ODD)
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en")])).count() == 0
    (row,) = phrases.collocations(table(spark, [(1, "Red, red sun. " * 9 + "red sun", None)])).collect()
    assert (row.lang, row.phrase, row.a, row.l, row.r, row.n) == ("und", "red sun", 10, 19, 10, 29)


def test_filter_of_phrases_never_says_no_wrongly(spark):
    entries = spark.createDataFrame([(b"en", f"p{i} q".encode() if i % 2 else b"", f"w{i}".encode()) for i in range(3_000)], "lang binary, prefix binary, next binary")
    known = phrases.frequent(entries)
    for i in range(0, 3_000, 7):
        words = phrases.word_hash([f"p{i}".encode(), b"q", f"w{i}".encode()] if i % 2 else [f"w{i}".encode()])
        assert known.has(phrases.phrase_hashes(b"en", *(words[k : k + 1] for k in range(len(words)))))[0]
    strange = phrases.phrase_hashes(b"en", phrases.word_hash([f"z{i}".encode() for i in range(4_000)]))
    assert known.has(strange).mean() < 0.05


def test_scores_are_exact(spark):
    rows = [(10**15 - 1, 10**15 - 1, 10**15 - 3), (999_999_999_999, 10**13, 10**12), (10, 10, 10), (11, 10**14, 17)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score_of("a", "l", "r").alias("s"))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_queries_at_the_smallest_size(spark):
    for name in ("op11_token_files", "op12_periodic_runs"):
        assert queries.QUERIES[name](spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


# ---- pages with odd anchors ----------------------------------------------------------------------
STORY = "It was the day on which all of them came to the house and said that it is not what we were told."


def test_open_anchors_lose_no_page():
    for mark in ("<a name='top'>", "<a id='x'/>", "<a id=x />", "<a class='p' data-href='z'>", "<A NAME=top>"):
        for page in (f"<article>{mark}<p>{STORY}</p><p>{STORY}</p></article>", f"{mark}<p>{STORY}</p><p>{STORY}</p>", f"<div><p>{mark}{STORY}</p></div><p>{STORY}</p>"):
            assert html.main_text(f"<html><body>{page}</body></html>") == f"{STORY}\n{STORY}", (mark, page)
    left_open = [f"<article><p><a href=x>Read on</p><p>{STORY}</p></article>", f"<div><div><a href=x>Read on</div><p>{STORY}</p></div>"]
    assert all(html.main_text(p).endswith(STORY) for p in left_open)
    assert html.main_text(f"<ul><li><a href=a>Home<li><a href=b>News</ul><p>{STORY}</p>") == STORY


def test_linked_running_text_is_kept():
    linked = f"<p><a href='x'>{STORY}</a></p>"
    assert html.main_text(f"<article><p>{STORY}</p>{linked}<p>{STORY}</p></article>") == "\n".join([STORY] * 3)
    assert html.main_text(linked) == STORY
    assert html.main_text(f"<p>{STORY}</p><div><a href=x>{STORY}</a></div>") == STORY  # a link list beside the text still goes
    assert html.main_text(f"<article><p>{STORY}</p></article><nav>{linked}</nav>") == STORY


# ---- license bands -------------------------------------------------------------------------------
def test_bands_are_enough_for_the_stated_miss():
    worst = 1.0
    for text in licenses.TEMPLATES.values():
        words, own = licenses.template_words(text), set(licenses.template_shingles(text))
        size = len(words) + licenses.step_of(len(words)) - 4  # shingles of a window
        for common in range(math.ceil(0.8 * len(own) - 1e-9), len(own) + 1):
            worst = min(worst, common / (size + len(own) - common))
    assert worst == pytest.approx(min(map(licenses.least_similarity, licenses.TEMPLATES.values())))
    assert (1 - worst) ** licenses.bands_for(licenses.TEMPLATES) <= licenses.MISS
    assert licenses.bands_for({"a": licenses.TEMPLATES["MIT"]}, 1e-3) < licenses.bands_for(licenses.TEMPLATES)


def test_bands_alone_retrieve_every_match_and_little_else(spark):
    rng = random.Random(8)
    names = sorted(licenses.TEMPLATES)
    rows, planted = [], set()
    for i in range(120):
        words = [f"filler{rng.randrange(500)}" for _ in range(rng.randrange(40))]
        for name in rng.sample(names, rng.randrange(3)):
            own = licenses.TEMPLATES[name].split()
            if len(own) > 40:
                own[rng.randrange(20)] = "changed"
            words += [*own, *[f"more{rng.randrange(500)}" for _ in range(rng.randrange(6))]]
            planted.add((i, name))
        rows.append((i, " ".join(words) or None, "en"))
    docs = table(spark, rows + [(None, licenses.TEMPLATES["MIT"], "en")])
    hits = licenses.window_shingles(docs, licenses.TEMPLATES, "doc_id", "text")
    retrieved = {(r.doc_id, r.license) for r in licenses.candidates(hits, licenses.TEMPLATES).collect()}
    found = {(r.doc_id, r.license): r.containment for r in licenses.scan(docs).collect()}
    assert planted | {(None, "MIT")} <= retrieved and planted <= set(found) and (None, "MIT") in found
    assert set(found) <= retrieved and len(retrieved) < 4 * len(found)
    by_document = {(i, n) for i, text, _ in rows if text for n in names if n not in (None,) and _whole(licenses.template_words(text), n) >= 0.8}
    assert set(found) - {(None, "MIT")} <= by_document


def _whole(words, name):
    own = set(licenses.template_shingles(licenses.TEMPLATES[name]))
    return len(own & {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}) / len(own)


def test_no_signature_without_templates(spark):
    with pytest.raises(ValueError):
        licenses.scan(table(spark, ODD), {})


# ---- slices of any ids, periodic texts -----------------------------------------------------------
def test_slices_of_extreme_ids(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE_BYTES", 300)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 300)
    rng = random.Random(2)
    shared = " ".join(f"w{i}" for i in range(30))
    for base in (0, 2**60, 2**63 - 70, -(2**63), -(2**60), None):
        if base is None:  # clusters far apart, and the two ends
            ids = sorted({-(2**63), 2**63 - 1, *range(5, 30), *range(2**55, 2**55 + 25), *(rng.randrange(-(2**62), 2**62) for _ in range(10))})
        else:
            ids = [base + i for i in range(60)]
        rows = [(i, f"{shared} t{k % 7} " + " ".join(f"x{rng.randrange(99)}" for _ in range(rng.randrange(40))), "en") for k, i in enumerate(ids)]
        docs = table(spark, rows)
        slices = texts.Slices.of(docs, "doc_id", F.octet_length("text"), 300)
        placed = [r[0] for r in docs.orderBy("doc_id").select(slices.number(F.col("doc_id"))).collect()]
        assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] < slices.count and len(set(placed)) > 10
        got = {r.key: r for r in fuzzy.edited_neighbours(docs).collect()}
        by_id = {i: t for i, t, _ in rows}
        for k, i in enumerate(ids):
            following = by_id[ids[k - 1]]
            edited = fuzzy.edit(by_id[i], following)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i].near_next == fuzzy.likeness(fuzzy.fingerprint(by_id[i].encode()), fuzzy.fingerprint(following.encode()))
        removed = {r.key: r.n_removed for r in substrings.repeats(docs).collect()}
        seen, expected = set(), {}
        for i in ids:
            words = by_id[i].split()
            gone = [False] * len(words)
            for a in range(len(words) - 19):
                own = tuple(words[a : a + 20])
                if own in seen:
                    gone[a : a + 20] = [True] * 20
                seen.add(own)
            expected[i] = sum(gone)
        assert removed == expected


def test_long_periodic_texts_are_compared_quickly():
    for period in ("the same line again\n", "a", "one line of it\nand another one, longer than that\n"):
        text = (period * (5_000_000 // len(period))).encode()
        other = text[: len(text) * 2 // 3] + b"quite another line to end with\n" * (len(text) // 93)
        one, two = fuzzy.fingerprint(text), fuzzy.fingerprint(other)
        start = time.perf_counter()
        near = fuzzy.likeness(one, two)
        assert time.perf_counter() - start < 1.0 and 0 <= near <= 1 and fuzzy.likeness(one, one) == 1
    assert fuzzy.shortened("ABABABABABAB") == "ABABAB" and fuzzy.shortened("xAAAAAy") == "xAAAy" and fuzzy.shortened("ABCABC") == "ABCABC"
