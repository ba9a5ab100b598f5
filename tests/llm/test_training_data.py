"""Operators on Spark: odd rows, brute force, the SQL twins and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_CHECK
from pyspark.sql import functions as F
from test_kernels import brute_fingerprint

import corpus_pipeline
from tenura.llm import components, fuzzy, html, language, licenses, mixing, pieces, pivots, simhash, storage, substrings, texts, toxicity
from tenura.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice int, range string, key string"
LONG = "der lange Satz ist hier und da " * 9_000


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, 7, "r", "k") for i, t, lang in rows], SCHEMA)


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "12 ... 34", "de"), (5, "The king and the queen of the land", "en"),
    (6, "The king and the queen of the land", "en"), (7, LONG, "de"), (8, "É à la une", "fr"), (9, "x", None), (10, "The king and the queen of the land", "en"),
    (11, " ".join(f"w{i}" for i in range(60)), "en"), (12, " ".join(f"w{i}" for i in range(30, 90)), "en"), (13, "w " * 50, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text, r.lang) for r in docs.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF_CHECK), oracle.connect(SF_CHECK), ORACLES[name]) == []


# ---- SimHash -------------------------------------------------------------------------------------
def brute_components(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    forest = simhash.Forest(len(ids))
    for i in range(len(ids)):
        j = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
        forest.join(np.full(len(j), i), j)
    return {i: ids[r] for i, r in zip(ids, forest.root.tolist())}


def test_simhash_components(spark, rows):
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    expected = brute_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, SF_CHECK).collect()}
    assert got == {i: (fps[i], expected[i]) for i in fps}


def test_simhash_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6, 10)] == [1, 1, 1, 5, 5, 5]
    assert simhash.near_duplicates(none).count() == 0
    unknown = odd.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert {r.component_id for r in simhash.near_duplicates(unknown).collect() if r.doc_id is None} == {None}
    assert sorted(r.doc_id for r in simhash.keep_one(odd).collect()) == sorted({got[i] for i in got})


def test_many_near_copies_give_a_forest(spark):
    rng = random.Random(4)
    base = [str(rng.random()) for _ in range(400)]
    made = [(i, " ".join(w if rng.random() > 0.002 else "changed" for w in base), "en") for i in range(300)]
    nodes = simhash.fingerprints(table(spark, made)).groupBy("fp").agg(F.min("doc_id").alias("node"))
    assert simhash.near_links(nodes).count() <= 3 * 300
    fps = {i: brute_fingerprint(t) for i, t, _ in made}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, made)).collect()}
    assert got == brute_components(fps)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (140, 139), (10, 11)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x int, y int"), "x", "y").collect()}
    assert got == {**dict.fromkeys(range(10, 61), 10), **dict.fromkeys(range(100, 141), 100)}
    assert components.components(spark.createDataFrame([], "x int, y int"), "x", "y").count() == 0


# ---- SentencePiece -------------------------------------------------------------------------------
def test_sentencepiece_digests(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SF_CHECK).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.key: r for r in pieces.encode(odd, path, keep=("lang",)).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 2 and bytes(got[1].ids) == np.array([1, 2], "<u4").tobytes()
    assert all(got[i].decoded == (t or "") for i, t, _ in ODD)
    assert pieces.encode(none, path).count() == 0
    assert pieces.encode(odd, path, keep=("key", "slice")).columns[-2:] == ["key_input", "slice"]


# ---- toxicity ------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    got = QUERIES["op3_toxicity"](spark, SF_CHECK).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    wins = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert sum(wins) / len(wins) > 0.8 and not any(s >= 0.5 for s, x in held if not x)


def test_toxicity_bounds_and_swaps(spark, monkeypatch):
    assert (toxicity.FIT_ROWS, toxicity.MAX_FEATURES) == (50_000, 16_384)  # as in the README
    seen = []
    fit = toxicity.fit_weights
    monkeypatch.setattr(toxicity, "fit_weights", lambda *a: seen.append(a) or fit(*a))
    words = ["the muslim garden is a river of idiot.", "the garden of the woman is idiot.", "the river is a cloud.", "the man was in a garden."]
    rows = spark.createDataFrame([(words[i % 4] * 2, int(i % 4 < 2)) for i in range(400)], "text string, toxic int")
    model = toxicity.learn(rows, "text", "toxic")
    number, row, labels, swap, swap_row, sign, n, ridge, fairness, count = seen[0]
    assert len(labels) == 400 and len(count) <= 8 and count.sum() >= 400  # two sentences in each text
    times = np.repeat(np.arange(len(count)), count.astype(int))  # each swap as often as it occurs
    parts = [np.flatnonzero(swap_row == k) for k in times]
    at, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    weights, base = fit(number, row, labels, swap[at], owner, sign[at], n, ridge, fairness)
    assert np.allclose(weights, model.weights, atol=1e-4) and math.isclose(base, model.base, abs_tol=1e-4)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, toxic int")
    model = toxicity.learned_model(odd, labels)
    got = {r.key: r.score for r in toxicity.score(odd, model).collect()}
    assert len(got) == len(ODD) and got[1] == got[2] == got[3]
    one_label = toxicity.learned_model(odd, labels.withColumn("toxic", F.lit(0)))
    assert max(r.score for r in toxicity.score(odd, one_label).collect()) < 0.5
    assert toxicity.score(none, toxicity.learned_model(none, labels.limit(0))).count() == 0


# ---- fingerprints --------------------------------------------------------------------------------
def brute_edits(rows):
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(ordered):
        following, third = ordered[(k + 1) % len(ordered)][1], len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        one, other, after = (fuzzy.fingerprint(x.encode()) for x in (t, edited, following))
        yield i, (len(t), hashlib.sha256(edited.encode()).hexdigest(), one, other, fuzzy.likeness(one, other), fuzzy.likeness(one, after))


@pytest.mark.parametrize("size", [16 << 20, 300_000])
def test_edited_neighbours(docs, rows, size, monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE_BYTES", size)
    got = {r.key: tuple(r)[1:] for r in fuzzy.edited_neighbours(docs).collect()}
    assert got == dict(brute_edits([(i, t) for i, t, _ in rows]))


def test_fingerprints_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE_BYTES", 100)
    got = {r.key: tuple(r)[1:] for r in fuzzy.edited_neighbours(odd).collect()}
    assert got == dict(brute_edits([(i, t) for i, t, _ in ODD]))
    assert fuzzy.edited_neighbours(none).count() == 0
    assert [r.n_chars for r in fuzzy.edited_neighbours(odd.limit(1)).collect()] == [0]
    unknown = odd.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert sorted(r.n_chars for r in fuzzy.edited_neighbours(unknown).collect()) == sorted(len(t or "") for _, t, _ in ODD)
    assert {r.fingerprint for r in fuzzy.fingerprints(odd).where("key in (1, 2)").collect()} == {"3::"}


# ---- embeddings ----------------------------------------------------------------------------------
def test_embeddings_that_cannot_link_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0, 0.0, 0.0], [1.0, 0.0], [0.97, 0.2]]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, node int, d int, list string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    linked = {0: (3, 0, True), 1: (3, 0, False), 10: (3, 0, False), 11: (3, 0, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i in range(len(vectors))}
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    rng = np.random.default_rng(1)
    tight = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.02
    loose = rng.normal(size=(600, 16))
    near = loose[:200] + rng.normal(size=(200, 16)) * 0.15
    data = np.concatenate([tight, loose, near]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    unit = pivots.unit(data.astype(float))
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(data))])
    assert (found <= links).all() and found[:400].sum() == links[:400].sum() and found.sum() >= 0.97 * links.sum()


# ---- mixing --------------------------------------------------------------------------------------
def test_mixing_meets_its_targets(spark, docs):
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = mixing.mix(docs, labels, {"high": 0.7, "low": 0.2, "toxic": 0.1}, budget=300_000.0).collect()
    assert all(r.rate >= 0 and abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in got)
    for k, share in enumerate((0.7, 0.2, 0.1)):
        assert abs(sum(r.rate * r.tokens * r[f"p{k}"] for r in got) - share * 300_000) < 0.02 * 300_000
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in got} == words


def test_mixing_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    twice = odd.union(odd.where("doc_id = 5"))
    got = {r.doc_id: r for r in mixing.mix(twice, labels).collect()}
    assert len(got) == len(ODD) and got[1].tokens == 0 and got[5].n_rows == 2 and got[5].tokens == 16
    assert mixing.mix(none, labels).count() == 0 and mixing.resample(none, labels).columns == odd.columns
    assert {r.rate for r in mixing.mix(odd.where("doc_id <= 3"), labels.limit(0)).collect()} == {1.0}
    taken = mixing.resample(odd.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id"))), labels)
    assert taken.where("doc_id is null").count() == 1
    with pytest.raises(ValueError):
        mixing.mix(odd, labels, {"high": 0.0})


def test_copies_follow_the_rate(spark):
    drawn = spark.range(20_000).select(mixing.copies_of(F.lit(1.3), F.col("id")).alias("n"), mixing.copies_of(F.lit(0.95), F.col("id")).alias("one"))
    row = drawn.agg(F.avg("n"), F.min("one"), F.max("one")).first()
    assert abs(row[0] - 1.3) < 0.02 and row[1:] == (0, 1)


def test_tokens_taken_meet_the_targets(spark):
    n, made, known = 3_000, [], []
    for k, (word, quality, toxic) in enumerate((("fine", 1, 0), ("poor", 0, 0), ("vile", 0, 1))):
        for i in range(k * n, (k + 1) * n):
            made.append((i, f"{word} " * 10 + f"and {word}ly {word}er {word}est in it", "en"))
            known.append((i, quality, toxic))
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    taken = mixing.resample(table(spark, made), labels, multiples=corpus_pipeline.MULTIPLES)
    got = {r.k: r.n for r in taken.groupBy(F.floor(F.col("doc_id") / n).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for k, domain in enumerate(mixing.DOMAINS):
        part = corpus_pipeline.MULTIPLES[domain]
        assert abs(got.get(k, 0) - part * n) <= 4 * math.sqrt(n * part * (1 - part)) + 0.002 * n


def test_native_operators_run_no_python(spark):
    for name in ("op6_mixing", "op8_license_scan"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- substrings ----------------------------------------------------------------------------------
def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted((i, t or "") for i, t in rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            own = tuple(words[a : a + window])
            if own in seen:
                gone[a : a + window] = [True] * window
            seen.add(own)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("size", [8 << 20, 4_000])
def test_repeats_of_odd_rows(spark, odd, none, size, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", size)
    got = {r.key: r for r in substrings.repeats(odd, keep=("lang", "slice")).collect()}
    assert {i: (r.n_words, r.n_removed, bytes(r.kept).decode()) for i, r in got.items()} == brute_repeats([(i, t) for i, t, _ in ODD])
    assert [tuple(s) for s in got[12].spans] == [(0, 30)] and got[12].lang == "en" and got[12].slice_input == 7
    assert substrings.repeats(none).count() == 0
    whole = {r.key: r.kept for r in substrings.repeats(odd, untouched=True).collect()}
    assert whole[1] is None and bytes(whole[3]) == b" \t\n"
    unknown = odd.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert substrings.repeats(unknown).count() == len(ODD)
    first = table(spark, [(None, " ".join(f"w{i}" for i in range(40)), "en"), (-5, " ".join(f"w{i}" for i in range(10, 40)), "en")])
    assert {r.key: r.n_removed for r in substrings.repeats(first).collect()} == {None: 0, -5: 30}


def test_repeats_in_random_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 3_000)
    rng = random.Random(11)
    passages = [[f"p{k}x{rng.randint(0, 9)}" for _ in range(rng.randint(15, 60))] for k in range(6)]
    made = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{rng.random()}" for _ in range(rng.randint(0, 25))]
            passage = rng.choice(passages)
            words += passage[rng.randint(0, 10) : rng.randint(12, 60)]
        made.append((i * 37, " ".join(words), "en"))
    got = {r.key: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substrings.repeats(table(spark, made)).collect()}
    assert got == brute_repeats([(i, t) for i, t, _ in made])


def test_slices_keep_the_order(spark):
    ids = spark.range(0, 5000, 7).union(spark.range(1 << 40, (1 << 40) + 50)).withColumnRenamed("id", "k")
    slices = texts.Slices.of(ids, "k", F.lit(1000), 1000)
    got = ids.select("k", slices.number(F.col("k")).alias("s")).orderBy("k").collect()
    numbers = [r.s for r in got]
    assert numbers == sorted(numbers) and len(set(numbers)) > 100 and max(numbers) < slices.count


def test_slice_borders_bring_ids_to_the_driver_and_no_texts(spark, monkeypatch):
    rows = spark.range(4_000).select(F.when(F.col("id") < 1_500, 7).otherwise(F.col("id")).alias("k"), F.repeat(F.lit("x"), 500).alias("text"))
    sample = texts.sampled_ids(rows, "k", F.octet_length("text"), 4_000, 400)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert sample.columns == ["key", "count"] and "TakeOrdered" not in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "text" in x]
    assert 100 < sample.count() < 700
    # an id that a third of the rows have is one border; the others are about even
    points = texts.borders(rows, "k", F.octet_length("text"), 4_000, 40)
    others = sorted(set(points) - {7})
    assert len(others) > 15 and max(b - a for a, b in zip(others, others[1:])) < 400
    # the jobs of the whole cut send less than the texts hold
    seen = []
    real = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: seen.append(df.columns) or real(df))
    slices = texts.Slices.of(rows, "k", F.octet_length("text"), 20_000)
    assert slices.count > 15 and seen and all("text" not in c for c in seen)


# ---- licenses ------------------------------------------------------------------------------------
def test_license_scan_of_odd_rows(spark, odd, none):
    text = licenses.TEMPLATES["MIT"]
    words = licenses.template_words(text)
    edited = words[:40] + ["really"] + words[41:]
    cases = [(1, "word " * 700 + text), (2, " ".join(edited)), (3, " ".join(words[:40])), (4, None), (5, ""), (6, "license " * 5000), (7, f"{licenses.TEMPLATES['MIT-short']} {licenses.TEMPLATES['CC-BY-4.0']}")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(table(spark, [(i, t, "en") for i, t in cases])).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (7, "MIT-short"), (7, "CC-BY-4.0")}
    assert got[1, "MIT"].first_word == 700 and got[1, "MIT"].containment == 1 and math.isclose(got[2, "MIT"].containment, 78 / 83)
    assert licenses.scan(odd).count() == licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, {"short": "two words"})


def test_anchors_beside_underscores(spark):
    cases = [(1, "_Released under the MIT License_"), (2, "_Licensed under CC BY-NC 4.0_"), (3, "__RELEASED_UNDER_THE_MIT_LICENSE__"), (4, "Released under the MIT Licenses")]
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, [(i, t, "en") for i, t in cases])).collect()}
    assert got == {(1, "MIT-short"), (2, "CC-BY-NC-4.0-short"), (3, "MIT-short")}


def test_short_notices_side_by_side(spark):
    short = [t for t in licenses.TEMPLATES if len(licenses.template_words(licenses.TEMPLATES[t])) <= 16]
    pairs = [(a, b) for a in short for b in short if a != b]
    cases = [(i, f"{licenses.TEMPLATES[a]} {licenses.TEMPLATES[b]}", "en") for i, (a, b) in enumerate(pairs)]
    # a template of one shingle beside two of eight, all in one window
    many = {**{f"o{k}": " ".join(f"v{k}x{i}" for i in range(5)) for k in range(40)}, **{f"t{k}": " ".join(f"w{k}x{i}" for i in range(12)) for k in range(40)}}
    cases += [(1000 + k, f"{many[f'o{k}']} {many[f't{k}']} {many[f't{(k + 1) % 40}']}", "en") for k in range(40)]
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, cases), licenses.TEMPLATES | many).collect()}
    assert {(i, n) for i, pair in enumerate(pairs) for n in pair} <= got
    assert {(1000 + k, n) for k in range(40) for n in (f"o{k}", f"t{k}", f"t{(k + 1) % 40}")} <= got


# ---- language ------------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark, rows):
    lang = {i: x for i, _, x in rows}
    got = QUERIES["op9_language_id"](spark, SF_CHECK).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(odd, none):
    model = language.learn(odd, "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.identify(odd.select("doc_id", "text", "slice", "key"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[7].lang_pred == "de" and got[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language.learn(none, "text", "lang")
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    clash = language.identify(odd.withColumn("score", F.lit(7)), model).first()
    assert clash.score_input == 7 and clash.score <= 1


# ---- pages ---------------------------------------------------------------------------------------
def test_pages(spark):
    got = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, SF_CHECK).collect()}
    for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"<[^>]+>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article))
        expected = "\n".join(p for p in (" ".join(__import__("html").unescape(p).split()) for p in parts) if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (expected, len(expected))
    odd = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>x", None)], "page_id long, html string, url string")
    assert [(r.text, r.n_chars) for r in html.extract(odd).orderBy("page_id").collect()] == [("", 0), ("", 0), ("x", 1)]
    assert html.extract(odd.limit(0)).count() == 0
    assert {r.text_input for r in html.extract(odd.withColumn("text", F.lit("own"))).collect()} == {"own"}


# ---- pipeline ------------------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark, docs):
    now, folder = docs, SF_CHECK
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = storage.materialise(stage(spark, now, folder), "test")
        after = {r.doc_id: r for r in now.collect()}
        if name.startswith("language"):
            assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        elif name.startswith("SimHash"):
            near, exact = brute_near_copies({i: r.text for i, r in before.items()})
            groups = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame([tuple(r) for r in before.values()], docs.schema)).collect()}
            assert after == {i: before[i] for i in set(groups.values())}
            assert all(groups[a] == groups[b] for a, b in exact)
            assert len(near) >= 5 and sum(groups[a] == groups[b] for a, b in near) >= 0.9 * len(near)
            joined = simhash.Forest(max(groups) + 1)
            for a, b in [*near, *exact]:
                joined.join(np.array([a]), np.array([b]))
            assert all(joined.root[i] == joined.root[c] for i, c in groups.items())  # nothing else is linked
        elif name.startswith("substring"):
            cut = brute_repeats([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (n, gone, _) in cut.items() if gone < n or not n}
            assert all(r.text == (cut[i][2] if cut[i][1] else before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
        elif name.startswith("mixing"):
            labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            assert all(r == before[i] for i, r in after.items())
            toxic = [i for i in before if i in labels and labels[i].toxic]
            clean = [i for i in before if i in labels and not labels[i].toxic and labels[i].quality]
            assert sum(i in after for i in toxic) < len(toxic) / 2 and sum(i in after for i in clean) >= 0.98 * len(clean)
        else:
            for i, r in after.items():
                assert bytes(r.ids) == np.array(library.encode(before[i].text, add_bos=True, add_eos=True), "<u4").tobytes()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns


def brute_near_copies(texts, least=0.8, width=5):
    """Pairs of similar texts with different words, and each text beside the first with its words."""
    exact, first, sets = [], {}, {}
    for i, text in sorted(texts.items()):
        words = tuple((text or "").encode().lower().split())
        if words in first:
            exact.append((first[words], i))
            continue
        first[words] = i
        if len(words) >= width:
            sets[i] = {words[k : k + width] for k in range(len(words) - width + 1)}
    holders, common = {}, {}
    for i, own in sets.items():
        for s in own:
            for j in holders.setdefault(s, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[s].append(i)
    near = [(a, b) for (a, b), n in common.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    return near, exact


def test_near_copies_at_many_similarities(spark):
    """Recall against brute force on pairs that are no exact copies; a large group of near copies stays one."""
    rng = random.Random(12)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(4_000)}" for _ in range(rng.choice([30, 120, 400]))]
        rows.append(base)
        for _ in range(2):
            rows.append([w if rng.random() > rng.choice([0.002, 0.01, 0.02, 0.03]) else f"v{rng.randrange(10**6)}" for w in base])
    base = [f"w{rng.randrange(4_000)}" for _ in range(200)]
    rows += [[w if rng.random() > 0.004 else f"u{rng.randrange(10**6)}" for w in base] for _ in range(400)]
    texts = {i: " ".join(w) for i, w in enumerate(rows)} | {9_000: None, 9_001: "", 9_002: "one two", 9_003: "One  two", 9_004: "one three"}
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, [(i, t, "en") for i, t in texts.items()])).collect()}
    near, exact = brute_near_copies(texts)
    small = [(a, b) for a, b in near if b < 450]
    assert len(small) > 150 and sum(groups[a] == groups[b] for a, b in small) >= 0.9 * len(small)
    assert all(groups[a] == groups[b] for a, b in exact) and len({groups[i] for i in range(450, 850)}) == 1
    assert (groups[9_001], groups[9_003], groups[9_004]) == (9_000, 9_002, 9_004)
    joined = simhash.Forest(len(rows))
    for a, b in [*near, *(p for p in exact if p[1] < 9_000)]:
        joined.join(np.array([a]), np.array([b]))
    assert all(joined.root[i] == joined.root[c] for i, c in groups.items() if i < 9_000)


def test_wide_fingerprints_go_to_two_shards_a_field_at_most(spark, monkeypatch):
    """Rows to be shuffled do not grow with the number of shards, and links within one bit of a field are found in any shards."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (400, simhash.WIDE), dtype=np.uint64)
    twin = base.copy()
    for i in range(len(twin)):
        word, bit = divmod(int(rng.integers(0, 64 * simhash.WIDE)), 64)
        twin[i] = rng.integers(0, 1 << 63, simhash.WIDE, dtype=np.uint64) if i % 4 == 0 else twin[i]
        twin[i, word] ^= np.uint64(1 << bit)
    made = [(i, bytearray(fp.tobytes())) for i, fp in enumerate(np.concatenate((base, twin)))]
    nodes = spark.createDataFrame(made, "node long, fp binary")
    expected = {(i, i + 400) for i in range(400) if i % 4}
    dealt = []
    for rows in (8_192, 50, 5):
        monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
        seen = spark.sparkContext.accumulator(0)
        real = simhash.wide_search
        monkeypatch.setattr(simhash, "wide_search", lambda prints, *a: (seen.add(len(prints)), real(prints, *a))[1])
        assert {(r.a, r.b) for r in simhash.wide_links(nodes).collect()} == expected
        monkeypatch.setattr(simhash, "wide_search", real)
        dealt.append(seen.value)
    assert dealt[0] == 18 * 800 and dealt[1] == dealt[2] == 36 * 800


def test_pipeline_columns_named_as_helpers(spark):
    names = ("_lang", "_score", "_copy", "_rate", "_id", "_digest", "lang_pred", "score", "_0", "id", "copy", "rate", "digest", "component_id")
    now = table(spark, [r for r in ODD if r[0] in (5, 8, 11)] + [(20, "The story of the house on the hill is that of the man and his dog", "en")])
    now = now.withColumns({n: F.lit(f"own {n}") for n in names})
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = storage.materialise(stage(spark, now, SF_CHECK), "test")
        assert now.columns == columns
    rows = now.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for source in (odd, none):
        now = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = storage.materialise(stage(spark, now, SF_CHECK), "test")
            assert now.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF_CHECK).count() == now.count()
