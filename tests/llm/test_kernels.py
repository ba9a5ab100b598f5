"""Kernels against plain definitions; no Spark."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from sentencepiece import sentencepiece_model_pb2

from tenura.llm import fuzzy, html, language, licenses, pieces, pivots, simhash, texts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_word_hashes_tell_words_apart_and_only_words():
    rng = random.Random(1)
    docs = [b"", b"  ", "é a\tb\x0bc é".encode(), b"x" * 3_000_000, *(b" ".join(rng.choice([b"a", b"ab", b"b"]) for _ in range(rng.randint(0, 50))) for _ in range(40))]
    hashes, bounds = texts.word_hashes(docs)
    words = [w for d in docs for w in d.split()]
    assert np.diff(bounds).tolist() == [len(d.split()) for d in docs]
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    spans, first = texts.window_hashes(hashes, bounds, 3)
    expected = [(i, tuple(words[i : i + 3])) for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b - 2)]
    assert first.tolist() == [i for i, _ in expected]
    assert len({(s, w) for s, (_, w) in zip(spans.tolist(), expected)}) == len({w for _, w in expected})


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "É A b é É A b é " * 9, "w " * 70_000, "Ein\x85Wort hier da dort"])
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_vantage_point_search_is_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres, *(centres[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for _ in range(6))]))
    expected = simhash.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        expected.join(np.full(len(j), i), j)
    got = simhash.Forest(len(fps))
    for number in range(3):
        part = simhash.field(fps, number)
        tree = simhash.grow(part[::5], 3)
        row, shard, home = simhash.shards_of(tree, part, 1)
        assert sorted(row[home].tolist()) == list(range(len(fps)))
        for s in range(simhash.leaves(tree)):
            own = row[shard == s]
            local = simhash.Forest(len(own))
            simhash.search(fps[own], part[own], np.flatnonzero(home[shard == s]), np.arange(len(own)), 1, 4, local)
            got.join(own, own[local.root])
    assert got.root.tolist() == expected.root.tolist()


def test_half_shards_bring_values_within_one_bit_together():
    rng = np.random.default_rng(5)
    for _, bits in simhash.FIELDS:
        values = rng.integers(0, 1 << bits, 300, dtype=np.uint64)
        for depth in (1, 5, simhash.WIDE_DEPTH):
            own = [simhash.half_shards(values, bits, h, depth) for h in range(2)]
            assert all(x.min() >= 0 and x.max() < 1 << depth for x in own)
            for bit in range(bits):
                other = [simhash.half_shards(values ^ np.uint64(1 << bit), bits, h, depth) for h in range(2)]
                assert ((own[0] == other[0]) | (own[1] == other[1])).all()


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 80))) for _ in range(2))
        assert fuzzy.edit_distance(a, b) == plain(a, b)


def test_piecewise_hash():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)).encode()
    other = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)).encode()
    one = fuzzy.fingerprint(text)
    assert one == fuzzy.fingerprint(bytes(text))
    assert fuzzy.likeness(one, fuzzy.fingerprint(text[:9000] + b"!" + text[9000:])) > 0.9
    assert fuzzy.likeness(one, fuzzy.fingerprint(other)) == 0
    assert fuzzy.fingerprint(b"") == "3::" and fuzzy.likeness("3::", "3::") == 1 and fuzzy.likeness("3::", one) == 0
    long = text * 60  # more than one block of bytes
    size, first, second = fuzzy.fingerprint(long).split(":")
    source = np.frombuffer(long, np.uint8)
    ends = np.append(np.flatnonzero(fuzzy.rolling(source) % int(size) == int(size) - 1) + 1, len(source))
    assert len(first) == len(np.unique(ends)) and len(second) <= len(first)


SAMPLES = ["", " ", "a  b ", "Übergröße — naïve", "日本語 x😀y\n\t z", "<s> ▁ ok </s>", "\x00a\x01", "1234567890" * 300, "é é"]


@pytest.mark.parametrize("text", SAMPLES)
def test_pieces_equal_the_library(text):
    with open(MODEL, "rb") as file:
        own = pieces.encoder(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    [(ids, spans)] = own.encode([text])
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert spans[1:-1].tolist() == [[p.begin, p.end] for p in library.encode(text, return_type="proto").pieces]
    assert own.decode([ids.tolist()]) == [library.decode(ids.tolist())]
    data = text.encode()
    if text:
        assert b"".join(data[a:b] for a, b in spans[1:-1].tolist()) == data


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("text", ["ﬁne ① x²", "  a　b  ", "㍿ ｶﾞ Ａ", "é é  z ", "", "   ", "½ a\tb\nc", "　", "x­ y"])
def test_compiled_character_map(text, prefix, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    normal, align = pieces.Normaliser(proto.normalizer_spec).run(text.encode())
    expected, offsets = library.normalize(text, with_offsets=True)
    assert normal.decode() == expected
    begins = np.cumsum([0, *(len(c.encode()) for c in expected)])
    assert [len(text.encode()[: align[b]].decode()) for b in begins] == list(offsets)


def test_language_grams():
    got = language.buckets_of(["Ab c", "", "é1é"])
    assert [len(b) for b, _ in got] == [5 + 4, 4 + 3]
    assert language.Model([], np.zeros((8, 0)), np.zeros(0)).predict(["abc", None])[0] == ["und", "und"]


def page(*parts: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>x='</p>'</script></head><body>{''.join(parts)}</body></html>"


STORY = "The story of the man and his dog is one that was told in the house of the king for all of his years."


def test_main_text():
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("plain  text") == "plain text"
    menu = "<nav><ul><li><a href='/a'>The house of the king and all of the men in it are to be read here</a></li></ul></nav>"
    got = html.main_text(page(menu, f"<div class='ad'>{STORY}</div>", f"<article><h1>A &amp; B</h1><p>{STORY}</p><p>Short&nbsp;one</p>", "<p>XQ ZV " * 9, f"</article><div id='comments'><p>{STORY}</p></div>", f"<footer>&copy; {STORY}</footer>"))
    assert got.split("\n") == ["A & B", STORY, "Short one", *["XQ ZV"] * 9]
    loose = html.main_text(page("<ul><li><a href=x>Home</a></li><li><a>About us</a></li></ul><h1>Head</h1>", f"<p>{STORY}</p><p>Short</p>", "<div class=cookie-notice>We and you</div>", f"<form>{STORY}</form>"))
    assert loose.split("\n") == ["Head", STORY, "Short"]
    assert html.main_text("<article><p>a <b>b</b>c<br>d &lt;p&gt; <!-- no --> e") == "a bc d <p> e"
    assert html.main_text(page(f"<main><p>{STORY}</p><aside>{STORY}</aside><section class='comment-list'><article><p>{STORY}</p></article></section></main>")) == STORY
    assert len(html.main_text("<p>" + "the word and " * 200_000)) == 13 * 200_000 - 1
    assert html.main_text("<" * 5000 + '<a href="' * 300) is not None


def test_swap_penalty_lowers_false_positives_on_group_mentions():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        toxic = i % 2
        words = rng.choices("river stone cloud table window garden".split(), k=6) + (["idiot"] if toxic and i % 3 else []) + (["muslim"] if toxic and i % 5 else [])
        rows.append((" ".join(words) + ".", toxic))
    pattern, to = toxicity.swaps(toxicity.IDENTITY_GROUPS)
    vocabulary = toxicity.Vocabulary(np.unique(toxicity.features_of([t for t, _ in rows] + ["christian"])[0]))
    number, owner = vocabulary.find([t for t, _ in rows])
    swap = []
    for text, _ in rows:
        for pair in toxicity.swapped_sentences(text, pattern, to):
            f, o = vocabulary.find(list(pair))
            was, now = set(f[o == 0].tolist()), set(f[o == 1].tolist())
            swap.append([(x, 1 if x in now else -1) for x in sorted(was ^ now)])
    flat = [(k, x, s) for k, pairs in enumerate(swap) for x, s in pairs]
    labels = np.array([t for _, t in rows], float)

    def mention(fairness: float) -> float:
        weights, base = toxicity.fit_weights(number, owner, labels, *(np.array(c) for c in ([x for _, x, _ in flat], [k for k, _, _ in flat], [float(s) for _, _, s in flat])), len(vocabulary.hashes), 1.0, fairness)
        return float(toxicity.Model(vocabulary, weights, base).score(["the muslim garden is a river"])[0])

    assert mention(0.0) > 0.8 and mention(50.0) < 0.6


def test_anchors_cover_what_a_match_needs():
    words = set(licenses.anchors(licenses.TEMPLATES))
    for text in licenses.TEMPLATES.values():
        shingles = [set(s.split()) for s in licenses.template_shingles(text)]
        assert sum(not s & words for s in shingles) < licenses.LEAST * len(shingles)


def test_prefixes_order_the_nearest_pivots():
    rng = np.random.default_rng(0)
    rows = pivots.unit(rng.normal(size=(50, 8)))
    known = pivots.chosen_pivots(rows, 10)
    assert (pivots.prefixes(rows, known, 4) == np.argsort(-(rows @ known.T), 1, kind="stable")[:, :4]).all()
    assert np.isfinite(pivots.unit(np.array([[1e300, 1e300], [1e-300, 0]]))).all()


def test_titles_in_headers_of_the_content_stay():
    inside = page(f"<div class='site-header'><h1>Site</h1></div><div id='content'><div class='article-header'><h2>Title</h2><p>By X</p></div><p>{STORY}</p></div>")
    assert html.main_text(inside).split("\n") == ["Title", STORY]
    rows = "Alpha | Beta | Gamma | Delta | Eps | Zeta | Eta | Theta | Iota | Kappa | Mu | Nu"
    assert html.main_text(page(f"<p>{STORY}</p><p>{rows}</p>", f"<p>{rows} <a href=y>x</a></p>")).split("\n") == [STORY, rows]


def test_hinted_wrappers_and_teasers_keep_the_text():
    whole = f"<h1>Title</h1><p>{STORY}</p><p>{STORY}</p>"
    side = f"<div class='sidebar'><p>{STORY}</p><ul><li><a href=x>More</a></li></ul></div>"
    want = ["Title", STORY, STORY]
    for name in ("content-sidebar-wrap", "has-sidebar", "nav-open", "widget-page", "related-layout", "social", "comments-open", "with-header"):
        for inner in (f"<main>{whole}</main>", f"<article>{whole}</article>", f"<div>{whole}</div>"):
            assert html.main_text(page(f"<div class='{name}'>{inner}{side}</div>")).split("\n") == want
    assert html.main_text(page(f"<form id='aspnetForm'>{whole}{side}</form>")).split("\n") == want
    assert html.main_text(page("<div class='has-sidebar'><p>Short one</p></div>")) == "Short one"
    card = f"<article class='card'><p>{STORY}</p></article>"
    assert html.main_text(page(f"<main>{whole}</main>{card}")).split("\n") == want
    assert html.main_text(page(f"<main>{whole}</main><article class='card'><p>A teaser</p></article>")).split("\n") == want
    assert html.main_text(page(f"<article>{whole}</article><div class='comments'>{f'<p>{STORY}</p>' * 9}</div>")).split("\n") == want
