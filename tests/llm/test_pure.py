"""The operators' array and string helpers against plain definitions."""
import random

import numpy as np
import pyarrow as pa
import pytest

from textprov.llm import brown, crosspolytope, pow2pack, ppm, simtrie, textratio


def links(values, radius):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if int(a ^ b).bit_count() <= radius]


def components(values, pairs):
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def flip(v, bits, rng):
    for b in rng.sample(range(64), bits):
        v ^= 1 << b
    return v


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_links_equal_all_pairs(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(60)]
    vals = sorted({*base, *(flip(rng.choice(base), rng.randint(1, 7), rng) for _ in range(300))})
    x = np.array(vals, np.uint64)
    turn = lambda v: v << np.uint64(32) | v >> np.uint64(32)
    found = []
    for f in (lambda v: v, turn):
        a, b = np.sort(f(x[::2])), np.sort(f(x[1::2]))
        for part in (simtrie.trie_links(a, None, 2, 4), simtrie.trie_links(b, None, 2, 4), simtrie.trie_links(a, b, 2, 4)):
            found += [(f(p), f(q)) for p, q in zip(*part)]
    assert components(vals, found) == components(vals, links(vals, 4))
    assert all(int(p ^ q).bit_count() for p, q in found)


def test_trie_empty_and_single():
    none = np.array([], np.uint64)
    assert len(simtrie.trie_links(none, None, 2, 4)[0]) == 0
    assert len(simtrie.trie_links(np.array([7], np.uint64), none, 2, 4)[0]) == 0


def test_fingerprint_by_hand():
    import xxhash
    text = "A b  c\nd e É".encode()
    words = [w for w in text.decode().replace("A", "a").split()]
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simtrie.fingerprints_of([text, b"", b" \t"]).tolist() == [want, 0, 0]
    assert simtrie.fingerprints_of([b"one two"]).tolist() == [xxhash.xxh64_intdigest(b"one two", 42)]


def test_pieces():
    assert pow2pack.piece_lengths(0) == []
    assert pow2pack.piece_lengths(2 * 2048 + 5) == [2048, 2048, 4, 1]
    for n in range(1, 5000, 7):
        p = pow2pack.piece_lengths(n)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p)


def test_token_ids_equal_the_tokenizers():
    import public_tokenizers
    enc = pow2pack.Encoder(public_tokenizers.path(pow2pack.TOKENIZER))
    rng = random.Random(5)
    bits = ["a", "bc", " ", "  ", "\n", "1", "22", ".", "é", "ß", "×", "÷", "'", "'s", "'ll", "\t", "œ", "\x1c", "\xa0",
            "<|endoftext|>", "中", "😀", "don't", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 16))) for _ in range(3000)]
    for got, t in zip(enc(texts), texts):
        assert got.tolist() == enc.tok.encode(t, add_special_tokens=False).ids, repr(t)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div>
<article><h1>A title</h1><p><b>Lead&nbsp;in   text &amp; more of it to read here.<br><p>Second   para\ngraph with <i>in</i>line
text that goes on.</p><p>De.</p><div class="share">Share this</div><form><p>Mail</p></form></article>
<section id="comments"><p>First! A long comment that looks like running text, as comments do.</p></section>
<aside><p>Related things</p></aside><footer>&copy; me</footer>"""


def test_main_text():
    assert textratio.main_text(PAGE) == ("A title\nLead in text & more of it to read here.\n"
                                         "Second para graph with inline text that goes on.\nDe.")
    assert textratio.main_text(None) == textratio.main_text("") == textratio.main_text("<p>") == ""
    plain = "<body><div class='menu'>Menu</div><div><p>Some running text of a page.</p><p>Yes.</p></div></body>"
    assert textratio.main_text(plain) == "Some running text of a page.\nYes."
    assert textratio.main_text("just text, no tags") == "just text, no tags"


def test_ratios_choose_beside_articles():
    """The body text in a div is kept whatever the article elements hold; what is in main is judged by its ratios."""
    body = [f"Paragraph {i} of the long running text of this page, which goes on and on in a plain div." for i in range(6)]
    div = "<div>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    teaser = "<article><h3>More</h3><p>A teaser with a long enough line of running text to be over the threshold of the page.</p></article>"
    got = textratio.main_text(f"<body>{div}{teaser}</body>").split("\n")
    assert got[:6] == body
    menu = "<div>" + "".join(f"<p><a href='/{i}'>Item {i}</a></p>" for i in range(8)) + "</div>"
    assert textratio.main_text(f"<body><main>{menu}{div}</main></body>").split("\n") == body
    teasers = "".join(f"<article><p>Short {i}</p><p>x</p></article>" for i in range(6))
    assert textratio.main_text(f"<body>{div}<div>{menu}</div><main>{teasers}</main></body>").split("\n") == body
    inner = f"<body>{menu}<article><h1>Title</h1>{div}<div><p>Yes.</p></div></article>{menu}</body>"
    assert textratio.main_text(inner).split("\n") == ["Title", *body, "Yes."]


@pytest.mark.parametrize("name", ["content has-sidebar", "wrapper with-header", "sidebar-layout", "content header-fixed", "no-comments page"])
def test_container_classes_do_not_empty_a_page(name):
    body = [f"Paragraph {i} of the long running text of this page, which goes on and on." for i in range(4)]
    inner = "".join(f"<p>{x}</p>" for x in body) + "<div class='cookie-notice'><p>We use cookies on all of these pages of ours.</p></div>"
    assert textratio.main_text(f"<body><div class='{name}'>{inner}</div></body>").split("\n") == body


def test_doubtful_elements_with_little_text_go():
    body = [f"Paragraph {i} of the long running text of this page, which goes on and on." for i in range(4)]
    page = "<div class='header-wrapper'><p>The name of the site and what it is for, in a line.</p></div>" + "".join(f"<p>{x}</p>" for x in body)
    page += "<div class='user-responses'><p>I think that all of this is wrong, and say so at some length here.</p></div>"
    page += "<div class='main sidebar-left'><p>Other things that one might read on this site some day.</p></div>"
    assert textratio.main_text(f"<body>{page}</body>").split("\n") == body
    # a doubtful element inside a container that stays is judged by itself
    page = "<div class='page has-nav header-top'>" + page + "</div>"
    assert textratio.main_text(f"<body>{page}</body>").split("\n") == body


def test_breaks_are_white_space_of_their_block():
    assert textratio.main_text("<p>One line,<br>another<br/>\n line</br>end.</p><p><br>Next paragraph.<br></p>") == \
        "One line, another line end.\nNext paragraph."


def test_deep_nesting_is_linear():
    import time
    text = "A paragraph of running text that is long enough."
    pages = ["<div>" * 20000 + f"<p>{text}</p>" * 2000, "<ul><li>" + "<b>" * 20000 + f"<li>{text}</li>" * 2000,
             "<div class='content has-nav sidebar'>" * 20000 + f"<p>{text}</p>" * 2000]
    for page in pages:
        at = time.process_time()
        assert textratio.main_text(page) == "\n".join([text] * 2000)
        assert time.process_time() - at < 5


def test_smoothing_keeps_a_constant():
    assert textratio.smooth([3.0] * 6) == pytest.approx([3.0] * 6)


def test_ppm_costs_are_a_code():
    """Every context's probabilities over 256 bytes sum to 1 for each language."""
    texts = {"a": b"abracadabra abracadabra", "b": b"the cat sat on the mat the end"}
    counts = {}
    for lang, t in texts.items():
        c = counts.setdefault(lang, {})
        padded = b"\0" * 3 + t
        for i in range(3, len(padded)):
            g = int.from_bytes(padded[i - 3:i + 1], "big")
            c[g] = c.get(g, 0) + 1
    m = ppm.build(counts, min_count=1)
    p = np.exp2(-m.cost.astype(float)).reshape(-1, 256, 2).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)
    bits = m.bits([b"abracadabra", b"the cat sat", b""])
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1 and bits[2].tolist() == [0, 0]
    # one by one equals together
    assert np.allclose(bits[1], m.bits([b"the cat sat"])[0])


def test_rotation_keeps_products_and_axes_are_ordered():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 20))
    y = crosspolytope.rotate(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)
    axes = crosspolytope.nearest_axes(x, 3, 5)
    both = np.concatenate([y, -y], axis=1)
    assert (axes == np.argsort(-both, axis=1)[:, :5]).all()


def test_tokens_of_slices():
    texts = pa.array(["Éa B\x0bc", None, " ", "q\xa0z\x0c\x1cé"] * 50)
    words, n = brown.tokens(texts.slice(101, 7))
    want = [(t or "").encode().lower().split() for t in texts.slice(101, 7).to_pylist()]
    assert [w.encode() for w in words.to_pylist()] == [w for t in want for w in t]
    assert n.tolist() == [len(t) for t in want]


def likelihood(pairs, cls, k):
    hot = np.eye(k)[cls]
    t = hot.T @ pairs @ hot
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(axis=1)) - f(t.sum(axis=0))


def test_gains_are_differences_of_the_likelihood():
    """Each gain equals the likelihood of the whole table with the word moved, up to one constant a word."""
    rng = np.random.default_rng(2)
    pairs = rng.poisson(1.0, (32, 32)).astype(float)
    pairs[:, 30] = pairs[30] = 3                                   # the end, then the rare words: classes of their own
    np.fill_diagonal(pairs, rng.poisson(2.0, 32))
    # every unit is left as often as it is entered
    pairs += pairs.T
    k = 4
    cls = np.concatenate([rng.integers(0, k, 30), [k, k + 1]])
    hot = np.eye(k + 2)[cls]
    off = pairs - np.diag(np.diag(pairs))
    got = brown.gains((off @ hot)[:30], (off.T @ hot)[:30], np.diag(pairs)[:30], cls[:30], hot.T @ pairs @ hot, k)
    for u in range(30):
        want = []
        for c in range(k):
            other = cls.copy()
            other[u] = c
            want.append(likelihood(pairs, other, k + 2))
        assert np.allclose(got[u] - got[u, 0], np.array(want) - want[0])


def test_gain_rows_of_small_and_large_counts():
    rng = np.random.default_rng(4)
    table, h, n = rng.integers(0, 40, (6, 5)).astype(float), rng.integers(0, 6, 200), rng.integers(1, 30, 200)
    f = lambda x: x * np.log(np.maximum(x, 1))
    want = f(table[h] + n[:, None]) - f(table)[h]
    assert np.array_equal(brown.gain_rows(brown.steps(table), table, h, n), want)


def test_word_buckets_follow_the_bytes_alone():
    words = pa.array([f"w{i}é" * (1 + i % 40) for i in range(3000)])
    got = brown.word_bucket(words, 7)
    assert np.array_equal(brown.word_bucket(words.slice(500, 900), 7), got[500:1400])
    assert np.bincount(got, minlength=7).min() > 300 and brown.word_bucket(words.slice(3, 0), 7).tolist() == []
