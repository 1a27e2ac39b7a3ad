"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.llm import bpe, exact_dedup, fertility, html_diff, line_dedup, ngram_join, packing, quality_cotrain, queries, repair, toxicity_crf
from casebook.llm.common import encode_column, hf_tokenizer, public_vocabulary, table
from tests.oracle import duck, rows

ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n  x", "don't  I'll 's", "x <|endoftext|> y<|endoftext|>", "é  b  c", "a\tb  ", " lead", "日本 語  テスト", "🙂 🙂", "a\x1c b \x85 c", "123 456,789", "q " * 300, "x\r\n y", None, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, a null id, and columns that clash with the operators' own."""
    made = [(i, t, "en", "s", 1, 0.5, True) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None), (3, "a  b", "en", "s", 1, 0.5, True), (700, "long " * 20000, None, None, None, None, None)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean")


def ids_of(t):
    return hf_tokenizer(public_vocabulary("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_bpe(spark, sf_dir, odd):
    tok = hf_tokenizer(public_vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op2_bpe_codec(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        e, g = ids_of(r.text), got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd)).collect()
    assert len(back) == odd.count()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in back) == Counter((r.doc_id, tuple(ids_of(r.text)), r.text or "") for r in odd.collect())
    flat, ends = encode_column(pa.array([t or "" for t in ODD]))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in ODD]
    assert bpe.encode(odd.limit(0)).count() == 0


def test_word_by_word_is_the_whole():
    """Texts cut into words, and words encoded many at a time, give the tokenizers library's ids of the whole text."""
    import random

    r = random.Random(1)
    bits = [*"ab cdé  \n\t\r 12'.,!<|>s t \x85\x1c 日本🙂  é́-_", "'s", " 're", "<|endoftext|>", "<|pad|>", "don't ", " the ", " of"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(20_000)]
    flat, ends = encode_column(pa.array(texts))
    want = [e.ids for e in hf_tokenizer(public_vocabulary("byte_bpe_50k.json")).encode_batch_fast(texts, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_repair(spark, sf_dir, odd, tmp_path):
    got, at = {r.doc_id: r for r in queries.op3_repair_token_files(spark, sf_dir).collect()}, 0
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        e = [*ids_of(r.text), 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(e), crc(e))
        at += len(e)
    repair.write_token_files(odd, str(tmp_path / "t"), shard_tokens=1000)
    read = repair.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted([r.doc_id for r in odd.collect()], key=lambda x: (x is not None, x or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == Counter((r.doc_id, (*ids_of(r.text), 2)) for r in odd.collect())
    assert {r.doc_id: r.ids for r in repair.fetch(spark, str(tmp_path / "t"), [4, 700]).collect()} == {4: [*ids_of(ODD[4]), 2], 700: [*ids_of("long " * 20000), 2]}
    repair.write_token_files(odd.limit(0), str(tmp_path / "e"))
    assert repair.read_token_files(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar(seed):
    x = np.random.default_rng(seed).zipf(1.3, 5000 * seed) % 50
    base, rules, lengths, seq = repair.build_grammar(x) if len(x) else (1, np.zeros((0, 2), int), np.zeros(0, int), x)
    assert (repair.expand(base, rules, lengths, seq) == x).all() and len(seq) <= len(x)
    for a in range(0, len(x), 997):
        assert (repair.expand_range(base, rules, lengths, seq, a, 60) == x[a : a + 60]).all()


def uses_left(seq):
    """The most uses without overlap that any pair of neighbours still has."""
    last, uses = {}, Counter()
    for i, pair in enumerate(zip(seq, seq[1:])):
        if last.get(pair, -2) < i - 1:
            uses[pair] += 1
            last[pair] = i
    return max(uses.values(), default=0)


def test_repair_to_the_end(spark, sf_dir):
    """No pair with two uses is left, whatever the sequence."""
    g = np.random.default_rng(0)
    made = [g.integers(0, int(g.integers(1, 6)), int(g.integers(0, 70))) for _ in range(1500)] + [np.zeros(1000, int), np.arange(500), np.tile(np.arange(7), 99)]
    texts = pa.array([r.text or "" for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()])
    made.append(encode_column(texts)[0])
    for ids in made:
        base, rules, lengths, seq = repair.build_grammar(ids)
        assert repair.expand(base, rules, lengths, seq).tolist() == ids.tolist() and uses_left(seq.tolist()) < 2


def test_toxicity(spark, odd):
    d = "/root/testdata/sf0.1"
    crf = toxicity_crf.fit(table(spark, d, "documents"), table(spark, d, "labels"))
    got = toxicity_crf.score(table(spark, d, "documents"), crf).join(table(spark, d, "labels"), "doc_id").where(toxicity_crf.held_out()).toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    assert hit > 0.85 and got[got.toxic == 0].predicted.mean() < 0.02 and got.score.between(0, 1).all()
    assert toxicity_crf.score(odd, crf, keep=("kept",)).count() == odd.count()
    none = toxicity_crf.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 3) for r in toxicity_crf.score(odd, none).collect()} == {0.5}
    assert toxicity_crf.score(odd.limit(0), crf).count() == 0


def test_spans(spark):
    crf = toxicity_crf.Crf(np.zeros(2**toxicity_crf.BITS, np.float32), np.array([[1.0, -2], [1, -0.5]]), np.array([0, -2.0]), np.array([-2.0, 0.5, 1, 0]), 0.1, True)
    own, _, _ = toxicity_crf._feature_ids(pa.array(["vile"], pa.large_string()))
    crf.weights[own[0][0]] = 12
    r = toxicity_crf.score(spark.createDataFrame([(1, "a Vile, vile day"), (2, "a fine day")], "doc_id long, text string"), crf).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in r[0].spans] == [(2, 12)] and r[1].spans == []


def brute_marginals(e, t, s):
    n, z, p = len(e), 0.0, np.zeros(len(e))
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        w = np.exp(s[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        z += w
        p += w * np.array(y)
    return p / z


def test_forward_backward():
    g = np.random.default_rng(1)
    e, t, s = g.normal(size=(3, 6)), g.normal(size=(2, 2)), g.normal(size=2)
    valid = np.ones((3, 6), bool)
    valid[1, 4:] = False
    p = toxicity_crf.marginals(e, valid, t, s)[0]
    assert np.allclose(p[0], brute_marginals(e[0], t, s)) and np.allclose(p[1, :4], brute_marginals(e[1, :4], t, s))


def test_chains_over_windows(monkeypatch):
    """Marginals, pair and start counts of whole documents, however they are cut into windows, against all paths."""
    monkeypatch.setattr(toxicity_crf, "WINDOW", 3)
    g = np.random.default_rng(4)
    sizes = [1, 11, 3, 0, 7, 4, 12]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    e, t, s = g.normal(size=offsets[-1]) * 2, g.normal(size=(2, 2)) * 2, g.normal(size=2)
    for step in (2, 1000):
        p, pairs, first = toxicity_crf.chain_marginals(e, offsets, t, s, step)
        for a, b in zip(offsets, offsets[1:]):
            if b > a:
                assert np.allclose(p[a:b], brute_marginals(e[a:b], t, s))
        assert np.isclose(pairs.sum(), sum(max(0, n - 1) for n in sizes)) and np.allclose(first[1], sum(p[a] for a, n in zip(offsets, sizes) if n))


def log_likelihood(c, w, t, s):
    total = 0.0
    for a, b in zip(c.offsets, c.offsets[1:]):
        codes = c.codes[a:b].astype(int)
        e = [sum(w[f] for f in c.own[x] if f >= 0) + (w[c.left[codes[i - 1]]] if i else 0) + (w[c.right[codes[i + 1]]] if i + 1 < len(codes) else 0) for i, x in enumerate(codes)]
        if not e:
            continue
        path = lambda y: s[y[0]] + sum(v * k for v, k in zip(e, y)) + sum(t[i, j] for i, j in zip(y, y[1:]))  # noqa: B023, E731
        total += path([int(x) for x in c.label[a:b]]) - np.log(sum(np.exp(path([k >> i & 1 for i in range(len(e))])) for k in range(2 ** len(e))))
    return total


def test_crf_gradient(monkeypatch):
    monkeypatch.setattr(toxicity_crf, "WINDOW", 2)
    monkeypatch.setattr(toxicity_crf, "BITS", 6)
    c = toxicity_crf.chains(pa.array(["a vile Vile day", "", "fine day", "so vile"], pa.large_string()), np.array([1, 0, 0, 1]), frozenset(["=vile"]))
    assert c.label.tolist() == [False, True, True, False, False, False, False, True]
    g = np.random.default_rng(6)
    w, t, s = g.normal(size=64) * 0.3, g.normal(size=(2, 2)), g.normal(size=2)
    got = c.gradient(w, t, s)
    for k, x in enumerate((w, t, s)):
        for i in np.ndindex(x.shape):
            up, down = [v.copy() for v in (w, t, s)], [v.copy() for v in (w, t, s)]
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert np.isclose(got[k][i], (log_likelihood(c, *down) - log_likelihood(c, *up)) / 2e-5, atol=1e-6)


def test_toxicity_of_odd_rows(spark, odd):
    """The query on a tiny corpus: every row by itself gets what the whole table gives it, by all paths of its chain."""
    words = ["fine", "calm", "plain", "sea", "hill", "road", "tree", "lamp"]
    g = np.random.default_rng(9)
    made = [(i, " ".join([*g.choice(words, 6), *(["scumword"] if i % 3 == 0 else []), *g.choice(words, 3)])) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    crf = toxicity_crf.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))
    rows = [*made[:40], *((r.doc_id, r.text) for r in odd.collect())]
    got = toxicity_crf.score(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()
    want = []
    for i, t in rows:
        p, offsets = toxicity_crf.token_marginals(crf, pa.array([t or ""], pa.large_string()))
        words_ = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if 0 < len(words_) <= 12:
            own, left, right = toxicity_crf._feature_ids(pa.array(words_, pa.large_string()))
            w = np.append(crf.weights.astype(float), 0)
            e = [w[own[k]].sum() + (w[left[k - 1]] if k else 0) + (w[right[k + 1]] if k + 1 < len(words_) else 0) for k in range(len(words_))]
            assert np.allclose(p, brute_marginals(np.array(e), crf.transitions, crf.start))
        top = np.clip(p.max(initial=0.0) if len(p) else 0.0, 1e-6, 1 - 1e-6)
        x = np.array([1, np.log(top / (1 - top)), np.log1p(p.sum()), np.log1p(1000 * p.sum() / max(1, len(p)))])
        want.append((i, round(float(1 / (1 + np.exp(-np.clip(x @ crf.calibration, -30, 30)))), 6)))
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == Counter(want)
    assert {r.doc_id: r.predicted for r in toxicity_crf.score(docs, crf).collect()} == {i: int(i % 3 == 0) for i in range(400)}


def article_text(raw):
    """What lies in the test pages' article, by patterns of its own."""
    import html

    m = re.search(r"<article>(.*?)(</article>|$)", raw, re.S)
    t = re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h1|br))>", "\0", m.group(1)))
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in t.split("\0")) if x)


def test_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in queries.op5_html_url_diff(spark, sf_dir).collect()}
    assert {k: (r.text, r.n_chars) for k, r in got.items()} == {k: (t, len(t)) for k, t in want.items()}
    alone = {r.page_id: r.text for r in html_diff.main_text(pages, reach=0).collect()}
    assert not any(alone[k] == t for k, t in want.items())  # the neighbours decide
    for n in (1, 3, 50):
        assert {r.page_id: r.text for r in html_diff.main_text(pages, n_ranges=n).collect()} == want


PAGES = "page_id long, url string, html string"


def texts_of(spark, pages, **more):
    return Counter((r.page_id, r.text) for r in html_diff.main_text(spark.createDataFrame(pages, PAGES), **more).collect())


def test_html_templates(spark):
    page = "<div><div>Home</div><div>Shop</div></div><div><p>{}</p><p>shared passage</p></div><div>All rights reserved</div><form>go</form><section id=comments><p>me too</p></section>"
    pages = [(i, f"http://h.org/a/{i}", page.format(f"own words {i} &amp; more")) for i in range(5)] + [(9, None, None), (10, "http://h.org/a/2b", page.format("own words 2 &amp; more")), (11, "http://[bad", "<p>alone</p>"), (0, "http://h.org/a/0", page.format("own words 0 &amp; more"))]
    want = Counter([*((i, f"own words {i} & more\nshared passage") for i in range(5)), (9, ""), (10, "own words 2 & more\nshared passage"), (11, "alone"), (0, "own words 0 & more\nshared passage")])
    for n in (1, 2, 7):
        assert texts_of(spark, pages, n_ranges=n) == want
    assert html_diff.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_html_ordinary_markup(spark):
    """Class names do not decide: titles, quoted notices and formulae of an article stay; slots beside it go."""
    page = '<div class="top">Menu {0}</div><article><div class="article-header"><h1>Title {0}</h1></div><p class="related-work">Related {0}</p><p class="notice">Note {0}</p><p>Of <math><mi>x{0}</mi></math> and more words of {0}, as articles have</p></article><div class="promo">Buy {0}!</div>'
    posts = '<div class="post share-page"><p>body {0} of a post, long enough to matter</p><p>second line {0}</p></div><div class="cookie">We bake {0}</div>'
    pages = [(i, f"https://a.org/x/{i}", page.format(i)) for i in range(4)] + [(10 + i, f"https://b.org/p?n={i}", posts.format(i)) for i in range(4)]
    assert texts_of(spark, pages) == Counter([*((i, f"Title {i}\nRelated {i}\nNote {i}\nOf x{i} and more words of {i}, as articles have") for i in range(4)), *((10 + i, f"body {i} of a post, long enough to matter\nsecond line {i}") for i in range(4))])


def test_html_copies_and_broken_markup(spark):
    """Runs of copies are no siblings; unclosed elements, a very long page and repeated lines are read whole."""
    page = "<div>Our site</div><div><h1>{0}</h1><p>Text of {0} with enough words</p></div><div>Imprint</div>"
    pages = [(i, f"http://c.org/{i:02}", page.format("the copied page")) for i in range(6)] + [(20 + i, f"http://c.org/{20 + i}", page.format(f"page {i}")) for i in range(3)]
    assert texts_of(spark, pages) == Counter([*((i, "the copied page\nText of the copied page with enough words") for i in range(6)), *((20 + i, f"page {i}\nText of page {i} with enough words") for i in range(3))])
    long = "<article>" + "".join(f"<p>line {k} <b>bold<p>same" for k in range(20_000)) + "<script>never closed"
    odd = [(1, "http://d.org/1", long), (2, "http://d.org/2", long.replace("line", "Line")), (3, "http://d.org/3", "a < b <p>c<!-- no end"), (4, "http://d.org/4", "</div></p>x"), (5, "http://d.org/5", ""), (None, "http://d.org/6", "<p>&amp;&#8364;&nbsp;1</p>")]
    got = {k: t for k, t in texts_of(spark, odd)}
    assert got[1].split("\n") == [x for k in range(20_000) for x in (f"line {k} bold", "same")]
    assert got[3] == "a < b\nc" and got[4] == "x" and got[5] == "" and got[None] == "&\u20ac 1"


def test_lcs():
    assert html_diff.shared_lines(list("abcd"), list("xbyd")) == {1, 3} and html_diff.shared_lines([], ["a"]) == set()


def test_exact_dedup(spark, odd):
    index = exact_dedup.DigestIndex(spark)
    first = index.add(odd.where("doc_id < 5 OR doc_id IS NULL")).collect()
    assert all(not r.seen_before for r in first) and Counter(r.doc_id for r in first)[3] == 2
    second = {r.doc_id: r for r in index.add(odd.where("doc_id >= 3")).collect()}
    assert second[3].seen_before and second[3].keep_id == 3 and not second[3].kept
    assert second[19].kept and not second[18].kept and second[18].keep_id == 19 and second[18].group_size == 2
    assert index.rows().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert index.add(odd.limit(0)).count() == 0


def brute_components(texts, n, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(sets[i]), find(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, sf_dir, n, percent):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    g = np.random.default_rng(5)
    base = [f"w{k}" for k in g.integers(0, 400, 120)]
    near = []
    for _ in range(60):  # copies of copies with a few edits, so that components are chains
        w = list(base if not near or g.random() < 0.5 else near[-1].split())
        for k in g.integers(0, len(w), 3):
            w[k] = f"v{g.integers(0, 50)}"
        near.append(" ".join(w))
    texts = [r.text for r in docs] + near + ["", None, "One two", "one TWO", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, n, percent, fragment_text=50_000).collect()}
    assert got == dict(enumerate(brute_components(texts, n, percent)))


def test_ngram_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    texts = [" ".join(["a b c d e f g h i j k l m n o p"] * 3 + [f"x{i % 9} y{i % 4}"]) for i in range(40)] + ["z " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, 3, 70).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 70)))


def test_ngram_join_fragments(spark, monkeypatch):
    """Partial counts of many fragments add up; blocks and fragments change nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 9)
    g = np.random.default_rng(2)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(w if g.random() > 0.02 else f"e{g.integers(0, 9)}" for w in words) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, 3, 80, segment=25).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 80)))


def test_ngram_join_long_chain(spark):
    """Each of 4,000 documents is the one before, moved on by five words: one component, 3 links either way."""
    words = [f"w{k}" for k in range(4_000 * 5 + 200)]
    df = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 200])) for i in range(4_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, 4, 85).collect()}
    assert got == {i: (197, 0, min(i, 3) + min(3_999 - i, 3)) for i in range(4_000)}


def test_ngram_join_odd(spark, odd):
    texts = [r.text for r in odd.collect()]
    want = brute_components(texts, 2, 80)  # by place of row; ids by what the rows carry
    ids = [r.doc_id for r in odd.collect()]
    groups = defaultdict(list)
    for i, (_, c, _) in zip(ids, want):
        groups[c].append(i)
    low = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(odd, 2, 80).collect())
    assert got == Counter((i, n, low[c] if n else i, k) for i, (n, c, k) in zip(ids, want))
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


def check_packing(df, docs, width=2048):
    got, pad = df.toPandas(), 0
    need = Counter((r.doc_id, len(ids_of(r.text)) + 1) for r in docs)
    have = Counter()
    for (i, n), g in got.groupby(["doc_id", "doc_tokens"], dropna=False):
        have[None if i != i else int(i), int(n)] = round(g.length.sum() / n)
        assert g.length.sum() % n == 0
    assert have == need
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = g.offset + g.length
        assert g.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.iloc[-1] <= width
        total = int(ends.iloc[-1])
        pad += width - total if total & (total - 1) else 0
    return got, pad / max(1, pad + got.length.sum())


def test_packing(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    rows_ = docs.collect()
    got, padding = check_packing(packing.pack(docs), rows_)
    assert padding < 0.02
    texts = {r.doc_id: [*ids_of(r.text), 1] for r in rows_}
    assert all(p.ids_crc32 == crc(texts[p.doc_id][p.start : p.start + p.length]) for p in got.itertuples())
    check_packing(packing.pack(odd), odd.collect())
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{175: 30_000}, {140: 10_000, 150: 9_000, 175: 12_345, 256: 7}, {3: 50, 129: 4_000, 175: 100_000, 256: 11}, {1: 3, 256: 1}])
def test_plan_rest(counts):
    slots, rest_from, n = packing.plan(counts, 2048, 8)
    assert sum((counts[c] - u) * c for c, u in rest_from.items()) <= packing.rest_bound(counts, 2048, 8)
    room, placed = Counter(), Counter()
    for c in counts:
        own = [s for s in slots if s[0] == c]
        for (_, first, per, sequence), till in zip(own, [*(s[1] for s in own[1:]), rest_from[c]]):
            assert first == placed[c] and (till - first) % per == 0
            placed[c] = till
            for k in range((till - first) // per):
                room[sequence + k] += per * c
    assert max(room.values(), default=0) <= 256 and len(room) == n and all(placed[c] == u for c, u in rest_from.items())


def test_packing_unfilled(spark, monkeypatch):
    made = spark.createDataFrame([(i, " the" * (1100 + i % 8)) for i in range(120)] + [(900 + i, " a" * 300) for i in range(9)], "doc_id long, text string")
    on_driver, best_fit = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda lengths, width: on_driver.append(len(lengths)) or best_fit(lengths, width))
    got, _ = check_packing(packing.pack(made), made.collect())
    assert got.sequence_id.nunique() == 120 and on_driver[0] < 20


def test_column_generation():
    sizes, demand = np.array([3, 5, 7]), np.array([30.0, 20, 10])
    patterns, use = packing.column_generation(sizes, demand, 10, gap=1e-9)
    assert (patterns @ sizes <= 10).all() and np.allclose(patterns.T @ use, demand) and use.sum() == pytest.approx(26.6667, abs=0.01)
    assert packing.best_pattern(np.array([0.3, 0.5, 0.71]), sizes, np.array([3, 2, 1]), 10)[1] == pytest.approx(1.01)


def test_lines(spark, odd):
    made = [(1, "Shared line here\nown one"), (2, " shared LINE here \nx\nshort\nshared line here"), (3, None), (4, "short\nshared line here"), (None, "shared line here"), (5, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for batches in (1, 3):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, batches).collect()}
        assert got == {1: (2, 0, made[0][1]), 2: (4, 2, "x\nshort"), 3: (1, 0, ""), 4: (2, 1, "short"), None: (1, 0, "shared line here"), 5: (1, 0, "")}
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, f"a line of batch {k}\nthe same line everywhere")], "doc_id long, text string"))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.seen().count() == 6


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, windows, covered = set(), 0, defaultdict(list), set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    for v in windows.values():
        if len(v) > 1:
            for i in v:
                covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_fertility(spark, sf_dir, odd):
    for df in (table(spark, sf_dir, "documents"), odd):
        got = fertility.assess(df)
        want = Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == want
    judged = fertility.assess(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1 AND NOT base_failed").toPandas()
    assert judged.kept.mean() > 0.98
    assert fertility.assess(odd.limit(0)).count() == 0


def test_cotraining(spark, odd):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality_cotrain.fit(docs, labels)
    got = quality_cotrain.score(docs, model).join(labels, "doc_id").where(toxicity_crf.held_out()).toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert quality_cotrain.score(odd, model).count() == odd.count() and quality_cotrain.score(odd.select("doc_id", "text"), model).count() == odd.count()
    none = quality_cotrain.fit(odd, labels.limit(0))
    assert {round(r.score, 3) for r in quality_cotrain.score(odd, none).collect()} == {0.5}


def test_cotraining_whole_pool(spark, odd, monkeypatch):
    made = [(i, f"fine calm words number{i % 7} of text {'good plain prose' if i % 2 else 'BUY BUY BUY !!! $$$'}", "en", "a" if i % 2 else "b", 40) for i in range(9000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, co_train = [], quality_cotrain.co_train
    monkeypatch.setattr(quality_cotrain, "co_train", lambda pool, *a: seen.append((pool.count(), co_train(pool, *a))) or seen[-1][1])
    model = quality_cotrain.fit(docs, labels)
    _, (_, _, numbers) = seen[0]
    size = docs.where(~toxicity_crf.held_out()).where("doc_id >= 200").count()
    assert size > 4000
    for v in quality_cotrain.VIEWS:
        assert 0.3 * size < numbers[-1][v] <= 0.48 * size
    assert model.fitted and {(r.doc_id % 2, r.predicted) for r in quality_cotrain.score(docs, model).collect()} == {(0, 0), (1, 1)}


def brute_cotrain(pool, jitter, known, y, rounds=4, steps=3, share=0.1):
    """Co-training on dense matrices: view -> rows x features."""
    views = ("content", "metadata")
    n, start = len(jitter), np.array([i for i in range(len(y)) if i % 4])
    w, m, u = ({v: np.zeros(known[v].shape[1]) for v in views} for _ in range(3))

    def step(v, x, t, c):
        p = 1 / (1 + np.exp(-(x @ w[v])))
        g = x.T @ ((p - t) * c) / c.sum() + 1e-5 * w[v]
        m[v], u[v] = 0.9 * m[v] + 0.1 * g, 0.99 * u[v] + 0.01 * g * g
        w[v] -= 0.3 * (m[v] / (1 - 0.9**k)) / (np.sqrt(u[v] / (1 - 0.99**k)) + 1e-9)

    for k in range(1, 51):
        for v in views:
            step(v, known[v][start], y[start], np.ones(len(start)))
    trust, good, told = 0.5 * min(1, len(start) / n), y[start].mean(), {v: np.full(n, -1) for v in views}
    for _ in range(rounds):
        c = max(1, int(share * n))
        c0, c1 = max(1, round(c * (1 - good))), max(1, round(c * good))
        sure = {}
        for v, other in (views, views[::-1]):
            z, free = pool[v] @ w[v].astype(np.float32).astype(float) + jitter, told[other] < 0
            line, f = np.sort(z[free]), free.sum()
            low, high = line[max(0, int(np.ceil(round(c0 / f * f, 9))) - 1)], line[max(0, int(np.ceil(round((f - c1 + 1) / f * f, 9))) - 1)]
            sure[other] = (free & (z <= low) & (z < -1), free & (z >= high) & (z > 1))
        for v, (no, yes) in sure.items():
            told[v][no], told[v][yes] = 0, 1
        for _ in range(steps):
            k += 1
            for v in views:
                own = told[v] >= 0
                step(v, np.concatenate([known[v][start], pool[v][own]]), np.concatenate([y[start], told[v][own]]), np.concatenate([np.ones(len(start)), np.full(own.sum(), trust)]))
    return w, {v: int((told[v] >= 0).sum()) for v in views}


def test_cotraining_by_hand(spark):
    """The exchange in Spark against dense matrices; the pool lies in chunks of odd sizes."""
    g = np.random.default_rng(8)
    bits = 2**quality_cotrain.BITS
    names = np.sort(g.choice(bits, 24, replace=False))
    y = np.array([i % 2 for i in range(24)], float)

    def rows(truth):
        content = [(names[np.r_[12 * int(t) + g.choice(12, 4, replace=False), g.choice(24, 2)]], g.integers(1, 9, 6) / 8) for t in truth]
        metadata = [(names[[int(t) if g.random() < 0.9 else 1 - int(t), 3 + int(g.integers(0, 4))]], np.ones(2)) for t in truth]
        return {"content": content, "metadata": metadata}

    flat = lambda r: (np.concatenate([f for f, _ in r]), np.concatenate([x for _, x in r]), np.concatenate([[0], np.cumsum([len(f) for f, _ in r])]))

    def dense(r):
        out = np.zeros((len(r), 24))
        for i, (f, x) in enumerate(r):
            np.add.at(out[i], np.searchsorted(names, f), x)
        return out

    known, pool = rows(y), rows(g.integers(0, 2, 160))
    jitter = g.permutation(160).astype(np.uint32) * 1000
    cuts = [0, 1, 40, 41, 100, 160]
    chunks = [quality_cotrain.pack_views({v: flat(pool[v][a:b]) for v in pool}, jitter[a:b]) for a, b in zip(cuts, cuts[1:])]
    back, j = quality_cotrain.unpack_views(chunks[3])
    assert all(np.allclose(back[v][k], flat(pool[v][41:100])[k]) for v in back for k in range(3)) and np.allclose(j, jitter[41:100] * 1e-6 / 2**30)
    stored = spark.createDataFrame([tuple(bytearray(c[k]) for k in ("sizes", "codes", "names", "values", "metadata", "jitter")) for c in chunks], quality_cotrain.FEATURES).repartition(3)
    weights, _, numbers = quality_cotrain.co_train(stored, {v: flat(known[v]) for v in known}, y)
    want, told = brute_cotrain({v: dense(r) for v, r in pool.items()}, jitter * 1e-6 / 2**30, {v: dense(r) for v, r in known.items()}, y)
    assert numbers[-1] == told and min(told.values()) > 20
    assert all(np.allclose(weights[v][names], want[v], atol=2e-3) for v in want)


def test_pipeline(spark, sf_dir, odd):
    import corpus_pipeline as C

    docs = table(spark, sf_dir, "documents")
    kept = C.toxicity(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    good = C.quality_rules(spark, docs, sf_dir)
    assert all(not brute_quality(r.text)[-1] for r in good.collect()) and good.columns == docs.columns
    single = C.exact_duplicates(spark, docs, sf_dir)
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())
    near = C.near_duplicates(spark, docs, sf_dir)
    listed = docs.orderBy("doc_id").collect()
    want = {listed[c].doc_id for _, c, _ in brute_components([r.text for r in listed], 5, 80)}
    assert {r.doc_id for r in near.collect()} == want
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() <= odd.count()
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert Counter(r.text for r in C.exact_duplicates(spark, odd, sf_dir).collect())["same"] == 1
