"""Each operator against brute force, the public library, an exact round trip or held-out accuracy, and on odd input."""

import base64
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from holdfast.llm import graph, jaccard, langid, mixing, neardup, pii, queries, sentencepieces, tokenids, tsmedia, warc, wrappers
from holdfast.llm.common import Scratch, word_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


ODD = [(1, "a b", "en", "s1"), (None, None, None, None), (3, "", "en", "s1"), (4, "A  b", "de", None), (4, "A  b", "de", None), (5, "x" * 30_000 + " y " * 9_000, "en", "s2"), (6, " \t\n", None, "s2"), (7, "é😀 ▁ <|endoftext|>\x00", "fr", "s3")]
KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, empty and very long texts, and columns with clashing names."""
    return spark.createDataFrame([(*r, 1, "z", 0) for r in ODD], f"{KIND}, size int, component_id string, n int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_word_count(spark):
    texts = ["", None, " ", "a", " a  b\t\nc ", "\x1f\xa0é"]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_components(spark, scratch):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(9, 9)] + [(1000, i) for i in range(1001, 1200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# 1


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_pieces_equal_the_library(documents):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), sentencepieces.PieceEncoder(path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abethnioth'ßΣİé́   \u0085 \t\n\x1c.1²𝕏一st t'll▁aaa  ___---==") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "\n", " \n", " " * 50, "a" * 300, *documents["text"]]
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == lib.encode(t or "")
        assert own.model.decode(ids[a:b].tolist()) == lib.decode(ids[a:b].tolist())


def unigram(pieces):
    """A model file of the unigram kind, field by field."""
    import struct

    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    field = lambda tag, data: bytes([tag << 3 | 2]) + size(len(data)) + data
    out = b""
    for piece, score, type_ in pieces:
        out += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([type_]))
    return out + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_unigram_viterbi_is_the_best_split():
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(p, -rng.uniform(1, 9), 1) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "aa", "▁▁")]
    model = sentencepieces.Model(unigram(pieces))
    score = {p: s for p, s, t in pieces if t == 1}

    def best(word):
        if not word:
            return 0.0, ()
        return max((s + best(word[len(p) :])[0], (p, *best(word[len(p) :])[1])) for p, s in [(word[:n], score.get(word[:n], model.outcast if n == 1 else -math.inf)) for n in range(1, 5)] if s > -math.inf and len(p) <= len(word))

    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(200)]
    for word, ids in zip(words, model.encode_words(words), strict=True):
        # equal scores may split in more than one way
        assert "".join(model.pieces[i] for i in ids) == word and math.isclose(sum(model.scores[i] for i in ids), best(word)[0], rel_tol=1e-5)
    assert model.encode_words(["▁aéüb"])[0].count(model.unknown) == 1


def test_encode_and_decode(odd, nothing):
    got = sentencepieces.encode(odd, sentencepieces.model_path())
    rows = got.collect()
    assert len(rows) == len(ODD) and sum(r["round_trip"] for r in rows) == len(ODD) - 1  # the mark itself comes back as a space
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(got, sentencepieces.model_path()).collect()}
    assert back[5] == ODD[5][1] and back[None] == "" and back[7] == ODD[7][1].replace("▁", " ")
    assert sentencepieces.encode(nothing, sentencepieces.model_path()).count() == 0


# 2


def test_warc_round_trip(spark, scratch):
    pages = [(1, "http://a.b/x", "q"), (2, None, "q"), (3, "http://a.b/x", None), (4, "é://u@h.é:81?x", "q"), (5, "http://a.b/x", ""), (6, "http://a.b/y", "é" * 70_000), (6, "http://a.b/y", "é" * 70_000), (None, "http://a.b/x", "null id")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.archive(df, scratch).collect()}
    first = defaultdict(int)
    for i, _, h in pages:
        first[h or ""] = max(first[h or ""], i or 0) or None
    for i, _, h in pages:
        raw = (h or "").encode()
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert len(got) == 7
    assert warc.archive(df.limit(0), Scratch(spark, "test")).count() == 0


def test_one_page_id_with_two_payloads(spark, scratch):
    pages = [(1, "u", "a"), (2, "u", "b"), (9, "u", "a"), (9, "u", "b"), (3, "u", "b")]
    got = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch).collect()
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    rows = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in got)
    assert rows[1, "revisit", 9, sha("a")] == rows[2, "revisit", 9, sha("b")] == rows[3, "revisit", 9, sha("b")] == 1
    assert rows[9, "response", None, sha("a")] == rows[9, "response", None, sha("b")] == 1 and len(got) == 5


def test_a_revisit_needs_its_response(spark):
    rows = [(1, "u", 3, "AAA", "response", None), (2, "u", 3, "AAA", "revisit", 1), (3, "u", 3, "BBB", "revisit", 1), (4, "u", 3, "AAA", "revisit", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert [r["payload_bytes"] for r in warc.resolved(df.filter("page_id < 3")).collect()] == [3, 3]
    for bad in (3, 4):
        with pytest.raises(Exception, match=f"page {bad} revisits"):
            warc.resolved(df.filter(f"page_id in (1, {bad})")).collect()


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.ORG:80/a?b#c") == "org,example,www)/a?b#c" and warc.url_key("https://u:p@h.io:8080") == "io,h:8080)/" and warc.url_key(None) == ""


def test_index_reads_one_block(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    df = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"p{i}") for i in range(200)], "page_id long, url string, html string")
    entries = warc.write(df, scratch)
    directory = warc.index(entries, scratch)
    assert directory.count() >= 20
    wanted = entries.filter("page_id % 3 = 0").select("key", "page_id").union(spark.createDataFrame([("zz)/", 1), ("", 1)], "key string, page_id long"))
    assert sorted(r["page_id"] for r in warc.lookup(wanted, directory, scratch).collect()) == list(range(0, 200, 3))


# 3


def test_article_text(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    got = {r["page_id"]: r for r in queries.QUERIES["op3_html_extraction"](spark, SF).collect()}
    for page in pages.itertuples():
        inner = re.sub(r"</?(?:b|i|em)>", "", re.sub("<br>", " ", page.html[page.html.index("<article>") + 9 : page.html.index("</article>")]))
        text = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert (got[page.page_id]["text"], got[page.page_id]["n_chars"], got[page.page_id]["url"]) == (text, len(text), page.url)


def test_odd_pages(spark, scratch):
    cases = [
        ("<html><body><div class='cookie-notice'>We use</div><div id=top><a>x</a></div><div class=content><h2>T&eacute;st</h2><div>a <b>b</b>&nbsp;c<br>d</div><ul><li>one<li>two</ul><table><tr><td>q<td>r</table><div class=comments><p>bad</div></div><aside>s</aside><form><p>f</form></body>", "Tést\na b c d\none\ntwo\nq\nr"),
        ("", ""), (None, ""), ("plain  text", "plain text"), ("<p>un<p>closed", "un\nclosed"), ("<script>if(a<b)</p></script><p>x<!-- y", "x"), ("<p>a &lt; b &amp;amp; c <3 x", "a < b &amp; c <3 x"),
        ("<article><header><h1>H</h1><p>by</p></header><p>t</p><aside>x</aside></article><article>two</article>", "H\nt\ntwo"), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.x/", h, 1) for i, (h, _) in enumerate(cases)] + [(99, None, "<p>z", 1)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df, scratch).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)} | {99: "z"}
    assert wrappers.main_text(df.limit(0), Scratch(spark, "test")).count() == 0


def test_wrapper_is_union_free():
    a, b = (wrappers.skeleton(wrappers.parse(x)) for x in ("<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><h1>b</h1><ul><li>1<li>2</ul><p>z</p></div>"))
    wrappers._merge(a, b)
    assert wrappers.expression(a) == "(<div>(<h1>#</>)(<ul>(<li>#</>)+</>)?(<p>#</>)+</>)"


def learned(*pages):
    made = [wrappers.skeleton(wrappers.parse(x)) for x in pages]
    for other in made[1:]:
        wrappers._merge(made[0], other)
    return made[0]


def test_slots_and_constants_without_article_marks():
    page = "<html><body><div class=top>The Daily Site</div><h1>{0} head</h1><p>{0} lead</p><div class=post><p>" + "{0} body " * 40 + "</p><p>Read more on our site</p></div><div class=base>All rights kept</div></body></html>"
    pages = [page.format(x) for x in ("one", "two", "three")]
    found = wrappers.article(learned(*pages))
    for x, p in zip(("one", "two", "three"), pages, strict=True):
        assert wrappers.extract(p, *found) == f"{x} head\n{x} lead\n{(f'{x} body ' * 40).strip()}"
    alone = wrappers.article(learned(pages[0]))
    assert "one head\none lead\none body" in wrappers.extract(pages[0], *alone)
    same = wrappers.article(learned(*pages[:1] * 3))
    assert wrappers.extract(pages[0], *same).startswith("The Daily Site\none head\none lead")


def test_deep_pages_lose_nothing():
    page = "<div id=page><article><p>first</p>" + "<div>" * 200 + "{}" + "</div>" * 200 + "<p>rest</p></article></div><p>outside</p>"
    for inner, text in (("", ""), ("in", "in\n"), ("a<div>b</div>c", "a\nb\nc\n"), ("a<nav><div>menu</div><nav>more</nav>menu</nav>c", "a\nc\n"), ("<p>x<p>y<ul><li>1<li>2</ul>", "x\ny\n1\n2\n")):
        assert wrappers.extract(page.format(inner), None) == f"first\n{text}rest"
    assert wrappers.extract("<div>" * 200 + "<div class=ad><article>bad</article></div><article><p>good</p><nav>menu</nav></article>" + "</div>" * 200, None) == "good"


@pytest.mark.parametrize("page, text", [
    ('<body class="has-sidebar"><article><p>Hello</p></article></body>', "Hello"),
    ('<div class="single with-comments"><p>Text of it</p><div class="comments"><p>first!</p></div></div>', "Text of it"),
    ("<form id=aspnetForm><nav>menu</nav><article>the article<form>mail</form></article></form>", "the article"),
    ("<div id=sidebar-page><nav>menu</nav><h1>Title</h1><p>long text here and there</p><footer>foot</footer></div>", "Title\nlong text here and there"),
    ("<div id=header><h1>Site</h1></div><div class=story><p>One</p></div><div id=comments><article>first!</article></div>", "One"),
    ("<div>" * 160 + "<nav>MENU</nav>Hello" + "</div>" * 160, "Hello"),
    ("<article><p>a</p><div style='display: none'>b</div><p role=alert>c</p></article>", "a"),
    ("<article><div class=ad-slot>buy</div><div class=NavBar>x</div><p class=broad>a</p></article>", "a"),
])
def test_layout_is_not_taken_for_chrome(page, text):
    assert wrappers.extract(page, None) == text


def test_wrappers_do_not_depend_on_the_order(spark):
    pages = ["<div id=a><p>Same</p><p role=note>x{0}</p></div>", "<div id=a><p>Same</p></div><p hidden>h</p>", "<div id=a><p>Same</p><div role=navigation>n</div><div>b{0}</div></div>", "<div role=navigation>n</div><div id=a><p>Same</p></div>"]
    made = [p.format(i) for i, p in enumerate(pages * 3)]
    want = wrappers.article(learned(*made))
    rng = random.Random(1)
    for _ in range(20):
        rng.shuffle(made)
        assert wrappers.article(learned(*made)) == want
    rows = spark.createDataFrame([(i, f"http://h{i % 3}/", p) for i, p in enumerate(made * 4)], "page_id long, url string, html string")
    one, many = ({r["page_id"]: r["text"] for r in wrappers.main_text(rows.repartition(n), Scratch(spark, "test")).collect()} for n in (1, 20))
    assert one == many


def test_copies_of_a_page_are_no_template():
    page = "<body><div class=top>The Daily Site</div><h1>{0} head</h1><div class=box{1}><p>{0} text of it</p></div></body>"
    pages = [page.format("one", "a")] * 3 + [page.format(x, "b") for x in ("two", "three", "four", "five")]
    found = wrappers.article(learned(*pages))
    assert wrappers.extract(pages[0], *found) == "one head\none text of it" and wrappers.extract(pages[4], *found) == "three head\nthree text of it"


def test_wrapper_has_constants_and_groups():
    wrapper = learned("<div>by</div><dl><dt>a<dd>1<dd>2<dt>b<dd>3</dl>", "<div>by</div><dl><dt>c<dd>4<dt>d<dd>5</dl>", "<div>by</div><dl><dt>e<dd>6</dl>")
    assert wrappers.expression(wrapper) == "(<div>=</>)(<dl>((<dt>#</>)(<dd>#</>)+)+</>)"


# 4


def brute_links(ids, x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.where(near), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return near.sum(1), [ids[find(i)] for i in range(len(ids))]


def test_neardup_equals_brute_force(spark, scratch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base + rng.standard_normal((40, 16)) * s for s in (0.1, 0.2, 0.3, 0.4, 0.5) for _ in range(4)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    n, c = brute_links(list(range(len(x))), x)
    got = {r["vec_id"]: r for r in neardup.link(df, scratch).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == n.tolist() and [got[i]["component_id"] for i in range(len(x))] == c
    assert all(got[i]["kept"] == (c[i] == i) for i in range(len(x)))


def test_neardup_recall_at_the_threshold(spark, scratch):
    """Single pairs just over the threshold, which only the passes can find, among many others."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((600, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * side
    x = np.concatenate([a, b, rng.standard_normal((3000, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = neardup.link(df, scratch).filter("vec_id < 1200 and n_links > 0").count()
    assert found >= 0.95 * 1200


def crowded(rng, pairs, hot, other):
    """Pairs just over the threshold among vectors around one direction, pairwise cosine about 0.7, and others."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit(rng.standard_normal((1, 64)))
    around = unit(math.sqrt(0.7) * centre + math.sqrt(0.3) * unit(rng.standard_normal((hot + pairs, 64))))
    a = around[:pairs]
    side = rng.standard_normal(a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    return np.concatenate([a, 0.901 * a + math.sqrt(1 - 0.901**2) * side, around[pairs:], rng.standard_normal((other, 64))])


def test_neardup_recall_in_a_crowd(spark, scratch):
    x = crowded(np.random.default_rng(3), 300, 4000, 8000)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert neardup.link(df, scratch).filter("vec_id < 600 and n_links > 0").count() >= 0.99 * 600


def test_neardup_long_runs(spark, scratch, monkeypatch):
    """Runs beyond the limit are compared whole: two passes with one bit find what brute force finds."""
    for name, value in (("LIMIT", 100), ("BLOCK", 32), ("bits_of", lambda *_: 1)):
        monkeypatch.setattr(neardup, name, value)
    x = crowded(np.random.default_rng(4), 60, 400, 800)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    n, c = brute_links(list(range(len(x))), x)
    got = {r["vec_id"]: r for r in neardup.link(df, scratch, passes=8).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == n.tolist() and [got[i]["component_id"] for i in range(len(x))] == c


def test_neardup_repeated_ids(spark, scratch):
    rng = np.random.default_rng(7)
    x, z = rng.standard_normal((2, 16))
    far = rng.standard_normal(16)
    rows = [(5, x), (5, far), (9, x + 0.01 * z), (7, -x), (9, far), (5, x), (3, x + 0.2 * z)]
    rows.sort(key=lambda r: r[0])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    n, c = brute_links([i for i, _ in rows], np.stack([v for _, v in rows]))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.link(df, scratch).collect())
    assert got == Counter((i, int(k), g, i == g) for (i, _), k, g in zip(rows, n, c, strict=True))


def test_neardup_recall_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    pairs = crowded(rng, 125, 0, 0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(pairs)], "vec_id long, embedding array<float>")
    before = [spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for n in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(neardup.link(df, Scratch(spark, "test"), passes=4).filter("n_links > 0").count())
        assert found[0] == found[1] >= 0.95 * 250
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((200, 24)), rng.standard_normal((50, 24)) * 10.0 ** rng.integers(-6, 6, (50, 24))])
    x = neardup.matrix([r.tobytes() for r in x], "<f8")
    own = neardup.uncode(neardup.code(x))
    for threshold in (0.0, 0.3, 0.9):
        sure, maybe = neardup.decided(own, own, threshold)
        near = x @ x.T >= threshold
        assert not (sure & ~near).any() and not (near & ~sure & ~maybe).any() and maybe.mean() < 0.1


def test_neardup_passes_are_not_cut():
    for n in (10, 10**4, 10**7, 10**9):
        bits = neardup.bits_for(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** neardup.passes_for(bits) >= neardup.RECALL


def test_neardup_odd_vectors(spark, scratch):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [math.nan, 1.0]), (4, []), (5, [None, 1.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (7, [2.0, 4.0]), (None, [1.0, 2.0]), (8, [-0.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [math.inf, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, size int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in neardup.link(df, scratch).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 10, 11, None)]
    assert got == Counter(alone + [(6, 2, 6), (7, 2, 6), (7, 2, 6), (8, 1, 8), (9, 1, 8)])
    assert neardup.link(df.limit(0), Scratch(spark, "test")).count() == 0


# 5


def brute_jaccard(rows, width, num, den):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(words[j : j + width]) for j in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in held[g] if j < i).items():
            if k * den >= num * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width, share", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard_equals_brute_force(spark, scratch, documents, width, share):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(160)]
    texts = [" ".join(base)]
    for _ in range(120):  # near copies around the limit, and a passage that many share
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"n{rng.random()}"
        texts.append(" ".join(own[: rng.randint(140, 160)]))
    texts += [" ".join(base[:60] + [f"u{rng.random()}" for _ in range(rng.randint(5, 90))]) for _ in range(80)]
    rows = [*zip(documents["doc_id"].tolist(), documents["text"], strict=True), *((10_000 + i, t) for i, t in enumerate(texts))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), scratch, width, share).collect()}
    assert got == brute_jaccard(rows, width, *share)


def test_jaccard_odd(odd, nothing, scratch, spark):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd, scratch).collect())
    assert got == Counter([(1, 1, 1), (4, 1, 1), (4, 1, 1), (None, 0, None), (3, 0, 3), (6, 0, 6), (5, got_size(ODD[5][1]), 5), (7, 1, 7)])
    assert jaccard.join(nothing, Scratch(spark, "test")).count() == 0
    kept = jaccard.keep_one(odd, Scratch(spark, "test"))
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, None, 3, 5, 6, 7])


def test_jaccard_repeated_ids(spark):
    rng = random.Random(11)
    text = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(4)]
    near = lambda t: t + " end"
    rows = [(1, text[0]), (1, text[1]), (2, near(text[1])), (3, near(text[0])), (4, text[2]), (4, text[2]), (4, text[2].upper()), (None, text[3]), (None, near(text[3])), (None, text[2]), (5, None), (5, None)]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, h string, n int")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.join(df, Scratch(spark, "test")).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (None, None), (None, None), (None, 4), (5, 5), (5, 5)])
    kept = jaccard.keep_one(df, Scratch(spark, "test"))
    rows = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    assert kept.columns == df.columns
    assert Counter(i for i, _ in rows) == Counter([1, 1, 4, None, 5, 5]) and {t for i, t in rows if i == 1} == {text[0], text[1]}


def test_jaccard_long_texts_and_large_blocks(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(4000)) for _ in range(3)]
    rows = [(i * 10 + j, t if j == 0 else t + f" x{j} " * j) for i, t in enumerate(texts) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (r, c) for i, (r, c) in brute_jaccard(rows, 5, 4, 5).items()}
    for name, value in (("PART", 1000), ("BLOCK_BYTES", 20_000)):
        monkeypatch.setattr(jaccard, name, value)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, Scratch(spark, "test")).collect()} == want


def test_words_of_long_texts_are_hashed_alike(monkeypatch):
    texts = ["a  bc d" * 50, "x" * 3000 + " y z w", "", " ", None, "q \t r\n" * 100]
    whole = jaccard.Shingler(3)(texts)
    monkeypatch.setattr(jaccard, "PART", 64)
    assert all((x == y).all() for x, y in zip(whole, jaccard.Shingler(3)(texts), strict=True))


def test_counters_stay_at_their_largest_value(spark, monkeypatch):
    big = np.array([2**32 + 5, 7], np.int64)
    assert np.minimum(big, 0xFFFFFFFF).astype("<u4").tolist() == [0xFFFFFFFF, 7]


def got_size(text):
    words = text.split()
    return len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


# 6

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_equal_plain_ones():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890@@..+- ()%_é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_pii"](spark, SF).collect()}
    for i, text in zip(documents["doc_id"].tolist(), documents["text"], strict=True):
        base = plain_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and got[i]["n_email"] == sum(s[0] == "email" for s in base)
        assert set(pii.joined(base).split(",")) <= set(got[i]["spans"].split(",")) | {""}


def test_random_field_adds_torn_numbers(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    base, added = pii.find("AB!! +1!! (017)!! 555-7713!! CD!!", model)
    assert base == [] and added == [("phone", 5, 26)]
    for clean in ("version 4.0. of 3.", "nothing here", "page 12 of 40", "x" * 200_000 + " 7"):
        assert pii.find(clean, model) == ([], [])


def test_messages_equal_enumeration():
    """On a chain, which has no loops, loopy message passing is exact."""
    rng = np.random.default_rng(1)
    words = pii.Words("+1 (017) 555-7713")
    words.repeats = words.similar = []
    model = {"weights": rng.standard_normal((1 << pii.BITS, 5)), "pairs": [rng.standard_normal((5, 5)) for _ in range(3)]}
    unary = np.array([model["weights"][f].sum(0) + model["weights"][0] for f in words.features])
    joint = np.zeros((5, 5, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                joint[a, b, c] = unary[0, a] + unary[1, b] + unary[2, c] + model["pairs"][0][a, b] + model["pairs"][0][b, c]
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(pii.posteriors(words, model), [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)
    finally:
        pii.ROUNDS = rounds


def test_messages_over_skip_links_equal_enumeration():
    """A word that comes back far away: a tree of one neighbour and one skip link, where message passing is exact."""
    words = pii.Words("12 ab@c.d between 12")
    assert (words.chain, words.repeats, words.similar) == ([(0, 1)], [(0, 2)], [(0, 2)])
    words.similar = []
    rng = np.random.default_rng(5)
    model = {"weights": rng.standard_normal((1 << pii.BITS, 5)), "pairs": [rng.standard_normal((5, 5)) for _ in range(3)]}
    unary = np.array([model["weights"][f].sum(0) + model["weights"][0] for f in words.features])
    joint = unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + model["pairs"][0][:, :, None] + model["pairs"][1][:, None, :]
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        got = pii.posteriors(words, model)
        assert np.allclose(got, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)
        # the far word counts: without the link its neighbour's label does not reach it
        words.repeats = []
        assert not np.allclose(pii.posteriors(words, model)[2], got[2], atol=1e-3)
    finally:
        pii.ROUNDS = rounds


def test_training_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = (pii.train(docs.repartition(n), 300) for n in (1, 16))
    assert (one["weights"] == many["weights"]).all() and all((a == b).all() for a, b in zip(one["pairs"], many["pairs"], strict=True))


def test_overlaps_of_spans():
    rng = random.Random(6)
    for _ in range(300):
        spans = [("ip", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 6)))]
        starts, ends = pii._united(spans)
        for a in range(70):
            for b in range(a + 1, a + 6):
                assert (pii.bisect_left(starts, b) != pii.bisect_right(ends, a)) == any(x < b and a < y for _, x, y in spans)


def test_many_spans_take_linear_time():
    import time

    text = "a.b@c.org 1.2.3.4 " * 60_000
    words, spans = pii.Words(text), pii.base_spans(text)
    began = time.time()
    assert Counter(pii.labels(words, spans)) == {1: 60_000, 2: 60_000} and len(pii._united(spans)[0]) == 120_000
    assert time.time() - began < 5


def test_redaction(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "write a.b@c.org or 1.2.3.4", 26, 5), (2, None, None, 5), (2, "clean text", 10, 5)], "doc_id long, text string, n_chars long, spans int")
    rows = pii.redact(docs).collect()
    assert [(r["text"], r["n_chars"], r["spans"]) for r in rows] == [("write <email> or <ip>", 21, 5), (None, None, 5), ("clean text", 10, 5)]
    assert pii.redact(nothing).count() == 0 and pii.annotate(odd, None).count() == len(ODD)


# 7


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_language_id"](spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_chunks_lose_nothing(monkeypatch):
    text = "ein Satz, der länger ist als ein Stück " * 40
    whole = np.sort(np.concatenate(list(langid.features(text))))
    monkeypatch.setattr(langid, "CHUNK", 50)
    parts = np.sort(np.concatenate(list(langid.features(text))))
    assert set(whole) == set(parts) and abs(len(whole) - len(parts)) <= 3 * (len(text) // 50 + 1)


def plain_ngrams(text):
    """Slots of all n-grams, character by character."""
    mix, cut = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 0xFFFFFFFF
    chars = re.sub(" +", " ", "".join(" " if ord(c) < 128 and not "a" <= c <= "z" else c for c in f" {text.lower()} "))
    out = []
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            state = 0
            for k, c in enumerate(chars[i : i + n], 1):
                state = ((state ^ ord(c)) * mix[k % 3]) & cut
                state ^= state >> 15
            out.append(((state * mix[0]) & cut) >> 16)
    return out


def test_languages_equal_plain_naive_bayes(spark):
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in pq.read_table(f"{SF}/documents.parquet").slice(0, 60).to_pylist()]
    langs, matrix, priors = langid.train(spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string"))
    counts = {x: Counter() for x in sorted({r[2] for r in rows})}
    for _, text, lang in rows:
        counts[lang].update(plain_ngrams(text))
    assert langs == list(counts)
    docs = Counter(r[2] for r in rows)
    for text in (*(r[1] for r in rows[:30]), "the", "der Hund", "¿qué?", "Ωμ"):
        score = {}
        for lang, own in counts.items():
            score[lang] = math.log((docs[lang] + 1) / (len(rows) + len(langs))) + sum(math.log((own[g] + 0.1) / (sum(own.values()) + 0.1 * 65536)) for g in plain_ngrams(text))
        best = max(score, key=score.get)
        got = langid.classify(text, langs, matrix, priors)
        assert got[0] == best and math.isclose(got[1], 1 / sum(math.exp(s - score[best]) for s in score.values()), rel_tol=1e-3)


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the house and the garden {i}", "en") for i in range(4000)] + [(4000 + i, f"zxq vwk jqz {i}", "rare") for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert langid.classify("zxq vwk jqz", *model)[0] == "rare" and langid.classify("the garden", *model)[0] == "en"


def test_languages_odd(spark, odd, nothing):
    model = langid.train(odd)
    assert model[0] == ["de", "en", "fr"]
    rows = langid.annotate(odd.select("doc_id", "text"), model).collect()
    assert Counter(r["lang_pred"] for r in rows if r["doc_id"] in (None, 3, 6)) == {"und": 3}
    assert langid.annotate(odd.select("doc_id", "text"), langid.train(nothing)).filter("lang_pred <> 'und' or score <> 0").count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 7}


# 8


@pytest.mark.parametrize("n", [0, 64, 128, 162, tsmedia.UNIT - 10, tsmedia.UNIT, tsmedia.UNIT + 64, 3 * tsmedia.UNIT + 5, 500_000])
def test_stream_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stream = tsmedia.mux(data)
    payload, pts, access = tsmedia.demux(stream)
    assert payload == data and len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
    assert (pts == np.arange(len(pts)) * tsmedia.UNIT).all() and (access == 2 + np.arange(len(pts)) * tsmedia.UNIT_PACKETS).all()


def plain_stream(stream):
    """Payload by the standard, packet by packet: tables first, adaptation fields skipped, PES packets by their own length."""
    pmt = pid = None
    counter, units = {}, []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        own, start, body = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), 4
        assert p[3] & 0x10
        if own in counter:
            assert p[3] & 15 == (counter[own] + 1) & 15
        counter[own] = p[3] & 15
        if p[3] & 0x20:
            field = p[5 : 5 + p[4]]
            body = 5 + p[4]
            held = 1 + 6 * bool(field and field[0] & 0x10)
            assert set(field[held:]) <= {0xFF}  # stuffing
        data = p[body:]
        if own == 0:
            section = data[1 + data[0] :]
            assert section[0] == 0 and tsmedia.crc_mpeg(section[: 3 + ((section[1] & 15) << 8 | section[2])]) == 0
            pmt = (section[10] & 0x1F) << 8 | section[11]
        elif own == pmt:
            section = data[1 + data[0] :]
            assert section[0] == 2
            pid = (section[13] & 0x1F) << 8 | section[14]
        elif own == pid:
            if start:
                units.append(bytearray())
            units[-1] += data
    out = b""
    for unit in units:
        assert unit[:4] == b"\0\0\1\xbd" and len(unit) == 6 + (unit[4] << 8 | unit[5])  # nothing behind a PES packet
        out += unit[9 + unit[8] :]
    return out


@pytest.mark.parametrize("n", [0, 1, 64, 128, 160, 161, 162, 163, 164, 345, 346, 347, tsmedia.UNIT - 184, tsmedia.UNIT - 183, tsmedia.UNIT - 2, tsmedia.UNIT - 1, tsmedia.UNIT, tsmedia.UNIT + 64, 500_000])
def test_streams_by_the_standard(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert plain_stream(tsmedia.mux(data)) == data


def test_damaged_streams():
    stream = tsmedia.mux(bytes(5000))
    assert tsmedia.crc_mpeg(b"123456789") == 0x0376E6E7
    for bad in (stream[:-1], stream[: 188 * 5] + stream[188 * 6 :], b"\0" + stream[1:], stream[:10] + b"\xff" + stream[11:], stream[188 * 3 :]):
        with pytest.raises(ValueError):
            tsmedia.demux(bad)


def test_media_query(odd, nothing):
    rows = tsmedia.read_back(tsmedia.store(odd)).collect()
    texts = {i: t for i, t, *_ in ODD}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (None, 3)}) == 1
    assert tsmedia.read_back(tsmedia.store(nothing)).count() == 0


# 9


def test_variable_length_codes():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3 + [5], np.uint32)
    assert (tokenids.unpack(*tokenids.pack(values), len(values)) == values).all() and not len(tokenids.unpack(b"", b"", 0))
    with pytest.raises(ValueError):
        tokenids.unpack(tokenids.pack(values)[0], b"", len(values))


def test_words_equal_the_library(documents):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(path("word_bpe_49k.json")), tokenids.WordEncoder(path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'ßΣİé́ÀÞ×  \u0085 \t\n\x1c.1²𝕏一s t'll'RE<|") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for part in (texts, [t.replace("<", "") for t in texts], ["<|endoftext|> a", "<|ENDOFTEXT|>", None, ""], documents["text"].tolist()):
        ids, counts = own.encode(part)
        ends = np.cumsum(counts)
        for t, a, b in zip(part, (ends - counts).tolist(), ends.tolist(), strict=True):
            assert ids[a:b].tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_unit_table_forgets(documents):
    own = tokenids.WordEncoder(path("word_bpe_49k.json"))
    texts = documents["text"].tolist()
    want = [own.encode([t])[0].tolist() for t in texts]
    all_units = len(own.keys)
    for bound in (1, 300, 3000):
        own.max_units = bound
        own.clear()
        assert [own.encode([t])[0].tolist() for t in texts] == want
        assert len(own.keys) < all_units and (np.diff(own.keys.astype(object)) > 0).all()


def test_token_files(odd, nothing, scratch, spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = tokenids.tokenize(odd, path("word_bpe_49k.json"), scratch).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 4, 4, 5, 6, 7]
    for r, (_, text, *_) in zip(rows, [ODD[1], ODD[0], ODD[2], ODD[3], ODD[4], ODD[5], ODD[6], ODD[7]], strict=True):
        want = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want), want.tobytes())
        at += len(want)
    assert tokenids.tokenize(nothing, path("word_bpe_49k.json"), Scratch(spark, "test")).count() == 0


# 10


def test_mix_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = db.execute(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op10_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()


def test_water_filling_equals_the_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = {f"s{i:02d}": int(10 ** rng.uniform(0, 5)) for i in range(9)} | {None: 50, "zero": 0}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_src string, size long")
        names = sorted(s for s in sizes if s is not None) + [None]
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        fixed, left = {}, 1.5 * sum(sizes.values())
        while True:
            open_ = [s for s in names if s not in fixed]
            level = (left - sum(fixed.values())) / max(1, sum(weight[s] for s in open_))
            over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
            if not over:
                break
            fixed |= {s: 2.0 * sizes[s] for s in over}
        want = fixed | {s: weight[s] * level for s in open_}
        got = {r["_src"]: r["target"] for r in mixing.sources(rows).collect()}
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)


def test_mix_near_targets_and_native(spark, scratch):
    df = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), scratch)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    for r in df.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] and r["over"] <= 0


def test_mix_odd(odd, nothing, scratch, spark):
    rows = mixing.mix(odd, scratch).collect()
    assert len(rows) == len(ODD) and sum(r["size"] for r in rows) == 2 + 2 + 2 + 9001 + 3
    again = mixing.mix(odd, Scratch(spark, "test")).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(nothing, Scratch(spark, "test")).count() == 0
    mixed = mixing.repeated(odd, Scratch(spark, "test"))
    assert mixed.columns == odd.columns


def test_repeated_rows_of_the_mix(spark):
    """An id in two sources is taken in each as often as that source's plan says, whatever other columns are called."""
    rows = [(i, " ".join("abc"[: i % 3 + 1]), s, i, i, i, i, "x.y") for s, n in (("a", 40), ("b", 400), ("c", 25), (None, 60)) for i in range(n)] + [(None, "a b", "b", 0, 0, 0, 0, "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _reps int, _n int, _id int, _src int, `a.b` string")
    plan = Counter()
    for r in mixing.mix(df, Scratch(spark, "test")).groupBy("doc_id", "size", "source_size").agg(F.sum("reps").alias("n")).collect():
        plan[r["doc_id"], r["size"], r["source_size"]] += r["n"]
    size = Counter()
    for r in rows:
        size[r[2]] += len(r[1].split())
    assert len(set(size.values())) == 4  # so a size names its source
    out = mixing.repeated(df, Scratch(spark, "test"))
    got = Counter((r["doc_id"], len(r["text"].split()), size[r["source"]]) for r in out.collect())
    assert out.columns == df.columns and got == +plan and len(set(got.values())) > 1
    assert mixing.repeated(df.limit(0), Scratch(spark, "test")).count() == 0


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
