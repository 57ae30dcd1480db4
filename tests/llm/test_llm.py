"""The numbered operators against brute force and on odd rows."""

import collections
import difflib
import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelcover.llm import bpe, chat, html, langid, media, mixing, quality, simhash, substring, text, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, label int"


def prose(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 4)) for _ in range(400)]
    return [vocabulary[i] for i in r.integers(0, 400, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeats, a long text, clashing columns."""
    base = " ".join(prose(1, 300))
    near = base.replace(base.split()[150], "changed", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, None, None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \t\n", "de", None), (7, "one Two", "de", "c"), (8, "one two", "de", "c"),
        (9, " ".join(prose(2, 30_000)), "en", "a"), (10, "Ärger ÄRGER 日本語 \u00a0x", "de", "a"), (None, base, "en", "a"), (None, None, None, None), (7, "one Two", "de", "c"), (-5, " ".join(prose(3, 80)), "en", "b"),
    ]
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fingerprint(t):
    w = WORD.findall((t or "").translate(AZ))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd, docs):
    for t in [r.text for r in odd.collect()] + [r.text for r in docs.limit(60).collect()]:
        assert simhash.fingerprint(t) == fingerprint(t)


def brute_components(points, bits):
    parent = {i: i for _, i in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (f, i) in enumerate(points):
        for g, j in points[k + 1 :]:
            if (f ^ g).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for _, i in points}


@pytest.mark.parametrize("bits,shard,block", [(4, 64, 1 << 16), (4, 1 << 16, 40), (7, 32, 30), (0, 64, 64), (15, 128, 1 << 16)])
def test_vantage_point_links(spark, bits, shard, block):
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base[:150].tolist():
        for _ in range(3):
            for b in r.integers(0, 64, r.integers(1, 8)):
                f ^= 1 << int(b)
            fps.add(f)
    points = list(zip(sorted(fps), r.permutation(len(fps)).tolist(), strict=True))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in points], "fp long, id long")
    found = simhash.links(df, bits, shard, block, sample=256).collect()
    want = brute_components(points, bits)
    parent = {i: i for _, i in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in parent} == want
    assert len(found) <= 4 * len(points)


def test_near_duplicates(odd, docs):
    for df in (odd, docs):
        rows = [r for r in df.collect()]
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        want = brute_components([(fingerprint(r.text), r.doc_id) for r in rows if r.doc_id is not None], 4)
        for g in got:
            if g.doc_id is not None:
                assert g.component_id == want[g.doc_id]
        assert sorted(g.fingerprint for g in got) == sorted(f"{fingerprint(r.text):016x}" for r in rows)


def test_dedupe_keeps_one_a_group(odd):
    kept = simhash.dedupe(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 4, 7, 9, 10] and ids.count(None) == 2


def similar(s, t):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(x.translate(AZ)) for x in (s, t)))
    return len(a & b) / len(a | b)


def test_dedupe_by_similarity(spark):
    """Near copies at similarities from 0.8 to 1 go, texts that are less alike stay; a repeated id keeps its other text."""
    r, rows, want = np.random.default_rng(8), [], set()
    for g in range(150):
        words = prose(1000 + g, 60 + 4 * g)
        near = list(words)
        for i in r.choice(len(words), max(1, int(len(words) * (0.005 + 0.02 * (g % 3)))), False):
            near[i] = f"n{i}"
        a, b = " ".join(words), " ".join(near)
        rows += [(2 * g, a), (2 * g + 1, b)]
        want |= {2 * g} if similar(a, b) >= 0.8 else {2 * g, 2 * g + 1}
    base = prose(3, 60)
    ring = [base, *(base[: 5 + i] + [f"r{i}"] + base[6 + i :] for i in range(40))]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(ring)]
    want.add(1000)
    got = {x.doc_id for x in simhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = len(got - want) / sum(i % 2 for i in set(range(300)) - want)
    print("recall", 1 - lost)
    assert want <= got and lost <= 0.03
    twice = spark.createDataFrame([(1, "one two three"), (1, "four five six"), (1, "one two three")], "doc_id long, text string")
    assert sorted(x.text for x in simhash.dedupe(twice).collect()) == ["four five six", "one two three"]


def test_candidates_go_by_rare_shingles(spark):
    """Points that pairs meet by don't grow with the number of texts, and no pair of similar sets is lost, crowded or not."""
    r = np.random.default_rng(11)
    known = np.sort(r.choice(1 << 40, 300, False).astype(np.uint64))
    rank = r.permutation(300)
    for n in (1, 4, 5, 40, 200):
        for _ in range(40):
            a = np.unique(np.concatenate([r.choice(known, min(n, 300) // 2, False), r.integers(0, 1 << 40, n - n // 2).astype(np.uint64)]))
            b = np.unique(np.concatenate([r.choice(a, max(1, int(len(a) * r.uniform(0.75, 1))), False), r.integers(0, 1 << 40, int(len(a) * r.uniform(0, 0.2))).astype(np.uint64)]))
            p, q = (simhash.prefix(x, known, rank) for x in (a, b))
            assert len(p) <= 0.2 * len(a) + 1 and (simhash.jaccard(a, b) < 0.8 or len(np.intersect1d(p, q)))
    # 60 near copies and 60 others with one key in common: every similar pair of different parts, once each in every grid.
    fp = [7 ^ 1 << int(r.integers(0, 64)) if i < 60 else int(r.integers(0, 1 << 62)) for i in range(120)]
    rows = [(f if f < 1 << 63 else f - (1 << 64), i, 100, 0, 0, 0, 0, [5, 1000 + i], i // 2) for i, f in enumerate(fp)]
    points = spark.createDataFrame(rows, "fp long, id long, size long, p0 long, p1 long, p2 long, p3 long, prefix array<long>, part long")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i // 2 != j // 2 and (fp[i] ^ fp[j]).bit_count() <= 15}
    for cell in (2048, 7):
        shared = simhash.shared_keys(points, cell)
        assert {x.key for x in shared.collect()} == {5} and shared.count() == 120
        assert sorted(map(tuple, simhash.candidates(points, shared).collect())) == sorted(want)
    near = simhash.nearest(points, simhash.shared_keys(points), window=8).collect()
    assert {i for x in near for i in x} == {i for p in want for i in p} | set(range(60)) and len(near) <= 240


def test_near_copies_give_few_links(spark, monkeypatch):
    """A group whose texts are near the limit of similarity gives links in proportion to its texts, not to their pairs, and
    loses none of them, in one task or dealt out in blocks."""
    r, base = np.random.default_rng(5), prose(77, 146)
    texts = [" ".join(f"e{g}x{i}" if i in own else w for i, w in enumerate(base)) for g in range(400) for own in [set(r.choice(146, int(r.integers(1, 7)), False).tolist())]]
    texts += [" ".join(prose(9000 + i, 90)) for i in range(40)]
    sets, fps = [set(simhash.shingles(t).tolist()) for t in texts], [simhash.fingerprint(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 15 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
                pairs += 1
    assert pairs > 15 * len(texts)
    df, whole, links = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash.components, []
    monkeypatch.setattr(simhash, "components", lambda x: links.append(x.count()) or whole(x))
    groups = simhash.similar_groups
    for most in (1024, 16):
        monkeypatch.setattr(simhash, "similar_groups", lambda sets, texts, most=most: groups(sets, texts, most=most))
        assert {x.doc_id for x in simhash.dedupe(df).collect()} == {find(i) for i in range(len(texts))}
        print("links", links, "pairs", pairs)
        assert links and max(links) <= 4 * len(texts)


def test_mix(odd, docs):
    for df in (odd, docs):
        rows = mixing.mix(df).collect()
        size = collections.Counter()
        for r in df.collect():
            size[r.source] += len(WORD.findall(r.text or ""))
        names = sorted((s for s in size if s is not None)) + [None] * (None in size)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, capped = 1.5 * sum(size.values()), set()
        while True:
            free = [s for s in names if s not in capped]
            level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
            new = {s for s in free if level * weight[s] > 2 * size[s] + 1e-9}
            if not new:
                break
            capped |= new
        taken = collections.Counter()
        for r in rows:
            want = 2 * size[r.source] if r.source in capped else level * weight[r.source]
            assert r.target == pytest.approx(want) and r.source_size == size[r.source] and r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert len(rows) == df.count()
        for s in names:
            want = 2 * size[s] if s in capped else level * weight[s]
            assert abs(taken[s] - want) <= max(4, 0.05 * size[s])
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))


def test_mixed_rows(docs):
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = collections.Counter()
    for r in mixing.mixed(docs).collect():
        out[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in plan.items() if v} == dict(out)


def test_mixed_rows_of_one_id(spark):
    """Rows that share an id, have none or are equal follow their own plans; a part keeps its white space; clashing columns stay."""
    rows = [(7, " ".join(prose(40 + i, 30)), "a") for i in range(6)] + [(None, "x y\n\nz  w", "a"), (None, "p q", "b"), (8, "s t\nu v w", "b"), (8, "s t\nu v w", "b"), (9, None, None), (9, "", "b"), (10, " one\n two three", None)]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, source string, mix_size int, mix_key string")
    for share in (0.5, 1.0, 1.5):
        plan, out = collections.Counter(), collections.Counter()
        for r in mixing.mix(df, share).collect():
            plan[r.doc_id, r.source] += r.taken
        texts = {r[1] for r in rows}
        for r in mixing.mixed(df, share).collect():
            assert (r.mix_size, r.mix_key) == (5, "k") and any(t and t.startswith(r.text) for t in texts)
            out[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert out == collections.Counter({k: v for k, v in plan.items() if v})
    with pytest.raises(ValueError):
        mixing.mix(df, 1.0, 1.5)


def test_stages_keep_clashing_columns(spark):
    """Names that the stages use within themselves, as columns of the table."""
    rows = [(1, " ".join(prose(1, 60)), "a"), (2, " ".join(prose(1, 60)), "b"), (None, " ".join(prose(2, 60)), "a"), (3, None, None)]
    names = ["d", "t", "k", "key", "mark", "tie", "size", "near_of", "mix_of", "bucket", "block"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for stage in (simhash.dedupe, mixing.mixed):
        out = stage(df)
        assert out.columns == df.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())


def test_rows_without_id_are_spread(spark):
    """Their order goes by text, so a source's rows without doc_id don't share a place."""
    df = spark.createDataFrame([(None, " ".join(prose(i, 20)), "a") for i in range(60)], "doc_id long, text string, source string")
    marks = df.select(mixing._tie(F.col("text")).alias("tie")).select(F.xxhash64(F.lit(7), F.lit(None).cast("long"), "tie").alias("m"))
    assert marks.distinct().count() == 60
    assert sorted(r.taken for r in mixing.mix(df).collect()) == sorted(r.taken for r in mixing.mix(df.repartition(7)).collect())


LONG = "This is a long paragraph of the article with many words in it, so that it counts as prose by itself. " * 3


@pytest.mark.parametrize("wrap", ["article", "div"])
@pytest.mark.parametrize("middle,kept", [
    ("<p>See <a href=x>this</a>.</p>", "See this."), ("<p>See <a>this</a> and <a>that</a> for details.</p>", "See this and that for details."), ("<p><a>Only a link</a></p>", "Only a link"),
    ("<table><tr><td>Cell</td><td><a>Linked</a></td></tr></table>", "Cell Linked"), ('<div class="entry-header"><h2>Headline</h2></div>', "Headline"), ('<p class="related-work">Related work is old.</p>', "Related work is old."),
])
def test_linked_text_stays(wrap, middle, kept):
    got = html.main_text(f"<body><nav><a>Home</a></nav><{wrap}><p>{LONG}</p>{middle}<p>{LONG}</p></{wrap}><footer>foot</footer></body>")
    assert got == f"{LONG.strip()} {kept} {LONG.strip()}"


def test_references_and_headers_of_an_article():
    got = html.main_text(f"<article><header><h1>Title</h1></header><p>{LONG}</p><ul><li><a>Ref one</a></li><li><a>Ref two</a></li><li><a>Ref three</a></li></ul><p>{LONG}</p></article>")
    assert got == f"Title {LONG.strip()} Ref one Ref two Ref three {LONG.strip()}"


@pytest.mark.parametrize("wrap", ["main", "div"])
def test_menus_without_a_name_go(wrap):
    menu = "<div>" + "".join(f"<div><a href=#>Menu item {k}</a></div>" for k in range(12)) + "</div>"
    got = html.main_text(f"<body><{wrap}>{menu}<p>{LONG}</p><p>{LONG}</p>{menu}</{wrap}><div class='cookie-banner'>Accept</div><div id='site-nav'>Go</div></body>")
    assert got == f"{LONG.strip()} {LONG.strip()}"


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>Menu</nav><div class='cookie-notice'>Cookies</div><article><h1>A &amp;  B</h1><p>First<br>line &lt;x&gt;<script>bad()</script></p>"
        "<aside>Side</aside><div class='ad'>Buy</div><ul><li>one<li>two</ul><section class='comments'><p>me too</p></section></article><footer>F</footer></body></html>"
    )
    assert html.main_text(page) == "A & B First line <x> one two"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain text only") == "plain text only"
    long = "".join(f"<p>This paragraph number {i} is prose that goes on for a while.</p>" for i in range(50))
    links = "<div>" + "".join(f"<a href=x>{i}</a> <b>|</b>" for i in range(60)) + "</div>"
    got = html.main_text(f"<body>{links}{long}{links}</body>")
    assert got.startswith("This paragraph number 0") and got.endswith("49 is prose that goes on for a while.")


def test_html_method_decides():
    """The smoothed ratios choose, whatever elements say main or article."""
    prose_of = lambda n: " ".join(f"<p>Paragraph {i} tells at some length what happened on that day.</p>" for i in range(n))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(12)) + "</ul>"
    got = html.main_text(f"<body><main>{menu}<div><h2>Title</h2>{prose_of(6)}</div>{menu}</main></body>")
    assert got.startswith("Title Paragraph 0") and got.endswith("that day.") and "Go" not in got
    teasers = "".join(f"<article><a href=/{i}>More {i}</a></article>" for i in range(5))
    got = html.main_text(f"<body><div>{prose_of(6)}</div>{teasers}</body>")
    assert got.startswith("Paragraph 0") and got.endswith("that day.") and "More" not in got
    assert html.main_text("<article><h1>A</h1><p>b.</p>" + "<p>c d.</p>" * 30 + "</article>") == "A b." + " c d." * 30
    assert html.main_text("</b>" * 50_000 + "<p>x</p>" * 3) == "x x x"


def test_html_without_article_elements(spark):
    """Texts of the given pages, whose article element bounds the text, come out nearly whole when that name is taken away."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    kept = same = words = 0
    for r in rows:
        want, got = html.main_text(r.html).split(), html.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)).split()
        kept += sum((collections.Counter(want) & collections.Counter(got)).values())
        words, same = words + max(len(want), len(got)), same + (want == got)
    assert kept >= 0.99 * words and same >= 0.98 * len(rows)


def test_html_lines_against_plain_steps():
    """Smoothing and threshold against loops; a page's text against the article cut out with regular expressions."""
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        v = r.random(n) * 50
        w = [np.exp(-0.5 * d * d) for d in range(-3, 4)]
        want = [sum(w[d + 3] * v[min(n - 1, max(0, i + d))] for d in range(-3, 4)) / sum(w) for i in range(n)]
        assert html.smooth(v) == pytest.approx(want)
    t = html.threshold(np.array([1.0, 2, 1, 40, 50, 45]))
    assert 2 < t < 40
    import html as library

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist():
        body = re.search(r"<article>(.*?)</article>", page, re.S)
        body = re.sub(r"<!--.*?-->", "", re.sub(r"<(script|style|aside|nav|form)\b.*?</\1>", "", body[1], flags=re.S), flags=re.S)
        if "class=" in body or "id=" in body:
            continue
        blocks = [re.sub(r"\s+", " ", library.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|h2|br|ul|li|div|blockquote|table|tr|td)\b[^>]*>", body)]
        assert html.main_text(page) == " ".join(b for b in blocks if b)


def test_html_marked_paragraph_without_end():
    assert html.main_text("<div><p class='ad'>Buy<p>Article text goes on.<p>And on.</div>") == "Article text goes on. And on."
    assert html.main_text("<article><p class=ad>Buy <b>now<h2>Title</h2><p>Text.</article>") == "Title Text."
    assert html.main_text("<div><p class=ad>Buy<ul><li>one</ul><table><tr><td>two</table></div>") == "one two"
    assert html.main_text("<p class=ad>Buy <button><div>x</div></button> more</p>Text.") == "Text."


def test_extract_rows(spark):
    rows = [(1, "u", "<p>x  y</p>"), (1, "u", "<p>x  y</p>"), (None, None, None), (2, "v", "<p>" + "word " * 200_000)]
    got = html.extract(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(((r.page_id or 0), r.n_chars) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 999_999)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bpe_equals_library(odd, docs):
    from tokenizers import Tokenizer

    path = bpe.public_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in odd.collect()] + docs.limit(80).collect()
    got = bpe.encode_documents(odd.select("doc_id", "text").unionByName(docs.limit(80).select("doc_id", "text")), full=True).collect()
    by_text = {}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        by_text[hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] = (ids, decoded)
    assert len(got) == len(rows)
    for g in got:
        ids, decoded = by_text[g.ids_sha256]
        assert g.ids == ids and g.decoded == decoded and g.n_tokens == len(ids)
        assert g.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    own = bpe.load(path)
    for t in ["a<|endoftext|>b", "ΑΣ ΟΔΟΣ", "a\x1cb\x85c", "it's I'LL", "½²٣", "e\u0301", "👩‍👧", "x" * 3000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_remembered_words_are_bounded():
    made = []
    r = bpe.Recent(lambda k: made.append(k) or k * 2, 50_000)
    for turn in range(3):
        for i in range(2000):
            assert r[f"w{i}"] == f"w{i}w{i}"
    assert r.size <= 50_000 and len(r) + len(r.old) < 1000 and r["x" * 60_000] == "x" * 120_000 and "x" * 60_000 not in r


def test_quality(odd, docs):
    rows = odd.collect() + docs.collect()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        n, seen, dup = len(w), set(), 0
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        inside = set()
        for i in range(n - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        got = quality.judge(r.text)
        want = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)
        assert got[:6] == want
        assert not (got[6] and got[5])
    assert quality.assess(odd).count() == odd.count()
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.where("doc_id > 1").collect()] == [2, 3, 9]
    line = "the same words stand here once more\n"
    assert not quality.judge(line * 30)[6] and quality.judge(" ".join(prose(5, 200)))[6]


CONV = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 0, "user", "\\"), (1, 2, "assistant", "\n</turn>\n### User: x"), (1, 3, "sys: tem\\n", "a\\</turn>\\"), (2, 0, None, None), (2, 0, None, None), (None, 5, "User", "x\\\\### Tool: y"),
        (3, 0, "assistant", "z" * 100_000), (3, None, "assistant", ""), (3, 1, "\u0001s", "### \\### A: ### "),
    ]
    df = spark.createDataFrame([(*r, "f") for r in rows], CONV)
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    spans = {r.conv_id: r for r in out.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=key)
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        f = spans[c].formatted
        assert re.sub(r"\\(\\*)(### [A-Za-z]{1,20}: |</turn>)", r"\1\2", "".join(f[s.start : s.end] for s in spans[c].loss_spans)) == loss
        assert f.count("\n</turn>\n") == len(turns)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
    # The loss text comes from the mask: another mask is another text.
    moved = {r.conv_id: r for r in chat.digest(out.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))))).collect()}
    assert all(moved[c].loss_chars == len(spans[c].loss_spans) and moved[c].turns_sha256 == got[c].turns_sha256 for c in moved)


def test_chat_settles_on_whole_conversations(spark):
    """Turns without conflict stay plain, a turn border or control string inside a text is escaped, and all come back."""
    plain = [("user", "hi"), ("assistant", "a\nb ### no\\")]
    hard = [("user", "x\n</turn>\n### Assistant: y"), ("assistant", "y"), ("user", "y\\### Assistant: z"), ("assistant", "### Assistant: z")]
    d = spark.createDataFrame([(1, plain), (2, hard), (3, [])], "conv_id long, turns array<struct<role: string, text: string>>")
    got = {r.conv_id: r for r in chat.settle(d).collect()}
    assert got[1].formatted == "### User: hi\n</turn>\n### Assistant: a\nb ### no\\\n</turn>\n" and not any(got[1].escaped)
    assert got[2].escaped[0] and got[2].escaped[2] and got[2].escaped[3] and got[3].formatted == ""
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.settle(d).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: plain, 2: hard, 3: []}
    assert spark.range(1).select(chat.parse(F.lit("### User: bare ### User: inside\n</turn>\n")).alias("t")).first().t[0].text is None


def test_urls(spark):
    made = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "https://sub.example.com/en/2", "http://example.com/fr", "http://x.net/es/1", "http://x.net/de/", "http://x.org", "no url", "", None, "ftp://com/", "http://a.com", "http://a.com?x=/en/", "http://[::1]:80/p#q", "a://b://c/d", "http://x.org/spam.html?a=1", "http://x.org/spam/", "http://x.net/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(made)], "page_id long, url string, host string")
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    listed = spark.createDataFrame([("x.org/spam",), ("x.org/spam",), (None,), ("nowhere/y",)], "entry string")
    got = {r.page_id: r for r in urls.judge(pages.select("page_id", "url"), spark.createDataFrame(rules, "rule string, action string"), listed).collect()}
    assert len(got) == len(made)
    for i, u in enumerate(made):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(AZ)
        fit = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
        best = max(fit, key=lambda r: len(r[0])) if fit else None
        on_list = re.sub(r"(/|\.html)$", "", host + path) == "x.org/spam"
        g = got[i]
        assert (g.host, g.path, g.rule, g.listed) == (host, path, best[0] if best else None, on_list)
        assert g.verdict == (best[1] if best else "block" if on_list else "allow")
    many = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("entry"))
    tried = spark.range(6000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    assert urls.hits(tried, many, 3000).count() == 3000
    assert urls.judge(pages.select("page_id", "url").limit(0), spark.createDataFrame(rules, "rule string, action string")).count() == 0


def test_winnow():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 16, 17, 400):
        h = r.integers(0, 1 << 63, n, dtype=np.uint64)
        got = set(substring.winnow(h, 16).tolist())
        want = {i + max(j for j in range(16) if h[i + j] >> np.uint64(24) == min(h[i : i + 16] >> np.uint64(24))) for i in range(n - 15)} if n > 16 else ({int(h.argmin())} if n else set())
        assert got == want


def test_passages(spark):
    shared = prose(50, 70)
    fuzzy = [w if i % 12 else f"x{i}" for i, w in enumerate(shared)]
    p = {1: prose(51, 200) + shared + prose(52, 100), 2: prose(53, 150), 3: prose(54, 90) + shared + prose(55, 40), 4: prose(56, 30) + fuzzy, 5: shared[:30] + prose(57, 120), 6: prose(58, 120), 7: prose(51, 200)}
    rows = [(k, " ".join(v)) for k, v in p.items()] + [(8, None), (9, ""), (None, " ".join(shared)), (10, "w " * 500), (11, "w " * 400), (3, " ".join(p[3]))]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, start string, h int")
    got = substring.passages(df).collect()
    pairs = {(r.doc_id, r.ref_id) for r in got}
    assert {(3, 1), (4, 1), (7, 1)} <= pairs and not {d for pair in pairs for d in pair} & {2, 5, 6, 8, 9}
    exact = next(r for r in got if (r.doc_id, r.ref_id) == (3, 1))
    assert (exact.start, exact.stop, exact.ref_start, exact.ref_stop) == (90, 160, 200, 270)
    f = next(r for r in got if (r.doc_id, r.ref_id) == (4, 1))
    assert f.start in (30, 31) and f.stop == 100 and 0.8 <= f.similarity < 1
    left = {r.doc_id: r.text for r in substring.remove(df.where("doc_id <> 3")).collect()}
    assert left[1] == " ".join(p[1]) and 7 not in left and left[4].split() == (p[4][:30] + ([p[4][30]] if f.start == 31 else []))
    assert substring.passages(df.limit(0)).count() == 0


def test_fuzzy_passages(spark):
    """Passages with evenly spread edits at rates from 0 to 0.2, against the share of words that truly agree."""
    rows, ask, n = [], {}, 0
    for length in (50, 60, 100):
        for every in (0, 10, 8, 7, 6, 5):
            for turn in range(8):
                p = prose(5000 + n, length)
                q = [f"x{i}" if every and i % every == every // 2 else w for i, w in enumerate(p)]
                rows += [(2 * n, " ".join(prose(7000 + n, 60) + p + prose(8000 + n, 60))), (2 * n + 1, " ".join(prose(9000 + n, 60) + q + prose(6000 + n, 60)))]
                ask[2 * n + 1] = (length, every)
                n += 1
    got = {(r.doc_id, r.ref_id) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.defaultdict(list)
    for d, key in ask.items():
        found[key].append((d, d - 1) in got)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    print("recall", recall)
    # With every fifth of just LEAST words changed, the last run is too short to reach the passage's end.
    assert all(v >= 0.9 for key, v in recall.items() if key != (50, 5))


def test_best_chains():
    """Scores against the plain recurrence over all earlier seeds; every seed is in one chain, none steps too far."""
    r = np.random.default_rng(4)
    for n in range(1, 120):
        points = sorted({(int(a), int(b)) for a, b in r.integers(0, 20 + 3 * n, (n, 2))})
        pos, ref = [p for p, _ in points], [q for _, q in points]
        want = []
        for i in range(len(pos)):
            want.append(max([substring.VALUE] + [want[j] + substring.VALUE - substring.COST * (pos[i] - pos[j] + ref[i] - ref[j]) for j in range(i) if pos[j] < pos[i] and ref[j] < ref[i]]))
        score, back = substring.scores(pos, ref)
        assert score == pytest.approx(want) and all(j < 0 or (pos[j] < pos[i] and ref[j] < ref[i]) for i, j in enumerate(back))
        assert sum(c[4] for c in substring.chains(pos, ref)) == len(pos)
    assert sorted(c[:2] for c in substring.chains([0, 5, 90, 95], [0, 5, 90, 97])) == [(0, 5), (90, 95)]


def test_nearest_run_is_difflibs():
    """The same run as by all matching blocks, of which none behind the wanted one is made."""
    r = np.random.default_rng(6)
    for n in range(600):
        x = [b"%d" % i for i in r.integers(0, 3 + n % 40, r.integers(1, 64))]
        y = list(x)
        for i in r.integers(0, len(x), 1 + n % 9):
            y[i : i + int(r.integers(0, 3))] = [b"%d" % k for k in r.integers(0, 3 + n % 40, r.integers(0, 3))] if i < len(y) else []
        for inside in (True, False):
            blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
            want = next(((m.a, m.b) for m in blocks if m.size > (0 if inside and m.size >= 3 else max(2, m.a, m.b))), None)
            assert substring.nearest_run(x, y, inside) == want


def test_scattered_passages(spark):
    """A passage whose sentences all stand in earlier documents, each in another, is found in the document that has it whole."""
    rows = []
    for g in range(30):
        sentences = [prose(20_000 + 10 * g + i, 12) for i in range(5)]
        for i, x in enumerate(sentences):
            rows.append((100 * g + i, " ".join(prose(30_000 + 10 * g + i, 40) + x + prose(31_000 + 10 * g + i, 40))))
        whole = sum(sentences, [])
        rows += [(100 * g + 10, " ".join(prose(32_000 + g, 50) + whole + prose(33_000 + g, 50))), (100 * g + 20, " ".join(prose(34_000 + g, 30) + whole + prose(35_000 + g, 70)))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_id) for r in got if r.stop - r.start >= 58} == {(100 * g + 20, 100 * g + 10) for g in range(30)}
    assert {r.doc_id % 100 for r in got} <= {10, 20}  # 10 has a span of passages from five documents


def test_passages_cover_all_exact_repeats(docs):
    """Every run of 50 words that an earlier document has lies in a span, by brute force over all runs."""
    rows = sorted((r.doc_id, WORD.findall(r.text.translate(AZ))) for r in docs.collect() if r.text)
    spans = collections.defaultdict(set)
    for r in substring.passages(docs).select("doc_id", "span_start", "span_stop").distinct().collect():
        spans[r.doc_id] |= set(range(r.span_start, r.span_stop))
    seen, missed, asked = {}, 0, 0
    for d, w in rows:
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) != d:
                asked += 1
                missed += not spans[d].issuperset(range(i, i + 50))
    assert asked > 100 and missed <= 0.05 * asked


def test_without():
    assert substring.without("a b  c\nd", [(1, 3)]) == "a d" and substring.without("a b", [(0, 2)]) == "" and substring.without("a b c", [(2, 3)]) == "a b "


def test_language(docs, odd):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = [r for r in docs.collect()]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    more = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {more[i].lang_pred for i in (4, 5, 6)} == {"und"} and all(0 <= r.score <= 1 for r in more.values())
    two = {r.lang: r.text for r in rows if r.lang in ("en", "fr") and r.n_chars > 1500}
    both = odd.sparkSession.createDataFrame([(1, two["en"][:1500] + " " + two["fr"][:1500])], "doc_id long, text string")
    names = {x.split(":")[0] for x in langid.predict(both, model).first().languages}
    assert {"en", "fr"} <= names
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == odd.count() and {r.lang_pred for r in nothing} == {"und"}


def test_media(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 80").select("vec_id", "embedding")
    v = v.unionByName(spark.createDataFrame([(1000, None), (None, None)], "vec_id long, embedding array<float>"))
    images = media.paint(v)
    got = {r.id: r for r in media.near_copies(images).collect()}
    assert len(got) == v.count()
    for i in range(80):
        assert (got[i].class_id == i - 1 and got[i].n_links == 1) if i % 10 == 7 else got[i].class_id == i
    same = images.where("id < 5").select("id", "image").unionByName(images.where("id < 5").select((F.col("id") + 100).alias("id"), "image"))
    classes = {r.id: r.class_id for r in media.near_copies(same).collect()}
    assert all(classes[i + 100] == i for i in range(5))
    assert media.near_copies(same.limit(0)).count() == 0


def test_crowded_group_of_images(spark):
    r = np.random.default_rng(1)
    base = r.normal(0, 0.125, 64)
    rows = [(i * 10, (base + r.normal(0, 0.0005, 64)).tolist()) for i in range(400)] + [(i * 10 + 3, r.normal(0, 0.125, 64).tolist()) for i in range(20)]
    images = media.paint(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {x.id: x for x in media.near_copies(images).collect()}
    assert {got[i * 10].class_id for i in range(400)} == {0} and all(got[i * 10 + 3].n_links == 0 for i in range(20))
    assert sum(x.n_links for x in got.values()) / 2 < 400 * 399 / 2 / 4  # classes are whole without all pairs


def brute_links(found):
    """Linked pairs of ids among corners {id: rows of (at, d0 to d3)}, by comparing all corners of all images."""
    links = set()
    for a in sorted(found):
        for b in sorted(found):
            if a >= b or not len(found[a]) or not len(found[b]):
                continue
            x, y = (np.array(found[i], np.int64) for i in (a, b))
            bits = np.bitwise_count((x[:, None, 1:] ^ y[None, :, 1:]).view(np.uint64)).sum(2)
            votes = {}
            for i, j in zip(*np.nonzero(bits <= media.NEAR), strict=True):
                (ya, xa, sa, ta), (yb, xb, sb, tb) = ((int(p) >> 40, int(p) >> 16 & 0xFFFFFF, int(p) >> 12 & 15, int(p) & 0xFFF) for p in (x[i, 0], y[j, 0]))
                ya, xa, yb, xb, turn = ya / 4, xa / 4, yb / 4, xb / 4, (tb - ta) % 360
                c, s, ratio = np.cos(np.radians(turn)), np.sin(np.radians(turn)), media.SCALES[1] ** (sa - sb)
                dx, dy = xb - ratio * (c * xa - s * ya), yb - ratio * (s * xa + c * ya)
                for u in (0, 1):
                    for v in (0, 1):
                        key = ((turn + media.TURN / 2) // media.TURN % (360 // media.TURN), sa - sb, np.floor(dx / 12 + u / 2), np.floor(dy / 12 + v / 2), u, v)
                        votes.setdefault(key, set()).add((xa // 2, ya // 2))
            if any(len(v) >= media.AGREE for v in votes.values()):
                links.add((a, b))
    return links


def test_media_links_against_all_pairs_of_corners(spark):
    """Of the links that comparing all corners gives, at least 0.9 are found, for each kind of copy, and no other."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 200 and vec_id % 10 in (6, 7)").select("vec_id", "embedding")
    images = media.paint(v).collect()
    found = {r.id: media.features(media.decode(r.image)) for r in images}
    got = {(r.a, r.b) for r in media.consensus(media.matches(functools.reduce(lambda a, b: a.union(b), media.shared_keys(media.describe(media.paint(v)))))).collect()}
    links = brute_links(found)
    assert got <= links and len(got) >= 0.9 * len(links) and len(links) == 20


def test_media_keeps_one_slice_of_keys(spark, tmp_path, monkeypatch):
    """Of the tables of keys, one slice at most is on disk at a time, and images aren't shuffled."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 100").select("vec_id", "embedding")
    held, most, write, drop = {}, [0], media.materialize, media.release

    def written(df, name="table"):
        out = write(df, name)
        held[out.inputFiles()[0].rsplit("/", 1)[0]] = name
        most[0] = max(most[0], sum(n == "keys" for n in held.values()))
        return out

    def released(df):
        for f in df.inputFiles():
            held.pop(f.rsplit("/", 1)[0], None)
        drop(df)

    monkeypatch.setattr(media, "materialize", written)
    monkeypatch.setattr(media, "release", released)
    got = {r.id: r.class_id for r in media.near_copies(media.paint(v)).collect()}
    assert most == [1] and "corners" not in held.values() and "hot" not in held.values()
    assert len(got) == v.count() and all(got[i] == i - 1 for i in got if i % 10 == 7)


def test_classes_of_crowded_keys(spark):
    """Groups of near copies, and a corner shown by many others: with a bound of two corners a key and with none, the classes are the same."""
    r = np.random.default_rng(3)
    at = np.arange(64)
    images = []
    for g in range(5):
        base = media.decode(media.paint(spark.createDataFrame([(g, r.normal(0, 0.125, 64).tolist())], "vec_id long, embedding array<double>")).first().image).astype(float)
        for k in range(6):
            x = base + r.normal(0, 1.5, base.shape)
            x[:26, :26] = 40 + 170 * ((at[:26, None] // 6 + at[None, :26] // 6) % 2)  # a pattern in common
            images.append((g * 10 + k, bytearray(media.encode(np.clip(np.rint(x), 0, 255)))))
    t = spark.createDataFrame(images, "id long, image binary")
    classes = [{x.id: x.class_id for x in media.near_copies(t, bucket=n).collect()} for n in (2, 10**9)]
    assert classes[0] == classes[1] and len(classes[0]) == 30
    corners = functools.reduce(lambda a, b: a.union(b), media.shared_keys(media.describe(t)))
    label = t.select(F.col("id").alias("node"), F.col("id").alias("label"))
    every = {tuple(x) for x in media.matches(corners, bucket=10**9).select("a_id", "a_at", "b_id", "b_at").collect()}
    for block in (1, 3, 2048):
        rest = {tuple(x) for x in media.matches_between(corners, label, bucket=2, block=block).select("a_id", "a_at", "b_id", "b_at").collect()}
        few = {tuple(x) for x in media.matches(corners, bucket=2).select("a_id", "a_at", "b_id", "b_at").collect()}
        assert rest | few == every


def test_ngram_hashes():
    ws = [w.encode() for w in prose(9, 50)] + [b"a", b"bc", b"ab", b"c"]
    h = text.word_hashes(ws)
    assert len(set(h.tolist())) == len(set(ws)) and text.ngram_hashes(h, 60).size == 0
    assert text.ngram_hashes(h, 3)[5] == text.ngram_hashes(h[5:8], 3)[0]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "bpe"]


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    d = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        d = spark.createDataFrame(out.collect(), d.schema)
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0
    assert {r.doc_id for r in d.collect()} <= {r.doc_id for r in odd.collect()}
