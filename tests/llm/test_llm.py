"""The operators for training text against brute force, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from harness import difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxtable.llm import (
    bpe,
    components,
    compression_quality,
    fingerprints,
    html_text,
    neardup,
    ngram_join,
    packing,
    paragraphs,
    quality_rules,
    queries,
    shingles,
    url_filters,
    warc,
)

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet' ORDER BY doc_id").df()


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def awkward(spark, *texts):
    """The texts with ids from 0, a null id, a null text, an empty one, a repeated row, and columns with clashing names."""
    rows = [*enumerate(texts), (None, "lone row"), (900, None), (901, ""), (902, "twice"), (902, "twice")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "bands", "score", "words", "row", "path", "vote", "ids", "_key", "n_chars"):
        df = df.withColumn(name, F.lit(1).cast("long"))
    return df


# shared parts


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: top(x) for x in linked}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_word_hashes_tell_words_apart():
    a = shingles.word_hashes("x yy\tx\n yy  zé ".encode())
    assert a[0] == a[2] and a[1] == a[3] and len(set(a.tolist())) == 3
    assert not len(shingles.shingles(" \n ")) and len(shingles.shingles("a b")) == 1 and len(shingles.shingles("a b c d e f")) == 2


def test_minhash_estimates_resemblance():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(600)]
    a, b = (shingles.shingles(" ".join(x)) for x in (words, words[:400] + [str(rng.random()) for _ in range(200)]))
    true = neardup.resemblance(a, b)
    lanes = shingles.minhash(a, 512), shingles.minhash(b, 512)
    assert abs((lanes[0] == lanes[1]).mean() - true) < 0.08


def test_bands_reach_their_recall():
    bands, rows = shingles.tune_bands(0.8, 1e-4, 128)
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands * rows <= 128


def test_pruning_bound_is_the_posterior():
    rng = np.random.default_rng(0)
    for n, m in neardup.least_matches(0.8, 1e-3, 48, 24):
        for k, sides in ((m, 1), (m - 1, -1)):
            tail = (rng.beta(k + 1, n - k + 1, 2_000_000) >= 0.8).mean()
            assert sides * (tail - 1e-3) >= -2e-4


# 1


def test_quality_learns_and_holds_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = compression_quality.fit(documents, labels)
    held = compression_quality.score(documents.where(compression_quality.held_out()).join(labels, "doc_id"), model).toPandas()
    assert (held.predicted == held.quality).mean() > 0.97
    ids = held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)
    assert (ids == 0).all()


def test_quality_stage_keeps_columns(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    clashing = documents.select("*", *[F.lit(7).alias(c) for c in ("score", "_score", "Predicted", "row", "held_out")])
    kept = compression_quality.keep_stage(spark, clashing.union(clashing.limit(3)), DATA)
    assert kept.columns == clashing.columns
    assert kept.where("score <> 7 or _score <> 7 or predicted <> 7").isEmpty() and not kept.isEmpty()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = compression_quality.fit(documents.unionByName(documents.withColumn("text", F.repeat("text", 100))), labels)
    assert model.weights and 0 < model.share < 1


def test_quality_of_awkward_rows(spark):
    model = compression_quality.fit_texts([f"good plain words number {i}" for i in range(40)], [f"$$$ %%% {i} ###" for i in range(40)])
    out = compression_quality.score(awkward(spark, "x" * 300_000).drop("score"), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert compression_quality.fit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")).share == 0.5


# 2

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class="with-sidebar"><header class="top"><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><div class="row-{0}"><div class="post-body c{0}"><h1>Title {0} &amp; more</h1><p>First   para
of page {0}, with <b>bold</b> words.<p>Second<br>part &lt;x&gt; <span class="ad">buy</span>end.</p><ul><li>one<li>two</ul><div class="ad-box"><p>Advert</p></div>
<form><p>Name</p></form><section id="comments"><p>Nice!</p></section></div><aside>Side</aside></div><footer>foot</footer><script>if (a<b) x("</p>")</script></body></html>"""
WANTED = "Title {0} & more\nFirst para of page {0}, with bold words.\nSecond part <x> end.\none\ntwo"


def test_main_text(spark):
    rows = [(i, f"https://Site{i % 2}.org/{i}", PAGE.format(i)) for i in range(6)] + [(None, None, None), (7, "x", "only text"), (8, "http://site0.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit("x"))
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i in range(6):
        assert out[i].text == WANTED.format(i) and out[i].n_chars == len(WANTED.format(i))
    assert (out[None].text, out[7].text, out[8].text) == ("", "only text", "")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_noise_goes_whatever_its_size():
    article, long = "<article><h1>Head</h1><p>A short article.</p></article>", "<p>" + "much more text than that " * 30 + "</p>"
    wanted = "Head\nA short article."
    for noise in ('<section id="comments">{}</section>', '<div class="comment-list"><div class="text">{}</div></div>', "<form>{}</form>",
                  '<div class="ad-box">{}</div>', '<div class="cookie-notice">{}</div>', '<div role="dialog">{}</div>', '<div class="sidebar">{}</div>'):
        assert html_text.Page(f"<body>{article}{noise.format(long)}").text(None) == wanted
        assert html_text.Page(f"<body><div>{noise.format(long)}</div>{article}").text(None) == wanted
    for wrapper in ("<form>{}</form>", '<div class="has-sidebar">{}</div>', '<div class="post comments-open">{}</div>'):
        assert html_text.Page(f"<body>{wrapper.format(article)}").text(None) == wanted


@pytest.mark.parametrize("html", ["<a " * 700_000, "<![CDATA[" * 300_000, "<!--" * 500_000, "<div>x" * 100_000, "<" * 2_000_000, "<div>" * 100_000 + "</p>" * 100_000, "<p class='a" * 200_000, "<td>y" * 200_000, "&amp;<b>z</b>" * 100_000])
def test_long_pages_take_linear_time(html):
    began = time.process_time()
    html_text.Page(html).text(None)
    assert time.process_time() - began < 20


def test_host_path_wins_over_own_best():
    """Pages whose own best container is a list of links with prose; the host's other pages tell where the article is."""
    short = '<body><div class="story"><p>{}</p></div><div class="extra"><p>{}</p></div>'
    path = "html>body>div.story"
    one = html_text.Page(short.format("Little is said here but it is the story.", "A longer piece of something else that is found on this page only, with more words."))
    assert one.text(None) != "Little is said here but it is the story." and one.text(path) == "Little is said here but it is the story."


def test_broken_markup_keeps_its_text():
    assert html_text.Page("<p>a<p>b<div>c").text(None) == "a\nb\nc"
    assert html_text.Page("<div class=ad>" + "long words " * 50).text(None) == ""
    assert html_text.Page('<p title="a>b">q</p><!-- no end <p>z').text(None) == "q"
    assert html_text.Page("<div>" * 3000 + "deep").text(None) == "deep"


def test_all_template_pages():
    for (html,) in duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|<footer|\Z)", html, re.S)[1]
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert html_text.Page(html).text(None) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("wrappers", [1, 2, 3, 5])
@pytest.mark.parametrize("top", ["article", "div class=x"])
def test_sections_in_wrappers_are_one_text(spark, wrappers, top):
    parts = [f"Section {i} " + "has words enough to be read as prose. " * 4 for i in range(10)]
    inner = "".join("<section>" + "<div>" * wrappers + f"<p>{p}</p>" + "</div>" * wrappers + "</section>" for p in parts)
    html = f"<body><nav><p>Home</p></nav><{top}>{inner}</{top.split()[0]}><footer>foot</footer></body>"
    wanted = "\n".join(p.strip() for p in parts)
    page = html_text.Page(html)
    assert page.text(None) == wanted and page.text(page.votes()[0][0]) == wanted
    innermost = next(n for n in page.containers() if n.tag == "div" and not any(m.parent is n and m.tag == "div" for m in page.nodes) and "div.x" != n.steps[-1])
    assert page.text(">".join(innermost.steps)) == wanted


# 3


def test_sketches_merge_and_estimate():
    rng = random.Random(2)
    a, b = prose(rng, 900), prose(rng, 700)
    whole = np.union1d(shingles.shingles(a), shingles.shingles(b))
    merged = fingerprints.Sketch.of(a).merge(fingerprints.Sketch.of(b))
    assert np.array_equal(merged.hashes, whole[: fingerprints.K])
    assert abs(merged.distinct() / len(whole) - 1) < 0.3
    both = fingerprints.Sketch.of(a + " " + b)
    assert fingerprints.Sketch.of(a).containment(both) > 0.8
    again = fingerprints.Sketch.parse(both.text())
    assert np.array_equal(again.hashes, both.hashes) and again.more
    small = fingerprints.Sketch.of("a b c d e f g"), fingerprints.Sketch.of("a b c d e f x")
    assert small[0].resemblance(small[1]) == 2 / 4


def test_fingerprints_against_brute_force(spark, docs):
    out = fingerprints.compare(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    for k, r in enumerate(out.itertuples()):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.Sketch.of(text).text() and r.edited_fingerprint == fingerprints.Sketch.of(edited).text()
        sets = [set(shingles.shingles(x).tolist()) for x in (text, edited, following)]
        assert abs(r.near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2
        assert abs(r.near_next - len(sets[0] & sets[2]) / max(1, len(sets[0] | sets[2]))) < 0.2


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_next_documents_over_any_bounds(spark, buckets):
    rows = [(i * i, f"t{i}") for i in range(25)]
    dealt = fingerprints.followed(spark.createDataFrame(rows, DOCS).repartition(5), buckets).toPandas()
    for _, part in dealt.groupby("bucket"):
        part = part.sort_values(["place", "doc_id", "copy"])
        texts = part.text.tolist()
        assert part["copy"].tolist()[-1] and not any(part["copy"].tolist()[:-1])
        for a, b in zip(texts, texts[1:], strict=False):
            assert (int(a[1:]) + 1) % 25 == int(b[1:])


def test_fingerprints_of_awkward_rows(spark):
    out = fingerprints.compare(awkward(spark, "a b c", "long " * 50_000)).collect()
    assert len(out) == 7 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    (lone,) = fingerprints.compare(spark.createDataFrame([(1, "x y")], DOCS)).collect()
    assert lone.near_next == 1.0
    assert fingerprints.compare(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprint_plans_do_not_grow_with_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    few, many = (len(fingerprints.followed(df, n)._jdf.queryExecution().toString()) for n in (4, 2000))
    assert many < 2 * few
    dealt = fingerprints.followed(df, 2000).where("not copy").groupBy("bucket").count()
    assert dealt.count() == 2000 and dealt.agg(F.max("count")).first()[0] <= 2


def test_fingerprints_of_other_ids(spark):
    rng = random.Random(8)
    rows = sorted((f"{rng.randrange(10**6)}-é{i}", prose(rng, rng.randrange(1, 60))) for i in range(150))
    out = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()}
    assert len(out) == len(rows)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[key].fingerprint == fingerprints.Sketch.of(text).text()
    dates = spark.createDataFrame([("2020-01-01", "a b"), ("2021-01-01", "c d"), (None, "e")], "d string, text string").select(F.to_date("d").alias("doc_id"), "text")
    assert fingerprints.compare(dates).count() == 3
    assert fingerprints.compare(dates.limit(0)).count() == 0


def test_group_sketches(spark):
    df = spark.createDataFrame([(i, f"{i % 3}", prose(random.Random(i), 40)) for i in range(30)], "doc_id long, g string, text string")
    out = {r.g: r.fingerprint for r in fingerprints.merged(fingerprints.fingerprint(df), ["g"]).collect()}
    rows = df.collect()
    for g in "012":
        whole = np.unique(np.concatenate([shingles.shingles(r.text) for r in rows if r.g == g]))
        assert np.array_equal(fingerprints.Sketch.parse(out[g]).hashes, whole[: fingerprints.K])


# 4


@pytest.mark.parametrize("seed", range(30))
def test_plans_place_everything_without_gaps(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 80))
    counts = np.zeros(capacity + 1, int)
    counts[1:] = rng.integers(0, 40, capacity) * (rng.random(capacity) < 0.5)
    plan = packing.plan_for(counts, capacity)
    assert not plan.left.any() and np.array_equal(plan.used, counts)
    held = sorted((s + i, o, n) for n, _, many, s, o in plan.rows for i in range(many))
    filled = Counter()
    for s, o, n in held:
        assert filled[s] == o
        filled[s] += n
        assert filled[s] <= capacity
    assert sorted(filled) == list(range(plan.sequences))


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(np.exp(rng.normal(6.3, 1, 50_000)).astype(int), 1, 2048), minlength=2049)
    plan = packing.plan_for(counts)
    assert plan.sequences <= 1.002 * (counts * np.arange(2049)).sum() / 2048


def test_packed_documents(spark, library, docs):
    out = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), PATH, capacity=256, with_ids=True)
    pdf = out.toPandas()
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.itertuples()}
    for doc_id, part in pdf.groupby("doc_id"):
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(len(part)))
        assert np.concatenate(part.ids.tolist()).tolist() == ids[doc_id]
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]]
        assert (part.length.iloc[1:] == 256).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for _, part in pdf.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 256
    whole = {r.sequence_id: r.ids for r in packing.assemble(out).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))


def test_packing_of_awkward_rows(spark):
    out = packing.pack(awkward(spark, "x " * 5000), PATH, capacity=64).collect()
    assert {r.length for r in out if r.doc_id in (900, 901)} == {1}
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


# 5


def strange_texts():
    rng = random.Random(5)
    parts = ["a", "b", "th", "é", "ß", "1", "23", "'s", "***", "中", "😀", "<|endoftext|>", "'", "The", "\x1c", "͸", "́"]
    spaces = [" ", "\n", "  ", "　", "\xa0", "\t", "\x85"]
    for k in range(400):
        yield "".join(rng.choice(parts + spaces * (k % 2)) for _ in range(rng.randrange(300)))
    yield from ("", " " * 500, "a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(2000)), "\n" * 400 + "x", "=-" * 700, "😀" * 400, "a b" * 300 + "c" * 500)


@pytest.mark.parametrize("leaf", [7, 48])
def test_tree_concatenation_is_exact(library, leaf):
    codec = bpe.Codec(PATH, leaf=leaf)
    for text in strange_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert codec.windows > 100


@pytest.mark.parametrize("leaf", [9, 16, 48])
def test_joined_halves_are_exact(library, leaf):
    rng = random.Random(leaf)
    parts = ["a", "the ", "  ", "\n", "\n\n", "é", "日本", "'s", " 12", "345", "!!", " ", "　", "<|endoftext|>", "😀", "x", "\t", "ing", "\r\n", "\u0085", "ß "]
    codec = bpe.Codec(PATH, leaf=leaf)
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120)))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.joins > 100


def test_long_documents_go_by_joins(library):
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    codec = bpe.Codec(PATH)
    for (text,) in texts:
        assert codec.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert codec.joins >= sum(len(t or "") > bpe.LEAF for (t,) in texts) > 50


def test_both_engines_agree(library, docs):
    codec = bpe.Codec(PATH)
    assert codec.fast is not None
    for text in docs.text:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, library):
    df = awkward(spark, *strange_texts())
    out = bpe.round_trip(df, PATH)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in out.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], DOCS), PATH).count() == 0
    assert bpe.encode(df.limit(3), PATH).count() == 3


# 6


def links_by_hand(texts):
    sets = {t: set(shingles.shingles(t).tolist()) for t in set(texts) if t.split()}
    out = Counter()
    pairs = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                out[a] += 1
                out[b] += 1
                pairs.add((a, b))
    return out, pairs


def near_texts(seed=4):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 8, 60, 200])) for _ in range(25)]
    texts = list(base)
    for t in base:
        words = t.split()
        for k in (1, 2, 6):
            changed = list(words)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = "new"
            texts.append(" ".join(changed))
    group = prose(rng, 300).split()
    for i in range(60):
        words = list(group)
        words[5 * i % 300] = f"x{i}"
        texts.append(" ".join(words))
    return texts + texts[:10] * 3


@pytest.mark.parametrize("block", [256, 16])
def test_join_loses_no_link(spark, block):
    texts = near_texts()
    df = awkward(spark, *texts)
    out = ngram_join.join(df, block=block).toPandas()
    assert len(out) == df.count()
    known = {r.doc_id: r.text or "" for r in df.collect()}
    links, pairs = links_by_hand(known.values())
    classes = dict(zip(out.doc_id, out.class_id, strict=True))
    for r in out.itertuples():
        if not pd.isna(r.doc_id):
            assert r.n_links == links[known[r.doc_id]]
            assert r.n_copies == sum(t == known[r.doc_id] for t in [x.text or "" for x in df.collect()]) if r.doc_id < 3 else True
    ids = {}
    for i, t in known.items():
        ids.setdefault(t, i)
    for a, b in pairs:
        assert classes[ids[a]] == classes[ids[b]]
    root = {t: t for t in known.values()}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in pairs:
        root[top(a)] = top(b)
    assert out.dropna(subset=["doc_id"]).class_id.nunique() == len({top(t) for i, t in known.items() if i is not None})


def test_one_of_each_group_stays(spark):
    df = awkward(spark, *near_texts())
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    _, pairs = links_by_hand([r.text or "" for r in df.collect()])
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and not any(a in texts and b in texts for a, b in pairs)
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


# 7


def test_url_filters_equal_sql(spark):
    assert difference(spark, url_filters.op7_url_filters, url_filters.ORACLES["op7_url_filters"], DATA) == ""


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    rows = [
        (1, "http://A.org/x#f", '<link rel="canonical" href="https://b.net/es/1">'),
        (2, "https://c.org/", '<meta http-equiv=refresh content="0; url=http://a.org/x">'),
        (3, "https://www.example.com/en/1", "<link href=http://c.org/ rel=canonical>"),
        (4, None, None), (5, "no url", "x"), (6, "http://d.org?q", "<p>"), (6, "http://d.org?q", "<p>"), (7, "http://x.EXAMPLE.com/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(1))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, url_filters.page_edges(pages)).collect()}
    assert out == {
        1: ("a.org", "/x", None, "block"), 2: ("c.org", "/", None, "block"), 3: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("d.org", "", None, "allow"), 7: ("x.example.com", "/en/", "example.com/en/", "block"),
    }
    assert url_filters.judge(pages.limit(0), url_filters.page_edges(pages.limit(0))).count() == 0


def test_links_are_decoded_and_resolved(spark):
    rows = [
        (1, "http://a.org/q/x", '<link rel="canonical" href="/en/1?a=1&amp;b=2">'), (2, "http://a.org/en/1?a=1&b=2", '<link rel=canonical href="//b.net/es/1">'),
        (3, "https://c.org/p", '<base href="https://b.net/es/"><meta http-equiv="refresh" content="0; url=\'2\'">'),
        (4, "https://d.org/p", '<meta property="og:url" content="https&#58;//b.net/fr/3">'), (5, "https://e.org/p", '<link rel=canonical href="mailto:x@b.net"><link rel=canonical>'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in url_filters.judge(pages, url_filters.page_edges(pages)).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


# 8


@pytest.mark.parametrize("split", [7, 300, 1 << 20])
def test_archives_round_trip(spark, tmp_path, split):
    rng = random.Random(7)
    payloads = ["aé", "aé", None, "", "zz" * 5000, "\x1f\x8b\x08" * 9, "".join(chr(rng.randrange(32, 50_000)) for _ in range(3000))]
    rows = [(i, f"http://h/{i} %é\n", p) for i, p in enumerate(payloads)] + [(None, None, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    folder = f"file://{tmp_path}/w"
    assert warc.write(warc.with_types(pages), folder).agg(F.sum("records")).first()[0] == len(rows)
    out = {r.page_id and int(r.page_id): r for r in warc.read(spark, folder, split).collect()}
    assert len(out) == len(rows)
    for i, p in enumerate(payloads):
        data = (p or "").encode()
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.url == f"http://h/{i} %é\n"
        assert r.payload is None or bytes(r.payload) == data
    assert [(out[i].record_type, out[i].refers_to) for i in (0, 1, 2, 3)] == [("revisit", "1"), ("response", None), ("revisit", "3"), ("response", None)]


def test_archives_read_elsewhere(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.with_types(pages), f"file://{tmp_path}/w").count()
    files = (tmp_path / "w").glob("*.warc.gz")
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == 2
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


# 9


def test_repeats_against_brute_force(spark):
    rng = random.Random(9)
    lines = [prose(rng, 60) for _ in range(12)] + [prose(rng, 20) for _ in range(3)]
    near = lines[0].split()
    near[30] = "other"
    lines.append(" ".join(near))
    texts = ["\n".join([prose(rng, 55), *rng.sample(lines, 3), ""]) for _ in range(40)]
    df = awkward(spark, *texts)
    out = paragraphs.repeats(df, block=8).collect()
    found = {(r.doc_id, r.line): r for r in out}
    place = {}
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if len(line.split()) >= 50:
                place.setdefault(lines[0] if line == lines[-1] else line, []).append((i, n))
    wanted = {p: p != min(places) for places in place.values() if len(places) > 1 for p in places}
    assert {k: r.removed for k, r in found.items()} == wanted
    for (i, n), r in found.items():
        assert texts[i][r.start : r.end] == texts[i].split("\n")[n]
    clean = {r.doc_id: r.text for r in paragraphs.remove(df).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert clean[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if not wanted.get((i, n)))


def test_passages_across_and_within_lines(spark):
    rng = random.Random(11)
    passage, fill = prose(rng, 54).split(), lambda n: prose(rng, n)
    across = "\n".join(" ".join(passage[i : i + 18]) for i in range(0, 54, 18))
    within = " ".join(passage)
    short = " ".join(passage[:49])
    texts = [f"{fill(30)}\n{across}\n{fill(20)}", f"{fill(70)} {within} é {fill(70)}", f"{fill(9)}\n\n{across}\n{fill(30)}", f"{fill(60)} {short} {fill(60)}", "y " * 70]
    df = awkward(spark, *texts)
    out = sorted((r.doc_id, r.line, r.removed, r.n_words, texts[r.doc_id][r.start : r.end]) for r in paragraphs.repeats(df).collect())
    assert out == [(0, 1, False, 54, across), (1, 0, True, 54, within), (2, 2, True, 54, across)]
    assert len({r.cluster_id for r in paragraphs.repeats(df).collect()}) == 1
    clean = {r.doc_id: r.text for r in paragraphs.remove(df).collect()}
    assert [clean[i] for i in (0, 3, 4)] == [texts[i] for i in (0, 3, 4)]
    assert clean[1] == texts[1].replace(f" {within}", "") and clean[2] == texts[2].replace(f"{across}\n", "")


def test_passage_windows_leave_in_portions(spark, monkeypatch):
    """What a worker holds of the windows does not follow the number of texts in a frame."""
    taken, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInPandas", lambda df, f, *rest, real=kind.mapInPandas: taken.append(f) or real(df, f, *rest))
    empty = [spark.createDataFrame([], x) for x in ("doc long, doc_id long, doc_key long, text string", "doc long, pos int, line int, h long", "doc long, line int, near boolean")]
    assert paragraphs.passages(*empty).count() == 0 and len(taken) == 1
    rng = random.Random(8)
    texts = [prose(rng, 40 if i % 50 == 0 else 500) for i in range(600)]
    frame = pd.DataFrame({"id": [str(i) for i in range(600)], "doc_key": range(600), "text": texts, "hits": [[*range(t.count(" ") - 24)] for t in texts]}).assign(gone=None, near=None)
    out = list(taken[0](iter([frame])))
    assert len(out) > 1 and max(map(len, out)) <= 1 << 17
    alone = [x for i in range(600) for x in taken[0](iter([frame[i : i + 1]]))]
    pd.testing.assert_frame_equal(pd.concat(out, ignore_index=True), pd.concat(alone, ignore_index=True))


def test_texts_are_cut_once(spark):
    """Cut twice in a plan, each task of the stage holds two Python workers, which stay."""
    line = prose(random.Random(9), 60)
    out = paragraphs.remove(awkward(spark, line, f"a\n{line}"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in out.collect()}[1] == "a"


def test_passages_against_brute_force(spark, docs):
    few = docs.head(120)
    grams, size = {}, 50
    for i, t in zip(few.doc_id, few.text, strict=True):
        words = (t or "").encode().split()
        for p in range(len(words) - size + 1):
            grams.setdefault(tuple(words[p : p + size]), []).append((i, p))
    wanted = {(i, w) for places in grams.values() for i, p in places[1:] if (i, p - size) >= places[0] or i != places[0][0] for w in range(p, p + size)}
    covered = set()
    for r in paragraphs.repeats(spark.createDataFrame(few[["doc_id", "text"]], DOCS)).where("removed").collect():
        text = few.text[few.doc_id == r.doc_id].iloc[0]
        at = len(text[: r.start].encode().split())
        covered |= {(r.doc_id, w) for w in range(at, at + len(text[r.start : r.end].encode().split()))}
    # beside lines that go as a whole fewer than 50 words may stay
    left = wanted - covered
    assert len(wanted) > 1000 and not any(all((i, w + k) in left for k in range(size)) for i, w in left)


def test_repeats_of_awkward_rows(spark):
    rng = random.Random(1)
    line = prose(rng, 80)
    df = awkward(spark, line, line, "x " * 100_000)
    out = paragraphs.remove(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {0, 2, None, 900, 901, 902}
    empty = spark.createDataFrame([], DOCS)
    assert paragraphs.repeats(empty).count() == 0 and paragraphs.remove(empty).count() == 0


def test_edit_distance():
    assert paragraphs._edit_likeness("kitten", "sitting", 0.0) == 1 - 3 / 7
    assert paragraphs._edit_likeness("", "", 0.5) == 1.0 and paragraphs._edit_likeness("abc", "a", 0.8) == 0.0


def test_edit_measure(spark):
    a = prose(random.Random(2), 70)
    df = spark.createDataFrame([(1, a), (2, a.replace("w1", "v1", 3))], DOCS)
    assert paragraphs.repeats(df, threshold=0.5, measure="edit", likeness=0.9).count() == 2
    with pytest.raises(ValueError):
        paragraphs.repeats(df, measure="other")


# 10


def rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return counts, len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rules_against_brute_force(spark, docs):
    extra = ["a a a a a", "a b a b a b", "x\n\x0by z\n\nx\n x", "a b c d a b c e a b c", "😀 # 😀 # 😀 #"]
    df = awkward(spark, *extra, *docs.text)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    out = quality_rules.judge(df).collect()
    assert len(out) == df.count()
    for r in out:
        counts, failed = rules_by_hand(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == failed and not (r.kept and failed)


def test_rules_part_labelled_documents(spark):
    out = quality_rules.op10_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    own = out[~out.base_failed]
    assert own[own.quality == 1].kept.mean() > 0.97 and own[own.quality == 0].kept.mean() < 0.1


def em_by_hand(patterns, n, rounds):
    """(right, caught, prior) by the textbook, with numpy."""
    votes = np.array(patterns)
    good, bad, spoke = votes > 0, votes < 0, votes != 0
    right, caught, prior = np.full(votes.shape[1], 0.99), np.full(votes.shape[1], 0.15), 0.8
    for _ in range(rounds):
        weight = np.log(prior / (1 - prior)) + good @ np.log(right / (1 - caught)) + bad @ np.log((1 - right) / caught)
        p = 1 / (1 + np.exp(-weight))
        a, b = n * p, n * (1 - p)
        right = np.clip((a @ good + 0.99) / (a @ spoke + 1), 0.5, 0.999)
        caught = np.clip((b @ bad + 0.15) / (b @ spoke + 1), 0.01, 0.99)
        prior = np.clip((a.sum() + 0.8) / (n.sum() + 1), 0.01, 0.99)
    return right, caught, prior


@pytest.mark.parametrize("share", [0.8, 0.3])
def test_rules_recover_accuracies(spark, share):
    rng = np.random.default_rng(1)
    good = rng.random(8000) < share
    right = np.array([0.9, 0.99, 0.95, 0.995, 0.97, 0.99, 0.99, 0.98])
    caught = np.array([0.5, 0.3, 0.6, 0.2, 0.4, 0.5, 0.3, 0.6])
    votes = np.where(rng.random((8000, 8)) < np.where(good[:, None], 1 - right, caught), -1.0, 1.0)
    votes = np.where(rng.random(votes.shape) < 0.1, 0.0, votes)
    counts = Counter(map(tuple, votes.tolist()))
    patterns = spark.createDataFrame([(list(v), float(n)) for v, n in counts.items()], "vote array<double>, n double")
    found = quality_rules.fit(patterns, 8, rounds=30)
    for mine, hand in zip(found, em_by_hand(list(counts), np.array(list(counts.values()), float), 30), strict=True):
        assert np.allclose(mine, hand, atol=1e-6)
    assert np.abs(np.array(found[0]) - right).max() < 0.03 and np.abs(np.array(found[1]) - caught).max() < 0.08 and abs(found[2] - share) < 0.05


def test_rules_run_no_python(spark):
    out = quality_rules.op10_quality_rules(spark, DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kept_rows(spark):
    rng = random.Random(1)
    df = awkward(spark, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)) + ".")
    out = quality_rules.keep(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [0]
    assert quality_rules.keep(spark.createDataFrame([], DOCS)).count() == 0


# the pipeline


def test_pipeline(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    before, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).persist()
        assert after.columns == documents.columns
        seen.append((name, before.count(), after.count()))
        before = after
    assert all(a >= b for _, a, b in seen) and seen[-1][2] > 0
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in before.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]


def test_ten_queries_are_registered():
    names = queries.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 11))
