"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import byte_bpe, chat_format, common, components, cross_polytope, exact_dedup, html_extract, language_id, license_scan, mixing, ngram_join, pieces, shingles, unigram_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators make on the way.
CLASHING = DOCS + ", id long, row string, entry long, tag string, label string, node long, _size long, kept string, rank int"


def docs(spark, rows, clashing=False):
    full = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z", 3, 4, "k", 5) for r in full] if clashing else full, CLASHING if clashing else DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


BASE = prose(1, 200)
ODD_ROWS = [
    (1, None, None, None),
    (2, "", "en", "b"),
    (3, BASE, "en", "a"),
    (4, BASE, "en", "a"),
    (4, BASE, "en", "a"),  # a repeated row
    (None, BASE, "de", "a"),
    (6, BASE.replace("alpha", "ALPHA"), "fr", None),
    (7, prose(2, 3), "en", "b"),
    (8, " \n\t ", "en", "b"),
    (9, prose(3, 60_000), "de", "c"),  # very long
    (10, "é 日本 😀 \x00 end", "fr", "c"),
    (11, " ".join(BASE.split()[:195]), "en", "c"),
]


# op1


def test_split_directory_halves_overfull_buckets():
    assert exact_dedup.split_directory({0: 5, 3: 4}, 10, 2) == [0]
    assert exact_dedup.split_directory({0: 5, 3: 6}, 10, 2) == [0, 1]
    d = exact_dedup.split_directory({0: 11, 1: 3, 2: 1, 3: 1}, 10, 2)
    assert len(d) == 4 and d[0] != d[1] and d[2] == d[3]
    assert len(exact_dedup.split_directory({7: 10**6}, 1, 8)) == 256  # one key can't be split


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_dedup_cases(spark, clashing):
    found = exact_dedup.exact_dedup(docs(spark, ODD_ROWS, clashing)).collect()
    assert len(found) == len(ODD_ROWS)
    groups = defaultdict(list)
    for r in found:
        groups[r.text_sha256].append(r)
    texts = defaultdict(list)
    for i, t, *_ in ODD_ROWS:
        texts[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert {k: sorted(str(r.doc_id) for r in v) for k, v in groups.items()} == {k: sorted(map(str, v)) for k, v in texts.items()}
    for k, v in groups.items():
        assert {r.keep_id for r in v} == {max((i for i in texts[k] if i is not None), default=None)}
        assert {r.group_size for r in v} == {len(v)}
        assert sum(r.kept for r in v) == 1
    kept = exact_dedup.deduplicated(docs(spark, ODD_ROWS, clashing))
    assert kept.columns == docs(spark, [], clashing).columns and kept.count() == len(groups)


def test_exact_dedup_collisions_are_told_apart_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([5, 5, 5, 6]), pa.array([1, 2, 3, 4]), pa.array([1, 1, 1, 1]), pa.array([1, 2, 3, 4]), pa.array([b"x", b"y", b"x", b"x"])], names=["tag", "entry", "n", "best_id", "text"])
    (out,) = exact_dedup._chains(iter([b]))
    assert out.column(1).to_pylist() == [1, 2, 1, 4]


def test_exact_dedup_of_a_million_empty_texts_and_a_long_repeated_one(spark):
    from pyspark.sql import functions as F

    long = prose(12, 20_000)
    text = F.when(F.col("id") < 1_000_000, F.when(F.col("id") % 2 == 0, F.lit(""))).when(F.col("id") < 1_000_900, F.lit(long)).otherwise(F.concat(F.lit(long), F.col("id").cast("string")))
    df = spark.range(0, 1_001_000, 1, 6).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = exact_dedup.exact_dedup(df).groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert Counter((r.group_size, r.n, r.kept) for r in found) == {(1_000_000, 1_000_000, 1): 1, (900, 900, 1): 1, (1, 1, 1): 100}
    assert {r.keep_id for r in found if r.group_size > 1} == {999_999, 1_000_899}


def test_exact_dedup_hot_tags_are_chained_in_parts(spark, monkeypatch):
    for name, value in (("HELD_ROWS", 3), ("SALTS", 5), ("HOT_SHARE", 0.05)):
        monkeypatch.setattr(exact_dedup, name, value)
    texts = ["hot"] * 300 + ["warm"] * 120 + [f"t{k % 40}" for k in range(100)]
    random.Random(5).shuffle(texts)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    found = exact_dedup.exact_dedup(df).collect()
    last, size = {t: k for k, t in enumerate(texts)}, Counter(texts)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [(k, last[t], size[t], last[t] == k) for k, t in enumerate(texts)]
    assert exact_dedup.deduplicated(df).count() == len(size)


# components, op10


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 8), (20, 21), (7, 7)] + [(100, 101 + k) for k in range(50)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {x: 3 for x in (3, 4, 5, 8, 9)} | {20: 20, 21: 20} | {100 + k: 100 for k in range(51)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def grams(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "日", "ß", "x1"]), max_size=40))
def test_shingles_agree_with_sets(words):
    s = shingles.Shingler()
    assert len(s(" ".join(words))) == len(grams(" ".join(words)))
    assert list(s("  \n".join(words))) == list(s(" ".join(words)))


def test_shingles_of_long_texts_are_whole(monkeypatch):
    whole = shingles.Shingler()(prose(5, 3000))
    monkeypatch.setattr(shingles, "BLOCK_WORDS", 100)
    assert list(shingles.Shingler()(prose(5, 3000))) == list(whole)


def brute_classes(rows):
    sets = [grams(t) for _, t, *_ in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    return label, [len(x) for x in near]


def near_rows():
    rng, rows = random.Random(4), list(ODD_ROWS)
    for g in range(12):
        base = prose(100 + g, rng.choice([6, 30, 120])).split()
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((1000 + len(rows), " ".join(w), "en", "d"))
    return rows


@pytest.mark.parametrize("block", [2048, 5])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)  # 5: components are dealt out as pairs of blocks
    rows = near_rows()
    found = ngram_join.ngram_join(docs(spark, rows, True)).collect()
    label, links = brute_classes(rows)
    classes = defaultdict(list)
    for i, k in enumerate(label):
        classes[k].append(i)
    want = Counter()
    for members in classes.values():
        keep = max((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            want[rows[i][0], keep, len(members), links[i]] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in found) == want
    assert sum(r.kept for r in found) == len(classes)
    kept = ngram_join.one_of_each(docs(spark, rows, True))
    assert kept.count() == len(classes) and kept.columns == docs(spark, [], True).columns


def test_linked_across_blocks_equals_within_one(monkeypatch):
    monkeypatch.setattr(ngram_join, "STRIP", 3)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 30, 25)).astype(np.uint64) for _ in range(23)]
    whole = ngram_join.linked(sets, 0.55)
    for i in range(23):
        assert [j for j in range(23) if whole[i, j]] == [j for j in range(23) if j != i and len(np.intersect1d(sets[i], sets[j])) >= 0.55 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    part = ngram_join.linked(sets[:9], 0.55, sets[9:])
    assert (part == whole[:9, 9:]).all() and part.any()
    both = np.zeros((23, 23), bool)
    both[:9, 9:], both[9:, :9] = part, part.T
    assert (ngram_join._labels(part, True) == ngram_join._labels(both)).all()


def test_ngram_join_loses_few_links_of_drifting_families(spark):
    """Chains of texts, each a little further from the first: most pairs lie about the threshold."""
    rng, texts = random.Random(21), []
    for f in range(40):
        w = [f"f{f}w{i}" for i in range(120)]
        for _ in range(30):
            w = list(w)
            w[rng.randrange(len(w))] = f"r{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    found = ngram_join.ngram_join(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    sets = [grams(t) for t in texts]
    want = sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for f in range(40) for i in range(30 * f, 30 * f + 30) for j in range(30 * f, 30 * f + 30) if i != j)
    assert want > 5000 and sum(r.n_links for r in found) >= 0.9999 * want


def test_shortest_prefix_reaches_recall():
    d = ngram_join.shortest_prefix(0.8)
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_link_prefixes_reaches_over_nodes_that_joined_a_head():
    short = np.array([[0] * 10, [0] * 6 + [1] * 4, [0] * 2 + [1] * 8, [2] * 10], np.uint8)  # 0-1 agree in 6, 1-2 in 6, 0-2 in 2 of 10
    for keys in ([b"aaaabbbb"] * 4, [b"aaaabbbb", b"aaaabbbb", b"aaaacccc", b"aaaadddd"]):
        assert sorted(tuple(sorted(x)) for x in ngram_join.link_prefixes(keys, short, 1, 2)) == [(0, 1), (1, 2)]


def test_link_prefixes_connects_all_that_agree():
    rng = np.random.default_rng(3)
    short = rng.integers(0, 2, (200, 20)).astype(np.uint8)
    keys = sorted(b"head" + bytes(rng.integers(0, 2, 8).astype(np.uint8)) for _ in short)
    for least in (0.6, 0.75, 0.9):
        labels = []
        for edges in ([(a, b) for a in range(200) for b in range(a) if (short[a] == short[b]).mean() >= least], ngram_join.link_prefixes(keys, short, 1, 3, least)):
            label, before = list(range(200)), None
            while label != before:
                before = list(label)
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            labels.append(label)
        assert labels[0] == labels[1]


def test_ngram_join_finds_a_pair_among_many_siblings_below_the_threshold(spark):
    rng = random.Random(11)
    base = [f"w11x{i}" for i in range(504)]
    texts = [" ".join(base), " ".join(base[:404])]  # 500 and 400 shingles: Jaccard 0.8
    for m in range(300):  # Jaccard about 0.65 to the first, less to the second
        w = list(base)
        for i in range(21):
            w[i * 19 + rng.randrange(19)] = f"s{m}y{i}"
        texts.append(" ".join(w))
    found = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert found[0].n_links == found[1].n_links == 1 and found[0].class_id == found[1].class_id == 1


# op2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line %d</h1><p>First  para<br>graph &eacute;&#233; with <b>bold <a href=x>link</a></b>s<p>Second of %d<ul><li>one<li>two</ul>
<aside>Also read</aside><div id="comments"><p>I disagree</p></div></article><form><p>Sign up</p></form><footer><p>&copy; us</p></footer></body></html>"""


def test_html_main_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % (k, k)) for k in range(5)] + [(90, None, None), (91, "", ""), (92, "x", "<p>only <i>this"), (92, "x", "<p>only <i>this"), (93, "http://h.example/9", "a < b & c" * 5), (94, "http://l/", "<div>" * 2000 + "deep")]
    found = {r.page_id: r for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template")).collect()}
    for k in range(5):
        assert found[k].text == f"Head & line {k}\n\nFirst para graph éé with bold links\n\nSecond of {k}\n\none\n\ntwo"
    assert found[90].text == found[91].text == "" and found[92].text == "only this" and found[93].text == "a < b & c" * 5 and found[94].text == "deep"
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_text_goes_without_roles(spark):
    page = "<html><body><div class=top><p>Welcome to our site</p></div><div class=text><p>{}</p><p>{}</p></div><div class=low><p>All rights here</p></div></body></html>"
    rows = [(k, "http://plain.example/", page.format(prose(k, 40), prose(100 + k, 40))) for k in range(12)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"{prose(r.page_id, 40)}\n\n{prose(100 + r.page_id, 40)}"


@pytest.mark.parametrize("area", ["article", "div class=text", "div"])
def test_html_copies_keep_their_text(spark, area):
    page = f"<html><body><p>{{}}</p><{area}><h1>Weekly letter</h1><p>{{}}</p></{area.split()[0]}></body></html>"
    shared, rows = "" if area == "div" else "Good morning", []
    rows += [(k, "http://copies.example/", page.format(shared, prose(1, 40))) for k in range(20)]
    rows += [(100 + k, "http://few.example/", page.format(shared, prose(k % 2, 40))) for k in range(30)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "Weekly letter\n\n" + (prose(1, 40) if r.page_id < 100 else prose(r.page_id % 2, 40))


def test_html_text_that_all_articles_share_stays(spark):
    page = "<html><body><p>Good morning</p><article><h1>Weekly letter</h1><p>{}</p></article></body></html>"
    rows = [(k, "http://letters.example/", page.format(prose(k, 40))) for k in range(20)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Weekly letter\n\n{prose(r.page_id, 40)}"


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 12, 40])
def test_html_says_the_same_for_any_number_of_pages(spark, n):
    page = "<html><body><div class=top><p>Welcome</p></div><div class=x><h2>Intro.</h2><p>{}</p><p><a href=/>a link</a></p></div></body></html>"
    rows = [(k, f"http://equal.example/{k}", page.format(prose(7, 60))) for k in range(n)] + [(100 + k, f"http://apart.example/{k}", page.format(prose(k, 60))) for k in range(n)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Intro.\n\n{prose(7 if r.page_id < 100 else r.page_id - 100, 60)}\n\na link"


def test_html_branches_of_a_template_have_slots_of_their_own(spark):
    story = "<body><div class=s><div class=t>Story</div><div class=u><p>{}</p><p>{}</p></div></div><div class=b><p>Imprint</p></div></body>"
    shop = "<body><section class=g><div class=h>Offer</div><div class=i><p>{}</p><p>{}</p></div></section><div class=b><p>Imprint</p></div></body>"
    rows = [(k, "http://two.example/", (story if k % 3 else shop).format(prose(k, 30), prose(50 + k, 30))) for k in range(18)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"{prose(r.page_id, 30)}\n\n{prose(50 + r.page_id, 30)}"


def test_html_very_long_pages_and_hot_hosts(spark):
    long = [prose(k, 40) for k in range(2000)]
    rows = [(0, "http://hot.example/0", "<body><div><p>" + "<p>".join(long) + "</div></body>")] + [(k, "http://hot.example/1", f"<body><div><p>{long[k]}<p>x</div></body>") for k in range(1, 300)]
    rows += [(1000 + k, f"http://h{k}.example:80/?q", f"<body><div><p>{long[k]}</div></body>") for k in range(50)]
    found = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == "\n\n".join(long) and all(found[k] == f"{long[k]}\n\nx" for k in range(1, 300)) and all(found[1000 + k] == long[k] for k in range(50))


def test_html_hosts():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    urls = {"http://a.example/x": "a.example", "HTTPS://U:p@B.example:8/?q": "b.example:8", "//c.example#t": "c.example", "d.example/x": "d.example", "": "", "http://e.example?x@y": "e.example"}
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in df.select("url", F.regexp_extract(F.lower("url"), html_extract.HOST, 1).alias("h")).collect()} == urls


def test_html_vectors_equal_brute_force(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.tokens = (), Counter()

        def handle_starttag(self, tag, attrs):
            self.path += ((tag, dict(attrs).get("class", "")),)
            self.tokens[self.path] += 1

        def handle_endtag(self, tag):
            self.path = self.path[:-1]

        def handle_data(self, data):
            if data.strip():
                self.tokens[self.path, " ".join(data.split())] += 1

    rng, pages = random.Random(4), []
    for k in range(30):
        inner = "".join(f"<div class={rng.choice('abc')}><p>{rng.choice(['one', 'two', prose(k, 3)])}</p></div>" for _ in range(rng.randrange(4)))
        pages.append(f"<html><body><div class=top><p>Hello</p></div>{inner}" + "<section><p>more</p></section>" * (k % 2) + "</body></html>")
    counts = {}
    for page in set(pages):
        plain = Plain()
        plain.feed(page)
        counts[page] = plain.tokens
    every = sorted(set().union(*counts.values()), key=str)
    vector = {t: tuple(counts[p][t] for p in sorted(counts)) for t in every}
    want = Counter(Counter(v for t, v in vector.items() if sum(map(bool, v)) > 1).values())  # sizes of classes on several pages
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    rows = html_extract.vectors(df).filter("kind > 0 and pages > 1").collect()
    assert Counter(Counter(r.vector for r in rows).values()) == want
    assert sum(r.vector == r.root_vector for r in rows) == sum(set(v) == {1} for v in vector.values()) and {r.of_pages for r in rows} == {len(counts)}


# op3


def lingual(spark, n=300):
    ends = {"en": ["ing", "the", "tion", "wh"], "de": ["ung", "sch", "keit", "ei"], "fr": ["eau", "oux", "que", "elle"]}
    rng, rows = random.Random(8), []
    for i in range(n):
        lang = sorted(ends)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS)[:3] + rng.choice(ends[lang]) for _ in range(rng.choice([2, 10, 60]))), lang, "s"))
    return rows


def test_language_held_out_accuracy_and_cases(spark):
    rows = lingual(spark) + [(1001, None, "en", "s"), (1002, "", "en", "s"), (1003, "123 !!", "de", "s"), (1004, "eau " * 400_000, None, "s"), (1004, "eau " * 400_000, None, "s"), (None, "sch keit", "de", "s")]
    found = language_id.identified(docs(spark, rows, True)).select("row.doc_id", language_id.held_out("row.doc_id").alias("held_out"), "lang_pred", "score").collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1001, 1002, 1003)) and by[1004].lang_pred == "fr"
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows[:300] if by[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    whole = f" {' '.join(words)} " if words else ""
    return [whole[i : i + n] for n in (3, 4, 5) for i in range(len(whole) - n + 1)]


def test_language_equals_exact_sets(spark):
    """The rule with Python sets in place of the filter; both count the same languages for almost every n-gram."""
    rows = [(i, t, lang if i % 7 else None, s) for i, t, lang, s in lingual(spark)]
    learned = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    size, having = Counter(lang for _, lang in learned), defaultdict(Counter)
    for t, lang in learned:
        having[lang].update(set(plain_grams(t)))
    known = {lang: {g for g, n in c.items() if n >= language_id.LEAST_SHARE * size[lang]} for lang, c in having.items()}
    same, apart = 0, []
    found = {r.doc_id: r for r in language_id.identified(docs(spark, rows)).select("row.doc_id", "lang_pred", "score").collect()}
    for i, t, _, _ in rows:
        hits = {lang: sum(g in known[lang] for g in plain_grams(t)) for lang in sorted(known)}
        best, low = max(hits, key=hits.get), min(hits.values())
        same += found[i].lang_pred == best
        if len(plain_grams(t)) >= 100:  # in short texts one false positive shows in the score
            apart.append(abs(found[i].score - (hits[best] - low) / max(1, sum(h - low for h in hits.values()))))
    assert same == len(rows) and len(apart) > 100 and max(apart) < 0.05 and sum(apart) < 0.01 * len(apart)


def test_language_blocks_change_nothing(monkeypatch):
    text = " ".join(["ein", "Wörterbuch", "x" * 90, "12", "--", "d'un"] * 9)
    whole = Counter(np.concatenate(list(language_id._grams(text))).tolist())
    assert sum(whole.values()) == len(plain_grams(text)) and len(whole) == len(set(plain_grams(text)))
    for block in (1, 5, 40, 300):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", block)
        assert "".join(language_id._blocks(text)) == text
        assert Counter(np.concatenate(list(language_id._grams(text))).tolist()) == whole


def test_language_masks_have_all_languages_of_an_ngram():
    grams = {x: np.array([g], np.uint64) for x, g in (("a", 1), ("b", 2))} | {"c": np.array([1, 2], np.uint64)}
    f = language_id.BitSlicedFilter.of(grams, 16)
    assert f.masks(np.array([1, 2, 3], np.uint64))[0].tolist() == [0b101, 0b110, 0]


def test_language_without_labels_and_rows(spark):
    assert {r.lang_pred for r in language_id.identified(docs(spark, [(1, "some words", None, "s")])).collect()} == {"und"}
    assert language_id.identified(docs(spark, [])).count() == 0


def test_bit_sliced_filter_finds_all_and_corrects():
    rng = np.random.default_rng(3)
    own = {x: rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for x in map(str, range(70))}  # two planes
    f = language_id.BitSlicedFilter.of(own, 18)
    for k, name in enumerate(sorted(own)):
        if k % 13 == 0:
            counts = f.counts(own[name])
            assert counts[k] == 5000 and counts.argmax() == k
    other = f.counts(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    assert np.abs(other - 20_000 * f.false).max() < 60


# op4


def vectors(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_cases(spark):
    e = [[1.0, 0, 0, 0, 0], [0.9, 0.1, 0, 0, 0], [0, 1.0, 0, 0, 0]]
    rows = [(0, e[0], 0), (1, e[0], 0), (2, e[0], 0), (3, e[1], 0), (4, e[2], 1), (4, e[2], 1), (5, None, 0), (6, [0.0] * 5, 0), (7, [float("nan")] + [1.0] * 4, 0), (8, [None, 1.0, 1.0, 1.0, 1.0], 0), (9, [1.0, 2.0], 0), (None, e[0], 0), (10, [float("inf")] * 5, 0)]
    v = vectors(spark, rows).selectExpr("*", "1 AS code", "2 AS ids", "'x' AS vec")
    found = cross_polytope.nearest(v, v.filter("vec_id % 5 = 0"), 3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)] and {r.query_id for r in found} == {0}
    assert all(abs(r.score - (0 if r.vec_id < 3 else math.dist(np.float32(e[0]).tolist(), np.float32(e[1]).tolist()))) < 1e-15 for r in found)
    few = cross_polytope.nearest(v, v.filter("vec_id = 0"), 50).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert cross_polytope.nearest(vectors(spark, []), vectors(spark, [])).count() == 0


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "CELL", 30)  # many cells; large buckets are dealt out in blocks
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 48))
    x = (centres[np.arange(2000) % 8] + 0.8 * rng.normal(size=(2000, 48))).astype(np.float32)
    v = vectors(spark, [(i, y.tolist(), 0) for i, y in enumerate(x)])
    found = defaultdict(list)
    for r in cross_polytope.nearest(v, v.filter("vec_id % 100 = 0")).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = set(np.argsort(d, kind="stable")[:10].tolist())
        got = sorted(found[q])
        assert len(got) == 10 and all(abs(d[i] - s) < 1e-12 for _, i, s in got) and [s for *_, s in got] == sorted(s for *_, s in got)
        hit += len(best & {i for _, i, _ in got})
    assert hit / 200 >= 0.9


def share_met(x, queries, k=10):
    """(recall, share of candidates met) of the probes fitted to these queries, and whether buckets stay small."""
    n = len(x)
    hashing = cross_polytope.CrossPolytope(x.shape[1], n)
    codes, needed, best = hashing.index(x), [], {}
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best[q] = np.argsort(d, kind="stable")[:k]
        needed += hashing.needed(x[q], codes[best[q]])
    share, hit, met = float(np.quantile(needed, cross_polytope.RECALL, method="higher")), 0, 0
    for q in queries:
        found = np.zeros(n, bool)
        for t, c in enumerate(hashing.probes(x[q], share)):
            found |= np.isin(codes[:, t], c)
        hit += found[best[q]].sum()
        met += found.sum() - found[q]
    return hit / (k * len(queries)), met / (n * len(queries))


def test_nearest_meets_a_falling_share_of_candidates():
    rng, shares = np.random.default_rng(4), []
    for n in (1000, 8000, 40_000):  # no structure at all: the hardest case
        recall, share = share_met(rng.normal(size=(n, 32)), range(0, n, n // 20))
        assert recall >= 0.9
        shares.append(share)
    assert shares[2] < shares[1] < shares[0]
    centres = rng.normal(size=(200, 32))
    recall, share = share_met(centres[np.arange(8000) % 200] + 0.2 * rng.normal(size=(8000, 32)), range(0, 8000, 400))
    assert recall >= 0.9 and share < 0.05  # neighbours that stand out


def test_cross_polytope_takes_a_third_rotation_when_buckets_fill():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    hashing = cross_polytope.CrossPolytope(8, 8 * 64 * 4)
    assert hashing.axes == 4 and cross_polytope.CrossPolytope(8, 500).axes == 0
    codes = hashing.index(x)
    assert codes.shape == (300, cross_polytope.TABLES) and codes.max() < 16 * 16 * 8
    for y, own in zip(x[:20], codes[:20], strict=True):
        assert all(c in p for c, p in zip(own.tolist(), hashing.probes(y, 1.0), strict=True)) and max(hashing.needed(y, own[None])) < 0.01


# op5


def test_license_scan_equals_brute_force(spark):
    mit = dict(license_scan.templates())["MIT"]
    texts = [None, "", "Released under the MIT Licence.", f"{prose(1, 50)}\n\n{mit}\n\n{prose(2, 50)}", mit.upper(), prose(3, 80), "x " * 300_000, "This work is licensed under CC BY-SA 4.0. Released under the MIT License."]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(2, texts[2], "en", "s")]
    found = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows, True)).collect()}
    assert found[0].license is None and found[1].n_matches == 0 and found[5].score == 0 and found[6].license is None
    assert found[2].licenses == ["MIT"] and found[3].license == "MIT" and found[4].license == "MIT" and found[7].licenses == ["CC-BY-SA-4.0", "MIT"]
    s = license_scan.Scanner()
    rng = random.Random(2)
    for t in texts[2:6] + [texts[7]]:
        w = t.split(" ")
        for _ in range(6):
            w[rng.randrange(len(w))] = "other"
            text = " ".join(w)
            want = []
            for unit in s.units(text):
                best = [(license_scan.dice(license_scan.bigrams_of(unit), b), name) for name, b in s.known]
                best = [x for x in best if x[0] >= license_scan.DICE - 1e-12]
                want += [min(best, key=lambda x: (-x[0], x[1]))] if best else []
            got = s.scan(text)
            assert got[: len(want)] == want
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_license_windows_find_what_no_line_or_paragraph_holds():
    import textwrap

    s = license_scan.Scanner()
    for name in ("ISC", "BSL-1.0", "Zlib"):
        notice = next(t for n, t in license_scan.templates() if n == name)
        lines = textwrap.wrap(f"{prose(1, 20)} {notice} {prose(2, 20)}", 72)
        assert name in {x[1] for x in s.scan("\n".join([*textwrap.wrap(prose(3, 90), 72), *lines, *textwrap.wrap(prose(4, 90), 72)]))}
    assert s.scan("This tool, which we wrote last year, is released under the MIT License and comes with tests.") == [(1.0, "MIT")]
    assert s.scan("We wrote it under pressure, and the license of our dog is new.") == []
    assert len(s.scan("It is released under the MIT License and so on, " * 300)) >= 300  # a repeated text


def plain_dice(words, i, j, template):
    a, b = set(zip(words[i:j], words[i + 1 : j])), set(zip(template, template[1:]))
    return 2 * len(a & b) / (len(a) + len(b))


def test_license_windows_equal_brute_force():
    """Over every window of short texts, with sets alone: a template is reported if and only if some window matches it, and none of higher score is missed."""
    rng, known = random.Random(9), [("A", "a b c d e f g h"), ("B", "x a b y c d z"), ("C", "m n o p q r s t u v w")]
    s = license_scan.Scanner(known=known)
    hits = 0
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(1, 7)):
            t = rng.choice(known)[1].split()
            i = rng.randrange(len(t))
            words += rng.choice((t[i : i + rng.randrange(1, 9)], t, list("kkj"), [rng.choice("abcdefg")]))
        for k, (name, text) in enumerate(known):
            best = max((plain_dice(words, i, j, text.split()) for i in range(len(words)) for j in range(i + 2, len(words) + 1)), default=0)
            found = max((x[0] for x in s.windows(list(zip(words, words[1:])), k)), default=0)
            assert found == (best if best >= license_scan.DICE - 1e-12 else 0), (words, name)
            hits += found > 0
        got = s.scan(" ".join(words))
        top = max(((plain_dice(words, i, j, text.split()), name) for i in range(len(words)) for j in range(i + 2, len(words) + 1) for name, text in known), default=(0, ""))
        assert bool(got) == (top[0] >= license_scan.DICE - 1e-12)
    assert hits > 200


def test_license_scan_finds_runs_of_paragraphs_and_full_texts():
    s = license_scan.Scanner()
    around = "\n\n".join(prose(k, 60) for k in range(30))
    notice = next(t for name, t in license_scan.templates() if name == "GPL-3.0" and t.startswith("This program is free"))
    bsd = next(t for name, t in license_scan.templates() if name == "BSD-2-Clause" and "WARRANT" not in t.upper())
    for text, name in ((notice.replace("\n", "\n\n"), "GPL-3.0"), (bsd.replace("\n", "\n\n"), "BSD-2-Clause")):
        assert min(s.scan(f"{around}\n\n{text}\n\n{around}"), key=lambda x: (-x[0], x[1])) == (1.0, name)
    for name, text in license_scan.templates():
        if len(text) > 5000:
            assert (1.0, name) in s.scan(f"{prose(1, 60)}\n\n{text}\n\n{prose(2, 60)}")
    assert {name for name, text in license_scan.templates() if len(text) > 5000} == {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}


def test_license_scan_runs_equal_brute_force():
    rng = random.Random(6)
    known = [("A", "a b c d e f g h"), ("B", "a b c d e f g h i j k l m n o p"), ("C", "h g f e d c")]
    s = license_scan.Scanner(known=known)
    for _ in range(300):
        parts, letters = [], "abcdefghijklmnop"
        for _ in range(rng.randrange(1, 9)):
            i = rng.randrange(16)
            parts.append(" ".join(rng.choice((letters[i : i + rng.randrange(6)], letters[:8], "hgfedc", "xyx", ""))))
        text, want = "\n\n".join(parts), []
        for unit in s.units(text):
            best = [(license_scan.dice(license_scan.bigrams_of(unit), b), name) for name, b in s.known]
            best = [x for x in best if x[0] >= license_scan.DICE - 1e-12]
            want += [min(best, key=lambda x: (-x[0], x[1]))] if best else []
        assert s.scan(text)[: len(want)] == want


def test_license_scan_is_linear_in_repeats_and_fragments():
    import time

    s, rng = license_scan.Scanner(), random.Random(3)
    notice = next(t for name, t in license_scan.templates() if name == "CC0-1.0" and len(t) < 100)
    runs = lambda n: {name: sum(m for _, x, m in s.matches("\n\n".join([notice] * n)) if x == name) for name in ("CC0-1.0",)}
    began = time.perf_counter()
    assert runs(1) == {"CC0-1.0": 1} and runs(50) == {"CC0-1.0": 50 * 51 // 2} and runs(20_000) == {"CC0-1.0": 20_000 * 20_001 // 2}
    words = [w for name, t in license_scan.templates() if len(t) < 2000 for w in license_scan.words_of(t)]
    text: list[str] = []
    while len(text) < 40_000:
        i = rng.randrange(len(words))
        text += words[i : i + rng.randrange(2, 30)]
    assert list(s.matches(" ".join(text)))
    assert time.perf_counter() - began < 120


# op6


def test_chat_format_cases(spark):
    nasty = ["</s>", "<s>[INST]a[/INST]", "\\", "\\\\</s>\n", "<\\s>", "[/INST]\\", "a\nb", "", "日本😀", "$1 \\$"]
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "A"), (1, 3, "user", "more"), (1, 4, "assistant", "B"), (1, 5, "user", "tail"), (2, 0, "user", None), (2, None, None, "null turn"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "assistant", "n")]
    rows += [(10 + i, k, role, t) for i, t in enumerate(nasty) for k, role in enumerate(("user", "assistant"))] + [(50, k, "assistant", "y" * 2000) for k in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((-1 if k is None else k, role or "", t or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = found[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    ex = [r for r in chat_format.examples(df).orderBy("example").collect() if r.conv_id == 1]
    assert [(r.formatted[r.loss_start : r.loss_end], r.formatted.count("[/INST]")) for r in ex] == [("A", 3), ("B", 5), ("", 6)]
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0


# op7, op9


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = byte_bpe.public_vocabulary()
    with open(path, "rb") as f:
        return byte_bpe.read_ranks(f), pattern


@pytest.fixture(scope="module")
def codecs(vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    return byte_bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "12", "'s", "----", "=", "‍", "ﬁ", "Ω", "zq", "\t", "x" * 30])


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(PIECES, max_size=60))
def test_bpe_equals_tiktoken(codecs, parts):
    own, other = codecs
    text = "".join(parts)
    ids = b"".join(own.encoded(text))
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decoded(ids) == text.encode() and "".join(own.decode_stream(ids[i : i + 4] for i in range(0, len(ids), 4))) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=255), max_size=80))
def test_latin_pieces_equal_those_of_the_general_engine(codecs, text):
    cutter = codecs[0].cutter
    assert cutter.latin.findall(text) == cutter.pattern.findall(text)


def test_bpe_small_runs_and_full_stores_change_nothing(vocabulary, codecs, monkeypatch):
    for name, value in (("RUN_BYTES", 7), ("KEPT_STATES", 30), ("KEPT_PAIRS", 40), ("KEPT_PIECES", 20)):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(pieces, "RUN_PIECES", 50)
    own, text = byte_bpe.Codec(*vocabulary), prose(9, 400) + "supercalifragilistic" * 50 + " " * 300 + "-" * 200
    assert np.frombuffer(b"".join(own.encoded(text)), "<u4").tolist() == codecs[1].encode_ordinary(text)


@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine_equals_decoder(data, step):
    m = byte_bpe.Utf8Machine()
    assert "".join([*(m.feed(data[i : i + step]) for i in range(0, len(data), step)), m.feed(b"", True)]) == data.decode("utf-8", "replace")


def test_bpe_query_cases(spark, codecs):
    rows = ODD_ROWS + [(99, "a" * 50_000, "en", "s"), (100, "-=" * 9000 + "ab" * 9000, "en", "s")]
    found = byte_bpe.encoded(docs(spark, rows, True), *byte_bpe.public_vocabulary(), with_ids=True).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r.row.text or ""
        ids = codecs[1].encode_ordinary(text)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encoded(docs(spark, []), *byte_bpe.public_vocabulary()).count() == 0


def brute_tokens(costs, data):
    best = [(0, 0)]
    for end in range(1, len(data) + 1):
        best.append(min((best[a][0] + costs[data[a:end]], best[a][1] + 1) for a in range(end) if data[a:end] in costs))
    return best[-1][1]


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(PIECES, max_size=20))
def test_unigram_counts_equal_brute_force(vocabulary, parts):
    import regex

    ranks, pattern = vocabulary
    costs, text = unigram_counts.zipf_costs(ranks), "".join(parts)
    pieces = regex.findall(pattern, text)
    assert COUNTERS.setdefault(0, unigram_counts.counter(costs, pattern))(text) == (len(pieces), sum(brute_tokens(costs, p.encode()) for p in pieces))


COUNTERS = {}


def test_unigram_full_trie_and_cases(spark, vocabulary, monkeypatch):
    costs, pattern = unigram_counts.zipf_costs(vocabulary[0]), vocabulary[1]
    want = unigram_counts.counter(costs, pattern)(BASE)
    found = {r.doc_id: r for r in unigram_counts.token_counts(docs(spark, ODD_ROWS, True), *byte_bpe.public_vocabulary()).collect()}
    assert (found[1].n_tokens, found[2].n_pretokens) == (0, 0) and (found[4].n_pretokens, found[4].n_tokens) == want and found[9].n_tokens > 60_000
    for name, value in (("KEPT_NODES", 50), ("KEPT_COUNTS", 10), ("LONGEST", 4)):
        monkeypatch.setattr(unigram_counts, name, value)
    monkeypatch.setattr(pieces, "RUN_PIECES", 30)
    assert unigram_counts.counter(costs, pattern)(BASE) == want
    assert unigram_counts.token_counts(docs(spark, []), *byte_bpe.public_vocabulary()).count() == 0


def test_unigram_scores_are_an_argument(spark, vocabulary):
    scores = {b"ab": -1.0, b"a": -3.0, b"b": -3.0, b"abab": -1.5, b" ": -2.0, b" ab": -9.0}
    rows = [(1, "ab abab", "en", "s"), (2, "abababz", "en", "s"), (3, None, "en", "s")]
    found = {r.doc_id: r.n_tokens for r in unigram_counts.token_counts(docs(spark, rows, True), None, vocabulary[1], scores).collect()}
    costs = unigram_counts.score_costs(scores)
    assert found == {1: brute_tokens(costs, b"ab") + brute_tokens(costs, b" abab"), 2: 3, 3: 0} and found[1] == 3


# op8


def brute_targets(sizes):
    """By the rule itself: share by weight, stop at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        target |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3.0 * sizes[s]
            full.add(s)


@pytest.mark.parametrize("clashing", [False, True])
def test_mixing_targets_and_amounts(spark, monkeypatch, clashing):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)
    rng, rows = random.Random(3), []
    for s, n in (("a", 900), ("b", 60), (None, 30), ("é", 300), ("c", 0), ("Z", 15)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randrange(1, 40)), "en", s) for k in range(n)]
    rows += [(9001, None, "en", "a"), (9002, "  ", "en", "c"), (None, "x y", "en", "b"), (9003, "w " * 50, "en", "b"), (9003, "w " * 50, "en", "b")]
    quality = spark.createDataFrame([(k, float(k % 3)) for k in range(0, 1200, 2)] + [(4, None), (None, 1.0), (6, 9.0)], "doc_id long, quality double")
    d = docs(spark, rows, clashing)
    found = mixing.mix(d, quality).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(d.repartition(3), quality).collect()))  # reruns agree
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    want = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    whole = mixing.mixed(d, quality)
    assert whole.columns == d.columns
    assert sum(len((r.text or "").split()) for r in whole.collect()) == sum(taken.values())
    assert mixing.mix(docs(spark, []), quality).count() == 0 and mixing.mixed(docs(spark, []), None).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(k, "w " * 10, "en", "a" if k < 1000 else "b") for k in range(2000)]
    quality = spark.createDataFrame([(k, 4.0 if k % 2 else 0.5) for k in range(1000)], "doc_id long, quality double")
    got = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows), quality).collect()}
    assert sum(got[k] for k in range(1, 1000, 2)) > 2 * sum(got[k] for k in range(0, 1000, 2))


def test_shared_folder_is_the_cluster_s(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
