"""Quality, decontamination, toxicity and HTML extraction on small fixtures and against brute force."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, quality_ratio, toxicity

TEXTS = [None, "", "\n\n", "a b c d e f g h i j", "x y\nx y\n  \n \nx y", "one two three four five one two three four five six " * 3, "## $$ a%b <tag> | é ü z " * 4, "ab\tcd\x0bef\rgh"]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_like_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").drop("n_words")
    for r in quality_ratio.base_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text), r.text


def test_ratio_parts_trusted_from_junk(spark):
    rng = random.Random(1)  # many words, as one is added to the count of each bucket
    prose = lambda: " ".join(rng.choice(["the", "a", "house", "tree."]) for _ in range(2000)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["HOUSE!!", "tree###", "|", "a$$$"]) for _ in range(2000))
    texts = [prose() for _ in range(30)] + [junk() for _ in range(10)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = quality_ratio.log_ratios(docs, docs.filter("doc_id < 20"))
    got = {r.doc_id: r for r in quality_ratio.judge(docs, ratios, -0.25).collect()}
    assert len(got) == len(texts) and ratios.count() == quality_ratio.BUCKETS
    assert all(got[i].log_ratio > 0 for i in range(30)) and all(got[i].log_ratio < -0.25 and not got[i].kept for i in range(30, 40))
    assert got[40].base_failed and not got[40].kept and got[40].log_ratio is None


def test_ratio_without_trusted_rows_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    ratios = quality_ratio.log_ratios(docs, docs.limit(0))
    assert quality_ratio.judge(docs, ratios, -0.25).first().kept
    assert quality_ratio.judge(docs.limit(0), ratios, -0.25).count() == 0


def test_texts_are_read_and_hashed_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "One two three"), (3, None)], "doc_id long, text string")
    grams = quality_ratio.grams(docs)
    assert "text" not in grams.columns and grams.count() == docs.count()
    for r in quality_ratio.with_buckets(docs).collect():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert len(r["__buckets"]) == 2 * words and all(0 <= b < quality_ratio.BUCKETS for b in r["__buckets"])
    ratios = [quality_ratio.log_ratios(x, docs.filter("doc_id < 3")) for x in (docs, grams)]
    assert sorted(ratios[0].collect()) == sorted(ratios[1].collect())
    got = [sorted(map(str, quality_ratio.judge(x, ratios[0], -0.25).collect())) for x in (docs, grams)]
    assert got[0] == got[1]
    plan = quality_ratio.judge(grams, ratios[0], -0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "xxhash64" not in plan


def test_leaks_whole_substituted_and_clean(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    swapped = list(item)
    for k in (4, 12, 20, 28):
        swapped[k] = "zzz"
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    texts = [noise(50), noise(20) + item + noise(20), noise(5) + [w.upper() + "," for w in swapped], item[:6] + noise(30), item[10:24], []]
    docs = spark.createDataFrame([(i, " ".join(t), i) for i, t in enumerate(texts)] + [(None, " ".join(item), 0), (9, None, 0)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (None, None)], "item_id long, text string")
    rows = decontaminate.contaminated(docs, items).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    assert {k for k, r in got.items() if r.contaminated} == {1, 2, 4, None}
    assert got[1].item_ids == [7] and got[1].overlap == 1.0 and got[0].overlap == 0.0
    assert not decontaminate.contaminated(docs, items.limit(0)).filter("contaminated").count()
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("words", range(1, 14))
def test_masks_fit_between_all_substitutions(words):
    masks = decontaminate.masks_for(words)
    for gone in itertools.combinations(range(words), words - -(-75 * words // 100)):
        assert any(not any(m == "1" and i + k in gone for k, m in enumerate(mask)) for mask in masks for i in range(words - len(mask) + 1)), gone


def test_short_items_and_close_substitutions(spark):
    items = {n: [f"q{n}-{i}".replace("-", "x") for i in range(n)] for n in (1, 2, 3, 4, 6, 8, 12, 13)}
    swap = lambda n, *at: ["zzz" if i in at else w for i, w in enumerate(items[n])]
    cases = [(swap(n), n) for n in items] + [(swap(13, 2, 4, 6), 13), (swap(13, 0, 6, 12), 13), (swap(12, 2, 5, 8), 12), (swap(8, 2, 5), 8), (swap(6, 3), 6), (swap(4, 1), 4), (swap(4, 1, 2), None), (swap(3, 1), None), (swap(13, 1, 4, 7, 10), None)]
    docs = spark.createDataFrame([(k, " ".join(["before", *x, "behind"])) for k, (x, _) in enumerate(cases)], "doc_id long, text string")
    tests = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, tests).collect()}
    assert got == {k: [n] if n else [] for k, (_, n) in enumerate(cases)}


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum*": 4.0, "trash": 3.0}, ("trash can",))
    assert toxicity.fold_words("1d10t! ІDIОT idi0t, $cum 2024 a@b") == ["idiot", "idiot", "idiot", "scum", "2024", "aab"]
    assert lexicon.features("an 1d1ot and scummy Scum")[2] == 3
    assert lexicon.features("the trash can")[2] == 0 and lexicon.features("trash the can")[2] == 1
    assert lexicon.features("idiotic stuff")[2] == 0 and lexicon.features("")[0] == 0.0


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(3)
    clean = lambda: [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))]
    docs, labels = [], []
    for i in range(240):
        words, bad = clean(), i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grumbo", f"zarkfa{rng.randrange(10**5)}"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(1000, "nothing here"), (1001, None), (1002, "what a GRUMB0"), (1003, "zarkfa777777 then")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(d, toxicity.training_labels(y))
    assert "grumbo" in lexicon.weights and any(k.startswith("zark") and k.endswith("*") for k in lexicon.weights)
    got = {r.doc_id: r.score for r in toxicity.score(d, lexicon).collect()}
    assert sum((got[i] >= 0.5) == bool(b) for i, b in labels) >= 236
    assert got[1000] < 0.5 and got[1001] < 0.5 and got[1002] >= 0.5 and got[1003] >= 0.5
    assert toxicity.fit(d, y.limit(0)).weights == {} and toxicity.score(d.limit(0), lexicon).count() == 0


def test_labels_of_the_held_out_fold_are_not_learnt_from(spark):
    import zlib

    y = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity.training_labels(y).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
line.<br>Second<p>Be.</p><!-- <p>hidden</p> --><form><p>Sign up</p></form><div class='ad'>Buy</div><p>Third &eacute;&#33;</p>
<section id=comments><p>I disagree with a long comment that goes on and on and on and on</p></section></article>
<aside><p>Related story with quite some text in it that is longer than the article itself, really much longer</p></aside>
<footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [(PAGE, "Title & more First bold line. Second Be. Third é!"), (None, ""), ("", ""), ("<nav>only</nav>", ""), ("plain text", "plain text"), ("<p>a<p>b<script>x", "a b"), ("<div><p>x &lt;b&gt; y</p>", "x <b> y"), ("<p>" + "long " * 50_000, ("long " * 50_000).strip())],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_pages_without_an_article_element():
    menu = "<ul>" + "<li><a href=x>Menu entry</a></li>" * 12 + "</ul>"
    body = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} with several words in it.</p>" for i in range(6))
    got = html_extract.main_text(f"<body>{menu}<div>{body}</div>{menu}</body>")
    assert got.startswith("Head Paragraph 0") and got.endswith("5 with several words in it.") and "Menu" not in got


def test_boxes_in_the_middle_of_an_article():
    text = lambda a, b: "".join(f"<p>Paragraph {i} with several words.</p>" for i in range(a, b))
    links = "<ul>" + "<li><a href=x>Menu entry</a></li>" * 7 + "</ul>"
    advert = "<div class=ad>" + "<p>Buy this now</p>" * 8 + "</div>"
    side = "<div><p>Teaser of another page</p></div>"
    want = " ".join(f"Paragraph {i} with several words." for i in range(12))
    for whole in (f"<div>{text(0, 2)}{links}{text(2, 9)}{advert}{text(9, 12)}</div>", f"<div>{text(0, 9)}<section>{advert}{text(9, 12)}</section></div>"):
        assert html_extract.main_text(f"<body>{side}{links}{whole}{links}{side}</body>") == want
    assert html_extract.main_text(f"<body>{text(0, 3)}{links}{text(3, 12)}{links}{side}</body>") == want


@pytest.mark.parametrize("unclosed", ["<p><b>x<br>", "<dl><dt>x<dd>y", "<table><tr><td>x"])
@pytest.mark.parametrize("n", [20, 40, 3000])
def test_end_tags_over_many_unclosed_elements(unclosed, n):
    page = f"<body><nav>{unclosed * n}</nav><article><p>First words.</p>{unclosed * n}</article><p>Behind it.</p></body>"
    got = html_extract.main_text(page)
    assert got.startswith("First words.") and "Behind" not in got
    assert html_extract.main_text(f"<body><div class=ad>{unclosed * n}</div><p>First words.</p></body>") == "First words."


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, "v", None, "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].n_chars == len(got[1].text) > 0 and (got[2].text, got[2].n_chars, got[2].url) == ("", 0, "v")
    assert html_extract.extract(pages.filter(F.lit(False))).count() == 0


def test_words_of_any_length_become_entries(spark):
    word = "abcdefghij" * 9
    rows = [(i, f"a plain text {'with ' + word if i % 2 else 'of nothing'} number {i}", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert word in lexicon.weights


@pytest.mark.parametrize(
    "mark",
    ['title="the hidden cost"', 'data-x="not hidden"', 'class="ad-hoc"', 'id="social-history"', 'class="share-price-table"', 'class="notice-of-death"', 'class="download head-of-state"', "alt='display:none'"],
)
def test_attributes_that_only_look_like_marks(mark):
    page = f"<body><nav>Menu</nav><article><p>First words here.</p><p {mark}>Second words here.</p></article></body>"
    assert html_extract.main_text(page) == "First words here. Second words here."


@pytest.mark.parametrize("mark", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', 'class="x comment-list"', 'class="site-footer"', 'id=cookie-banner', 'role="navigation"', 'class="post-comments"', 'class="ad-slot"'])
def test_attributes_that_are_marks(mark):
    page = f"<body><article><p>First words here.</p><div {mark}>Second words here.</div></article></body>"
    assert html_extract.main_text(page) == "First words here."


def test_captions_formulas_comments_and_cards():
    text = " ".join(f"word{i}" for i in range(40))
    page = f"<body><section><article><p>{text}</p><figure><img><figcaption>A caption.</figcaption></figure><p>Sum <math><mi>x</mi></math> of it.</p></article></section><section><article class=comment>I disagree.</article></section><article><h2><a href=x>Another piece</a></h2><p>Its lead.</p></article></body>"
    assert html_extract.main_text(page) == f"{text} A caption. Sum x of it."
    two = f"<body><article>{text}</article><article>{text} more</article></body>"
    assert html_extract.main_text(two) == f"{text} {text} more"


def test_many_scripts_and_long_pages_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 16_000):
        page = "<body><article>" + "".join(f"<SCRIPT>var a{i} = '</p>';</Script><p>Line {i}.</p>" for i in range(n)) + "</article></body>"
        start = time.process_time()
        assert html_extract.main_text(page) == " ".join(f"Line {i}." for i in range(n))
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0]
