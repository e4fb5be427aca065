"""Periodic runs, main texts of pages and token alignment against brute force."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landlens.llm import alignment, maintext, repeats
from landlens.llm.common import tokenizer_file

# -- periodic runs -------------------------------------------------------------------------------------------------------------


def plain_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) by testing every period."""
    found: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


def as_tuples(got) -> list[tuple[int, int, int]]:
    return list(zip(*[x.tolist() for x in got], strict=True))


def test_runs_of_random_words_equal_those_of_every_period():
    rng = random.Random(5)
    for _ in range(600):
        kinds = rng.choice([1, 2, 2, 3, 6])
        words = [str(rng.randrange(kinds)).encode() for _ in range(rng.randrange(0, 70))]
        if words and rng.random() < 0.4:
            p = rng.randrange(1, 9)
            words = (words[:p] * 70)[: len(words)]
        other = [str(rng.randrange(kinds)).encode() for _ in range(rng.randrange(0, 30))]
        for text, got in zip((words, other, words), repeats.find_runs([words, other, words], least=2), strict=True):
            assert as_tuples(got) == plain_runs(text, 2)


def test_runs_of_long_periodic_texts_take_linear_memory_and_little_time():
    for words in ([b"a"] * 60_000, [b"a", b"b", b"c"] * 20_000, [b"x"] + [b"p%d" % k for k in range(7_000)] * 4):
        got = as_tuples(repeats.find_runs([words])[0])
        assert len(got) == 1 and got[0][2] == len(set(words) - {b"x"})


def test_a_run_leaves_its_first_period():
    words = b"say a b a b a b a b a b a b end".split()
    (start, length, period), = as_tuples(repeats.find_runs([words])[0])
    assert (start, length, period) == (1, 12, 2)
    assert b" ".join(repeats.collapsed(words, *map(np.array, ([start], [length], [period])))) == b"say a b end"


def contract_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    dropped = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digests_of_documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(0, 80)))) for k in range(120)]
    rows += [(None, "x y " * 20), (7, None), (8, ""), (9, " \t\n "), (10, "a b " * 13), (11, "é   " * 14), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("period", F.lit(1)).withColumn("words", F.lit("x"))
    docs.write.parquet(path := f"{_folder(spark)}/documents.parquet")
    got = repeats.op11_periodic_runs(spark, path.rsplit("/", 1)[0]).drop("n_words", "n_kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted((contract_runs(*r) for r in rows), key=str)
    texts = {r.collapsed for r in repeats.text_runs(spark.createDataFrame([(1, "z " + "a b c " * 9)], "doc_id long, text string")).collect()}
    assert texts == {"z a b c"}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    none.write.parquet(path := f"{_folder(spark)}/documents.parquet")
    folder = path.rsplit("/", 1)[0]
    assert repeats.op11_periodic_runs(spark, folder).count() == 0
    assert alignment.op13_token_alignment(spark, folder).count() == 0


def _folder(spark) -> str:
    from landlens.session import shared_dir

    return shared_dir(spark, "test")


# -- main texts ----------------------------------------------------------------------------------------------------------------

STATED = np.array(maintext.STATED)


def test_cut_is_the_least_of_all():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        gain = rng.normal(0, 1, n).tolist()
        edges = [(a, b, float(rng.random())) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            ties = sum(max(0.0, g if not s else -g) for g, s in zip(gain, side, strict=True))
            return ties + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(maintext.minimum_cut(gain, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/a">Menu</a></ul></nav></header><div class="cookie-notice">We use cookies.</div>
<div id="content"><h2>Title &amp; more</h2><p>First paragraph,
  with <b>bold</b>&nbsp;and<br>a break. It is a text.</p><!-- <p>no</p> --><div class="ad-box"><p>Buy this now. It is good.</p></div>
<p>Short<p>Third one closes the text here. It does.<aside><p>See also these pages. They are good.</p></aside></div>
<form><label>Mail</label><button>Send</button></form><section class="comments"><p>I liked the article very much. Thanks.</p></section>
<div class="sidebar"><p>Popular pages</p></div><footer>&copy; 2020</footer></body></html>"""


def test_content_is_told_from_the_rest():
    assert maintext.main_text(PAGE, STATED) == (
        "Title & more\nFirst paragraph, with bold and a break. It is a text.\nShort\nThird one closes the text here. It does."
    )


def test_odd_pages_have_a_result():
    for page in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<b><i>", "&#0;&nbsp;", "<nav>menu"):
        assert isinstance(maintext.main_text(page, STATED), str)
    assert maintext.main_text("One sentence without markup, long enough to be one. And another.", STATED) != ""
    assert maintext.main_text("<article><p>" + "word. " * 40_000, STATED).count("word") == 40_000
    assert len(maintext.blocks_of("<div>t" * 20_000)) == 20_000


def test_unclosed_quotes_take_linear_time():
    assert maintext.main_text("<a href='" * 40_000, STATED) is not None


def test_pages_of_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in maintext.op12_html_extraction(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[page.page_id] == "\n".join(x for x in lines if x)


def test_page_tables_with_nulls_and_clashing_columns(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "v", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    got = maintext.extract_main_text(pages, maintext.fit_weights(pages)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:2] == [(0, 0), (1, got[0].n_chars)] and len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert maintext.extract_main_text(pages.limit(0), maintext.fit_weights(pages.limit(0))).count() == 0


# -- alignment -----------------------------------------------------------------------------------------------------------------

FILES = tokenizer_file(alignment.A_FILE), tokenizer_file(alignment.B_FILE)


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(*FILES)


def plain_alignment(tool, text):
    """Ids of the libraries on the whole text, ends by the tokens' bytes: (n_a, n_b, groups, links)."""
    whole = " " + (text or "")
    a, b = tool.a.encode(whole, add_special_tokens=False).ids, tool.b.encode(text or "")
    a_bytes, b_bytes = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
    if not text or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
        return 0, 0, "", []
    a_end, b_end = ({e: k for k, e in enumerate(itertools.accumulate(map(len, x)))} for x in (a_bytes, b_bytes))
    groups, links, i, j = [], [], 0, 0
    for e in sorted(a_end.keys() & b_end.keys()):
        m, k = a_end[e], b_end[e]
        groups.append(",".join(map(str, a[i : m + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
        links.append((a[m], b[k]))
        i, j = m + 1, k + 1
    return len(a), len(b), ";".join(groups), links


ODD = " \n\t\r\x0b\x1c\x85  　aáeé́İi中文😀👨‍.,;:!?'0<|▁\x00ABđßﬁ﻿"


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    some = ["hello", "world ", " the", "<|endoftext|>", "don't", "\n\n", "   ", "naïve,", "</s>", "<0x0A>", "x&&&"]
    return ["".join(rng.choice(some) if rng.random() < 0.3 else rng.choice(ODD) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_groups_of_odd_texts_equal_those_of_whole_texts(tool):
    texts = [*odd_texts(3000, 1), "", None, "a" * 500, "word " * 3000, " ", "\n"]
    for text, (n_a, n_b, groups, codes) in zip(texts, tool.documents(texts), strict=True):
        links = [(c >> 32, c & 0xFFFFFFFF) for c in np.frombuffer(codes, "<i8").tolist()]
        assert (n_a, n_b, groups, links) == plain_alignment(tool, text), text


def test_corpus_counts(spark, tool, monkeypatch):
    texts = [*odd_texts(60, 2), "the cat the cat", "the cat the cat", None, ""]
    rows = [*enumerate(texts), (None, "the dog"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("pair", F.lit("x"))
    got = [tuple(r) for r in alignment.align_documents(docs.repartition(5), *FILES).collect()]
    each = [(i, plain_alignment(tool, t)) for i, t in rows]
    count: dict = {}
    for _, (_, _, _, links) in each:
        for pair in links:
            count[pair] = count.get(pair, 0) + 1
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = [
        (i, n_a, n_b, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, (n_a, n_b, groups, links) in each
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "naïve 中文, yes"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.aligned_groups(docs, *FILES).collect()}
    assert got[2] == [] and got[1][0].start == 0 and got[1][-1].end == len(" naïve 中文, yes".encode())


# -- ids of odd texts ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_words_give_the_ids_of_whole_texts(name):
    from landlens.llm.tokens import WordTokenizer

    mine = WordTokenizer(tokenizer_file(name))
    rng = random.Random(9)
    texts = ["KEDİ!", "ŞEHRİ, ANKARA", "kedi İ. İ, ǰ. ŉ, ẖ!", *odd_texts(500, 3)]
    for _ in range(12):
        codes = [rng.randrange(1, 0x3000) if rng.random() < 0.7 else rng.randrange(0x20, 0x7F) for _ in range(2000)]
        texts.append("".join(chr(c) + (" " if rng.random() < 0.2 else rng.choice(["", "", ",", "."])) for c in codes if not 0xD800 <= c < 0xE000))
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids, text
