import hashlib
import math
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, linededup, media, neardup, packing, queries, tokencount, wrappers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- decontamination


def contamination(docs, items):
    """Plain windows by dictionary."""
    by = defaultdict(set)
    for item_id, text in items:
        w = WORD.findall(fold(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            by[tuple(w[i:i + 13])].add(str(item_id) if item_id is not None else "")
    sizes = {len(k) for k in by}
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(fold(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                ids = by.get(tuple(w[i:i + n]))
                if ids:
                    found |= ids
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_query(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.op4_fm_decontamination(spark, sf).collect()))
    assert got == sorted(contamination([(r.doc_id, r.text) for r in docs.collect()], items))
    assert any(r[2] for r in got)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = [(1, "Lazy DOG"), (2, None), (None, "id"), (3, "word " * 20), (4, "!!"), (1, "lazy dog"), (5, "neg"), (6, "é中\U0001f600")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, (tuple(r) for r in decontamination.contamination(odd, bench).collect())))
    assert got == sorted(map(str, contamination([(r.doc_id, r.text) for r in odd.collect()], items)))
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum("False" in x for x in got)
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(1, 5, 3000), 0)
    index = decontamination.FMIndex(s)
    for n in (1, 3, 7):
        phrase = s[100:100 + n]
        lo, hi = index.search(phrase[None])
        at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert at == [i for i in range(len(s) - n) if (s[i:i + n] == phrase).all()]


# --- near-duplicates


def sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def linked(rows, words, percent):
    """Components over all pairs; rows are ``(doc_id, text)``."""
    found, at = sets([t for _, t in rows], words), list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if a and found[j] and 100 * both >= percent * (len(a) + len(found[j]) - both):
                at[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        low[r] = min(low.get(r, doc_id), doc_id)
    return {doc_id: (len(found[i]), low[root(i)]) for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, words, percent):
    expected = linked([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, words, percent).collect()}
    assert got == expected and any(i != c for i, (_, c) in got.items())
    kept = neardup.one_of_each(docs, words, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_near_duplicates_of_odd_rows(odd, none):
    found = neardup.near_duplicates(odd, 3, 85)
    assert found.count() == odd.count()
    by = defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for i in (2, 3, 4) for r in by[i])
    assert neardup.one_of_each(odd).columns == odd.columns
    assert neardup.one_of_each(odd).count() == odd.distinct().count()
    assert neardup.near_duplicates(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_odd_sketch_tells_how_many_samples_differ():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, neardup.SAMPLES).astype(np.uint64)
    b = a.copy()
    b[:20] = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    apart = np.bitwise_count((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64)).sum()
    assert 20 <= apart <= 40 and apart <= neardup.farthest(1 - 20 / neardup.SAMPLES)


# --- line dedup


def repeated(rows, min_words):
    """By (doc_id, text) the lines that stand in a run of min_words words or more seen before."""
    runs, gone = {}, defaultdict(set)
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for doc in order:
        lines = [(i, x) for i, y in enumerate(doc[1].split("\n")) if (x := y.strip())]
        for a in range(len(lines)):
            for e in range(a + 1, len(lines) + 1):
                text = tuple(x for _, x in lines[a:e])
                if sum(len(x.split()) for x in text) >= min_words:
                    place = (doc, lines[a][0], lines[e - 1][0] + 1)
                    if text not in runs:
                        runs[text] = place
                    elif runs[text][0] != doc or lines[a][0] >= runs[text][2]:
                        gone[doc].update(i for i, _ in lines[a:e])
    return gone


def test_line_dedup_deletes_later_runs(spark):
    p = ["alpha beta gamma delta", "one two three", "uno dos tres cuatro"]
    rows = [
        (1, "\n".join(["start here", *p, "end"])), (2, "\n".join(["other", *p])), (3, "\n".join([p[0], "cut", p[1]])), (4, None), (5, ""),
        (6, "\n".join(["x y"] * 9)), (2, "\n".join(["other", *p])), (7, " \n".join(p)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(3))
    got = linededup.dedup_lines(docs, 8)
    assert got.columns == ["doc_id", "text", "removed", "removed_"]
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[1] == rows[0][1] and text[2] == "other" and text[3] == rows[2][1] and text[4] is None and text[5] == "" and text[7] == ""
    assert got.count() == len(rows)


def test_line_dedup_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone = repeated(rows, linededup.MIN_WORDS)
    for r in linededup.dedup_lines(docs.select("doc_id", "text")).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        expected = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[r.doc_id, text])
        assert r.text == expected, r.doc_id


def test_line_dedup_of_odd_rows(odd, none):
    got = linededup.dedup_lines(odd)
    assert got.columns[:-1] == odd.columns and got.count() == odd.count()
    assert linededup.dedup_lines(none).count() == 0


# --- packing


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, pieces):
    expected = defaultdict(list)
    for (doc_id, text), ids in zip(rows, tokens([t or "" for _, t in rows])):
        expected[doc_id].append(ids)
    for doc_id, lists in expected.items():
        mine = [p for p in pieces if p.doc_id == doc_id]
        for ids in lists:
            for p in [p for p in mine if p.doc_tokens == len(ids)]:
                some = [zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) for x in lists if len(x) == p.doc_tokens]
                assert p.ids_crc32 in some
        assert sum(p.length for p in mine) == sum(map(len, lists))
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for some in by.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    short = [n for n in (sum(p.length for p in some) for some in by.values()) if n < packing.WINDOW]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 11


def test_packing_query(spark, sf, docs):
    check_packing([(r.doc_id, r.text) for r in docs.collect()], queries.op5_mixture_packing(spark, sf).collect())


def test_packing_of_odd_rows(odd, none):
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.digest(packing.pack(odd)).collect())
    assert packing.pack(none).count() == 0


def test_packing_keeps_to_the_mixture(spark):
    docs = spark.createDataFrame([(i, f"tok {i} " * (5 + i % 7), "a" if i % 4 else "b") for i in range(1200)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, {"a": 0.5, "b": 0.5}, window=256).collect()
    total = {s: sum(p.length for p in pieces if p.source == s) for s in "ab"}
    filled = int(2 * total["b"] / 256 * 0.9)
    early = [p for p in pieces if p.sequence_id < filled]
    share = sum(p.length for p in early if p.source == "b") / sum(p.length for p in early)
    assert abs(share - 0.5) < 0.03


def test_packing_fills_each_window_to_the_shares(spark):
    rows = [(i, "tok " * (5 + i % 7), "abc"[i % 3]) for i in range(1500)] + [(5000, "long " * 6000, "a")] + [(6000 + i, "rare one", f"r{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, window=256).collect()
    total, held, ids = defaultdict(int), defaultdict(lambda: defaultdict(int)), 0
    for p in pieces:
        total[p.source] += p.length
        held[p.sequence_id][p.source] += p.length
        ids += p.length
    windows = ids // 256
    for s in "abc":
        assert all(abs(held[w][s] - 256 * total[s] / ids) < 20 for w in range(windows)), s
    # Rare sources are spread, and not stacked at the end.
    late = {p.source for p in pieces if p.source.startswith("r") and p.sequence_id >= windows - windows // 4}
    assert len(late) < 20


def test_packing_puts_sources_without_a_share_last(spark):
    docs = spark.createDataFrame([(i, "tok " * 30, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    got = sorted(packing.pack(docs, {"a": 0.0}, window=256).collect(), key=lambda p: (p.sequence_id, p.offset))
    order = [p.source for p in got]
    assert order == sorted(order, reverse=True) and {p.doc_id for p in got} == set(range(200))


# --- token counts


def viterbi(word, scores, unknown):
    """The unigram model's best path, spelled out."""
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            piece = word[s:e]
            if piece in scores:
                new, n = best[s][0] + scores[piece], best[s][1] + 1
            elif e - s == 1:
                new, n = best[s][0] + unknown, best[s][1] + len(piece.encode())
            else:
                continue
            if best[e] is None or new > best[e][0]:
                best[e] = (new, n)
    return best[-1][1]


def test_token_counts_against_plain_viterbi(docs):
    pieces = tokencount.vocabulary()
    scores = dict(reversed(pieces))
    unknown = min(scores.values()) - tokencount.UNKNOWN_PENALTY
    some = docs.orderBy("doc_id").limit(25)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(some).collect()}
    for r in some.collect():
        assert got[r.doc_id] == sum(viterbi(tokencount.MARK + w, scores, unknown) for w in r.text.split()), r.doc_id


def test_token_counts_agree_with_the_tokenizers_library(tmp_path, spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -2.0), ("b", -2.5), ("ab", -4.5), ("▁a", -4.0), ("abab", -9.0), ("c", -3.0), ("bc", -5.5)]
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    model.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = tokencount.Counter(pieces[1:])
    for text in ("abab", "a", "abcabc", "ccc", "aab bca"):
        assert sum(map(counter.word, text.split())) == len(model.encode(text).ids), text


def test_token_counts_of_odd_rows(odd, none):
    got = tokencount.token_counts(odd).collect()
    assert len(got) == odd.count() and all((r.n_tokens == 0) == (r.n_words == 0) for r in got)
    assert tokencount.token_counts(none).count() == 0


# --- media


def check_media(rows, got):
    expected = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data.ljust(max(64, math.ceil(len(data) / 64) * 64), b"\0")
        expected.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in got)


def test_media_query(spark, sf, docs):
    check_media([(r.doc_id, r.text) for r in docs.collect()], queries.op3_iso_media_columns(spark, sf).collect())


def test_media_of_odd_rows(odd, none):
    check_media([(r.doc_id, r.text) for r in odd.collect()], media.digest(media.stored_as_media(odd)).collect())
    assert media.digest(media.stored_as_media(none)).count() == 0


def test_media_columns_read_tables_and_say_what_is_broken(spark):
    good = media.container(bytes(range(64)) * 40)
    rows = [(1, good), (2, None), (3, good[:100]), (4, b""), (5, b"\0" * 40)]
    got = {r.id: r.media_info for r in media.media_columns(spark.createDataFrame(rows, "id int, media binary")).collect()}
    x = got[1]
    assert (x.codec, x.timescale, x.duration, x.n_samples, x.payload_bytes, len(x.keyframes), x.error) == ("raw ", 8000, 2560, 40, 2560, 3, None)
    assert all(good[k.offset:k.offset + k.length] == bytes(range(64)) for k in x.keyframes)
    assert all(got[i].error and got[i].codec is None for i in (2, 3, 4, 5))


# --- HTML


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
    return " ".join(x for x in parts if x)


def test_main_text_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_wrapper_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def page(body, extra=""):
    return (
        f"<html><head><title>t</title></head><body class=\"has-sidebar\"><header>Site</header><div class=menu><a href=/>Home</a> <a href=/x>X</a></div>{extra}"
        f"<div id=content><h1>Head</h1>{body}<div class='comments'><p>first!</p></div></div><div class=footer>(c)</div></body></html>"
    )


def test_wrapper_of_a_host_without_article_tags(spark):
    bodies = ["<p>one &amp; two<p>three <i>fo</i>ur", "<p>five</p><ul><li>a<li>b</ul>", "<p>six</p><h2>s</h2><p>t</p><h2>u</h2><p>v</p>"]
    rows = [(i, f"https://h.example/{i}", page(b, "<div class='cookie-notice'>cookies</div>" if i else "")) for i, b in enumerate(bodies)]
    rows += [(8, None, None), (9, "nonsense", ""), (9, "nonsense", ""), (10, "https://one.example/", "plain &lt;text&gt; alone"), (None, "https://h.example/0", page(bodies[0]))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, wrapper int")
    got = wrappers.main_texts(frame).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[0] == text[None] == "Head one & two three four" and text[1] == "Head five a b" and text[2] == "Head six s t u v"
    assert text[8] == text[9] == "" and text[10] == "plain <text> alone"
    assert wrappers.main_texts(frame.where("false")).count() == 0


def test_alignment_makes_repeats_and_optionals():
    tree = lambda h: wrappers.item(wrappers.parse(h))
    x = wrappers.merge(tree("<div><p>a</p><p>b</p></div>"), tree("<div><h2>t</h2><p>c</p></div>"))[wrappers.CHILDREN][0]
    found = [(c[wrappers.LABEL], c[wrappers.PAGES], c[wrappers.REPEATED]) for c in x[wrappers.CHILDREN]]
    assert found == [("h2", 1, False), ("p", 3, True)]
    same = wrappers.merge(tree("<div>same</div>"), tree("<div>same</div>"))
    assert same[wrappers.CHILDREN][0][wrappers.CHILDREN][0][wrappers.CONSTANT] == "same"


def main_texts(*pages):
    """The main text of each page of a host, in the order in which its wrapper was built."""
    trees = [wrappers.parse(p) for p in pages]
    wrapper = wrappers.item(trees[0])
    for tree in trees[1:]:
        wrapper = wrappers.merge(wrapper, wrappers.item(tree))
    wrapper = wrappers.mark(wrapper)
    return [wrappers.main_text(tree, wrapper) for tree in trees]


def test_main_text_takes_the_places_that_the_alignment_gave():
    links = "<div><ul><li><a href=/>Home</a></li><li><a href=/x>X</a></li></ul></div>"
    a = f"<body>{links}<h1>Head</h1><div><p>first of the page</p><p>and second</p></div><h2>More</h2></body>"
    b = "<body><div><p>an article of its own</p></div><h2>More</h2></body>"
    c = f"<body>{links}<div><p>third</p><h3>sub</h3><p>text here</p></div><h2>More</h2></body>"
    assert main_texts(a, b) == ["first of the page and second", "an article of its own"]
    assert main_texts(b, a) == ["an article of its own", "first of the page and second"]
    d = f"<body>{links}<h1>Head</h1><div><p>one</p><ul><li>in a list</li></ul></div><h2>More</h2></body>"
    assert main_texts(a, b, d)[1:] == ["an article of its own", "one in a list"]
    # A child without a place in the wrapper stays where what it stands in is main, save a menu.
    wrapper = wrappers.mark(wrappers.item(wrappers.parse(a)))
    assert wrappers.main_text(wrappers.parse(a.replace("<p>and second</p>", "<h3>new</h3><nav>menu</nav>loose")), wrapper) == "first of the page new loose"


def test_alignment_counts_most_against_brute_force():
    rng = np.random.default_rng(5)

    def brute(children, places, again, group):
        def go(i, last):
            if i == len(children):
                return 0
            most = go(i + 1, last)
            for j in range(len(places)):
                if (w := wrappers.likeness(children[i], places[j])) and (j > last or last >= 0 and again[j] and group[j] == group[last]):
                    most = max(most, w + go(i + 1, j))
            return most
        return go(0, -1)

    for _ in range(150):
        some = lambda n: [(str(k), frozenset(rng.integers(0, 3, 2).tolist()), None) for k in rng.integers(0, 3, n)]
        children, places = some(rng.integers(1, 7)), some(rng.integers(1, 6))
        group = np.cumsum(rng.integers(0, 2, len(places)))
        sizes = np.bincount(group)
        again = (sizes[group] > 1) | (rng.random(len(places)) < 0.3)
        found = wrappers.best(children, places, again, group)
        placed = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert all(j < k or again[k] and group[j] == group[k] for (_, j), (_, k) in zip(placed, placed[1:]))
        assert sum(wrappers.likeness(children[i], places[j]) for i, j in placed) == brute(children, places, again, group)


def test_long_pages_are_aligned_as_short_ones():
    def parts(n, tag):
        return [(f"head {tag}{i}", f"text {tag}{i} is longer than its head", f"point {tag}{i}", f"text {tag}{i} ends") for i in range(n)]

    def page(found):
        body = "".join(f"<h2>{h}</h2><p>{p}</p><ul><li>{u}</li></ul><p>{q}</p>" for h, p, u, q in found)
        return f"<body><div class=menu><a href=/>Home</a></div><div id=content>{body}</div><div class=footer>(c)</div></body>"

    for sizes in ((3, 2, 1), (130, 129, 1)):
        pages = [parts(n, tag) for n, tag in zip(sizes, "abc")]
        assert main_texts(*map(page, pages)) == [" ".join(" ".join(part) for part in found) for found in pages]


def test_long_texts_that_agree_on_all_pages_are_constant():
    legal = "This site keeps records of each visit as the law of the land asks of it, and says so on every one of its pages. " * 3

    def page(body):
        return f"<body><h1>Site</h1><section>{legal}</section><div>{body}</div><table><tr><td>2024</td></tr></table></body>"

    bodies = [f"<p>article {i} is short</p><p>and ends at {i}</p>" for i in range(4)]
    want = [f"article {i} is short and ends at {i}" for i in range(4)]
    assert main_texts(*map(page, bodies)) == want
    # A long text that one page alone has can't be told to be the same on all, and counts as part of the article.
    long = [" ".join([f"said at length by {i}"] * 6) for i in range(3)]
    bodies = [f"<{tag}>{text}</{tag}>" for tag, text in zip(("p", "blockquote", "pre"), long)]
    assert main_texts(*(page(b).replace("2024", f"202{i}") for i, b in enumerate(bodies))) == long
