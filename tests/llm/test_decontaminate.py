import time

import numpy as np
import pytest

from ledgerline.llm import decontaminate as d

WORDS = [a + b for a in ("str", "pl", "qu", "m", "tr", "gl", "v") for b in ("ang", "ore", "ick", "ulp", "end", "ost", "arm")]


def passage(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def edit(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < rate / 3 else str(rng.choice(list("abc "))) if x < 2 * rate / 3 else c + "z" if x < rate else c)
    return "".join(out)


def levenshtein(window, text):
    """Edits of the best occurrence of window in text; both are arrays of code points."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(window.tolist(), 1):
        new = np.r_[i, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def held(item, text):
    """Whether text holds item, by slow alignment of every window."""
    codes, data = d.normalise(item), d.normalise(text or "")
    if not len(codes) or not len(data):
        return False
    met = set()
    for s in d.window_starts(len(codes)):
        w = codes[s : s + (d.LONG if len(codes) > d.WHOLE else d.WHOLE)]
        if levenshtein(w, data) <= d.budget(len(w)):
            met |= set(range(s, s + len(w)))
    return len(met) >= d.needed(len(codes))


def plain(codes):
    return "".join(map(chr, codes))


@pytest.fixture(scope="module")
def bench():
    rng = np.random.default_rng(0)
    return [(k, passage(rng, n)) for k, n in enumerate((20, 35, 60, 15, 90))]


def test_aligned():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(80):
        text = rng.integers(97, 101, 80).astype(np.uint32)
        window = text[20 : 20 + int(rng.integers(8, 40))].copy()
        for _ in range(int(rng.integers(0, 6))):
            k, how = int(rng.integers(len(window))), rng.integers(3)
            window = np.delete(window, k) if how == 0 else np.insert(window, k, 101) if how == 1 else np.r_[window[:k], 102, window[k + 1 :]].astype(np.uint32)
        rows.append((window, text))
    wide = max(len(w) for w, _ in rows)
    windows, texts = np.zeros((80, wide), np.uint32), np.full((80, wide + 250), 2**32 - 1, np.uint32)
    for k, (w, t) in enumerate(rows):
        windows[k, : len(w)], texts[k, 90:170] = w, t
    for (w, t), edits, start, end in zip(rows, *d.aligned(windows, np.array([len(w) for w, _ in rows]), texts, 200)):
        assert edits == levenshtein(w, t)
        assert levenshtein(w, t[max(0, start - 90) : max(0, end - 90)]) == edits


def test_all_items_within_budget_are_found(bench):
    """Complete against slow alignment of every item with every document."""
    rng = np.random.default_rng(2)
    docs = [passage(rng, 30) + " " + edit(rng, bench[k % 5][1], r) + " " + passage(rng, 40) for k, r in enumerate(np.linspace(0, 0.25, 60))]
    docs += [passage(rng, 10) + bench[4][1][a : a + n] + passage(rng, 9) for a, n in zip(range(0, 300, 11), range(60, 300, 9))]
    for text, got in zip(docs, d.Index(bench).search_texts(docs)):
        assert set(got) == {k for k, item in bench if held(item, text)}


def test_items_of_any_length_and_script(monkeypatch):
    rng = np.random.default_rng(12)
    letters = list("abcdefgh") + list("漢字仮名交文章例") + list("жщэюя")
    words = ["".join(rng.choice(letters, int(rng.integers(1, 6)))) for _ in range(40)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate([1, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 18, 25, 40, 60])] + [(90, " ?! "), (91, None), (92, "")]
    docs = []
    for k in range(150):
        item = items[k % 15][1]
        chars = list(item)
        for _ in range(int(rng.integers(0, 2 + len(chars) // 9))):
            chars[int(rng.integers(len(chars)))] = str(rng.choice(letters))
        docs.append(" ".join([*rng.choice(words, 3), "".join(chars), *rng.choice(words, 5)]))
    index = d.Index(items)
    want = [{k for k, item in items if held(item or "", text)} for text in docs]
    assert [set(f) for f in index.search_texts(docs)] == want
    monkeypatch.setattr(d, "FINDS", 50)  # in portions of slabs and of windows
    monkeypatch.setattr(d, "TOGETHER", 3)
    monkeypatch.setattr(d, "PART", 300)
    assert [set(f) for f in index.search_texts(docs)] == want


def test_short_items_are_whole_words():
    index = d.Index([(1, "forty-two"), (2, "Paris"), (3, "B"), (4, "中")])
    texts = ["He said FORTY two!", "forty twofold", "comparison", "in paris, b", "中", "中国"]
    assert [set(f) for f in index.search_texts(texts)] == [{1}, set(), set(), {2, 3}, {4}, set()]


def test_a_template_reports_no_long_item():
    """Items that share a quarter of their text with all others are reported only by documents that hold more of them."""
    rng = np.random.default_rng(13)
    template = passage(rng, 30)[:120]
    items = [(k, template + " " + passage(rng, 90)) for k in range(50)]
    index = d.Index(items)
    assert len(index.windows) < len(index.owner) and min(index.needed) > 122
    assert index.search_texts([passage(rng, 20) + " " + template + " " + passage(rng, 20), items[7][1]]) == [{}, {7: index.search_texts([items[7][1]])[0][7]}]


def test_degenerate_texts_take_bounded_time():
    """A run of one letter in many items against a text of that letter."""
    rng = np.random.default_rng(14)
    items = [(k, passage(rng, 12)[:60] + "a" * 100 + passage(rng, 12)[:60]) for k in range(100)]
    began = time.time()
    found = d.Index(items).search_texts(["a" * 2_000_000, "aab" * 200_000])
    assert time.time() - began < 60
    assert set(found[0]) == {k for k, t in items if held(t, "a" * 500)} and not found[1]


def test_clean_texts_stay_clean(bench):
    rng = np.random.default_rng(3)
    assert not any(d.Index(bench).search_texts([passage(rng, 400) for _ in range(50)]))


def test_spark(spark, bench):
    rng = np.random.default_rng(4)
    item = bench[1][1]
    long = passage(rng, 20_000) + " ; " + item + " " + passage(rng, 20_000)
    rows = [(1, "intro " + item + " outro"), (2, None), (3, ""), (4, passage(rng, 50)), (5, item.upper().replace(" ", "\n\t")), (5, item), (None, item), (7, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(bench + [(90, None), (91, "shrt"), (92, item)], "item_id bigint, text string")
    out = d.find_leaks(docs, items).collect()
    assert sorted({(r.doc_id, r.item_id) for r in out}, key=str) == sorted({(i, k) for i in (1, 5, None, 7) for k in (1, 92)}, key=str)
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id and t and (r.end <= len(t)))
        if r.doc_id in (1, 7):
            assert plain(d.normalise(text[r.start : r.end])) in plain(d.normalise(item)) and r.distance == 0
    kept = d.remove_contaminated(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4]
    assert d.find_leaks(docs.limit(0), items).count() == 0
    assert d.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, bench, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 100)
    docs = spark.createDataFrame([(k, t) for k, t in bench], "doc_id bigint, text string")
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()} == {(k, k) for k, _ in bench}
    assert d.remove_contaminated(docs, items).count() == 0


def test_parts_of_long_texts_overlap(bench, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(d, "PART", 500)
    item = bench[0][1]
    for at in range(0, 260, 7):
        text = passage(rng, 200)
        assert set(d.Index(bench).search_texts([text[:at] + " " + item + " " + text[at:]])[0]) == {0}


def test_query_on_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in d.op1_decontaminate(spark, small).collect()}
    exact = {(i, k) for i, t in docs for k, b in items if plain(d.normalise(b)) in plain(d.normalise(t or ""))}
    assert exact <= got and len(got) <= len(exact) + 3


@pytest.mark.parametrize("cut", [2, 3, 5, 8])
def test_a_truncated_item_is_found_where_it_lies(cut):
    """Its first bytes are missing and another text goes before: the hit is not the neighbour's, whatever the order."""
    rng = np.random.default_rng(6)
    items = [(k, passage(rng, 20)[:110]) for k in range(40)]
    index = d.Index(items)
    texts = []
    for _, text in items:
        texts += [passage(rng, 30), text[cut:] + " " + passage(rng, 12)]
    found = index.search_texts(texts)
    assert [set(f) for f in found] == [s for k in range(40) for s in (set(), {k})]
    assert found == [index.search_texts([t])[0] for t in texts]
    assert found[::-1] == index.search_texts(texts[::-1])
    ending = [t for _, text in items for t in (passage(rng, 12) + " " + text[:-cut], passage(rng, 30))]
    assert [set(f) for f in index.search_texts(ending)] == [s for k in range(40) for s in ({k}, set())]


def test_short_texts_side_by_side(bench):
    rng = np.random.default_rng(7)
    pieces = [bench[0][1][k : k + 12] for k in range(0, 120, 12)]
    assert not any(d.Index(bench).search_texts(pieces))
    texts = [edit(rng, bench[k % 5][1], 0.02)[: int(rng.integers(5, 200))] for k in range(80)]
    for text, got in zip(texts, d.Index(bench).search_texts(texts)):
        assert set(got) == {k for k, item in bench if held(item, text)}


def test_passages_of_a_long_item_are_found_at_every_offset():
    rng = np.random.default_rng(9)
    text = plain(d.normalise(passage(rng, 90)))[1:310]
    run = d.LONG + d.STEP - 1
    index = d.Index([(1, text)])
    cuts = [text[at : at + run] for at in range(len(text) - run + 1)]
    assert all(set(f) == {1} for f in index.search_texts(cuts))
    assert all(set(f) == {1} for f in index.search_texts([passage(rng, 20) + " " + c + " " + passage(rng, 20) for c in cuts]))
    spoilt = []
    for c in cuts:
        chars = list(c)
        for k in rng.choice(len(chars), d.budget(d.LONG), replace=False):
            chars[k] = "q" if chars[k] != "q" else "x"
        spoilt.append(passage(rng, 8) + " ; " + "".join(chars) + " ; " + passage(rng, 8))
    assert all(set(f) == {1} for f in index.search_texts(spoilt))


def test_spans_in_the_original_text():
    for text in ("  Straße,\t42 Äpfel!! und Öl ", "x", "«a»", "ﬁne ﬂow"):
        codes = d.normalise(text)
        whole = d.original_span(text, 0, len(codes))
        assert plain(d.normalise(text[slice(*whole)])) == plain(codes)
        for at in range(1, len(codes) - 1):
            a, z = d.original_span(text, at, at + 1)
            assert chr(codes[at]) in text[a:z].casefold() or codes[at] == 32
