"""Encoding, leaked items, shared spans."""

import random

import numpy as np
import pytest

from kinfold.llm import bpe, leaks, spans

TEXTS = [
    "", " ", "  \n\n x", "Hello world's it'll don't 123 4567 !!! \t\n", "a\u00a0b\u3000c  ", "naïve café 日本語 \U0001f600 <|endoftext|>", "x = {'a': 1}\r\n\r\n  return\r\n",
    "a" * 3000, "ab" * 2000 + " " * 700 + "\n", "\x00\x1c\x1d a\x1fb", "const aVeryLongMinifiedName=function(){return!0};" * 40, "\u200bzero\u200d width\u0301", "\x1c x \x85 y",
]


@pytest.fixture(scope="module")
def ranks():
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return bpe.read_ranks(f.read())


def test_encoder_against_the_library(ranks):
    import public_tokenizers
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks)
    rnd = random.Random(3)
    pool = "abcdefgh  \n\t'ste123_=();é\u00a0\u2003中\u0301\r"
    for text in TEXTS + ["".join(rnd.choices(pool, k=rnd.randrange(60))) for _ in range(3000)]:
        assert own.encode(text) == known.encode_ordinary(text), text[:80]


def test_merge_of_one_long_word(ranks):
    import tiktoken

    rnd = random.Random(5)
    word = "".join(rnd.choices("abcdefghijklmnop", k=60_000))
    known = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert bpe.Encoder(ranks).merge(word.encode()) == known.encode_ordinary(word)


def test_rank_queue_pops_in_order():
    rnd, queue, want = random.Random(1), bpe.RankQueue(), {}
    for _ in range(2000):
        r, p = rnd.randrange(50_000), rnd.randrange(10**6)
        queue.push(r, p)
        want.setdefault(r, []).append(p)
    got = []
    while queue.top:
        got.append(queue.pop())
    assert got == [(r, sorted(p)) for r, p in sorted(want.items())]


def test_encode_column(spark, ranks):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, None])] + [(0, "", "clash")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect())
    own = bpe.Encoder(ranks)
    assert got == sorted([(i, own.encode(t)) for i, t in enumerate([*TEXTS, None])] + [(0, [])])
    assert bpe.encode_column(df.where("doc_id < 0"), "doc_id", "text").collect() == []


def test_fm_index_against_scanning():
    rng = np.random.default_rng(1)
    for sigma, n in ((3, 400), (40, 2000), (1, 300)):
        s = rng.integers(1, sigma + 1, n)
        s[rng.integers(0, n, n // 20)] = 0
        s[-1] = 0
        index = leaks.FMIndex(s, sigma)
        phrases = rng.integers(1, sigma + 1, (60, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (s[i : i + 3] == p).all()]


def test_suffixes_against_sorting():
    rng = np.random.default_rng(2)
    for sigma, n in ((1, 500), (2, 800), (1500, 3000)):
        s = rng.integers(1, sigma + 1, n)
        s[rng.integers(0, n, n // 60)] = 0
        s[100:150] = s[200:250]
        s[-1] = 0
        place = np.cumsum(s == 0)  # separators differ by place and come before all words
        key = [n if x else int(place[i]) - n for i, x in enumerate(s.tolist())]
        want = sorted(range(n), key=lambda i: [(x, 0) if x else (0, key[j]) for j, x in enumerate(s[i : i + 600].tolist(), i)])
        assert leaks.FMIndex._suffixes(s, sigma).tolist() == want


def item(seed, n=80):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))


def test_leaked_items(spark):
    rnd = random.Random(9)
    one, two = item(1), item(2)
    w = one.split()
    swapped = [("zzz" if i % 9 == 4 else x) for i, x in enumerate(w)]
    code = "\n".join(f"int {item(k, 3).replace(' ', '_')} = {k};" for k in range(40))
    docs = {
        1: code + "\n// " + one.upper().replace(" ", ",\n//   ") + code, 2: " ".join(swapped), 3: " ".join(w[:30]), 4: " ".join(w[:25]) + code + " ".join(w[25:50]), 5: code,
        6: " ".join(w[40:] + w[:40]), 7: one.replace(" ", "\\n").replace("a", "\\u0061"), 8: " ".join(rnd.sample(w, len(w))), 9: None, 10: "", 11: one + " " + two, 12: (one + "\n") * 200,
        13: " ".join(w[:45]), 14: one.replace(" ", " &quot; "),
    }
    rows = [(i, t, "clash", 0.5) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, share double")
    items = spark.createDataFrame([(1, one), (2, two), (3, None), (4, ""), (5, "a b")], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, items).collect()}
    # 6 holds both halves in the wrong order: one half follows the item's order, which is half of it; &quot; is layout
    assert got == {(i, 1) for i in (1, 2, 4, 6, 7, 11, 12, 13, 14)} | {(11, 2)}
    assert leaks.leaked_items(df, items.where("item_id > 9")).collect() == [] == leaks.leaked_items(df.where("doc_id < 0"), items).collect()


@pytest.mark.parametrize(("words", "every"), [(80, 5), (100, 4)])
def test_items_with_many_swapped_words(spark, words, every):
    one = item(5, 100)
    text = " ".join("zzz" if i % every == every - 2 else x for i, x in enumerate(one.split()[:words]))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = leaks.leaked_items(df, spark.createDataFrame([(1, one)], "item_id long, item_text string")).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 1)] and rows[0].share > 0.75


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "x Alpha, beta y"), (2, "alpha y beta"), (3, "solo"), (4, "alpha"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "Solo!"), (3, "alpha beta"), (4, "")], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id, r.share) for r in leaks.leaked_items(docs, items).collect()}
    assert got == {(1, 1, 1.0), (1, 3, 1.0), (3, 2, 1.0)}


def test_items_in_parts_and_documents_apart(spark):
    texts = [item(k, 20) for k in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    w = texts[0].split()
    docs = spark.createDataFrame([*enumerate(texts), (50, " ".join(w[:6])), (51, " ".join(w[6:12]))], "doc_id long, text string").coalesce(1)
    want = sorted((i, i, 1.0) for i in range(12))
    for chars in (300, 10**6):
        assert sorted(map(tuple, leaks.leaked_items(docs, items, max_item_chars=chars).collect())) == want


def test_swapped_words_of_most_of_an_item(spark):
    one = item(6, 80)
    text = " ".join("zzz" if i % 5 == 3 else x for i, x in enumerate(one.split()[:56]))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = leaks.leaked_items(df, spark.createDataFrame([(1, one)], "item_id long, item_text string")).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 1)] and rows[0].share >= 0.65


def brute_spans(rows, n):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for i, t in rows:
        shared = set()
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                shared |= set(range(k, k + n))
        for p in shared:
            if p - 1 not in shared:
                e = p
                while e in shared:
                    e += 1
                out.add((i, p, e))
    return out


@pytest.mark.parametrize(("limit", "hot", "seed"), [(1, 1, 1), (20_000, 10**6, 1), (20_000, 1, 2)])
def test_shared_spans_against_brute_force(spark, monkeypatch, limit, hot, seed):
    monkeypatch.setattr(spans, "BLOCK", 700)
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdef é\U0001f600", k=rnd.randrange(40, 160))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            b = rnd.choice(base)
            lo, hi = sorted(rnd.sample(range(len(b)), 2))
            parts += [b[lo:hi], "".join(rnd.choices("ghij", k=rnd.randrange(0, 9)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 150), (102, "-" * 500), (103, "y" + "-" * 90), (104, None), (105, ""), (106, base[0] * 2), (107, base[0] + base[1] + base[0] * 3)]
    rows += [(200 + k, base[2] + base[3]) for k in range(5)] + [(300, "q" * 2500 + base[4] + "r" * 100), (301, "s" + base[4] + "r" * 60)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, id string, first int").repartition(3)
    got = {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 40, limit, hot).collect()}
    assert got == brute_spans(rows, 40)


def test_equal_hashes_of_different_texts(monkeypatch):
    """With a hash that tells nothing apart, the texts decide."""
    levels = spans.Levels(40)
    rnd = random.Random(4)
    text = "".join(rnd.choices("abcd", k=70))
    ctx = [text, "xx" + text[2:-3] + "yyy", "".join(rnd.choices("efgh", k=70)), text[:-20] + "".join(rnd.choices("z", k=20))]
    args = (np.zeros(4, np.int64), np.arange(4), np.arange(4), np.full(4, levels.reach), ctx, levels)
    want = [x.tolist() for x in spans.double_sides(*args)]
    assert want[0][2] == -1 and want[0][0] >= 0
    monkeypatch.setattr(spans, "_mixed", lambda x: np.zeros_like(x))
    assert [x.tolist() for x in spans.double_sides(*args)] == want


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500), (None, "a" * 500)], "doc_id long, text string")
    assert spans.shared_spans(df, "doc_id", "text").collect() == []
    assert spans.shared_spans(df.limit(0), "doc_id", "text").collect() == []
