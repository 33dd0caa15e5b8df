"""Look-alike text, spellings, term counts."""

import itertools
import random
import unicodedata
from collections import Counter

import pytest

from kinfold.llm import lookalike, spellings, terms

SAME = [
    ("Vlad Kłagizesk", "Vlad Kłаgizes\ufe0fk"), ("stop", "ﬆop"), ("é", "e\u0301"), ("A B", "Ａ\u3000B "), ("x", "\u200ex"), ("ạ\u0307", "a\u0307\u0323"),
    ("soft", "so\u00adft"), ("a b", "\ta\u00a0 b"), ("è", "ѐ"), ("e\u0301", "e\u200b\u0301"), ("한", "한"),
]
DIFFERENT = [("Ann", "ann"), ("e", "é"), ("A.B", "A B"), ("ab", "a b"), ("x2", "x²"), ("Ann Lee", "Lee Ann"), ("l", "1"), ("Yıldız", "Yildiz"), ("α", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert lookalike.canonical(a) == lookalike.canonical(b) != ""


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    assert lookalike.canonical(a) != lookalike.canonical(b)


def test_segments_give_what_the_whole_gives():
    rnd = random.Random(4)
    pool = [chr(i) for i in range(0x20, 0x500)] + list("\u0301\u0327\u0323ﬁＡ\u200b\u00ad\u3000한\ufe0f  ")
    for _ in range(3000):
        text = "".join(rnd.choices(pool, k=rnd.randrange(12)))
        whole = " ".join(lookalike._normalised(text).split(" ")).strip(" ")
        while "  " in whole:
            whole = whole.replace("  ", " ")
        assert lookalike.canonical(text) == whole
        assert lookalike.canonical(whole) == whole
        assert unicodedata.is_normalized("NFC", whole)


def test_same_look_pairs(spark):
    values = ["Ann", "Аnn", "Ann ", "ann", None, "", " ", "\u200b", "Ann", "z" * 100_000, "z" * 100_000 + "\u00ad"]
    df = spark.createDataFrame([(v, "clash", "clash") for v in values], "n string, form string, value string")
    got = {tuple(r) for r in lookalike.same_look_pairs(df, "n").collect()}
    assert got == {("Ann", "Ann "), ("Ann", "Аnn"), ("Ann ", "Аnn"), ("z" * 100_000, "z" * 100_000 + "\u00ad")}
    assert lookalike.same_look_pairs(df.where("n = 'none'"), "n").collect() == []


def test_line_ends_after_plain_text(spark):
    values = ["Jane Doe"] + ["Jane Doe" + end for end in ("\n", "\r\n", "\r", "\u0085", "\u2028", "\u2029")]
    df = spark.createDataFrame([(v,) for v in values], "n string")
    assert {r.form for r in lookalike.canonical_values(df, "n").collect()} == {"Jane Doe"}
    assert lookalike.same_look_pairs(df, "n").count() == 21


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_enumerates_all_neighbours():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abc", k=rnd.randrange(1, 9))) for _ in range(150)]
    trie = spellings.Trie()
    for i, w in enumerate(words):
        trie.insert(w, i)
    for query in words[:40] + ["", "abcabcabc"]:
        for k in range(3):
            assert trie.within(query, k) == {i for i, w in enumerate(words) if distance(query, w) <= k}


def test_name_words():
    for form in ("Dr. Søren Nabopinkova", "Nabopinkova, Søren", "soren.nabopinkova", "Søren Nabopinkova (ext)", '"Søren Nabopinkova"', "Søren Nabopinkova, PhD", 'Søren "hammer" Nabopinkova', "Søren Nabopinkova via Harbor"):
        words = spellings.name_words(lookalike.canonical(form))
        assert sorted(words) == ["nabopinkova", "soren"], form
    assert spellings.name_words("The Plubenakamp Laboratories Team") == ("plubenakamp", "laboratories")
    assert spellings.name_words("(x)") == ("x",) and spellings.name_words("--") == ()
    assert spellings.addresses("mailto:A@x.com, <b@y.org> c at z.net") != [] and spellings.addresses(None) == [] == spellings.addresses("x")


def test_spellings(spark):
    rows = [
        ("Søren Nabopinkova", "nabopinkova.soren@a.example"), ("Soren Nabpoinkova", "nabopinkova.soren@b.example"), ("snabopinkova", "nabopinkova.soren@a.example"),
        ("Søren  Nabopinkova", "nabopinkova.soren@a.example"), ("Søren Nabopinkovy", "soren.nabopinkovy@a.example"),
        ("Maggie Ledavanen", "margaret14v@b.test"), ("Margaret Ledavanen", "MARGARET14V@b.test "), ("Ledavanen, Margaret", None), ("William Ledavanen", "w@b.test"),
        ("root", "root@x.y"), (None, "margaret14v@b.test"), (" ", "margaret14v@b.test"), ("Solo", ""), ("Q" * 20_000 + " R", "q@q.q"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + rows[:3]], "n string, e string, value string, entity int")
    nobody = spark.createDataFrame([("root",)], "entry string")
    got = {tuple(r) for r in spellings.spelling_pairs(df, "n", "e", nobody).collect()}
    a, b, c, a2 = (r[0] for r in rows[:4])
    m = [rows[5][0], rows[6][0], rows[7][0]]
    pairs = lambda xs: {tuple(sorted(p)) for p in itertools.combinations(xs, 2)}
    assert got == (pairs([a, b, c]) | pairs([a2, b, c]) | pairs(m))
    assert spellings.spelling_pairs(df.where("n = 'none'"), "n", "e", nobody).collect() == []


def test_shared_mailbox_is_no_evidence(spark):
    names = [f"Name{i:02d} Family" for i in range(14)]
    df = spark.createDataFrame([(n, "team@x.example") for n in names], "n string, e string")
    assert spellings.spelling_pairs(df, "n", "e").collect() == []


def test_common_mailbox_name_keeps_evidence(spark):
    first = lambda i: "bcdfghjklmnpqrst"[i] * 2 + "o" + "tsrqpnmlkjhgfdcb"[i] * 2
    rows = [(f"{first(i)} {first(15 - i)}ak", f"me@d{i}.example") for i in range(14)]  # nobody is like another
    rows += [("Maggie Ledavanen", "me@own.example"), ("Margaret Ledavanen", "me@own.example")]  # one address
    rows += [("Ulrike Wolatinez", "me@one.example"), ("Wolatimez, Ulrike", "me@other.example")]  # whole names
    rows += [("Kim Wolatinez", "me@third.example"), ("Ulrike Pram", "me@fourth.example")]  # a word alone is no evidence across domains
    rows += [(f"Hanko {c}. Vesterlund", None) for c in "abcdefghijklmn"]  # first and last word are the same
    team = [(f"Name{i:02d} Family", "dev-list@x.example") for i in range(14)]  # nor do the words of a shared mailbox tell anything
    df = spark.createDataFrame(rows + team, "n string, e string")
    got = {tuple(r) for r in spellings.spelling_pairs(df, "n", "e").collect()}
    want = {(rows[14][0], rows[15][0]), (rows[16][0], rows[17][0])} | set(itertools.combinations([n for n, _ in rows[20:]], 2))
    assert got == want


def test_what_is_no_evidence(spark):
    """A given name and a mailbox of that name make nobody of two people; a family name tells more at one address than across domains."""
    rows = [
        ("John Smith", "john@a.example"), ("John Doe", "john@b.example"), ("Mary Wolatinez", "wolatinez@a.example"), ("Paul Wolatinez", "wolatinez@b.example"),
        ("Ann Brukamel", "pair@a.example"), ("Ann Postevin", "pair@a.example"),
        ("Maggie Ledavanen", "ledavanen14v@a.example"), ("Margaret Ledavanen", "ledavanen14v@b.example"), ("M. Ledavanen", "ledavanen14v@c.example"),
        ("Grutik Software", "info@a.example"), ("Grutik SW", "info@b.example"),
    ]
    got = {tuple(r) for r in spellings.spelling_pairs(spark.createDataFrame(rows, "n string, e string"), "n", "e").collect()}
    same = [sorted(n for n, _ in rows[6:9]), sorted(n for n, _ in rows[9:])]
    assert got == {p for names in same for p in itertools.combinations(names, 2)}


def test_agreement_of_names():
    agree = lambda key, a, b: spellings.agree(key, *(spellings.name_words(x) for x in (a, b)))
    for a, b in (("Søren Nabopinkova", "nabopinkova soren"), ("S. Nabopinkova", "Soren Nabpoinkova"), ("snabopinkova", "Soren Nabopinkova"), ("Labs of Gruv", "Laboratories Gruv"), ("Ann Mary Lee", "Lee, Ann"), ("sorennabopinkova", "Soren B. Nabopinkova")):
        assert agree("m x", a, b), (a, b)
    for a, b in (("john smith", "john doe"), ("ann lee", "bob lee"), ("soren", "soren nabopinkova"), ("lee ann", "ann moore")):
        assert not agree("m x", a, b), (a, b)
    assert agree("a x@y", "ann ledavanen", "bob ledavanen") and not agree("m ledavanen", "ann ledavanen", "bob ledavanen")
    assert spellings.trie_links(["john smith", "john doe"], "m john") == [] == spellings.trie_links(["john smith", "john doe"], "a john@x.y")


def test_a_large_shard_is_linked_whole(spark):
    """500 spellings of one name at 500 addresses with one mailbox name, among as many names of other people."""
    rnd = random.Random(11)
    spelled = {"Ottokar Wilberforcedottir"}
    while len(spelled) < 500:
        w = list(rnd.choice(["ottokar wilberforcedottir", "wilberforcedottir ottokar"]))
        w[rnd.randrange(len(w))] = rnd.choice("abcdefghijklmnop")
        spelled.add("".join(w))
    others = ["".join(rnd.choices("bcdfgklmnprst", k=7)) + " " + "".join(rnd.choices("aeiouvwxz", k=9)) for _ in range(500)]
    df = spark.createDataFrame([(n, f"me@d{i}.example") for i, n in enumerate([*sorted(spelled), *others])], "n string, e string")
    got = spellings.spelling_entities(df, "n", "e").collect()
    kept = {r.value for r in got} & {s for s in spelled if len(s.split()) == 2 and all(len(x) > 2 for x in s.split())}
    whole = {s for s in spelled if len(s.split()) == 2}
    assert kept >= {s for s in whole if len(s.split()[0]) in (7, 17)} and len({r.entity for r in got if r.value in kept}) == 1
    assert not {r.value for r in got} & set(others)


STRANGERS = ["Bruno Kalmet", "Dagny Ostrel", "Fenja Piltov", "Gustav Rembik", "Hedda Solvan", "Ivo Trunek", "Jorun Valdem", "Kaspar Wendig", "Livia Xantor", "Milan Yorvet", "Nora Zelnik", "Oskar Brandov", "Petra Cimrak"]


def entities(spark, rows):
    got = {}
    for r in spellings.spelling_entities(spark.createDataFrame(rows, "n string, e string"), "n", "e").collect():
        got.setdefault(r.entity, set()).add(r.value)
    return sorted(map(sorted, got.values()))


def test_many_spellings_of_few_people_keep_evidence(spark):
    """More than 12 names of one person, or of two, at one address or under one mailbox name are no crowd."""
    spelled = [f"Ottokar Wilberforce{c}ottir" for c in "abcdefghijklmn"]
    short = ["Otto Wilberforcedottir", "owilberforcedottir"]
    at_home = [(n, "dd77@x.example") for n in [*spelled, *short, "Kim Pastrel"]]
    assert entities(spark, at_home) == [sorted(spelled + short)]
    spread = [(n, f"ottowilb77@d{i}.example") for i, n in enumerate([*spelled, *short, "Kim Pastrel"])]
    assert entities(spark, spread) == [sorted(spelled + short)]


def test_names_of_a_shared_mailbox_are_compared_whole(spark):
    team = "team@x.example"
    rows = [(n, team) for n in [*STRANGERS, "Robot1 Build", "Robot2 Build"]]
    rows += [("Ulrike Wolatinez", team), ("Wolatimez, Ulrike", team)]  # nobody knows either from elsewhere
    rows += [("Maren Wolatinez", team)]  # a family name alone tells nothing there
    rows += [("Lukas Noretinkova", team), ("Lukas Noretinkovy", team), ("Lukas Noretinkova", "ln1@a.example"), ("Lukas Noretinkovy", "ln2@b.example")]  # both known: namesakes
    rows += [("Lukas Noretinkovo", team)]  # either of them
    rows += [("Ingeborg Tasmerin", team), ("Ingeborg Tasmerim", team), ("Ingeborg Tasmerin", "it@a.example"), ("I. Tasmerin", "it@a.example")]
    rows += [("Thekla Dorvanes", team), ("Thekla Dorvames", "team@y.example")]  # the same mailbox name elsewhere
    want = [["I. Tasmerin", "Ingeborg Tasmerim", "Ingeborg Tasmerin"], ["Thekla Dorvames", "Thekla Dorvanes"], ["Ulrike Wolatinez", "Wolatimez, Ulrike"]]
    assert entities(spark, rows) == want
    assert entities(spark, rows + [(n, "team@y.example") for n in STRANGERS]) == want


def test_pieces_bring_near_forms_together():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("ab", k=rnd.randrange(1, 12))) for _ in range(400)]
    for a, b in itertools.combinations(sorted(set(words), key=len), 2):
        if distance(a, b) <= spellings.allowed_errors(len(b)):
            assert {p for p, looks in spellings.pieces(a) if not looks} & {p for p, looks in spellings.pieces(b) if looks}, (a, b)
            assert spellings.near_links([(a, "x")], [(b, "y")]) == [("y", "x")]


@pytest.mark.parametrize("burst", [2, 512])
def test_burst_trie_counts(burst):
    rnd = random.Random(burst)
    words = ["".join(rnd.choices("abé", k=rnd.randrange(0, 6))) for _ in range(2000)] + ["x" * 5000] * 3
    trie = terms.BurstTrie(burst)
    for w in words:
        trie.add(w, 2, 1)
    got = {}
    for prefix, leaf in trie.leaves():
        assert all(w.startswith(prefix) for w in leaf)
        assert not got.keys() & leaf.keys()
        got |= {w: tuple(s) for w, s in leaf.items()}
    assert got == {w: (2 * n, n) for w, n in Counter(words).items()}


@pytest.mark.parametrize(("flush", "route"), [(10, 3), (10**6, 20_000)])
def test_term_statistics(spark, monkeypatch, flush, route):
    monkeypatch.setattr(terms, "ROUTE_TERMS", route)
    rnd = random.Random(7)
    rows = [(" ".join("".join(rnd.choices("abc", k=rnd.randrange(1, 5))) for _ in range(rnd.randrange(4))), f"m{rnd.randrange(40)}") for _ in range(400)]
    rows += [(None, ""), ("", None), ("  a  a b\u00a0c ", "x y"), ("t" * 50_000, "z")] + [("hot hot", "hot")] * 300
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "n string, e string, term string, field string").repartition(4)
    got = {(r.field, r.term): (r.n_occurrences, r.n_records) for r in terms.term_statistics(df, {"n": terms.words, "e": terms.whole}, flush).collect()}
    occurrences, records = Counter(), Counter()
    for n, e in rows:
        own = [("n", t) for t in (n or "").split(" ") if t] + ([("e", e)] if e else [])
        occurrences.update(own)
        records.update(set(own))
    assert got == {k: (occurrences[k], records[k]) for k in occurrences}


def test_marks(spark):
    df = spark.createDataFrame([("c", None)] * 10 + [("r r", None)] * 2 + [("m", None)] * 3 + [("", None)] * 985, "n string, e string")
    got = {r.term: r.mark for r in terms.marked_terms(df, {"n": terms.words, "e": terms.whole}).collect()}
    assert got == {"c": "common", "r": "rare", "m": None}
    assert terms.marked_terms(df.limit(0), {"n": terms.words}).collect() == []
