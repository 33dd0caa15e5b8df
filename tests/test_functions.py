from datetime import datetime

import pytest
from pyspark.sql import DataFrame, functions as F

from kinfold.functions import clean as C, predicates as P
from kinfold.functions.lists import DEFAULTS, FilterLists, read_lists


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean(spark):
    cases = {
        "  Máximo \t Ω ": "maximo ω", "Dév  1": "dev 1", "a\u3000b\u00a0c": "a b c", "ΟΔΟΣ": "οδοσ", "e\u0301": "e", "Ångström": "angstrom",
        "": "", "   ": "", "İ": "i", "𝔘 x": "𝔘 x", "ﬁ": "ﬁ",
    }
    assert apply(spark, C.clean, [*cases, None]) == [*cases.values(), None]


def test_clean_of_a_very_long_text(spark):
    assert apply(spark, C.clean, ["É " * 100_000]) == [("e " * 100_000).strip()]


def test_accents_match_unicode(spark):
    import unicodedata

    sample = [chr(i) for i in range(0xC0, 0x2FF)] + ["각", "ệ", "ё", "й"]
    plain = [unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")) for s in sample]
    assert apply(spark, C.strip_accents, sample) == plain


def test_parens_capital_latin(spark):
    assert apply(spark, C.remove_parens, ["Bob (work)", "something (x) else (y)", "(only)", ""]) == ["Bob", "something else", "(only)", ""]
    assert apply(spark, C.is_capitalized, ["Ab", "ab", "", "Ж"]) == [True, False, False, True]
    assert apply(spark, C.has_latin_letters, ["жA", "жж", ""]) == [True, False, False]


def test_labels(spark):
    df = spark.createDataFrame([("", "bob", "", "h", None)], "repo string, name string, email string, hash string, ts timestamp")
    assert df.select(C.signature_label(*[F.col(c) for c in df.columns])).first()[0] == "[<no repo> bob <no email> h <no time>]"
    assert df.select(C.name_key(F.lit("a"), F.lit("r"))).first()[0] == "{a, r}"
    assert df.select(C.person_label(F.lit(""), F.array(F.lit("b"), F.lit("a")), F.array(F.lit("m")))).first()[0] == "<no external id>:a|b||m"
    assert df.select(C.unique_sorted(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0] == ["a", "b"]


MAILS = {
    "bob@google.com": False, "bob": True, "a@b@c.com": True, "bob@example.com": True, "bob@host": True, "bob@x.lan": True,
    "bob@192.168.0.1": True, "bob@ip172.16.0.1": True, "bob@fe80::1": True, "spam@mail.org": True, "": True, "@": True, "bob@a.b.co": False,
}


def test_ignored_emails(spark):
    lists = FilterLists.of({"emails": {"spam@mail.org"}, "domains": {"example.com"}, "top_level_domains": {"lan"}, "names": {"admin"}})
    assert apply(spark, lists.is_ignored_email, list(MAILS)) == list(MAILS.values())
    assert apply(spark, lists.is_ignored_name, ["Admin", "admin2", ""]) == [True, False, False]
    assert apply(spark, lists.is_popular_email, ["x"]) == [False]


@pytest.mark.parametrize(("domain", "is_ip"), [("blockchaindev34.172.16.0.1", True), ("1.2.3", False), ("2001:db8::1", True), ("1:2:3:4:5:6:7:8", True), ("::1", True), ("a.b", False), ("fe80:%eth0", True), ("fe80:eth0.x", False), ("1:2:3:4:5:6:7", False), ("1.2.3.4.org", False)])
def test_ip(spark, domain, is_ip):
    assert apply(spark, P.is_ip_domain, [domain]) == [is_ip]


def test_cutoff_runs_on():
    assert P.recent_cutoff(datetime(2020, 3, 31, 5), 1) == datetime(2020, 3, 2, 5)
    assert P.recent_cutoff(datetime(2020, 1, 15), 12) == datetime(2019, 1, 15)
    with pytest.raises(ValueError):
        P.recent_cutoff(datetime(2020, 1, 1), 0)


def test_lists_from_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "names.gz", "wt") as f:
        f.write("Rôot\nroot\n admin \n")
    df = read_lists(spark, {"names": str(tmp_path / "names.gz")})
    assert FilterLists.from_frame(df).names == {"root", "admin"}
    assert FilterLists.defaults().names == DEFAULTS["names"]


def test_lists_of_any_size(spark):
    lists = {"emails": {"spam@mail.org"}, "domains": {"example.com"}, "top_level_domains": {"lan"}, "names": {"admin"}, "popular_names": {"bob"}}
    df = spark.createDataFrame([(k, e) for k, v in lists.items() for e in v] + [("names", None), ("other", "x")], "list_name string, entry string")
    large = FilterLists.from_frame(df, inline=0)
    assert isinstance(large.names, DataFrame) and large.popular_emails == frozenset()
    assert apply(spark, large.is_ignored_email, list(MAILS)) == list(MAILS.values())
    assert apply(spark, large.is_ignored_name, ["Admin", "admin2", "", None]) == [True, False, False, False]
    assert apply(spark, lambda c: ~large.is_popular_name(c), ["bob", "al", None]) == [False, True, True]
    values = spark.createDataFrame([("admin",), ("al",), (None,)], "v string")
    kept = values.where(~large.is_ignored_name(F.col("v")))
    assert [r[0] for r in kept.collect()] == ["al", None]
    assert "BroadcastNestedLoopJoin" not in kept._jdf.queryExecution().executedPlan().toString()
