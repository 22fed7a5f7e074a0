import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import html, text
from docketry.functions.grounding import find_quote
from docketry.functions.similarity import partial, partials, ratio, ratios, token_set, token_sets


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *inputs):
        row = spark.createDataFrame([tuple(inputs)], ", ".join(f"c{i} string" for i in range(len(inputs))))
        return row.select(make(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("v")).first()["v"]

    return of


CASES = [
    (text.tr_lower, "IŞIK İzmir", "ışık izmir"),
    (text.search_fold, "IŞIK ışık İBAN", "işik işik iban".replace("işik", "işik")),
    (text.clean_title, "–– (18.09.2026 - 11572) “Karar” ", "“Karar"),
    (text.title_key, "Bankaların Kâr Dağıtımı’na  İlişkin Tebliğ!", "bankaların kar dağıtımına ilişkin tebliğ"),
    (text.guess_type, "Bankalar Yönetmeliğinde Değişiklik Yapılmasına Dair Tebliğ", "Tebliğ"),
    (text.guess_type, "Kart Yönetmeliği", "Yönetmelik"),
    (text.guess_type, "5411 Sayılı Kanun", "Kanun"),
    (text.guess_type, "nothing here", None),
    (text.amended_title, "Kart Yönetmeliğinde Değişiklik Yapılmasına Dair Yönetmelik", "Kart Yönetmeliği"),
    (text.decision_no, "Kurulun 11/03/2021 Tarihli ve 2021/238 Sayılı Kararı", "2021/238"),
    (text.decision_no, "(18.09.2026 - 11572) Karar", "11572"),
    (text.sequence_no, "Vergi Usul Kanunu Genel Tebliği (Sıra No: 596)", "596"),
    (text.sequence_no, "596 SIRA NOLU TEBLİĞ", None),
    (text.sequence_no, "Tebliğ (II-27.3)", "II-27.3"),
    (text.match_issuer, "Gelir İdaresi Başkanlığı, Hazine ve Maliye Bakanlığı", "GIB"),
    (text.match_issuer, "Ticaret Bakanlığı duyurdu", "TICARET"),
    (text.issuer_line, "T.C.\nBankacılık Düzenleme ve Denetleme  Kurumundan:\nmetin", "Bankacılık Düzenleme ve Denetleme Kurumu"),
    (text.gazette_issue, "Resmî Gazete Sayı : 33380", "33380"),
    (text.gazette_no, "(19.09.2026 tarih ve 33375 sayılı Resmî Gazete’de yayımlanmıştır.)", "33375"),
    (text.gazette_date, "(19.09.2026 tarih ve 33375 sayılı Resmî Gazete’de yayımlanmıştır.)", dt.date(2026, 9, 19)),
    (text.parse_date, "2026-09-19T10:00", dt.date(2026, 9, 19)),
    (text.parse_date, "5 Ağustos 2026", dt.date(2026, 8, 5)),
    (text.parse_date, "31/02/2026", None),
    (text.parse_date, "Sat, 05 Sep 2026 10:00:00 +0300", dt.date(2026, 9, 5)),
    (text.parse_date, "none", None),
    (text.canonical_url, "http://WWW.Example.org/a/b//?q=1#x", "example.org/a/b?q=1"),
    (text.neutral_cell, "=1+1", "'=1+1"),
    (text.neutral_cell, "a=1", "a=1"),
    (text.text_quality, "abc", 1.0),
    (text.text_quality, "", 0.0),
    (text.answer_json, '<think>x {</think>```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'),
    (text.neutral_tags, "a <kaynak_metin> b </kaynak_metin>", "a [kaynak_metin] b [/kaynak_metin]"),
    (text.effective_sentence, "Giriş.\nMADDE 5 - (1) Bu Tebliğ 01.01.2027 tarihinde yürürlüğe girer.\nSon.", "Bu Tebliğ 01.01.2027 tarihinde yürürlüğe girer"),
    (text.clean_body, "<p>short</p>", "short"),
    (text.clean_title, "01.02.2026 MÜLGA - Kredi &amp; Kart &quot;A&quot; Teblig&#287;i", 'Kredi & Kart "A" Tebligği'),
    (text.is_draft, "Kart Yönetmeliği Taslağı", True),
    (text.is_draft, "Taslaklar", False),
    (text.iso_moment, "2026-01-02T03:04:05Z", dt.datetime(2026, 1, 2, 3, 4, 5)),
    (text.iso_moment, "2026-13-02T03:04:05Z", None),
    (lambda c: text.without_words(c, ["Devamı için", "tıklayınız"]), "Yeni karar DEVAMI  İÇİN tıklayınız TIKLAYINIZ tıklayınızlar", "Yeni karar tıklayınızlar"),
]


@pytest.mark.parametrize(
    ("title", "body", "issuer", "want"),
    [
        ("Özelge E-12345678-130-99 hakkında", "", "GIB", ("ruling", "e-12345678-130-99", None, False)),
        ("2026 / 12 sayılı SPK bülten", "", "SPK", ("bulletin", "2026/12", None, False)),
        ("77 sayılı Genel Mektup", "", "TAKASBANK", ("letter", "77", None, False)),
        ("Kurulun 11.03.2021 tarihli ve 2021/238 sayılı kararı", "", "BDDK", ("decision", "2021/238", dt.date(2021, 3, 11), False)),
        ("Karar Sayısı: 15", "Karar No: 16\nKarar Tarihi: 01.02.2026", "BDDK", ("decision", "15", None, True)),
        ("Karar Sayısı: 15", "Karar No: 15\nKarar Tarihi: 01.02.2026", "BDDK", ("decision", "15", dt.date(2026, 2, 1), False)),
        ("11.03.2021 tarihli ve 5411 sayılı Kanun", "", "BDDK", None),
        ("12 ve 13 sayılı kurul kararları", "", "BDDK", None),
        (None, None, "BDDK", None),
    ],
)
def test_references(value, title, body, issuer, want):
    got = value(text.reference_of, title, body, issuer)
    assert (got and (got["kind"], got["number"], got["day"], got["conflicting"])) == want


def test_other_dates(value):
    of = lambda c, d: text.other_dates(c, F.to_date(d))
    assert value(of, "01.02.2026 ile 3/4/2027 ve 31.02.2026", "2026-02-01") == [dt.date(2027, 4, 3)]
    assert value(of, "01.02.2026", "2026-02-01") is None and value(of, None, "2026-02-01") is None


def test_tidy():
    cases = {"yükümlü-\n  lerin \t x": "yükümlülerin x", "A-\nB": "A-\nB", "a\u00ad\u200bb\xa0c\x01": "ab c", "x\r\n\r\r\n\n y": "x\n\ny", " -\na": "-\na", "e\u0301": "é", "a-\nb-\nc": "abc"}
    assert {k: html.tidy(k) for k in cases} == cases



@pytest.mark.parametrize("case", range(len(CASES)))
def test_text_function(value, case):
    make, given, want = CASES[case]
    assert value(make, given) == want


@pytest.mark.parametrize(
    ("clause", "day", "basis"),
    [
        ("yayımı tarihinden itibaren altı ay sonra yürürlüğe girer", dt.date(2026, 7, 31), "relative"),
        ("yayımından 30 gün sonra", dt.date(2026, 3, 2), "relative"),
        ("yayımı tarihinde yürürlüğe girer", dt.date(2026, 1, 31), "on_publication"),
        ("1 Ocak 2027 tarihinde", dt.date(2027, 1, 1), "explicit"),
        ("bir şey demez", None, "none"),
    ],
)
def test_effective_dates(value, clause, day, basis):
    got = value(lambda c, p: text.effective_date(c, F.to_date(p)), clause, "2026-01-31")
    assert (got["value"], got["basis"]) == (day, basis)


def test_compatible_issuers(value):
    assert value(text.issuers_compatible, "MASAK", "HMB") and value(text.issuers_compatible, None, "SPK") and not value(text.issuers_compatible, "SPK", "TBB")


def test_ranges_and_stems(spark):
    row = spark.range(1).select(text.page_ranges(F.array(*[F.lit(x) for x in (7, 1, 2, 3, 3)])).alias("r"), text.stem_match("kredi kartı limiti", F.split(F.lit("yeni kredi kartı limitlerinin artışı"), " ")).alias("s"), text.stem_match("kartı kredi", F.split(F.lit("kredi kartı"), " ")).alias("n")).first()
    assert tuple(row) == ("1-3,7", True, False)


def test_ratios():
    assert ratio("abcd", "abxd") == 75.0 and ratio("", "") == 100.0 and ratio("a", "") == 0.0
    assert token_set("a b c", "c b a d") == 100.0 and token_set("", "a") == 0.0
    assert partial("needle", "hay needle hay") == (100.0, 4, 10) and partial("abc", "abc") == (100.0, 0, 3)
    # "eedle" and "needl" have four letters of five in order.
    assert partial("nedle", "hay needle hay")[0] == 80.0


def test_quotes():
    source = "Giriş. Bankalar, sermaye yeterliliği oranını  her ay sonunda Kuruma bildirir.\nSon hüküm budur."
    for quote, method in (
        ("sermaye yeterliliği oranını her ay", "exact"),
        ("Bankalar sermaye yeterliliği oranını her ay", "exact_words"),
        ("sermaye yeterliligi oranını her ay sonunda", "fuzzy"),
        ("Bankalar oranını sonunda Kuruma bildirir", "elided"),
        ("Bankalar, sermaye ... Son hüküm budur", "exact"),
    ):
        found = find_quote(quote, source)
        assert found and found[3] == method, quote
        assert source[found[0] : found[1]]
    assert find_quote("tamamen başka bir cümle burada", source) is None and find_quote("kısa", source) is None


def test_html(spark):
    page = '<html><nav>menu</nav><body class="x"><p>One<br>two</p><script>bad()</script><table><tr><td>a</td><td>b</td></tr></table><a href="/d.pdf#p" title="T"></a></body></html>'
    row = spark.createDataFrame([(page, "http://h.org/x/")], "p string, u string").select(html.html_text("p").alias("t"), html.page_links("p", "u").alias("l"), html.decoded(F.encode(F.lit("şey"), "UTF-8"), F.lit(None).cast("string")).alias("d")).first()
    assert row["t"] == "One\ntwo\n\na b" and [tuple(x) for x in row["l"]] == [("http://h.org/d.pdf", "T")] and row["d"] == "şey"


def test_exact_quotes_of_any_number_of_words(spark):
    from docketry.functions.grounding import exact_quotes

    text = "(Whereas the board met, and nothing followed; misunderstandings aside it adjourned at once."
    quotes = ["misunderstandings", "board met", "the board met", "nothing followed; misunderstandings aside", "Whereas the board met, and nothing", "absent from it", None]
    docs = spark.createDataFrame([(1, text), (2, "board"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = {(r["item_id"], r["doc_id"], r["start"]) for r in exact_quotes(items, docs).collect()}
    assert got == {(n, 1, text.index(q) + 1) for n, q in enumerate(quotes) if q and q in text}


def test_a_sentence_is_sought_once_and_only_where_its_verb_stands(spark):
    from conftest import DATA

    from docketry.plans.catalogue import QUERIES

    plan = QUERIES["effective_clauses"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    said = "MADDE 5 - (1) Bu Tebliğ yayımı tarihinde yürürlüğe girer."
    rows = spark.createDataFrame([(f"{'x ' * 400}\n{said}\nSon.",), ("Giriş. tarihinden itibaren uygulanır\n",), ("yok. " * 4000,), (None,)], "text string")
    got = rows.select(text.effective_clause("text", F.lit("2024-02-01").cast("date")).alias("c")).select("c.clause", F.col("c.value").cast("string"), "c.basis").collect()
    assert [tuple(r) for r in got] == [("Bu Tebliğ yayımı tarihinde yürürlüğe girer", "2024-02-01", "on_publication"), ("tarihinden itibaren uygulanır", None, "none"), (None, None, "none"), (None, None, "none")]


def test_many_pairs_are_measured_as_each_one_is():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randrange(n)))
    pairs = [(some(70), some(rng.choice([5, 40, 90, 300]))) for _ in range(600)] + [("\0a", "a\0"), ("", ""), ("😀x", "😀"), ("a" * 63, "a" * 255), ("a" * 64, "a" * 64)]
    assert ratios(pairs) == [float(ratio(*p)) for p in pairs]
    assert token_sets(pairs) == [token_set(*p) for p in pairs]
    assert partials(pairs) == [float(partial(*p)[0]) for p in pairs]
    assert partials([]) == []
