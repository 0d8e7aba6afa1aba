from pyspark.sql import functions as F

from scholion.functions import keys, text


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(f(F.col("v"))).collect()]


def test_section_keys(spark):
    assert column(spark, ["14b:5-8", "14a:11–14b:3", "19a:11", "7b", "x", ""], keys.folio_key) == [[14, 1, 5], [14, 0, 11], [19, 0, 11], [7, 1, 0], [0, 0, 0], [0, 0, 0]]
    assert column(spark, ["5:13–6:27", "1:1-24", "24", "a:b", ""], keys.verse_key) == [[5, 13], [1, 1], [0, 24], [0, 0], [0, 0]]
    assert column(spark, ["12 x 3", "none"], keys.digits_key) == [[12, 3], [0]]


def test_canonical_and_import_order(spark):
    given = ["BT_Shabbat_0_14b:5", "TN_Genesis_0_2:4-7", "BT_Shabbat_0_14a:11", "TN_Exodus_0_1:1", "XX_Odd_0_3", "TN_Genesis_0_1:1-3", "MS_Berakhot_0_1:2", "TN"]
    df = spark.createDataFrame([(k,) for k in given], "key string")
    assert [r.key for r in keys.order_canonical(df).collect()] == [
        "TN", "TN_Genesis_0_1:1-3", "TN_Genesis_0_2:4-7", "TN_Exodus_0_1:1", "MS_Berakhot_0_1:2", "BT_Shabbat_0_14a:11", "BT_Shabbat_0_14b:5", "XX_Odd_0_3",
    ]
    assert [r.key for r in keys.order_import(df).collect()][-1] == "BT_Shabbat_0_14b:5"
    cited = {r.key: r.citation_en for r in keys.with_citation(df).collect()}
    assert cited["BT_Shabbat_0_14b:5"] == "Shabbat (Moed) 14b:5" and cited["TN_Genesis_0_1:1-3"] == "Bereishit (Torah) 1:1-3" and cited["XX_Odd_0_3"] == "Odd 3"


def test_clean_english(spark):
    html = ['A<sup class="footnote-marker">a</sup> <i class="footnote">note</i> G<small>OD</small><br>café — x’s', "plain  text\n", None]
    assert column(spark, html, text.clean_english) == ["A GOD cafe - xs", "plain text", None]
    assert column(spark, ["x’s"], lambda c: text.clean_english(c, keep_quotes=True)) == ["x's"]


def test_clean_hebrew(spark):
    html = ['בְרא<b>ש</b>י־ת׃&nbsp;<span class="mam-spi-pe">{x}</span>א']
    assert column(spark, html, text.clean_hebrew) == ["בראשי ת: א"]
    assert column(spark, ["\t א  ב\n", "\u00a0א\tב "], text.clean_hebrew) == ["א ב", "א\tב"]


def test_title_case(spark):
    assert column(spark, ["poti-phera", "putiel's son", "DAN", "o'neil"], text.title_case) == ["Poti-Phera", "Putiel's Son", "Dan", "O'neil"]


def test_numbers(spark):
    given = ["7", "1,000", "3/4", "2 1/2", "4/2", "thirty seven", "Thirty-seven", "two hundred and five", "one half", "three quarters", "five thousand", "zero", "thiry seven", "fourty", "1/0", "many", "", None, "1/12", "0.5", "-007.2500", "+.125", "3.14159265", "two thirds", "five hundred thousand twelve", "hundred", "one thousand, two", "and", "four halfs fifths", "half third", "zero fifths"]
    want = ["7", "1000", "0.75", "2.5", "2", "37", "37", "205", "0.5", "0.75", "5000", "0", "40", "40", None, None, None, None, "0.083333", "0.5", "-7.25", "0.125", "3.14159265", "0.666667", "500012", "100", None, None, "0.4", None, "0"]
    df = spark.createDataFrame(list(enumerate(given)), "k int, v string")
    assert [r.number for r in text.normalize_numbers(df, "v").orderBy("k").collect()] == want


def test_units_and_contexts(spark):
    assert column(spark, ["Cubits", "cities", "cubes", "incense", "glass", "houses", " ", "s"], text.normalize_unit) == ["cubit", "citi", "cub", "incense", "glass", "house", None, "s"]
    assert column(spark, ["A b", "a b c d e f g", "", None], text.check_context) == ["a b", None, None, None]
