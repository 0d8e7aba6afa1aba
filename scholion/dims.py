"""Enumerations, registries and word lists that results depend on.

Every table here is small and of a fixed size, so the DataFrames made from them may be
broadcast in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.

#: (prefix, name, display priority); types that are not listed come last.
SOURCE_TYPES = (
    ("TN", "Tanach", 0),
    ("MS", "Mishna", 1),
    ("BT", "Babylonian Talmud", 2),
    ("JT", "Jerusalem Talmud", 3),
    ("RM", "Rambam Mishne Torah", 3),
)
OTHER_PRIORITY = 3

TIME_PERIODS = ("Tanach", "Tanaim", "Amoraim", "No Time Period")
SYMBOL_TYPES = ("Clothing", "Holy Object", "Body Part", "Not Physical", "Part of Nature", "Weapon", "Other")
PLACE_TYPES = ("City", "Country or Region", "Building or Structure", "Body of Water", "Mountain", "Desert", "Not Physical", "Other")
ROLE_TYPES = ("Prophet", "King", "Judge", "Kohen", "Tanna", "Amora")
#: In display order.
NUMBER_CATEGORIES = ("Time", "People", "Measurement", "Sacrifice", "Money", "Misc")
#: (name, label).
PASSAGE_TYPES = (("LAW", "Law"), ("STORY", "Story"), ("PHILOSOPHIC", "Philosophic"), ("GENEALOGY", "Genealogy"), ("PROPHECY", "Prophecy"))
#: In the order in which a term's category is looked for.
ENTITY_TYPES = ("Person", "Place", "TribeOfIsrael", "Nation", "Symbol", "Number", "Animal", "Food", "Plant")
REL_TYPES = (
    "studiedFrom", "childOfFather", "childOfMother", "spouseOf", "descendantOf", "spokeWith", "disagreedWith",
    "prophesiedAbout", "bornIn", "diedIn", "prayedAt", "visited", "associatedWithPlace",
    "symbolAssociatedWithPlace", "personToTribeOfIsrael", "personBelongsToNation", "enemyOf", "allyOf",
    "placeToNation", "comparedTo", "contrastedWith", "AliasOf",
)
FAMILY_RELS = ("childOfFather", "childOfMother", "spouseOf")
SYMMETRIC_RELS = ("spouseOf", "spokeWith", "disagreedWith", "EnemyOf", "AllyOf", "AliasOf", "comparedTo", "contrastedWith")
SPECIFIC_PLACE_RELS = ("bornIn", "diedIn", "visited", "prayedAt")
#: (rel field, allowed type of term1, allowed type of term2); None is any type.
REL_CONSTRAINTS = (
    ("studiedFrom", "Person", "Person"),
    ("childOfFather", "Person", "Person"),
    ("childOfMother", "Person", "Person"),
    ("spouseOf", "Person", "Person"),
    ("descendantOf", "Person", "Person"),
    ("spokeWith", "Person", "Person"),
    ("spokeWith", "Animal", "Person"),
    ("spokeWith", "Person", "Animal"),
    ("spokeWith", "Animal", "Animal"),
    ("disagreedWith", "Person", "Person"),
    ("bornIn", "Person", "Place"),
    ("diedIn", "Person", "Place"),
    ("visited", "Person", "Place"),
    ("prayedAt", "Person", "Place"),
    ("associatedWithPlace", "Person", "Place"),
    ("personToTribeOfIsrael", "Person", "TribeOfIsrael"),
    ("personBelongsToNation", "Person", "Nation"),
    ("EnemyOf", "Nation", "Nation"),
    ("EnemyOf", "Person", "Person"),
    ("EnemyOf", "Person", "Nation"),
    ("AllyOf", "Nation", "Nation"),
    ("AllyOf", "Person", "Person"),
    ("AllyOf", "Person", "Nation"),
    ("placeToNation", "Place", "Nation"),
    ("prophesiedAbout", "Person", None),
    ("comparedTo", None, None),
    ("contrastedWith", None, None),
    ("AliasOf", None, None),
)
TRIBES = (
    "reuben", "simeon", "levi", "judah", "dan", "naphtali", "gad", "asher", "issachar", "zebulun",
    "joseph", "benjamin", "ephraim", "manasseh",
)
#: Fewest and most words of a summary.
SUMMARY_WORDS = (4, 10)

#: Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
NUMBER_SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000}
FRACTION_WORDS = {
    "half": 2, "third": 3, "quarter": 4, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8,
    "ninth": 9, "tenth": 10,
}
#: Spellings that are put right, the first by its value.
NUMBER_SPELLINGS = {"thiry seven": "40", "thiry": "thirty", "fourty": "forty"}

#: What is replaced in HTML, in this order.
ENGLISH_MARKUP = (
    ("יהוה", "HASHEM"),
    (r'<sup class="footnote-marker">[^<]*</sup>\s*<i class="footnote">.*?</i>', ""),
    ("</?small>", ""),
    ("<[^>]+>", " "),
)
ENGLISH_DASHES, ENGLISH_QUOTES = "—–", "‘’"
HEBREW_MARKUP = (
    (r'<span class="mam-spi-[^"]*">\{[^}]*\}</span>', ""),
    (r'<span class="mam-kq">.*?</span>', ""),
    ("</?(?:small|b)>", ""),
    ("<[^>]+>", " "),
    ("&nbsp;", " "),
    ("&thinsp;", ""),
    ("\u05be", " "),
    ("\u05c3", ":"),
    ("[\u0591-\u05c2\u05c4-\u05c7]", ""),
    (" +", " "),
)
#: White space in a character class.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: (source type, order, English name, Hebrew name, name in keys, category).
BOOKS = (
    ("TN", 1, "Bereishit", "בראשית", "Genesis", "Torah"),
    ("TN", 2, "Shemot", "שמות", "Exodus", "Torah"),
    ("TN", 3, "Vayikra", "ויקרא", "Leviticus", "Torah"),
    ("TN", 4, "Bamidbar", "במדבר", "Numbers", "Torah"),
    ("TN", 5, "Devarim", "דברים", "Deuteronomy", "Torah"),
    ("TN", 6, "Yehoshua", "יהושע", "Joshua", "Neviim"),
    ("TN", 7, "Shoftim", "שופטים", "Judges", "Neviim"),
    ("TN", 8, "Shmuel I", "שמואל א", "I Samuel", "Neviim"),
    ("TN", 9, "Shmuel II", "שמואל ב", "II Samuel", "Neviim"),
    ("TN", 10, "Melakhim I", "מלכים א", "I Kings", "Neviim"),
    ("TN", 11, "Melakhim II", "מלכים ב", "II Kings", "Neviim"),
    ("TN", 12, "Yeshayahu", "ישעיהו", "Isaiah", "Neviim"),
    ("TN", 13, "Yirmiyahu", "ירמיהו", "Jeremiah", "Neviim"),
    ("TN", 14, "Yehezkel", "יחזקאל", "Ezekiel", "Neviim"),
    ("TN", 15, "Hoshea", "הושע", "Hosea", "Neviim"),
    ("TN", 16, "Yoel", "יואל", "Joel", "Neviim"),
    ("TN", 17, "Amos", "עמוס", "Amos", "Neviim"),
    ("TN", 18, "Ovadyah", "עובדיה", "Obadiah", "Neviim"),
    ("TN", 19, "Yonah", "יונה", "Jonah", "Neviim"),
    ("TN", 20, "Mikah", "מיכה", "Micah", "Neviim"),
    ("TN", 21, "Nachum", "נחום", "Nahum", "Neviim"),
    ("TN", 22, "Chavakuk", "חבקוק", "Habakkuk", "Neviim"),
    ("TN", 23, "Tzefanyah", "צפניה", "Zephaniah", "Neviim"),
    ("TN", 24, "Chaggai", "חגי", "Haggai", "Neviim"),
    ("TN", 25, "Zekharyah", "זכריה", "Zechariah", "Neviim"),
    ("TN", 26, "Malakhi", "מלאכי", "Malachi", "Neviim"),
    ("TN", 27, "Tehillim", "תהילים", "Psalms", "Ketuvim"),
    ("TN", 28, "Mishlei", "משלי", "Proverbs", "Ketuvim"),
    ("TN", 29, "Iyov", "איוב", "Job", "Ketuvim"),
    ("TN", 30, "Shir HaShirim", "שיר השירים", "Song of Songs", "Ketuvim"),
    ("TN", 31, "Rut", "רות", "Ruth", "Ketuvim"),
    ("TN", 32, "Eikhah", "איכה", "Lamentations", "Ketuvim"),
    ("TN", 33, "Kohelet", "קהלת", "Ecclesiastes", "Ketuvim"),
    ("TN", 34, "Esther", "אסתר", "Esther", "Ketuvim"),
    ("TN", 35, "Daniel", "דניאל", "Daniel", "Ketuvim"),
    ("TN", 36, "Ezra", "עזרא", "Ezra", "Ketuvim"),
    ("TN", 37, "Nehemiah", "נחמיה", "Nehemiah", "Ketuvim"),
    ("TN", 38, "Divrei HaYamim I", "דברי הימים א", "I Chronicles", "Ketuvim"),
    ("TN", 39, "Divrei HaYamim II", "דברי הימים ב", "II Chronicles", "Ketuvim"),
    ("BT", 1, "Berakhot", "ברכות", "Berakhot", "Zeraim"),
    ("BT", 2, "Shabbat", "שבת", "Shabbat", "Moed"),
    ("BT", 3, "Eruvin", "עירובין", "Eruvin", "Moed"),
    ("BT", 4, "Pesachim", "פסחים", "Pesachim", "Moed"),
    ("BT", 5, "Shekalim", "שקלים", "Shekalim", "Moed"),
    ("BT", 6, "Yoma", "יומא", "Yoma", "Moed"),
    ("BT", 7, "Sukkah", "סוכה", "Sukkah", "Moed"),
    ("BT", 8, "Beitzah", "ביצה", "Beitzah", "Moed"),
    ("BT", 9, "Rosh Hashanah", "ראש השנה", "Rosh Hashanah", "Moed"),
    ("BT", 10, "Taanit", "תענית", "Taanit", "Moed"),
    ("BT", 11, "Megillah", "מגילה", "Megillah", "Moed"),
    ("BT", 12, "Moed Katan", "מועד קטן", "Moed Katan", "Moed"),
    ("BT", 13, "Chagigah", "חגיגה", "Chagigah", "Moed"),
    ("BT", 14, "Yevamot", "יבמות", "Yevamot", "Nashim"),
    ("BT", 15, "Ketubot", "כתובות", "Ketubot", "Nashim"),
    ("BT", 16, "Nedarim", "נדרים", "Nedarim", "Nashim"),
    ("BT", 17, "Nazir", "נזיר", "Nazir", "Nashim"),
    ("BT", 18, "Sotah", "סוטה", "Sotah", "Nashim"),
    ("BT", 19, "Gittin", "גיטין", "Gittin", "Nashim"),
    ("BT", 20, "Kiddushin", "קידושין", "Kiddushin", "Nashim"),
    ("BT", 21, "Bava Kamma", "בבא קמא", "Bava Kamma", "Nezikin"),
    ("BT", 22, "Bava Metzia", "בבא מציעא", "Bava Metzia", "Nezikin"),
    ("BT", 23, "Bava Batra", "בבא בתרא", "Bava Batra", "Nezikin"),
    ("BT", 24, "Sanhedrin", "סנהדרין", "Sanhedrin", "Nezikin"),
    ("BT", 25, "Makkot", "מכות", "Makkot", "Nezikin"),
    ("BT", 26, "Shevuot", "שבועות", "Shevuot", "Nezikin"),
    ("BT", 27, "Avodah Zarah", "עבודה זרה", "Avodah Zarah", "Nezikin"),
    ("BT", 28, "Horayot", "הוריות", "Horayot", "Nezikin"),
    ("BT", 29, "Zevachim", "זבחים", "Zevachim", "Kodashim"),
    ("BT", 30, "Menachot", "מנחות", "Menachot", "Kodashim"),
    ("BT", 31, "Chullin", "חולין", "Chullin", "Kodashim"),
    ("BT", 32, "Bekhorot", "בכורות", "Bekhorot", "Kodashim"),
    ("BT", 33, "Arakhin", "ערכין", "Arakhin", "Kodashim"),
    ("BT", 34, "Temurah", "תמורה", "Temurah", "Kodashim"),
    ("BT", 35, "Keritot", "כריתות", "Keritot", "Kodashim"),
    ("BT", 36, "Meilah", "מעילה", "Meilah", "Kodashim"),
    ("BT", 37, "Kinnim", "קנים", "Kinnim", "Kodashim"),
    ("BT", 38, "Tamid", "תמיד", "Tamid", "Kodashim"),
    ("BT", 39, "Middot", "מידות", "Middot", "Kodashim"),
    ("BT", 40, "Niddah", "נדה", "Niddah", "Tahorot"),
)

#: Demonym to nation name.
DEMONYMS = (
    ("aramean", "Aram"),
    ("arameans", "Aram"),
    ("syrian", "Syria"),
    ("syrians", "Syria"),
    ("egyptian", "Egypt"),
    ("egyptians", "Egypt"),
    ("moabite", "Moab"),
    ("moabites", "Moab"),
    ("ammonite", "Ammon"),
    ("ammonites", "Ammon"),
    ("edomite", "Edom"),
    ("edomites", "Edom"),
    ("philistine", "Philistia"),
    ("philistines", "Philistia"),
    ("assyrian", "Assyria"),
    ("assyrians", "Assyria"),
    ("babylonian", "Babylon"),
    ("babylonians", "Babylon"),
    ("chaldean", "Chaldea"),
    ("chaldeans", "Chaldea"),
    ("persian", "Persia"),
    ("persians", "Persia"),
    ("median", "Media"),
    ("medians", "Media"),
    ("mede", "Media"),
    ("medes", "Media"),
    ("greek", "Greece"),
    ("greeks", "Greece"),
    ("canaanite", "Canaan"),
    ("canaanites", "Canaan"),
    ("hittite", "Hittites"),
    ("hittites", "Hittites"),
    ("amalekite", "Amalek"),
    ("amalekites", "Amalek"),
    ("midianite", "Midian"),
    ("midianites", "Midian"),
    ("ishmaelite", "Ishmael"),
    ("ishmaelites", "Ishmael"),
    ("kenite", "Kenites"),
    ("kenites", "Kenites"),
    ("jebusite", "Jebusites"),
    ("jebusites", "Jebusites"),
    ("girgashite", "Girgashites"),
    ("girgashites", "Girgashites"),
    ("hivite", "Hivites"),
    ("hivites", "Hivites"),
    ("perizzite", "Perizzites"),
    ("perizzites", "Perizzites"),
)

#: Words that are no person or nation by themselves.
GENERIC_PERSONS = (
    "king", "priest", "prophet", "leader", "man", "woman", "child", "servant", "warrior", "elder", "judge",
    "scribe", "soldier", "messenger", "person", "people", "men", "women", "children", "elders", "my people",
    "his people", "your people", "their people", "my servants", "his servants", "he who", "she who",
    "they who", "those who", "one who", "whoever", "anyone", "someone",
)

GENERIC_NATIONS = (
    "nation", "nations", "people", "peoples", "enemy", "enemies", "army", "armies", "kingdom", "kingdoms",
    "tribe", "tribes",
)

#: (entity type, rel type, side of the entity, profile field).
PROFILE_FIELDS = (
    ("Person", "studiedFrom", 1, "studiedFrom"),
    ("Person", "childOfFather", 1, "childOfFather"),
    ("Person", "childOfMother", 1, "childOfMother"),
    ("Person", "spouseOf", 1, "spouseOf"),
    ("Person", "spouseOf", 2, "spouseOf"),
    ("Person", "descendantOf", 1, "descendantOf"),
    ("Person", "allyOf", 1, "allyOf"),
    ("Person", "allyOf", 2, "allyOf"),
    ("Person", "enemyOf", 1, "enemyOf"),
    ("Person", "enemyOf", 2, "enemyOf"),
    ("Person", "spokeWith", 1, "spokeWith"),
    ("Person", "spokeWith", 2, "spokeWith"),
    ("Person", "disagreedWith", 1, "disagreedWith"),
    ("Person", "disagreedWith", 2, "disagreedWith"),
    ("Person", "childOfFather", 2, "children"),
    ("Person", "childOfMother", 2, "children"),
    ("Person", "bornIn", 1, "bornIn"),
    ("Person", "diedIn", 1, "diedIn"),
    ("Person", "visited", 1, "visited"),
    ("Person", "prayedAt", 1, "prayedAt"),
    ("Person", "associatedWithPlace", 1, "associatedWithPlace"),
    ("Person", "personToTribeOfIsrael", 1, "tribeOfIsrael"),
    ("Person", "personBelongsToNation", 1, "belongsToNation"),
    ("Person", "prophesiedAbout", 1, "prophesiedAbout"),
    ("Person", "comparedTo", 1, "comparedTo"),
    ("Person", "comparedTo", 2, "comparedTo"),
    ("Person", "contrastedWith", 1, "contrastedWith"),
    ("Person", "contrastedWith", 2, "contrastedWith"),
    ("Place", "diedIn", 2, "personsDiedIn"),
    ("Place", "bornIn", 2, "personsBornIn"),
    ("Place", "visited", 2, "personsVisited"),
    ("Place", "prayedAt", 2, "personsPrayedAt"),
    ("Place", "associatedWithPlace", 2, "personsAssociated"),
    ("Place", "symbolAssociatedWithPlace", 2, "symbolsAssociated"),
    ("Place", "placeToNation", 1, "inNation"),
    ("Place", "comparedTo", 1, "comparedTo"),
    ("Place", "comparedTo", 2, "comparedTo"),
    ("Place", "contrastedWith", 1, "contrastedWith"),
    ("Place", "contrastedWith", 2, "contrastedWith"),
    ("Nation", "personBelongsToNation", 2, "personsBelongTo"),
    ("Nation", "placeToNation", 2, "placesIn"),
    ("Nation", "enemyOf", 1, "enemyOf"),
    ("Nation", "enemyOf", 2, "enemyOf"),
    ("Nation", "allyOf", 1, "allyOf"),
    ("Nation", "allyOf", 2, "allyOf"),
    ("Nation", "comparedTo", 1, "comparedTo"),
    ("Nation", "comparedTo", 2, "comparedTo"),
    ("Nation", "contrastedWith", 1, "contrastedWith"),
    ("Nation", "contrastedWith", 2, "contrastedWith"),
    ("Symbol", "symbolAssociatedWithPlace", 1, "associatedWithPlace"),
    ("Symbol", "comparedTo", 1, "comparedTo"),
    ("Symbol", "comparedTo", 2, "comparedTo"),
    ("Symbol", "contrastedWith", 1, "contrastedWith"),
    ("Symbol", "contrastedWith", 2, "contrastedWith"),
    ("TribeOfIsrael", "personToTribeOfIsrael", 2, "membersOfTribeIsrael"),
    ("TribeOfIsrael", "comparedTo", 1, "comparedTo"),
    ("TribeOfIsrael", "comparedTo", 2, "comparedTo"),
    ("TribeOfIsrael", "contrastedWith", 1, "contrastedWith"),
    ("TribeOfIsrael", "contrastedWith", 2, "contrastedWith"),
)


def books(spark: SparkSession) -> DataFrame:
    """dim_books: the registry, 79 rows."""
    return spark.createDataFrame(list(BOOKS), "src_type string, book_order int, en_name string, heb_name string, db_name string, category string")


def rel_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, r) for k, r in enumerate(REL_TYPES)], "ordinal int, rel_type string")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(ENTITY_TYPES)], "ordinal int, entity_type string")


def number_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(NUMBER_CATEGORIES)], "ordinal int, category string")


def passage_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PASSAGE_TYPES), "name string, label string")


def rel_constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REL_CONSTRAINTS), "rel_field string, type1 string, type2 string")


def demonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEMONYMS), "demonym string, nation string")


def generic_words(spark: SparkSession) -> DataFrame:
    rows = [("Person", w) for w in GENERIC_PERSONS] + [("Nation", w) for w in GENERIC_NATIONS]
    return spark.createDataFrame(rows, "category string, word string")


def profile_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILE_FIELDS), "entity_type string, rel_type string, side int, field string")
