"""Text columns: cleaning (D1-D7) and normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion import dims
from scholion.functions.shared import let
from scholion.functions.workers import ship


@F.pandas_udf(T.StringType())
def nfkd(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition; Spark has no built-in form."""
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def _substituted(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def clean_english(html: Column, keep_quotes: bool = False) -> Column:
    """Plain ASCII text of English HTML.

    Curly quotes vanish with the other non-ASCII characters unless ``keep_quotes``; ASCII
    texts do not go through Python.
    """
    ship(SparkSession.active())
    dashes, quotes = dims.ENGLISH_DASHES, dims.ENGLISH_QUOTES
    t = F.translate(_substituted(html, dims.ENGLISH_MARKUP), dashes + (quotes if keep_quotes else ""), "-" * len(dashes) + ("'" * len(quotes) if keep_quotes else ""))
    t = F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.regexp_replace(nfkd(t), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_hebrew(html: Column) -> Column:
    """Plain text of Hebrew HTML without points; spaces are collapsed, other white space
    goes at both ends only."""
    return F.regexp_replace(_substituted(html, dims.HEBREW_MARKUP), rf"^[{dims.WHITE}]+|[{dims.WHITE}]+$", "")


def tag_inventory(df: DataFrame, html: str) -> DataFrame:
    """D3: (tag, n): HTML tag names in lower case with their counts."""
    tags = F.explode(F.regexp_extract_all(F.col(html), F.lit("</?([a-zA-Z0-9]+)"), F.lit(1)))
    return df.select(tags.alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


#: Named references of HTML that terms have.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&thinsp;": "\u2009", "&amp;": "&"}


def decode_references(value: Column) -> Column:
    """Text with its numeric and most common named character references written out."""
    pieces = F.regexp_extract_all(value, F.lit(r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z]+;|[^&]+|&"), F.lit(0))

    def written(p: Column) -> Column:
        inner = lambda start: F.substr(p, F.lit(start), F.char_length(p) - start)
        number = F.when(F.rlike(p, F.lit("^&#[xX]")), F.conv(inner(4), 16, 10)).when(F.startswith(p, F.lit("&#")), inner(3)).cast("long")
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        named = F.try_element_at(F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair]), p)
        return F.when(number.between(1, 0x10FFFF), letter).otherwise(F.coalesce(named, p))

    return F.array_join(F.transform(pieces, written), "")


def italics(html: Column) -> Column:
    """The whole inner text of every <i>, tags taken out, inner ones before those around them.

    A fold over tags and what stands between: an <i> opens a text, all open texts grow, a </i>
    closes the last one.  What is never closed goes to the end; a </i> too many closes nothing.
    """
    tokens = F.regexp_extract_all(html, F.lit("</?[a-zA-Z!?][^>]*>|[^<]+|<"), F.lit(0))
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        opens, closes = F.rlike(t, F.lit(r"(?i)^<i(\s[^>]*)?/?>$")), F.rlike(t, F.lit(r"(?i)^</i\s*>$"))
        tag = F.rlike(t, F.lit("^</?[a-zA-Z!?][^>]*>$"))
        held = F.size(acc["open"])
        open_ = F.when(opens, F.concat(acc["open"], F.array(F.lit("")))).when(closes, F.slice(acc["open"], F.lit(1), F.greatest(held - 1, F.lit(0)))).when(tag | (held == 0), acc["open"])
        return F.struct(
            open_.otherwise(F.transform(acc["open"], lambda s: F.concat(s, t))).alias("open"),
            F.when(closes & (held > 0), F.concat(acc["done"], F.slice(acc["open"], F.lit(-1), F.lit(1)))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(tokens, F.struct(none.alias("open"), none.alias("done")), step, lambda acc: F.concat(acc["done"], F.reverse(acc["open"])))


def italic_terms(df: DataFrame, html: str) -> DataFrame:
    """(term): distinct non-empty italicised terms, nested ones too, without tags and with
    character references written out."""
    edges = rf"^[{dims.WHITE}]+|[{dims.WHITE}]+$"
    terms = df.where(F.rlike(F.col(html), F.lit(r"(?i)<i[\s>/]"))).select(F.explode(F.array_distinct(italics(F.col(html)))).alias("raw"))
    return terms.select(F.regexp_replace(decode_references(F.col("raw")), edges, "").alias("term")).where("term <> ''").distinct()


def drop_third_content(passages: DataFrame, content: str = "content") -> DataFrame:
    """Remove the third element where there is one; ``changed`` marks such rows."""
    c = F.col(content)
    return passages.withColumn("changed", F.size(c) > 2).withColumn(
        content, F.when(F.size(c) > 2, F.concat(F.slice(c, 1, 2), F.slice(c, F.lit(4), F.greatest(F.size(c) - 3, F.lit(0))))).otherwise(c)
    )


def bilingual_passage(english: Column, hebrew: Column) -> Column:
    """One text from the cleaned texts of both languages."""
    return F.concat(F.lit("English:\n"), F.coalesce(english, F.lit("")), F.lit("\n\nHebrew:\n"), F.coalesce(hebrew, F.lit("")))


def update_field(df: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the predicate holds; ``changed`` marks such rows."""
    hit = F.coalesce(predicate, F.lit(False))
    out = df.withColumn("changed", hit)
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.col("changed"), value).otherwise(F.col(name)))
    return out


#: Texts that initcap writes alike: words of ASCII letters or of digits, one space apart.
PLAIN = "^(?:[A-Za-z]+(?:'[A-Za-z]+)*|[0-9]+)(?: (?:[A-Za-z]+(?:'[A-Za-z]+)*|[0-9]+))*$"


def title_case(name: Column) -> Column:
    """capital after every non-letter but an apostrophe between letters."""
    plain = F.trim(name)
    pieces = F.regexp_extract_all(plain, F.lit(r"(?:\p{L}(?:\p{L}|'(?=\p{L}))*|[^\p{L}]+)"), F.lit(0))
    cased = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")
    return F.when(F.rlike(plain, F.lit(PLAIN)), F.initcap(plain)).otherwise(cased)


def _lookup(word: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def spelt_number(text: Column) -> Column:
    """The value of a number in lower-case words, as a double; null where it is none.

    Fraction words at the end divide what stands before them (1 if nothing does), as long as
    that is whole.  Of the other words, each unit adds to the open part, a hundred multiplies
    it, and a greater scale multiplies it and closes it.
    """
    for wrong, right in dims.NUMBER_SPELLINGS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    singular = lambda w: F.when(F.endswith(w, F.lit("s")), F.substring(w, F.lit(1), F.char_length(w) - 1))
    share = lambda w: F.coalesce(_lookup(w, dims.FRACTION_WORDS), _lookup(singular(w), dims.FRACTION_WORDS))

    def add(acc: Column, w: Column) -> Column:
        unit, scale = _lookup(w, dims.NUMBER_WORDS), _lookup(w, dims.NUMBER_SCALES)
        grown = F.greatest(acc["open"], F.lit(1)) * scale
        closes = scale > 100
        return F.struct(
            (acc["closed"] + F.when(closes, grown).otherwise(0)).cast("long").alias("closed"),
            # an unknown word makes the open part null for good
            F.when(acc["open"].isNotNull(), F.coalesce(acc["open"] + unit, F.when(closes, 0).otherwise(grown))).cast("long").alias("open"),
        )

    start = F.struct(F.lit(0).cast("long").alias("closed"), F.lit(0).cast("long").alias("open"))

    def value(words: Column, shares: Column, n_plain: Column) -> Column:
        plain, n_shares = F.slice(words, F.lit(1), n_plain), F.size(words) - n_plain
        total = F.aggregate(plain, start, add, lambda acc: acc["closed"] + acc["open"])
        base = F.when(n_plain == 0, F.when(n_shares > 0, F.lit(1).cast("long"))).otherwise(let(total, lambda t: F.when((t > 0) | (plain == F.array(F.lit("zero"))), t)))
        return F.aggregate(F.slice(shares, n_plain + 1, n_shares), base.cast("double"), lambda v, d: F.when(v == F.floor(v), v / d))

    words = F.filter(F.split(text, r"[\s-]+"), lambda w: ~w.isin("", "and"))
    n_plain = lambda shares: F.coalesce(F.array_max(F.transform(shares, lambda d, i: F.when(d.isNull(), i + 1))), F.lit(0))
    return let(words, lambda ws: let(F.transform(ws, share), lambda shares: let(n_plain(shares), lambda n: value(ws, shares, n))))


def number_text(value: Column) -> Column:
    """the canonical decimal text of a number, null where it is none.

    Decimals keep their digits; fractions are rounded to six.  Expressions only, so there is
    no join and no Python.
    """
    whole = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string"))
    written = lambda v: F.when(v.isNotNull(), F.coalesce(whole(v), F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")))
    rounded = lambda value: let(value, written)
    number = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
    frac, mixed = r"^(-?\d+)\s*/\s*(\d+)$", r"^(-?\d+)\s+(\d+)\s*/\s*(\d+)$"

    def of(fixed: Column, cleaned: Column, plain: Column) -> Column:
        # the digits as they stand, without a plus, zeros in front and zeros behind
        body = F.regexp_replace(F.regexp_replace(cleaned, r"^[+-]?0*", ""), r"(\.\d*?)0+$", "$1")
        digits = let(body, lambda b: F.concat(F.when(F.startswith(cleaned, F.lit("-")), "-").otherwise(""), F.when(F.startswith(b, F.lit(".")), "0").otherwise(""), b))
        decimal = F.coalesce(whole(plain), F.when(F.contains(cleaned, F.lit("e")), plain.cast("string")).otherwise(digits))
        group = lambda pattern, k: F.regexp_extract(cleaned, pattern, k).try_cast("double")
        slash = F.contains(cleaned, F.lit("/"))
        return (
            F.when(plain.isNotNull(), decimal)
            .when(slash & F.rlike(cleaned, F.lit(frac)), rounded(F.try_divide(group(frac, 1), group(frac, 2))))
            .when(slash & F.rlike(cleaned, F.lit(mixed)), rounded(group(mixed, 1) + F.try_divide(group(mixed, 2), group(mixed, 3))))
            .when(fixed != "", rounded(spelt_number(fixed)))
        )

    def fixed(raw: Column) -> Column:
        out = raw
        for wrong, right in dims.NUMBER_SPELLINGS.items():
            out = F.when(raw == wrong, F.lit(right)).otherwise(out)
        return out

    plain = lambda cleaned: F.when(F.rlike(cleaned, F.lit(number)), cleaned.try_cast("double"))
    # each step is worked out once
    return let(F.trim(F.lower(value)), lambda raw: let(fixed(raw), lambda f: let(F.translate(f, ",_", ""), lambda c: let(plain(c), lambda p: of(f, c, p)))))


def normalize_numbers(df: DataFrame, col: str, out: str = "number") -> DataFrame:
    """add the canonical text of a number column."""
    return df.withColumn(out, number_text(F.col(col)))


def match_fixed(value: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed value that equals the text, in any case; else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)]), F.lower(value))


def normalize_category(value: Column) -> Column:
    """a number category in any case, else Misc; null stays null."""
    return F.when(value.isNotNull(), F.coalesce(match_fixed(value, dims.NUMBER_CATEGORIES), F.lit("Misc")))


def normalize_unit(value: Column) -> Column:
    """lower case and a plain singular; null where nothing is left.

    Words of four letters or more that end in "ses" or "zes" lose one letter, in another "es"
    two; words of three or more that end in one "s" lose it.
    """

    def singular(v: Column) -> Column:
        cut = lambda n: F.substring(v, F.lit(1), F.char_length(v) - n)
        ends = lambda e: F.endswith(v, F.lit(e))
        plural = F.when(ends("es") & (F.char_length(v) > 3), F.when(ends("ses") | ends("zes"), cut(1)).otherwise(cut(2))).when(~ends("ss") & (F.char_length(v) > 2), cut(1)).otherwise(v)
        return F.when(v != "", F.when(ends("s"), plural).otherwise(v))

    return let(F.trim(F.lower(value)), singular)


def check_context(value: Column) -> Column:
    """F8: lower case where it has 1 to 6 words, else null."""
    return let(F.trim(F.lower(value)), lambda v: F.when((v != "") & (F.size(F.split(v, r"\s+")) <= 6), v))


def word_count(value: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(v.isNull() | (v == ""), 0).otherwise(F.size(F.split(v, " ")))
