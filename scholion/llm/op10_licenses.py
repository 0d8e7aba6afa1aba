r"""License scans by ordered signature rules.

``RULES`` holds some hundreds of regexes: each hand-written licence name below, long and short,
in each hand-written form (named alone, granted in a sentence, as an SPDX tag), the Creative
Commons names made of parts and versions, addresses of licence pages, and sentences of the
licences' own texts.  A rule runs only on a text that has its keywords, each a word that all its
matches contain, and no rule runs on a text without all keywords of some rule.  Every match is
an interval; an interval is suppressed by an overlapping one of higher priority, and by one of
equal priority that contains it.  What is left gives the labels.

One pass over the rows, no shuffle and no join; built-in Spark functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import ascii_lower, documents

#: Words of a text (A-Z lower-cased beforehand).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, keywords, name) of the licences: every match of the name contains each keyword.
NAMES = (
    ("apache-1.0", "apache", r"apache[\W_]+(?:software[\W_]+)?licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1\.0\b"),
    ("apache-1.1", "apache", r"apache[\W_]+(?:software[\W_]+)?licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("apache-2.0", "apache", r"apache[\W_]+(?:software[\W_]+)?licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("gpl-1.0", "gnu", r"gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1(?:\.0)?\b"),
    ("gpl-2.0", "gnu", r"gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("gpl-3.0", "gnu", r"gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?3(?:\.0)?\b"),
    ("gpl-2.0", "gpl", r"\bgpl[\W_]*(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("gpl-3.0", "gpl", r"\bgpl[\W_]*(?:version[\W_]*|v[\W_]*)?3(?:\.0)?\b"),
    ("gpl-2.0", "gnu foundation", r"gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+as[\W_]+published[\W_]+by[\W_]+the[\W_]+free[\W_]+software[\W_]+foundation[\W_]+(?:either[\W_]+)?version[\W_]+2(?:\.0)?\b"),
    ("gpl-3.0", "gnu foundation", r"gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+as[\W_]+published[\W_]+by[\W_]+the[\W_]+free[\W_]+software[\W_]+foundation[\W_]+(?:either[\W_]+)?version[\W_]+3(?:\.0)?\b"),
    ("gpl-2.0", "gnu version", r"version[\W_]+2[\W_]+of[\W_]+the[\W_]+gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e"),
    ("gpl-3.0", "gnu version", r"version[\W_]+3[\W_]+of[\W_]+the[\W_]+gnu[\W_]+general[\W_]+public[\W_]+licen[cs]e"),
    ("lgpl-2.1", "gnu foundation", r"gnu[\W_]+lesser[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+as[\W_]+published[\W_]+by[\W_]+the[\W_]+free[\W_]+software[\W_]+foundation[\W_]+(?:either[\W_]+)?version[\W_]+2\.1\b"),
    ("lgpl-3.0", "gnu foundation", r"gnu[\W_]+lesser[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+as[\W_]+published[\W_]+by[\W_]+the[\W_]+free[\W_]+software[\W_]+foundation[\W_]+(?:either[\W_]+)?version[\W_]+3(?:\.0)?\b"),
    ("lgpl-2.0", "lgpl", r"\blgpl[\W_]*(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("lgpl-2.1", "lgpl", r"\blgpl[\W_]*(?:version[\W_]*|v[\W_]*)?2\.1\b"),
    ("lgpl-3.0", "lgpl", r"\blgpl[\W_]*(?:version[\W_]*|v[\W_]*)?3(?:\.0)?\b"),
    ("agpl-3.0", "agpl", r"\bagpl[\W_]*(?:version[\W_]*|v[\W_]*)?3(?:\.0)?\b"),
    ("apache-1.0", "apache", r"\bapache[\W_]+(?:version[\W_]*|v[\W_]*)?1\.0\b"),
    ("apache-1.1", "apache", r"\bapache[\W_]+(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("apache-2.0", "apache", r"\bapache[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("apache-2.0", "apache", r"\bapache2(?:\.0)?\b"),
    ("apache-2.0", "asl", r"\basl[\W_]*(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("mpl-1.0", "mpl", r"\bmpl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.0\b"),
    ("mpl-1.1", "mpl", r"\bmpl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("mpl-2.0", "mpl", r"\bmpl[\W_]*(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("epl-1.0", "epl", r"\bepl[\W_]*(?:version[\W_]*|v[\W_]*)?1(?:\.0)?\b"),
    ("epl-2.0", "epl", r"\bepl[\W_]*(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("eupl-1.1", "eupl", r"\beupl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("eupl-1.2", "eupl", r"\beupl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.2\b"),
    ("cddl-1.0", "cddl", r"\bcddl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.0\b"),
    ("cddl-1.1", "cddl", r"\bcddl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("bsl-1.0", "bsl", r"\bbsl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.0\b"),
    ("osl-3.0", "osl", r"\bosl[\W_]*(?:version[\W_]*|v[\W_]*)?3\.0\b"),
    ("afl-3.0", "afl", r"\bafl[\W_]*(?:version[\W_]*|v[\W_]*)?3\.0\b"),
    ("ofl-1.1", "ofl", r"\bofl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("gfdl-1.3", "gfdl", r"\bgfdl[\W_]*(?:version[\W_]*|v[\W_]*)?1\.3\b"),
    ("mit", "mit x11", r"\bmit[\W_]*x11\b(?:[\W_]+licen[cs]e)?"),
    ("mit", "x11 licen", r"\bx11[\W_]+licen[cs]e"),
    ("mit", "expat licen", r"\bexpat[\W_]+licen[cs]e"),
    ("mit", "mit style", r"\bmit[\W_]+style[\W_]+licen[cs]e"),
    ("lgpl-2.0", "gnu general", r"gnu[\W_]+(?:lesser|library)[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("lgpl-2.1", "lesser", r"gnu[\W_]+lesser[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2\.1\b"),
    ("lgpl-3.0", "lesser", r"gnu[\W_]+lesser[\W_]+general[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?3(?:\.0)?\b"),
    ("lgpl", "lgpl", r"\blgpl\b"),
    ("agpl-3.0", "affero", r"gnu[\W_]+affero[\W_]+general[\W_]+public[\W_]+licen[cs]e"),
    ("agpl", "agpl", r"\bagpl\b"),
    ("mpl-1.1", "mozilla", r"mozilla[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1\.1\b"),
    ("mpl-2.0", "mozilla", r"mozilla[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("epl-1.0", "eclipse", r"eclipse[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1(?:\.0)?\b"),
    ("epl-2.0", "eclipse", r"eclipse[\W_]+public[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("eupl-1.2", "european", r"european[\W_]+union[\W_]+public[\W_]+licen[cs]e"),
    ("cddl-1.0", "common development", r"common[\W_]+development[\W_]+and[\W_]+distribution[\W_]+licen[cs]e"),
    ("cpl-1.0", "common public", r"common[\W_]+public[\W_]+licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd[\W_]+2[\W_]+clause|2[\W_]+clause[\W_]+bsd|simplified[\W_]+bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd[\W_]+3[\W_]+clause|3[\W_]+clause[\W_]+bsd|new[\W_]+bsd|modified[\W_]+bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd[\W_]+4[\W_]+clause|original[\W_]+bsd)"),
    ("bsd", "bsd", r"\bbsd[\W_]+(?:style[\W_]+)?licen[cs]e"),
    ("mit", "mit licen", r"\bmit[\W_]+licen[cs]e"),
    ("mit-0", "mit attribution", r"\bmit[\W_]+no[\W_]+attribution"),
    ("isc", "isc licen", r"\bisc[\W_]+licen[cs]e"),
    ("zlib", "zlib", r"\bzlib[\W_]+licen[cs]e"),
    ("bsl-1.0", "boost", r"boost[\W_]+software[\W_]+licen[cs]e"),
    ("unlicense", "unlicense", r"\bunlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("artistic-1.0", "artistic", r"artistic[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?1(?:\.0)?\b"),
    ("artistic-2.0", "artistic", r"artistic[\W_]+licen[cs]e[\W_]+(?:version[\W_]*|v[\W_]*)?2(?:\.0)?\b"),
    ("afl-3.0", "academic", r"academic[\W_]+free[\W_]+licen[cs]e"),
    ("osl-3.0", "open software", r"open[\W_]+software[\W_]+licen[cs]e"),
    ("psf-2.0", "python", r"python[\W_]+software[\W_]+foundation[\W_]+licen[cs]e"),
    ("php-3.01", "php licen", r"\bphp[\W_]+licen[cs]e"),
    ("ofl-1.1", "open font licen", r"(?:sil[\W_]+)?open[\W_]+font[\W_]+licen[cs]e"),
    ("odbl-1.0", "open database", r"open[\W_]+(?:data[\W_]+commons[\W_]+open[\W_]+)?database[\W_]+licen[cs]e"),
    ("odc-by-1.0", "open data attribution", r"open[\W_]+data[\W_]+commons[\W_]+attribution"),
    ("gfdl-1.3", "documentation", r"gnu[\W_]+free[\W_]+documentation[\W_]+licen[cs]e"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[\W_]+1\.0)?"),
    ("public-domain", "public domain", r"(?:dedicated[\W_]+to|in)[\W_]+the[\W_]+public[\W_]+domain"),
    ("proprietary", "rights reserved", r"all[\W_]+rights[\W_]+reserved"),
)

#: (label, keywords, sentence) of the licences' own texts, their words with any gap between.
TEXTS = (
    ("mit", "permission hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsl-1.0", "permission organization", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "permission distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse derived", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising acknowledgment", "all advertising materials mentioning features or use of this software must display the following acknowledgment"),
    ("gpl", "redistribute modify", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute modify", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "source mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0-1.0", "waiving", "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("ofl-1.1", "font reserved", "no modified version of the font software may use the reserved font name"),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code"),
)

#: (label, keyword, address) of the licences' own pages.
LINKS = (
    ("apache-1.0", "apache", r"apache\.org/licen[cs]es/licen[cs]e-1\.0"),
    ("apache-1.1", "apache", r"apache\.org/licen[cs]es/licen[cs]e-1\.1"),
    ("apache-2.0", "apache", r"apache\.org/licen[cs]es/licen[cs]e-2\.0"),
    ("agpl-3.0", "agpl", r"gnu\.org/licen[cs]es/agpl-3\.0"),
    ("gfdl-1.3", "fdl", r"gnu\.org/licen[cs]es/fdl-1\.3"),
    ("gpl-1.0", "gpl", r"gnu\.org/licen[cs]es/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl", r"gnu\.org/licen[cs]es/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl", r"gnu\.org/licen[cs]es/gpl-3\.0"),
    ("lgpl-2.0", "lgpl", r"gnu\.org/licen[cs]es/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lgpl", r"gnu\.org/licen[cs]es/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl", r"gnu\.org/licen[cs]es/lgpl-3\.0"),
    ("mpl-1.1", "mpl", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "epl", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("bsl-1.0", "boost", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl\.net"),
    ("ofl-1.1", "ofl", r"(?:scripts\.sil|openfontlicense)\.org/ofl"),
    ("php-3.01", "php", r"php\.net/license"),
    ("psf-2.0", "python", r"docs\.python\.org/3/license"),
    ("odbl-1.0", "odbl", r"opendatacommons\.org/licen[cs]es/odbl"),
    ("cc0-1.0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
)
#: Licences that have a page of their label at the same address.
OSI = ("afl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "artistic-1.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cddl-1.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ofl-1.1", "osl-3.0", "unlicense", "zlib")

#: Creative Commons: parts and versions, from which their names are made.
CC_PARTS = (("by", ""), ("by-sa", "sharealike"), ("by-nd", "noderivatives"), ("by-nc", "noncommercial"), ("by-nc-sa", "noncommercial[\\W_]+sharealike"), ("by-nc-nd", "noncommercial[\\W_]+noderivatives"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: (priority, pattern around a name N) of the forms.
FORMS = (
    (60, "N"),
    (80, r"(?:licen[cs]ed|released|distributed|published|available|provided)[\W_]+under[\W_]+(?:the[\W_]+)?(?:terms[\W_]+of[\W_]+)?(?:the[\W_]+)?N"),
    (70, r"(?:see|read|under|by|per|of)[\W_]+the[\W_]+N"),
)
SPDX = r"spdx-licen[cs]e-identifier:\s*"

def names() -> list[tuple[str, str, str]]:
    """(label, keywords, name): the hand-written names and those of Creative Commons."""
    out = list(NAMES)
    for part, spelt in CC_PARTS:
        for version in CC_VERSIONS:
            short = part.replace("-", r"[\W_]*")
            long = r"creative[\W_]+commons[\W_]+attribution" + (rf"[\W_]+{spelt}" if spelt else "")
            tail = r"[\W_]+(?:version[\W_]*|v[\W_]*)?" + version.replace(".", r"\.") + r"\b"
            out.append((f"cc-{part}-{version}", "cc by", rf"\bcc[\W_]*{short}{tail}"))
            out.append((f"cc-{part}-{version}", "creative commons attribution", long + tail))
    return out


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keywords, regex, priority), in order of their priority."""
    made = [(label, key, form.replace("N", name), priority) for label, key, name in names() for priority, form in FORMS]
    made += [(label, key, r"[\W_]+".join(sentence.split(" ")), 75) for label, key, sentence in TEXTS]
    labels = sorted({label for label, _, _ in names()})
    made += [(label, "spdx", SPDX + label.replace(".", r"\.") + r"(?:-only|-or-later)?\b", 90) for label in labels]
    made += [
        (f"cc-{part}-{version}", "creativecommons", rf"creativecommons\.org/licen[cs]es/{part}/{version}".replace(".", r"\.").replace(r"\\.", r"\."), 85)
        for part, _ in CC_PARTS
        for version in CC_VERSIONS
    ]
    made += [(label, key, address, 85) for label, key, address in LINKS]
    made += [(label, "opensource", r"opensource\.org/licen[cs]es?/" + label.replace(".", r"\.") + r"\b", 85) for label in OSI]
    return sorted(made, key=lambda r: (-r[3], r[0], r[2]))


RULES = rules()


def _has(text: Column, keywords: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(k)) for k in keywords.split(" ")])


#: Keywords that stand at the start of a word in all matches, and are part of common words.
WORD_STARTS = ("afl", "agpl", "asl", "bsl", "cddl", "epl", "eupl", "gpl", "lgpl", "mpl", "ofl", "osl")


def _may_match(text: Column, keywords: str) -> Column:
    """Whether the rules of these keywords are run on a text."""
    return _has(text, keywords) & F.rlike(text, F.lit(rf"\b{keywords}")) if keywords in WORD_STARTS else _has(text, keywords)


def _gates() -> list[str]:
    """Keywords of the rules and words of the base phrases, without those that hold a lesser one's."""
    every = sorted({key for _, key, _, _ in RULES} | {phrase for phrase, _ in PHRASES})
    return [k for k in every if not any(o != k and all(any(x in w for w in k.split(" ")) for x in o.split(" ")) for o in every)]


#: Texts without all words of any of these have no licence line.
GATE = _gates()


def _rule_array(keywords: str) -> Column:
    """Rules of these keywords: what each must match to begin with, and its forms.  All forms of
    a name hold the name, so they are tried only where it stands."""
    named = {}
    for label, key, name in names():
        for priority, form in FORMS:
            named[key, form.replace("N", name), priority] = name
    grouped: dict[tuple[str, str], list[tuple[str, int]]] = {}
    for label, key, rx, priority in RULES:
        if key == keywords:
            grouped.setdefault((label, named.get((key, rx, priority), rx)), []).append((rx, priority))
    forms = lambda rs: F.array(*[F.struct(F.lit(rx).alias("regex"), F.lit(p).alias("priority")) for rx, p in rs])
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(first).alias("first"), forms(rs).alias("forms")) for (label, first), rs in grouped.items()])


def _spans(text: Column, label: Column, rule: Column) -> Column:
    """Intervals [start, stop) of all matches of a form, from the pieces between them."""
    hits = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    between = F.transform(F.slice(F.split(text, rule["regex"], -1), F.lit(1), F.size(hits)), lambda p: F.length(p))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        stop = start + pair["size"]
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("spans"))

    pairs = F.zip_with(between, hits, lambda g, h: F.struct(g.alias("gap"), F.length(h).alias("size")))
    found = F.aggregate(pairs, zero, step, lambda acc: acc["spans"])
    return F.transform(found, lambda s: F.struct(s["start"], s["stop"], label.alias("label"), rule["priority"].alias("priority")))


def _form_spans(text: Column, rule: Column) -> Column:
    """Intervals of all forms of a rule."""
    return F.flatten(F.transform(F.filter(rule["forms"], lambda f: F.rlike(text, f["regex"])), lambda f: _spans(text, rule["label"], f)))


def _suppressed(x: Column, y: Column) -> Column:
    overlap = (y["start"] < x["stop"]) & (x["start"] < y["stop"])
    contains = (y["start"] <= x["start"]) & (y["stop"] >= x["stop"])
    same = (y["start"] == x["start"]) & (y["stop"] == x["stop"])
    return (overlap & (y["priority"] > x["priority"])) | ((y["priority"] == x["priority"]) & contains & (~same | (y["label"] < x["label"])))


def detections(text: Column) -> Column:
    """array<struct<start, stop, label, priority>> that remain of a lower-cased text; starts
    and stops are characters, from 0."""
    keys = sorted({key for _, key, _, _ in RULES})
    per_key = [
        F.when(_may_match(text, key), F.flatten(F.transform(F.filter(_rule_array(key), lambda r: F.rlike(text, r["first"])), lambda r: _form_spans(text, r)))).otherwise(
            F.array().cast("array<struct<start:int,stop:int,label:string,priority:int>>")
        )
        for key in keys
    ]
    found = F.array_distinct(F.concat(*per_key))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: _suppressed(x, y)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, detections.

    A null text counts as empty: no words, no labels (empty strings), score 0.  The score is
    the highest priority left, as a share of 100; base phrases alone give 0.5.  Of intervals of
    one priority and one place, the first label by name stays.  Rows are independent, so null
    and repeated ids need no care; a very long text is scanned whole, and an empty table gives
    no row.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    gate_text = F.lower(raw)
    gate = reduce(lambda a, b: a | b, [_has(gate_text, k) for k in GATE])
    d = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(raw, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.when(gate, ascii_lower(raw)).alias("low"))
    d = d.withColumn("spaced", F.when(F.col("low").isNotNull(), F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)), " "), F.lit(" "))))
    d = d.withColumn("detections", F.when(F.col("low").isNotNull(), detections(F.col("low"))))
    for k, (phrase, _) in enumerate(PHRASES):
        inside = F.lit(rf"(?<= ){phrase}(?= )")
        count = F.when(F.contains("spaced", F.lit(f" {phrase} ")), F.regexp_count("spaced", inside)).otherwise(0)
        d = d.withColumn(f"count{k}", count)
        before = F.substring(F.col("spaced"), F.lit(2), F.regexp_instr("spaced", inside) - 2)
        after = F.substring_index("spaced", f" {phrase} ", -1)
        hit = F.col(f"count{k}") > 0
        d = d.withColumn(f"first{k}", F.when(hit, F.regexp_count(before, F.lit(" ")).cast("long")))
        d = d.withColumn(f"last{k}", F.when(hit, F.col("n_words") - F.regexp_count(after, F.lit(" ")) - len(phrase.split(" "))))
    n = range(len(PHRASES))
    base = F.array_compact(F.array(*[F.when(F.col(f"count{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    own = F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])) / 100.0, F.lit(0.0))
    return d.select(
        "doc_id",
        "n_words",
        reduce(lambda a, b: a + b, [F.col(f"count{k}") for k in n]).cast("long").alias("n_base"),
        F.least(*[F.col(f"first{k}") for k in n]).alias("first_word"),
        F.greatest(*[F.col(f"last{k}") for k in n]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
        "detections",
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("detections")
