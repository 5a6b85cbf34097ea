"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A text is scanned as its lower-cased words, one space between. Texts without any keyword of the rules are done after
one look. The others meet the rules whose keyword they hold; every occurrence of a rule's regex is a
detection. Detections are read from left to right: one inside another goes (of equal places the lower priority), and of
two that overlap in part the one with the lower priority goes.

A null text has no words. Base phrases are counted on all texts. Rows are scanned one by one, also repeated ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Single rules: (label, keyword, regex over words). Earlier rules have the higher priority. A keyword is text that every match
# holds (with a space before it where a word has to start there), so that a text without it need not meet the regex.
SINGLE = [
    ("afl-3.0", "academic free license", r"academic free license( v(ersion)?)? 3( 0)?"),
    ("artistic-1.0", "artistic license", r"artistic license( version)? 1( 0)?"),
    ("artistic-2.0", "artistic license", r"artistic license( version)? 2( 0)?"),
    ("artistic", "artistic license", r"(the |perl )?artistic license"),
    ("beerware", "beer", r"(buy me a beer in return|beer ?ware license)"),
    ("bsl-1.0", "boost software license", r"boost software license( version 1 0)?"),
    ("busl-1.1", "business source license", r"business source license( 1 1)?"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("bsd-3-clause", "neither the name of", r"neither the name of [^ ]+( [^ ]+){0,12} may be used to endorse or promote"),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("cddl-1.0", "common development and", r"common development and distribution license( cddl)?( version)? 1 0"),
    ("cddl-1.1", "common development and", r"common development and distribution license( cddl)?( version)? 1 1"),
    ("cddl", "common development and", r"common development and distribution license"),
    ("cecill", "cecill", r"cecill( [abc])?( license| v2( 1)?)?"),
    ("cpl-1.0", "common public license", r"common public license( version 1 0| v1 0)?"),
    ("epl-1.0", "eclipse public license", r"eclipse public license( v(ersion)?)? 1( 0)?"),
    ("epl-2.0", "eclipse public license", r"eclipse public license( v(ersion)?)? 2( 0)?"),
    ("epl", "eclipse public license", r"eclipse public license"),
    ("eupl", "european union public", r"european union public licen[cs]e( v(ersion)? ?1 [012])?"),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", " isc license", r"(the )?isc license"),
    ("ijg", "independent jpeg group", r"independent jpeg group s software"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", " mit licen", r"(under|released under|licensed under)( the( terms of the)?)? mit licen[cs]e"),
    ("mit", " mit licen", r"the mit licen[cs]e( mit)?"),
    ("mit", " mit licen", r"mit licen[cs]ed?"),
    ("mit-0", " mit no attribution", r"mit no attribution( license)?"),
    ("ms-pl", "microsoft public license", r"microsoft public license( ms pl)?"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license( ms rl)?"),
    ("ncsa", "ncsa open source license", r"(university of illinois )?ncsa open source license"),
    ("ofl-1.1", " sil open font license", r"sil open font license( version)?( 1 1)?"),
    ("openssl", "openssl", r"openssl license"),
    ("odbl", "open database license", r"open database license( odbl)?( v1 0)?"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "public domain dedication", r"public domain dedication and license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf-2.0", "python software foundation", r"python software foundation license( agreement)?( version 2)?"),
    ("psf-2.0", " psf license", r"psf license( agreement)?( version 2)?"),
    ("php", " php license", r"php license( version)?( 3 0[01]?)?"),
    ("ruby", " ruby license", r"(the )?ruby license"),
    ("sspl-1.0", "server side public license", r"server side public license( version 1)?"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"(the )?unlicense"),
    ("upl-1.0", "universal permissive license", r"universal permissive license( v 1 0)?"),
    ("vim", " vim license", r"vim license"),
    ("w3c", " w3c software", r"w3c software( and document)? (notice and )?license"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("x11", " x11 license", r"x11 license"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "zlib", r"zlib( libpng)? license"),
    ("zpl", "zope public license", r"zope public license( zpl)?( version 2 [01])?"),
    ("public-domain", "public domain", r"(dedicated to|placed in|released into|is in) the public domain"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (copying|reproduction|use|distribution)( of this (file|document|software))?( via any medium)?( is)? (strictly )?prohibited"),
    ("no-derivatives", "no derivative works", r"no derivative works( are)? (allowed|permitted)"),
    ("non-commercial", "commercial use only", r"(for )?non ?commercial use only"),
    ("non-commercial", "not for commercial", r"not for commercial (use|purposes)"),
    ("warranty", "without warranty of any", r"without warranty of any kind"),
    ("warranty", "without warranties or", r"without warranties or conditions of any kind"),
    ("reserved", " rights reserved", r"(all|some) rights reserved"),
    ("reserved", "tous droits", r"tous droits réservés"),
    ("reserved", "alle rechte", r"alle rechte vorbehalten"),
    ("reserved", "los derechos", r"todos los derechos reservados"),
    ("copyright", "copyright", r"copyright( c)?( ©)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?"),
    ("copyright", "©", r"© (19|20)[0-9]{2}"),
]


def rules() -> list[tuple]:
    """All rules as (priority, label, keyword, regex): families by rule, then the single ones."""
    out = []
    for parts in (("nc", "sa"), ("nc", "nd"), ("sa",), ("nc",), ("nd",), ()):
        names = {"nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(ative)?s?( works)?"}
        short, long = " ".join(("by", *parts)), " ".join(("attribution", *(names[p] for p in parts)))
        for version in ("4.0", "3.0", "2.5", "2.0", "1.0", None):
            label = "-".join(("cc-by", *parts, *([version] if version else [])))
            end = rf"( version)? {version.replace('.', ' ')}( (unported|international|generic|deed))?" if version else ""
            out += [(label, f" cc {short}", rf"(licensed under |license )?(the )?cc {short}{end}"),
                    (label, "creative commons attribution", rf"(under )?(a |the )?creative commons {long}{end}( (international|unported|generic))?( public)? licen[cs]e"),
                    (label, f"creative commons {short}", rf"creative commons {short}{end}"),
                    (label, f"creativecommons org licenses {short}", rf"creativecommons org licenses {short}{' ' + version.replace('.', ' ') if version else ''}")]
    out += [("cc0-1.0", "cc0", r"cc0( 1 0)?( universal)?"), ("cc0-1.0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
            ("cc-pdm", "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0"), ("cc", "creative commons", r"creative commons")]
    for label, kind, versions in (("agpl", "affero ", ("3", "1")), ("lgpl", "(lesser|library) ", ("3", "2.1", "2")), ("gfdl", None, ("1.3", "1.2", "1.1")), ("gpl", "", ("3", "2", "1"))):
        name = "free documentation license" if kind is None else f"{kind}general public license"
        keyword = "free documentation license" if kind is None else "general public license"
        for version in versions:
            v = version.replace(".", " ")
            out += [(f"{label}-{version}-or-later", keyword, rf"(gnu )?{name}( as published by the free software foundation)?( either)? v(ersion)? ?{v}( 0)?( of the license)? or( at your option)? any later version"),
                    (f"{label}-{version}-only", keyword, rf"(gnu )?{name}( v)?( version)? ?{v}( 0)? only"),
                    (f"{label}-{version}", keyword, rf"(gnu )?{name}( as published by the free software foundation)? v(ersion)? ?{v}( 0)?"),
                    (f"{label}-{version}-or-later", f" {label}", rf"{label} ?v?{v}( 0)? or later"),
                    (f"{label}-{version}", f" {label}", rf"{label} ?v?{v}( 0)?")]
        out += [(label, keyword, rf"(gnu )?{name}"), (label, f" {label} ", rf"(gnu )?{label}( license)?")]
    for label, name, keyword, versions in (("apache", "apache( software)? license", "apache", ("2.0", "1.1", "1.0")), ("mpl", "mozilla public license", "mozilla public license", ("2.0", "1.1", "1.0")),
                                           ("osl", "open software license", "open software license", ("3.0", "2.1", "2.0", "1.1", "1.0")), ("apsl", "apple public source license", "apple public source license", ("2.0", "1.2", "1.1", "1.0"))):
        for version in versions:
            v = version.replace(".", " ").removesuffix(" 0")
            zero = "( 0)?" if version.endswith(".0") else ""
            out += [(f"{label}-{version}", keyword, rf"(licensed under the )?{name}( v(ersion)?)? {v}{zero}"), (f"{label}-{version}", f" {label} ", rf"{label} {v}{zero}( license)?")]
        out += [(label, keyword, name)]
    for n in (4, 3, 2, 1, 0):
        words = {4: "original|four clause", 3: "new|modified|revised|three clause", 2: "simplified|freebsd|two clause", 1: "one clause", 0: "zero clause"}[n]
        out += [(f"bsd-{n}-clause", " bsd ", rf"bsd {n} clause( license)?"), (f"bsd-{n}-clause", " bsd ", rf"({n} clause|{words}) bsd( license)?"), (f"bsd-{n}-clause", "0bsd" if n == 0 else f" bsd{n}", rf"0bsd" if n == 0 else rf"bsd{n}")]
    out += [("bsd", " bsd ", r"bsd( style)? licen[cs]e")]
    out += SINGLE
    return [(i, label, keyword, rf"(?<= ){regex}(?= )") for i, (label, keyword, regex) in enumerate((a, b, f"(?:{c})") for a, b, c in out)]


def words_of(text: Column) -> Column:
    """The words, each with one space before and after; one space where there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), *LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NO_WORD, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(phrase: str) -> Column:
    """Number, first and last start (in words) of a phrase in `_w`; null where it does not stand there."""
    pieces = F.split("_w", rf"(?<= )\Q{phrase}\E(?= )")
    end = _spaces(F.col("_w")) - _spaces(F.element_at(pieces, -1)) - phrase.count(" ") - 1
    return F.when(F.contains("_w", F.lit(f" {phrase} ")), F.struct(
        (F.size(pieces) - 1).cast("long").alias("n"), (_spaces(F.element_at(pieces, 1)) - 1).alias("first"), end.alias("last")))


def _detections(own: list[tuple]) -> Column:
    """First and last + 1 character, priority and label of all occurrences of the rules whose keyword stands in `_w`."""
    table = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(regex).alias("regex"))
                      for i, label, keyword, regex in own])

    def of(rule):
        zipped = F.arrays_zip(F.split("_w", rule["regex"]).alias("before"), F.regexp_extract_all("_w", rule["regex"], F.lit(0)).alias("found"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int,priority:int,label:string>>").alias("all"))

        def step(done, x):
            first = done["at"] + F.length(x["before"])
            last = first + F.coalesce(F.length(x["found"]), F.lit(0))
            one = F.array(F.struct(first.alias("first"), last.alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label")))
            return F.struct(last.alias("at"), F.when(x["found"].isNotNull(), F.concat(done["all"], one)).otherwise(done["all"]).alias("all"))
        return F.aggregate(zipped, start, step, lambda done: done["all"])

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains("_w", r["keyword"])), of))


def _resolved(found: Column) -> Column:
    """Labels and number of the detections that are left."""
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(
        d["first"].alias("first"), (-d["last"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label")))), lambda d: d)
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(-1).alias("last"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("label"))

    def step(done, d):
        last = -d["back"]
        new = F.struct(F.when(done["label"].isNull(), done["labels"]).otherwise(F.array_union(done["labels"], F.array(done["label"]))).alias("labels"),
                       (done["n"] + 1).alias("n"), last.alias("last"), d["priority"].alias("priority"), d["label"].alias("label"))
        better = F.struct(done["labels"].alias("labels"), done["n"].alias("n"), last.alias("last"), d["priority"].alias("priority"), d["label"].alias("label"))
        return F.when(d["first"] >= done["last"], new).when((last > done["last"]) & (d["priority"] < done["priority"]), better).otherwise(done)

    return F.aggregate(ordered, start, step, lambda done: F.struct(
        F.when(done["label"].isNull(), done["labels"]).otherwise(F.array_union(done["labels"], F.array(done["label"]))).alias("labels"), done["n"].alias("n")))


def scan(docs: DataFrame, own: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, base places (n_base, first_word, last_word), base_labels, labels and score of every row.

    The score is 1 - 0.5 ** (detections that are left): 0 for a text without any.
    """
    own = rules() if own is None else own
    # Anywhere in a word, as in `_detections`. Plain searches for each keyword are faster than one alternation.
    gate = reduce(lambda a, b: a | b, [F.contains("_w", F.lit(keyword)) for keyword in sorted({keyword for _, _, keyword, _ in own})])
    places = [F.col(f"_p{i}") for i in range(len(BASE))]
    nothing = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"))
    base = docs.select("doc_id", words_of(F.col("text")).alias("_w"))
    base = base.select("doc_id", (_spaces(F.col("_w")) - 1).alias("n_words"), *[_places(p).alias(f"_p{i}") for i, (p, _) in enumerate(BASE)],
                       F.when(gate, _resolved(_detections(own))).otherwise(nothing).alias("_found"))
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(places, BASE)]))
    return base.select(
        "doc_id", "n_words", sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[p["first"] for p in places]).alias("first_word"), F.greatest(*[p["last"] for p in places]).alias("last_word"),
        F.array_sort(labels).alias("base_labels"), F.array_sort(F.array_union(labels, F.col("_found.labels"))).alias("labels"),
        (1 - F.pow(F.lit(0.5), F.col("_found.n"))).alias("score"))
