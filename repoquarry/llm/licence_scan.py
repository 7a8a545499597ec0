"""Licence detection by ordered signature rules, as column functions of one row.

A rule is a regular expression over a text's words (lower-cased, joined by single spaces).  Only texts that pass a gate are
normalized at all, and of the rules only those of which a keyword occurs are tried.  Gate and keywords are derived from the
patterns: no match of a rule is without one of its keywords, no text with a match fails the gate.  Overlapping detections are settled by containment: of two intervals, one inside the other, the rule of higher
priority stays, and of equal priorities the outer one.
"""

from __future__ import annotations

import re
from functools import cache
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.spans import SPAN, found, let, once

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
PRIORITIES = (4, 3, 2, 1)

# fixed values: label, name as a pattern over normalized words, SPDX identifiers as normalized words
LICENCES = (
    ("0bsd", "(?:0bsd|bsd zero clause|zero clause bsd)", ("0bsd",)),
    ("afl", "academic free license", ("afl 2 1", "afl 3 0")),
    ("agpl", "(?:gnu )?affero general public license", ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    ("apache", "apache (?:software )?license", ("apache 1 1", "apache 2 0")),
    ("apsl", "apple public source license", ("apsl 2 0",)),
    ("artistic", "artistic license", ("artistic 1 0", "artistic 2 0")),
    ("blueoak", "blue oak model license", ("blueoak 1 0 0",)),
    ("bsd", "(?:(?:new|revised|simplified|modified|original) )?bsd (?:[234] clause )?(?:style )?license", ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause")),
    ("bsl", "boost software license", ("bsl 1 0",)),
    ("busl", "business source license", ("busl 1 1",)),
    ("cc-by", "creative commons attribution", ("cc by 3 0", "cc by 4 0")),
    ("cc-by-nc", "creative commons attribution non ?commercial", ("cc by nc 3 0", "cc by nc 4 0")),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s", ("cc by nd 3 0", "cc by nd 4 0")),
    ("cc-by-sa", "creative commons attribution share ?alike", ("cc by sa 3 0", "cc by sa 4 0")),
    ("cc0", "(?:creative commons zero|cc0)", ("cc0 1 0",)),
    ("cddl", "common development and distribution license", ("cddl 1 0", "cddl 1 1")),
    ("cecill", "cecill(?: free software)?(?: license)?", ("cecill 2 0", "cecill 2 1")),
    ("cpal", "common public attribution license", ("cpal 1 0",)),
    ("cpl", "common public license", ("cpl 1 0",)),
    ("ecl", "educational community license", ("ecl 2 0",)),
    ("efl", "eiffel forum license", ("efl 2 0",)),
    ("epl", "eclipse public license", ("epl 1 0", "epl 2 0")),
    ("eupl", "european union public licen[cs]e", ("eupl 1 1", "eupl 1 2")),
    ("fdl", "(?:gnu )?free documentation license", ("gfdl 1 2", "gfdl 1 3")),
    ("gpl", "(?:gnu )?general public license", ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    ("ipl", "ibm public license", ("ipl 1 0",)),
    ("isc", "isc license", ("isc",)),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license", ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0")),
    ("lppl", "latex project public license", ("lppl 1 3c",)),
    ("mit", "(?:expat|mit) license", ("mit", "mit 0")),
    ("mpl", "mozilla public license", ("mpl 1 1", "mpl 2 0")),
    ("ms-pl", "microsoft public license", ("ms pl",)),
    ("ms-rl", "microsoft reciprocal license", ("ms rl",)),
    ("mulanpsl", "mulan (?:permissive software|psl) license", ("mulanpsl 2 0",)),
    ("ncsa", "(?:university of illinois )?ncsa open source license", ("ncsa",)),
    ("odbl", "open (?:data commons open )?database license", ("odbl 1 0",)),
    ("ofl", "(?:sil )?open font license", ("ofl 1 1",)),
    ("osl", "open software license", ("osl 3 0",)),
    ("php", "php license", ("php 3 01",)),
    ("postgresql", "postgresql license", ("postgresql",)),
    ("psf", "python software foundation license", ("psf 2 0", "python 2 0")),
    ("ruby", "ruby license", ("ruby",)),
    ("sspl", "server side public license", ("sspl 1 0",)),
    ("unlicense", "unlicense", ("unlicense",)),
    ("upl", "universal permissive license", ("upl 1 0",)),
    ("vim", "vim license", ("vim",)),
    ("w3c", "w3c software (?:notice and )?license", ("w3c",)),
    ("wtfpl", "do what the fuck you want to public license", ("wtfpl",)),
    ("zlib", "zlib(?: libpng)? license", ("zlib",)),
    ("zpl", "zope public license", ("zpl 2 1",)),
)

# fixed values: label, a passage that only the licence's own text has
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", "licensor shall mean the copyright owner or entity authorized by the copyright owner"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("proprietary", "all rights reserved"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|in to|into|to) the public domain"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
)

WEAK = {"copyright": 0.2, "proprietary": 0.3}
VERSION = "(?: v(?:ersion)? ?[0-9]+(?: [0-9]+)?| [0-9]+ [0-9]+)?"


# words that stand in most rules and few texts; a text with one of them passes the gate
STEMS = ("licens", "licenc", "spdx", "copyright", "reserved", "public domain", "creative commons", "cc0", "cecill", "bsd", "permission", "redistribution", "licensor", "verbatim", "unencumbered", "misrepresented", "affirmer")
# words that say little about which rule a text matches
COMMON = set("licensed released distributed available provided published under the terms and conditions of subject to license licence public".split())
SPELLINGS = 64
_GAP, _EDGE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def rules() -> list[tuple[str, str, int, float]]:
    """(label, pattern, priority, confidence) in order: texts, identifiers, grants, headings, mentions."""
    made = [(label, pattern, 1 if label in WEAK else 4, WEAK.get(label, 1.0)) for label, pattern in TEXTS]
    for label, _, names in LICENCES:
        for name in sorted(names, key=len, reverse=True):
            made.append((label, f"spdx license identifier {name}", 4, 1.0))
            if len(name.split(" ")) > 1:
                made.append((label, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{name}", 3, 0.9))
    for label, name, _ in LICENCES:
        grant = "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
        made.append((label, f"{grant}{name}{VERSION}", 3, 0.95))
        made.append((label, f"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}{VERSION}", 3, 0.9))
        made.append((label, f"{name}{VERSION}", 2, 0.8))
    return made


def _runs(parsed: list) -> list[set[str]]:
    """Sets of strings, of each of which every match of a parsed pattern contains at least one.

    Neighbours of few spellings are joined to longer strings; whatever else there is ends a run.
    """
    done, open_ = [], {""}
    for op, value in parsed:
        some = _spelt(op, value)
        if some and len(open_) * len(some) <= SPELLINGS:
            open_ = {x + y for x in open_ for y in some}
        else:
            done.append(open_)
            open_ = some if some else {""}
    return [run for run in [*done, open_] if "" not in run]


def _spelt(op, value) -> set[str] | None:
    """All strings that a part of a pattern matches, or None if they are too many."""
    if op is _constants.LITERAL:
        return {chr(value)}
    if op is _constants.IN and all(kind is _constants.LITERAL for kind, _ in value):
        return {chr(code) for _, code in value}
    if op is _constants.SUBPATTERN:
        return _all_spelt(value[3])
    if op is _constants.BRANCH:
        each = [_all_spelt(branch) for branch in value[1]]
        return None if None in each else set().union(*each)
    if op is _constants.MAX_REPEAT and value[:2] == (0, 1):
        inner = _all_spelt(value[2])
        return None if inner is None else {"", *inner}
    return None


def _all_spelt(parsed: list) -> set[str] | None:
    all_ = {""}
    for op, value in parsed:
        some = _spelt(op, value)
        if some is None or len(all_) * len(some) > SPELLINGS:
            return None
        all_ = {x + y for x in all_ for y in some}
    return all_


def _least(run: set[str]) -> list[str]:
    """A run without the strings that contain another of its strings."""
    return sorted(x for x in run if not any(y != x and y in x for y in run))


@cache
def keywords(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a pattern, between single spaces, contains one: few, long and of a licence's own words."""
    best, most = (), -1000.0
    for run in _runs(list(_parser.parse(f" {pattern} "))):
        cuts = [run]
        for k in range(1, 5):
            cuts += [{"".join(re.findall(r" ?[^ ]* ?$| ?[^ ]+", x)[-k:]) for x in run}, {"".join(re.findall(r"[^ ]* ", x)[:k]) or x for x in run}]
        for some in map(_least, cuts):
            own = "" not in some and all(set(x.split()) - COMMON for x in some)
            worth = min(min(map(len, some)), 12) - 1.5 * len(some) - 100 * (not own)
            if worth > most and all(some):
                best, most = tuple(some), worth
    return best


@cache
def gate() -> str:
    """An expression that every text with a rule's match or a base phrase matches, whatever separates its words."""
    patterns = [*(pattern for _, pattern, _, _ in rules()), *(phrase for phrase, _ in BASE)]
    rest = [p for p in patterns if not any(all(any(stem in x for stem in STEMS) for x in run) for run in _runs(list(_parser.parse(f" {p} "))))]
    by: dict[str, list[str]] = {}
    for p in rest:
        name = re.search(r"[^)?]*$", p)[0]
        by.setdefault(p[: len(p) - len(name)], []).append(name)
    whole = [rf"(?<!{_EDGE}){head}(?:{'|'.join(names)})(?!{_EDGE})" for head, names in by.items()]
    return "(?i)" + "|".join([*STEMS, *whole]).replace(" ", _GAP)


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _phrase(phrase: str) -> str:
    """A phrase's words in any case, with any non-word characters between them, in the text itself."""
    return f"(?i)(?<!{_EDGE})" + _GAP.join(phrase.split(" ")) + f"(?!{_EDGE})"


def _places(text: str, phrase: str) -> Column:
    """Word numbers at which the words of a phrase stand."""
    spans = F.when(F.col(text).rlike(_phrase(phrase)), F.split(F.col(text), _phrase(phrase), -1))
    size = len(phrase.split(" "))

    def starts(gaps: Column) -> Column:
        words = F.transform(gaps, lambda g: F.regexp_count(g, F.lit(WORD_ANY_CASE)).cast("bigint"))
        step = lambda acc, n: F.struct((acc["at"] + n + size).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all"))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return let(words, lambda w: F.aggregate(F.slice(w, F.lit(1), F.size(w) - 1), zero, step)["all"])

    return F.when(spans.isNotNull(), let(spans, starts)).otherwise(F.array().cast("array<bigint>"))


def _rule_table() -> Column:
    fields = ("label", "keywords", "pattern", "priority", "confidence")
    made = [(label, F.array(*map(F.lit, keywords(pattern))), _bounded(pattern), priority, confidence) for label, pattern, priority, confidence in rules()]
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(fields, row, strict=True)]) for row in made])


DETECTIONS = "array<struct<label:string,priority:int,confidence:double,start:bigint,end:bigint>>"


def _detect(norm: Column, table: Column) -> Column:
    """All matches of the rules of which a keyword occurs, by start, then the longer, then priority."""
    tried = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, k)))

    def matches(r: Column) -> Column:
        return F.transform(
            found(norm, r["pattern"]),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-r["priority"]).alias("low"), r["label"].alias("label"), r["confidence"].alias("confidence")),
        )

    return F.array_sort(F.flatten(F.transform(tried, matches)))


def _settle(detected: Column) -> Column:
    """Keep what containment allows: of two nested intervals the one of higher priority, of equal priorities the outer.

    `detected` comes by start, longest first.  Forwards, an interval lies in an earlier one if any of at least its
    priority has reached its end; backwards, an interval encloses a later one that outranks it if the nearest end seen at
    a higher priority is not beyond its own.  Remembering one number for each priority is enough for both.
    """
    slots, far = len(PRIORITIES), 1 << 62

    def sweep(items: Column, forwards: bool) -> Column:
        marks = F.array(*[F.lit(-1 if forwards else far).cast("bigint") for _ in PRIORITIES])
        state = F.struct(marks.alias("marks"), F.array().cast(DETECTIONS).alias("kept"))

        def step(acc: Column, d: Column) -> Column:
            slot, end = F.lit(slots) - d["priority"], d["end"]  # slot 0 is the highest priority
            if forwards:
                loses = F.exists(F.slice(acc["marks"], F.lit(1), slot + 1), lambda m: m >= end)
                marked = F.transform(acc["marks"], lambda m, i: F.when(i == slot, F.greatest(m, end)).otherwise(m))
            else:
                loses = F.exists(F.slice(acc["marks"], F.lit(1), slot), lambda m: m <= end)
                marked = F.transform(acc["marks"], lambda m, i: F.when(i == slot, F.least(m, end)).otherwise(m))
            kept = F.when(loses, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d)))
            return F.struct(marked.alias("marks"), kept.alias("kept"))

        return F.aggregate(items, state, step)["kept"]

    items = F.transform(
        detected,
        lambda d: F.struct(d["label"].alias("label"), (-d["low"]).cast("int").alias("priority"), d["confidence"].alias("confidence"), d["start"].alias("start"), (-d["back"]).alias("end")),
    )
    return F.reverse(sweep(F.reverse(sweep(items, True)), False))


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `df` with `n_words`, `places` (label -> word numbers of its base phrase), `detections`, `labels`, `score`.

    `detections` are the rule matches that remain, with their places in the normalized text; `labels` the distinct
    sorted labels of base phrases and detections; `score` the highest confidence, 0 without labels, 0.7 for a base phrase
    alone.  Null and empty texts have no words and no labels.  Columns of `df` named like an output are replaced.
    """
    made = ("n_words", "places", "detections", "labels", "score")
    body, passed, norm = "__licence_text", "__licence_gate", "__licence_norm"
    source = df.drop(*made).withColumn(body, F.coalesce(F.col(text), F.lit("")))
    gated = F.col(body).rlike(gate())
    counted = once(source, **{"n_words": F.regexp_count(F.col(body), F.lit(WORD_ANY_CASE)).cast("bigint"), passed: gated})
    lowered = F.translate(F.col(body), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    ready = once(counted, **{norm: F.when(F.col(passed), joined)})
    detected = F.when(F.col(passed), let(_rule_table(), lambda t: _settle(_detect(F.col(norm), t)))).otherwise(F.array().cast(DETECTIONS))
    places = F.create_map(*[x for phrase, label in BASE for x in (F.lit(label), F.when(F.col(passed), _places(body, phrase)).otherwise(F.array().cast("array<bigint>")))])
    located = once(ready, places=places, detections=detected)
    base = F.map_keys(F.map_filter("places", lambda _, p: F.size(p) > 0))
    labels = F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"])))
    best = F.greatest(F.when(F.size(base) > 0, 0.7).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
    return once(located, labels=labels, score=best).drop(body, passed, norm)
