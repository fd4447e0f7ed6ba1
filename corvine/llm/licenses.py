"""License detection by ordered signature rules, in DataFrame functions only.

Rules are built from tables of licenses and of wordings.  A rule is a regular expression
over the text's words (lower case, one blank between), keywords of which one must occur before the
expression is tried, a label and a priority (its place in the table).  Detections that
overlap are settled in order of their start: one that lies within another goes, of
two equal ones the rule of better priority stays, and of two that overlap in part the one of
better priority stays.

One narrow pass, no shuffle: the expressions run only on texts that hold one of
the few gate words, and there only those with a keyword that occurs.  Time grows with the text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Base: a phrase's words standing consecutively, and its label. Fixed values.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Licenses, most specific names first: label, and a regular expression of the name's words. Fixed values.
NAMES = [
    ("agpl-3.0", r"(?:gnu )?affero general public license(?: (?:version|v))? ?3(?: 0)?"),
    ("agpl", r"(?:gnu )?affero general public license"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license(?: (?:version|v))? ?3(?: 0)?"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public license(?: (?:version|v))? ?2 1"),
    ("lgpl-2.0", r"(?:gnu )?library general public license(?: (?:version|v))? ?2(?: 0)?"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license"),
    ("gpl-3.0", r"(?:gnu )?general public license(?: (?:version|v))? ?3(?: 0)?"),
    ("gpl-2.0", r"(?:gnu )?general public license(?: (?:version|v))? ?2(?: 0)?"),
    ("gpl-1.0", r"(?:gnu )?general public license(?: (?:version|v))? ?1(?: 0)?"),
    ("apache-2.0", r"apache(?: software)? license(?: (?:version|v))? ?2(?: 0)?"),
    ("apache-1.1", r"apache(?: software)? license(?: (?:version|v))? ?1 1"),
    ("apache-1.0", r"apache(?: software)? license(?: (?:version|v))? ?1 0"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)(?: license)?"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd)(?: license)?"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)(?: license)?"),
    ("bsd-0-clause", r"(?:bsd zero clause|zero clause bsd|0bsd|free public license 1 0 0)(?: license)?"),
    ("bsd", r"bsd(?: style)? license"),
    ("mit-0", r"mit no attribution(?: license)?"),
    ("mpl-2.0", r"mozilla public license(?: (?:version|v))? ?2(?: 0)?"),
    ("mpl-1.1", r"mozilla public license(?: (?:version|v))? ?1 1"),
    ("mpl", r"mozilla public license"),
    ("epl-2.0", r"eclipse public license(?: (?:version|v))? ?2(?: 0)?"),
    ("epl-1.0", r"eclipse public license(?: (?:version|v))? ?1 0"),
    ("epl", r"eclipse public license"),
    ("edl-1.0", r"eclipse distribution license(?: (?:version|v))?(?: ?1 0)?"),
    ("cddl-1.1", r"common development and distribution license(?: (?:version|v))? ?1 1"),
    ("cddl-1.0", r"common development and distribution license(?: (?:version|v))?(?: ?1 0)?"),
    ("cpl-1.0", r"common public license(?: (?:version|v))?(?: ?1 0)?"),
    ("isc", r"isc license"),
    ("zlib", r"(?:zlib|zlib libpng) license"),
    ("bsl-1.0", r"boost software license(?: (?:version|v))?(?: ?1 0)?"),
    ("busl-1.1", r"business source license(?: (?:version|v))?(?: ?1 1)?"),
    ("unlicense", r"(?:the unlicense|unlicense license)"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("artistic-2.0", r"artistic license(?: (?:version|v))? ?2(?: 0)?"),
    ("artistic-1.0", r"artistic license(?: (?:version|v))?(?: ?1 0)?"),
    ("psf-2.0", r"python software foundation license(?: (?:version|v))?(?: ?2)?"),
    ("php-3.01", r"php license(?: (?:version|v))?(?: ?3 01)?"),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:version|v))?(?: ?1 1)?"),
    ("eupl-1.2", r"european union public (?:license|licence)(?: (?:version|v))?(?: ?1 2)?"),
    ("osl-3.0", r"open software license(?: (?:version|v))?(?: ?3 0)?"),
    ("afl-3.0", r"academic free license(?: (?:version|v))?(?: ?3 0)?"),
    ("ms-pl", r"microsoft public license"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("ncsa", r"university of illinois(?: ncsa)?(?: open source)? license"),
    ("openssl", r"openssl license"),
    ("postgresql", r"postgresql license"),
    ("vim", r"vim license"),
    ("ruby", r"ruby license"),
    ("odbl-1.0", r"open (?:data commons open )?database license(?: (?:version|v))?(?: ?1 0)?"),
    ("odc-by-1.0", r"open data commons attribution license(?: (?:version|v))?(?: ?1 0)?"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: (?:version|v))?(?: ?1 [123])?"),
    ("cc0-1.0", r"(?:cc0(?: ?1 0)?|creative commons zero)(?: universal)?(?: license)?"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv\w*)(?: [1234] [05])?(?: license)?"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1234] [05])?(?: license)?"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1234] [05])?(?: license)?"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv\w*)(?: [1234] [05])?(?: license)?"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1234] [05])?(?: license)?"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: [1234] [05])?(?: license)?"),
    ("mit", r"(?:mit|expat|x11)(?: style)? license"),
    ("apache", r"apache(?: software)? license"),
    ("gpl", r"(?:gnu )?general public license"),
    ("proprietary", r"all rights reserved"),
]

#: Words around a name, most telling first: score of the rule, and the expression with the name at {}. Fixed values.
WORDINGS = [
    (1.0, r"(?:this|the) (?:\w+ ){{0,3}}(?:is|are) (?:licensed|distributed|released|made available) under (?:the )?(?:terms of )?(?:the )?{}"),
    (0.95, r"(?:licensed|released|distributed|available|published|redistributed) under (?:the )?(?:terms of )?(?:the )?{}"),
    (0.9, r"(?:under|subject to|according to) (?:the )?terms (?:and conditions )?of (?:the )?{}"),
    (0.8, r"(?:see|read) (?:the )?{}"),
    (0.6, r"{}"),
]

#: Short identifiers that stand after "spdx license identifier" or "license", and their labels. Fixed values.
TAGS = {
    "agpl 3 0": "agpl-3.0", "lgpl 3 0": "lgpl-3.0", "lgpl 2 1": "lgpl-2.1", "gpl 3 0": "gpl-3.0", "gpl 2 0": "gpl-2.0", "apache 2 0": "apache-2.0",
    "mit": "mit", "isc": "isc", "zlib": "zlib", "mpl 2 0": "mpl-2.0", "epl 2 0": "epl-2.0", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause",
    "0bsd": "bsd-0-clause", "bsl 1 0": "bsl-1.0", "unlicense": "unlicense", "cc0 1 0": "cc0-1.0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "ofl 1 1": "ofl-1.1",
}

#: Sentences of the licenses themselves: label, keyword, expression. Fixed values.
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", r"rights to use copy modify merge publish distribute sublicense"),
    ("isc", "with or without fee", r"permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "contributors may be used", r"neither the name of .{1,80} nor the names of its contributors may be used"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "free software", r"this program is free software you can redistribute it (?:and or|and) modify it"),
    ("lgpl", "free software", r"this library is free software you can redistribute it (?:and or|and) modify it"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("bsl-1.0", "obtaining a copy of the software", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("wtfpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies"),
    ("public-domain", "public domain", r"(?:released into|placed in|dedicated to) the public domain"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution) of this (?:file|software) .{0,60}is strictly prohibited"),
]

#: A text without any of these goes through no rule; every rule's and phrase's match holds one. Fixed values.
GATE = ["licen", "clause", "cc0", "bsd", "creative", "cc", "attribution", "reserved", "hereby", "without", "redistribution", "contributors", "advertising", "free", "implied", "software", "altered", "form", "permitted", "domain", "proprietary", "unauthorized"]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    score: float


#: Words one of which every form of a license's name holds; by label or its part before the first hyphen. Fixed values.
_KEYWORDS = {
    "agpl": ("affero",), "lgpl": ("lesser general", "library general"), "gpl": ("general public",), "apache": ("apache",), "bsd": ("bsd",),
    "bsd-0-clause": ("bsd", "free public"), "mit-0": ("no attribution",), "mpl": ("mozilla",), "epl": ("eclipse",), "edl": ("eclipse",), "cddl": ("common development",),
    "cpl": ("common public",), "isc": ("isc",), "zlib": ("zlib",), "bsl": ("boost",), "busl": ("business source",), "unlicense": ("unlicense",), "wtfpl": ("do what the",),
    "artistic": ("artistic",), "psf": ("python",), "php": ("php",), "ofl": ("font",), "eupl": ("european",), "osl": ("open software",), "afl": ("academic",),
    "ms": ("microsoft",), "ncsa": ("illinois",), "openssl": ("openssl",), "postgresql": ("postgresql",), "vim": ("vim",), "ruby": ("ruby",), "odbl": ("database",),
    "odc": ("commons attribution",), "gfdl": ("documentation",), "cc0": ("cc0", "creative commons zero"), "cc": ("cc by", "cc attribution", "creative commons"),
    "mit": ("mit", "expat", "x11"), "proprietary": ("rights reserved",),
}


def _keywords(label: str) -> tuple[str, ...]:
    return _KEYWORDS.get(label) or _KEYWORDS[label.split("-")[0]]


def rules() -> list[Rule]:
    """All rules in order of priority: tags, the licenses' own sentences, then wordings by how telling they are, then names."""
    found = [(0.98, label, ("spdx license identifier",), rf"spdx license identifier {tag}") for tag, label in TAGS.items()]
    found += [(0.9, label, (keyword,), pattern) for label, keyword, pattern in SENTENCES]
    found += [(0.7, label, ("license",), rf"license(?:s)? {tag}") for tag, label in TAGS.items()]
    found += [(score, label, _keywords(label), wording.format(name)) for score, wording in WORDINGS for label, name in NAMES]
    return [Rule(i, label, keywords, rf"(?<![^ ]){pattern}(?![^ ])", score) for i, (score, label, keywords, pattern) in enumerate(found)]


_DETECTION = "struct<start:int,stop:int,priority:int,label:string,score:double>"
_FOUND = f"array<{_DETECTION}>"
def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements of an array that one fold's state gathers.
FOLD = 256


def _named(value: str, name: str, then: str) -> str:
    """``then`` with ``value`` under a name, so that it is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _blocks(items: str) -> str:
    """An array in blocks of ``FOLD``; an empty one has one empty block."""
    return _named(items, "all_", f"transform(sequence(0, greatest(size(all_) - 1, 0) div {FOLD}), i_ -> slice(all_, CAST(i_ * {FOLD} + 1 AS INT), {FOLD}))")


def _detections(text: str) -> Column:
    """Every match of every rule in a column of words joined by blanks, as places of characters."""
    table = ",".join(
        f"named_struct('p',{r.priority},'l',{_sql(r.label)},'k',array({','.join(map(_sql, r.keywords))}),'x',{_sql(r.pattern)},'s',{r.score}D)" for r in rules()
    )
    # a match starts where the text between matches, and the matches, before it end: one running sum
    gaps, sizes = f"transform(split({text}, r.x, -1), g -> length(g))", f"transform(regexp_extract_all({text}, r.x, 0), m -> length(m))"
    cut = f"zip_with({gaps}, {sizes}, (g, n) -> named_struct('gap', g, 'n', n))"
    # a fold's state is copied at each step: it grows within a block only, and blocks begin where those before them end
    sums = "transform(w, b -> aggregate(b, 0, (s, e) -> s + e.gap + coalesce(e.n, 0)))"
    offsets = f"aggregate({sums}, named_struct('at', 0, 'all', CAST(array() AS array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'all', concat(acc.all, array(acc.at))), acc -> acc.all)"
    inner = "aggregate(b, named_struct('at', o, 'all', CAST(array() AS array<int>)), (acc, e) -> named_struct('at', acc.at + e.gap + coalesce(e.n, 0), 'all', concat(acc.all, array(acc.at + e.gap))), acc -> acc.all)"
    starts = _named(_blocks(cut), "w", f"flatten(zip_with(w, {offsets}, (b, o) -> {inner}))")
    placed = f"zip_with({starts}, {sizes}, (s, n) -> named_struct('start', s, 'n', n))"
    return F.expr(
        f"flatten(transform(filter(array({table}), r -> exists(r.k, k -> contains({text}, k)) AND {text} RLIKE r.x), r -> "
        f"transform(filter({placed}, d -> d.n IS NOT NULL), d -> "
        "named_struct('start', d.start, 'stop', d.start + d.n, 'priority', r.p, 'label', r.l, 'score', r.s))))"
    ).cast(_FOUND)


def _sorted(found: str) -> Column:
    """By start, longer ones first, then by priority."""
    order = f"array_sort(transform({found}, d -> named_struct('start', d.start, 'back', -d.stop, 'priority', d.priority, 'label', d.label, 'score', d.score)))"
    return F.expr(f"transform({order}, d -> named_struct('start', d.start, 'stop', -d.back, 'priority', d.priority, 'label', d.label, 'score', d.score))").cast(_FOUND)


def _settled(found: str) -> Column:
    """Suppress detections of a sorted list that lie within others or lose an overlap: one walk that compares with the last one kept.

    The walk's state is the last one's place, end and priority, and the places of those before it that stay, gathered block by block.
    """
    last = "named_struct('at', i.at, 'stop', i.stop, 'priority', i.priority, 'kept', {})"
    walk = f"""aggregate(b, named_struct('at', acc.at, 'stop', acc.stop, 'priority', acc.priority, 'kept', CAST(array() AS array<int>)),
          (acc, i) -> CASE
            WHEN acc.at < 0 THEN {last.format('acc.kept')}
            WHEN i.start >= acc.stop THEN {last.format('concat(acc.kept, array(acc.at))')}
            WHEN i.stop <= acc.stop OR acc.priority < i.priority THEN acc
            ELSE {last.format('acc.kept')} END)"""
    step = _named(walk, "r", "named_struct('at', r.at, 'stop', r.stop, 'priority', r.priority, 'kept', concat(acc.kept, array(r.kept)))")
    items = f"transform({found}, (d, at) -> named_struct('at', at, 'start', d.start, 'stop', d.stop, 'priority', d.priority))"
    return F.expr(
        f"""transform(aggregate({_blocks(items)}, named_struct('at', -1, 'stop', 0, 'priority', 0, 'kept', CAST(array() AS array<array<int>>)), (acc, b) -> {step},
          acc -> CASE WHEN acc.at < 0 THEN flatten(acc.kept) ELSE concat(flatten(acc.kept), array(acc.at)) END), at -> element_at({found}, at + 1))"""
    ).cast(_FOUND)


def _places(phrase: str) -> Column:
    """Word places where a phrase's words stand consecutively, in an array column ``words``."""
    words = phrase.split(" ")
    here = " AND ".join(f"element_at(words, i + {k + 1}) = {_sql(w)}" for k, w in enumerate(words))
    n = len(words)
    return F.when(
        F.expr(f"size(words) >= {n}") & F.contains("line", F.lit(phrase)),
        F.expr(f"filter(sequence(0, size(words) - {n}), i -> {here})"),
    ).otherwise(F.expr("CAST(array() AS array<int>)"))


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``df``: base places and all settled detections.

    ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)``.
    Words are runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased.
    ``labels`` joins the base labels and those of the detections that stay, sorted;
    ``score`` is the best score of these (0 without any; base places count as 0.6);
    ``detections`` has places in characters of the words joined by blanks.  Null texts
    count as empty: no words, empty labels, null places.
    """
    lower = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(F.col("lower"), F.lit(word.split(" ")[0]))
    words = df.select(F.col(id_col).alias("id"), lower.alias("lower")).select(
        "id", gate.alias("gate"), F.expr(r"regexp_extract_all(lower, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)").alias("words")
    )
    lines = words.select("id", "words", F.when(F.col("gate"), F.array_join("words", " ")).otherwise(F.lit("")).alias("line"))
    nothing = F.expr(f"CAST(array() AS {_FOUND})")
    seen = lines.select(
        "id", F.size("words").cast("bigint").alias("n_words"),
        *[F.when(F.col("line") != "", _places(p)).otherwise(F.expr("CAST(array() AS array<int>)")).alias(f"at{i}") for i, (p, _) in enumerate(PHRASES)],
        F.when(F.col("line") != "", _detections("line")).otherwise(nothing).alias("found"),
    )
    seen = seen.withColumn("found", F.when(F.size("found") > 0, _sorted("found")).otherwise(nothing))
    kept = seen.withColumn("detections", F.when(F.size("found") > 0, _settled("found")).otherwise(nothing))
    at = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return kept.select(
        F.col("id").alias(id_col), "n_words", F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"), F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.size(at) > 0, 0.6).otherwise(0.0)
        ).alias("score"),
        "detections",
    )
