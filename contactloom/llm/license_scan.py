"""License detection with ordered signature rules, all in DataFrame expressions.

The text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``;
rules are regular expressions over the words joined by single blanks. Rules are
grouped by a keyword that every match contains from the start of a word on. A text without any of a few
anchors skips all rules; else each group's keyword is looked for once, and only
the rules of groups whose keyword occurs run their regular expression.

Overlapping detections are resolved by priority and containment: a detection
inside the interval of one with a higher priority, or inside a longer one of the
same priority, is dropped. Base detections (``base`` rules) always stay.

No shuffle, no Python: a row in, a row out.

Defined results: a null text counts as empty; an empty text has no words, no
detections and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Parts of Creative Commons' full names.
_SA, _NC, _ND = "share ?alike", "non ?commercial", "no ?deriv(ative(s| works)?|s)"

#: Families: label, keyword, name as a pattern over words, versions as patterns.
#: A name may be followed by "license", and a version by nothing else.
FAMILIES = (
    ("apache", "apache", "apache( software)?", ("1 0", "1 1", "2( 0)?")),
    ("mit", "mit", "(the )?mit( x11)?", ()),
    ("bsd", "bsd", "((original|modified|simplified|new|berkeley) )*bsd", ("[0234] clause", "zero clause")),
    ("gpl", "gpl", "(gnu )?gpl", ("v?1( 0)?", "v?2( 0)?", "v?3( 0)?")),
    ("gpl", "general public", "(gnu )?general public", ("version [123]( 0)?",)),
    ("lgpl", "lgpl", "(gnu )?lgpl", ("v?2( 0)?", "v?2 1", "v?3( 0)?")),
    ("lgpl", "lesser general", "(gnu )?lesser general public", ("version 2 1", "version 3( 0)?")),
    ("agpl", "agpl", "(gnu )?agpl", ("v?3( 0)?",)),
    ("agpl", "affero", "(gnu )?affero general public", ("version 3( 0)?",)),
    ("mpl", "mpl", "mpl", ("1 [01]", "2( 0)?")),
    ("mpl", "mozilla", "mozilla public", ("version 1 [01]", "version 2( 0)?", "v?2( 0)?")),
    ("epl", "eclipse", "eclipse public", ("version [12]( 0)?", "v?[12]( 0)?")),
    ("cddl", "cddl", "cddl", ("1 [01]",)),
    ("cddl", "common development", "common development and distribution", ("version 1 [01]",)),
    ("artistic", "artistic", "artistic", ("[12] 0", "version 2( 0)?")),
    ("zlib", "zlib", "zlib( libpng)?", ()),
    ("boost", "boost", "boost software", ("1 0", "version 1 0")),
    ("isc", "isc", "isc", ()),
    ("unlicense", "unlicense", "(the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("version 2",)),
    ("eupl", "european union", "european union public", ("v?1 [012]",)),
    ("ofl", "open font", "(sil )?open font", ("1 [01]", "version 1 1")),
    ("odbl", "open data", "open (data commons )?database", ("v?1 0",)),
    ("php", "php", "php", ("3 0[01]?",)),
    ("python", "python", "python( software foundation)?", ("2( 0)?",)),
    ("ms-pl", "microsoft", "microsoft (public|reciprocal)", ()),
    ("cc-by", "cc by", "cc by", ("[1234] [05]",)),
    ("cc-by-sa", "cc by sa", "cc by sa", ("[1234] [05]",)),
    ("cc-by-nc", "cc by nc", "cc by nc", ("[1234] [05]",)),
    ("cc-by-nd", "cc by nd", "cc by nd", ("[1234] [05]",)),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ("[1234] [05]",)),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ("[1234] [05]",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by", "creative commons", "creative commons attribution", ("[1234] [05]( international| unported)?",)),
    ("cc-by-sa", "creative commons", f"creative commons attribution {_SA}", ("[1234] [05]( international| unported)?",)),
    ("cc-by-nc", "creative commons", f"creative commons attribution {_NC}", ("[1234] [05]( international| unported)?",)),
    ("cc-by-nd", "creative commons", f"creative commons attribution {_ND}", ("[1234] [05]( international| unported)?",)),
    ("cc-by-nc-sa", "creative commons", f"creative commons attribution {_NC} {_SA}", ("[1234] [05]( international| unported)?",)),
    ("cc-by-nc-nd", "creative commons", f"creative commons attribution ({_NC} {_ND}|{_ND} {_NC})", ("[1234] [05]( international| unported)?",)),
    ("cc0", "creative commons", "creative commons (zero|cc0)", ("v?1 0( universal)?",)),
)

#: Ways in which a family is named: priority, text before, must "license" follow, text after.
FORMS = (
    (4, "spdx licen[sc]e identifier ", False, "( only| or later)?"),
    (3, "(is |are |be )?(re)?(licensed|released|distributed|available|published|provided) under (the )?(terms of )?(the |an? )?", False, "( licen[sc]e)?"),
    (3, "under the (terms|conditions|provisions) of (the |an? )?", False, "( licen[sc]e)?"),
    (3, "subject to (the terms of )?(the |an? )?", True, ""),
    (2, "", True, ""),
)

#: Notices that name no family: priority, label, keyword, pattern.
NOTICES = (
    (2, "reserved", "rights reserved", "(some|no) rights reserved"),
    (2, "public-domain", "public domain", "(dedicated to|placed in(to)?|released into|in) the public domain"),
    (2, "permissive", "permission is hereby", "permission is hereby granted free of charge to any person"),
    (2, "permissive", "permission to use", "permission to use copy modify and( or)? distribute this software"),
    (2, "permissive", "redistribution and use", "redistribution and use in source and binary forms"),
    (2, "warranty", "without warranty", "(provided as is )?without warranty of any kind( express or implied)?"),
    (2, "warranty", "as is", "(the )?software is provided as is"),
    (2, "proprietary", "proprietary", "(confidential and proprietary|proprietary and confidential)"),
    (2, "proprietary", "unauthorized copying", "unauthorized copying (of this|or distribution)"),
    (1, "copyright", "copyright", "copyright( c)?( (19|20)[0-9][0-9])+"),
    (1, "license", "see license", "see license( txt| md)? (file )?for"),
    (1, "license", "see the license", "see the license for"),
)

#: Every match of every default rule holds one of these inside a word.
ANCHORS = (
    "licen", "under", "reserved", "cc", "domain", "permission", "redistribution", "warranty", "provided", "proprietary", "unauthorized",
    "copyright",
)

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]++"
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]++"
_ON, _OFF = "\x01", "\x02"
_SPAN = "struct<first:int,last:int,priority:int,label:string,base:boolean>"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """Whole words only; group 1 is the detection."""
        return f"(?<![^ ])({self.pattern})(?![^ ])"


def default_rules() -> list[Rule]:
    """Base phrases, every form of every family with and without each version, and the notices."""
    out = [Rule(5, label, phrase, phrase, True) for phrase, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        for priority, before, needs, after in FORMS:
            end = " licen[sc]e" if needs else after
            out.append(Rule(priority, label, keyword, f"{before}{name}{end}"))
            for v in versions:
                out.append(Rule(priority + 1 if not before else priority, label, keyword, f"{before}{name}( licen[sc]e)?( version)? {v}" if not needs else f"{before}{name} licen[sc]e( version)? {v}"))
    out += [Rule(p, label, keyword, pattern) for p, label, keyword, pattern in NOTICES]
    return out


def words(text: Column) -> Column:
    """The words, joined by single blanks."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, F.lit(_SEPARATORS), F.lit(" ")))


def _spans(norm: Column, rule: Column) -> Column:
    """The detections of one rule: word numbers of the first word and after the last."""
    marked = F.split(F.regexp_replace(norm, rule["regex"], F.lit(f"{_ON}$1{_OFF}")), " ", -1)
    at = F.transform(marked, lambda w, i: F.struct(i.alias("i"), F.startswith(w, F.lit(_ON)).alias("on"), F.endswith(w, F.lit(_OFF)).alias("off")))
    first = F.transform(F.filter(at, lambda x: x["on"]), lambda x: x["i"])
    last = F.transform(F.filter(at, lambda x: x["off"]), lambda x: x["i"] + 1)
    return F.zip_with(
        first,
        last,
        lambda a, b: F.struct(
            a.alias("first"), b.alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base")
        ),
    )


def _groups(rules: list[Rule]) -> Column:
    """The rules by keyword, as one literal."""
    by: dict[str, list[Column]] = {}
    for r in rules:
        rule = F.struct(F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.base).alias("base"))
        by.setdefault(r.keyword, []).append(rule)
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*rs).alias("rules")) for k, rs in by.items()])


def _resolved(spans: Column, levels: list[int]) -> Column:
    """Drops contained detections. In order of start (longest first), a detection is
    inside an earlier one exactly if the furthest end so far reaches its own end.
    Equal detections follow each other there, and the first one stays."""
    order = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("neg"), (-s["priority"]).alias("rank"), s["label"].alias("label"), (~s["base"]).alias("method")),
        )
    )
    state = F.struct(
        *[F.lit(0).alias(f"e{p}") for p in levels],
        F.lit(0).alias("covered"),
        F.lit(0).alias("end"),
        F.lit(None).cast("struct<first:int,neg:int,rank:int,label:string,method:boolean>").alias("former"),
        F.array().cast(f"array<{_SPAN}>").alias("kept"),
    )

    def step(acc: Column, s: Column) -> Column:
        last, priority = -s["neg"], -s["rank"]
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((priority <= p) & (acc[f"e{p}"] >= last))
        keep = (~s["method"] | ~inside) & ~s.eqNullSafe(acc["former"])
        span = F.struct(s["first"].alias("first"), last.alias("last"), priority.alias("priority"), s["label"].alias("label"), (~s["method"]).alias("base"))
        return F.struct(
            *[F.when(priority == p, F.greatest(acc[f"e{p}"], last)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels],
            (acc["covered"] + F.greatest(F.lit(0), last - F.greatest(s["first"], acc["end"]))).alias("covered"),
            F.greatest(acc["end"], last).alias("end"),
            s.alias("former"),
            F.when(keep, F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(order, state, step)


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, detections (first, last, priority, label, base) and score of each row.

    The score is the part of the words that lies inside any detection.
    """
    rules = default_rules() if rules is None else rules
    groups, levels = _groups(rules), sorted({r.priority for r in rules}, reverse=True)
    empty = F.array().cast(f"array<{_SPAN}>")
    lower = F.lower(F.col(text))  # may change other letters too, but only to look for anchors
    maybe = reduce(lambda x, y: x | y, [F.contains(lower, F.lit(k)) for k in ANCHORS]) if rules == default_rules() else F.lit(True)
    rows = docs.select(
        *[F.col(c) for c in carry],
        F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.when(F.coalesce(maybe, F.lit(False)), words(F.col(text))).alias("norm"),
    )
    norm = F.col("norm")
    found = F.transform(
        F.filter(groups, lambda g: F.contains(F.concat(F.lit(" "), norm), F.concat(F.lit(" "), g["keyword"]))),
        lambda g: F.flatten(F.transform(F.filter(g["rules"], lambda r: F.rlike(norm, r["regex"])), lambda r: _spans(norm, r))),
    )
    rows = rows.withColumn("found", F.when(norm.isNotNull(), F.flatten(found)).otherwise(empty))
    rows = rows.withColumn("out", F.when(F.size("found") > 0, _resolved(F.col("found"), levels)))
    return rows.select(
        *carry,
        "n_words",
        F.coalesce("out.kept", F.array().cast(f"array<{_SPAN}>")).alias("detections"),
        F.coalesce(F.col("out.covered") / F.col("n_words"), F.lit(0.0)).alias("score"),
    )


def digest(scanned: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and labels of the contract from the detections."""
    base = F.filter("detections", lambda d: d["base"])
    names = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda d: d["label"]))))
    return scanned.select(
        *carry,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("detections")).alias("labels"),
        "score",
    )
