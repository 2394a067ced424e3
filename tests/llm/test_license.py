"""License rules on texts made from their own patterns."""

import random
import re

from contactloom.llm import license_scan


def _sample(pattern, r):
    """A text that the pattern matches."""

    def of(parsed):
        out = ""
        for kind, value in parsed:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "SUBPATTERN":
                out += of(value[3])
            elif name == "BRANCH":
                out += of(r.choice(value[1]))
            elif name == "MAX_REPEAT":
                out += "".join(of(value[2]) for _ in range(r.randint(value[0], min(value[1], 2))))
            else:
                assert name == "IN", name
                one, what = r.choice(value)
                out += chr(what if str(one) == "LITERAL" else r.randint(*what))
        return out

    return of(re._parser.parse(pattern))


def _whole(spark, texts):
    """The labels of the detections that cover each text."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    return [{d.label for d in rows[i].detections if (d.first, d.last) == (0, rows[i].n_words)} for i in range(len(texts))]


def test_every_rule_finds_its_own_samples(spark):
    r = random.Random(5)
    made = [(x, _sample(x.pattern, r)) for x in license_scan.default_rules() for _ in range(8)]
    found = _whole(spark, [text for _, text in made])
    assert [(x, text) for (x, text), labels in zip(made, found, strict=True) if x.label not in labels] == []
    assert [(x, text) for x, text in made if f" {x.keyword}" not in f" {text}" or not any(a in text for a in license_scan.ANCHORS)] == []


def test_full_names(spark):
    texts = {
        "Available under the Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc",
        "licensed under a Creative Commons Attribution-NonCommercial License": "cc-by-nc",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa",
        "Licensed under a Creative Commons Attribution-NoDerivatives 4.0": "cc-by-nd",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported": "cc-by-nc-nd",
        "Licensed under a Creative Commons Attribution Share Alike 3.0": "cc-by-sa",
        "Open Data Commons Database License": "odbl",
        "released under Creative Commons Zero v1.0 Universal": "cc0",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.digest(license_scan.scan(docs)).collect()
    assert {x.doc_id: x.labels for x in rows} == dict(enumerate(texts.values()))


def test_every_form_of_every_family(spark):
    r, made = random.Random(8), []
    for label, _, name, versions in license_scan.FAMILIES:
        for before in ("SPDX License Identifier ", "is licensed under the ", "under the terms of the ", "subject to the ", ""):
            for version in (None, *versions):
                made.append((label, f"{before}{_sample(name, r)}" + (" license" if "SPDX" not in before else "") + (f" {_sample(version, r)}" if version else "")))
    found = _whole(spark, [text for _, text in made])
    assert [(label, text) for (label, text), labels in zip(made, found, strict=True) if label not in labels] == []
