"""License scans: ordered signature rules over the words of a text.

A text is reduced to its lower-case words, one space apart, so layout, punctuation and version dots do not
matter.  Each rule is a regex over whole words with a keyword, a label and a priority; it runs only where its
keyword stands in the text, and no rule runs on a text without any license vocabulary.  Overlaps are settled
by containment: a detection inside the span of one with higher priority is dropped ("apache license" inside
"licensed under the apache license version 2 0").  The base phrases always count for the base columns and
their labels.

Everything is column expressions on the row: no Python on the executors, no shuffle, no join.

Defined cases: a null or empty text, or one without words, has zero counts, null places, empty labels and
score 0; repeated rows and null doc_ids are judged one by one; other columns are not read; very long texts
are scanned whole, in time linear in the words for each rule that matches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Licenses by the names texts use: label, name as a regex over words, one word every mention holds.
NAMES = (
    ("mit", r"(mit|expat)", "mit"), ("isc", r"isc", "isc"), ("apache-1.1", r"apache( software)? license (version )?1 1", "apache"),
    ("apache-2.0", r"apache( software)?( license)?( version| v)? ?2( 0)?", "apache"), ("bsd-2-clause", r"(bsd 2 clause|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", r"(bsd 3 clause|new bsd|modified bsd|revised bsd)", "bsd"), ("bsd-4-clause", r"(bsd 4 clause|original bsd)", "bsd"), ("0bsd", r"(0bsd|zero clause bsd)", "bsd"),
    ("gpl-2.0", r"(gnu )?(gpl|general public license)( version| v)? ?2( 0)?", "2"), ("gpl-3.0", r"(gnu )?(gpl|general public license)( version| v)? ?3( 0)?", "3"),
    ("lgpl-2.1", r"(gnu )?(lgpl|(lesser|library) general public license)( version| v)? ?2( 1)?", "2"), ("lgpl-3.0", r"(gnu )?(lgpl|lesser general public license)( version| v)? ?3( 0)?", "3"),
    ("agpl-3.0", r"(gnu )?(agpl|affero general public license)( version| v)? ?3( 0)?", "3"), ("gfdl-1.3", r"(gnu )?(gfdl|free documentation license)( version| v)?( 1 [123])?", "d"),
    ("mpl-1.1", r"(mpl|mozilla public license)( version| v)? ?1 1", "1"), ("mpl-2.0", r"(mpl|mozilla public license)( version| v)? ?2( 0)?", "2"),
    ("epl-1.0", r"(epl|eclipse public license)( version| v)? ?1( 0)?", "1"), ("epl-2.0", r"(epl|eclipse public license)( version| v)? ?2( 0)?", "2"),
    ("cddl-1.0", r"(cddl|common development and distribution license)( version| v)?( 1 [01])?", "d"), ("cpl-1.0", r"common public license( version| v)?( 1 0)?", "common"),
    ("eupl-1.2", r"(eupl|european union public licen[cs]e)( version| v)?( 1 [12])?", "eu"), ("artistic-2.0", r"artistic license( version)?( 2( 0)?)?", "artistic"),
    ("bsl-1.0", r"boost software license( version)?( 1 0)?", "boost"), ("busl-1.1", r"business source license( version)?( 1 1)?", "business"),
    ("zlib", r"(zlib|libpng|zlib libpng)", "lib"), ("unlicense", r"unlicense", "unlicense"), ("wtfpl", r"(wtfpl|do what the fuck you want to public license)", "w"),
    ("postgresql", r"postgresql", "postgresql"), ("python-2.0", r"(psf|python software foundation)( license)?( version 2)?", "p"), ("php-3.01", r"php( license)? ?3 01", "php"),
    ("ofl-1.1", r"(sil )?(ofl|open font license)( version)?( 1 1)?", "o"), ("odbl-1.0", r"(odbl|open database license)( version)?( 1 0)?", "o"),
    ("odc-by-1.0", r"(odc by|open data commons attribution license)( version)?( 1 0)?", "o"), ("ms-pl", r"(ms pl|microsoft public license)", "m"),
    ("sspl-1.0", r"server side public license( version| v)?( 1)?", "server"), ("elastic-2.0", r"elastic license( version)?( 2( 0)?)?", "elastic"),
    ("cc0-1.0", r"(cc0|cc zero|creative commons zero)( 1 0)?( universal)?", "c"), ("openrail-m", r"(creativeml |bigscience )?open ?rail( plus plus)? m", "rail"),
)
# Ways to state one of the names: priority and pattern, {n} the name.
FORMS = (
    (3, r"spdx license identifier {n}( only| or later)?", "spdx"),
    (3, r"(licensed|released|distributed|published|provided|available|redistributed) under( the)?( terms of)?( the)?( conditions of)?( the)? {n}( licen[cs]e)?", "under"),
    (3, r"(subject to|governed by|covered by|pursuant to)( the)?( terms of)?( the)? {n}( licen[cs]e)?", ""),
    (2, r"{n} licen[cs]ed?", "licen"),
    (2, r"licen[cs]e {n}", "licen"),
    (2, r"licen[cs]es {n}", "licen"),
)
# Creative Commons: the elements after "by", and the three ways to write a license.
CC = (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?deriv(s|atives|ative works)"),
      ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(s|atives|ative works)"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Sentences of license notices, by label.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("mit", r"the above copyright notice and this permission notice shall be included", "permission"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "modify"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", r"http www apache org licenses license 2 0", "apache"),
    ("gpl", r"this program is free software you can redistribute it and or modify", "redistribute"),
    ("gpl", r"you should have received a copy of the gnu general public license", "gnu"),
    ("lgpl", r"this library is free software you can redistribute it and or modify", "redistribute"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided as is without any express or implied warranty", "warranty"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work", "deed"),
    ("public-domain", r"(dedicated to|placed in|released into|is in) the public domain", "public"),
    ("proprietary", r"all rights reserved", "reserved"),
    ("proprietary", r"(proprietary and confidential|confidential and proprietary)", "confidential"),
    ("gpl", r"gnu (gpl|general public license)", "gnu"), ("lgpl", r"(lgpl|lesser general public license)", "l"), ("agpl", r"(agpl|affero general public license)", "a"),
    ("bsd", r"bsd (style )?license", "bsd"), ("cc", r"creative commons licen[cs]e", "creative"),
)
# One of these stands in every text that a rule or a base phrase can match.
VOCABULARY = r"licen[cs]|cc[^a-z0-9]+by|cc0|cc[^a-z0-9]+zero|creative|spdx|gnu|gpl|domain|rights|under|confidential|subject|governed|covered|pursuant|permission|redistribut|unencumbered|warranty|deed"
SCORE = {3: 0.95, 2: 0.8, 1: 0.6, 0: 0.7}


def rules() -> list[dict]:
    """label, priority (0: base), keyword, regex: over words, one space apart."""
    found = [{"label": label, "priority": 0, "keyword": phrase, "regex": phrase} for phrase, label in BASE]
    for label, name, word in NAMES:
        for priority, form, keyword in FORMS:
            found.append({"label": label, "priority": priority, "keyword": max(word, keyword, key=len), "regex": form.replace("{n}", name)})
    for element, short, long in CC:
        for version in CC_VERSIONS:
            label = f"cc-{element}-{version.replace(' ', '.')}"
            found.append({"label": label, "priority": 2, "keyword": f"cc {short} {version}", "regex": f"cc {short} {version}"})
            found.append({"label": label, "priority": 3, "keyword": "creative commons", "regex": f"creative commons {long}( license)?( version)? {version}( international| unported| generic)?"})
            found.append({"label": label, "priority": 3, "keyword": "creativecommons", "regex": f"creativecommons org licenses {short} {version}"})
    found += [{"label": label, "priority": 3 if len(regex) > 45 else 1, "keyword": word, "regex": regex} for label, regex, word in NOTICES]
    return found


def _rule_array(entries: list[dict]) -> Column:
    rows = [r | {"regex": f"(?<= )({r['regex']})(?= )"} for r in entries]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,priority:int,keyword:string,regex:string>>")


def _spans(norm: Column, rule: Column) -> Column:
    """Spans of one rule in words: every match is marked and the marked words are looked up, in one pass."""
    words = F.split(F.trim(F.regexp_replace(norm, rule["regex"], F.lit("\x01$0\x02"))), " ")
    at = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("i"), F.startswith(w, F.lit("\x01")).alias("first"), F.endswith(w, F.lit("\x02")).alias("last")))
    starts = F.transform(F.filter(at, lambda x: x["first"]), lambda x: x["i"])
    ends = F.transform(F.filter(at, lambda x: x["last"]), lambda x: x["i"] + 1)
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (-e).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label")))


def scan(docs: DataFrame, entries: list[dict] | None = None) -> DataFrame:
    """One row per document: the counts and labels, and ``detections``, sorted, with what containment kept."""
    table = _rule_array(entries or rules())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id"), text.alias("_text"))
    # A generator between the steps keeps Catalyst from writing an expression out once for each use.
    low = plain.select("doc_id", F.explode(F.array(common.ascii_lower(F.col("_text")))).alias("low"))
    first, words = common.words(F.col("low"))
    low = low.select("doc_id", "low", first).select("doc_id", "low", F.size(words).cast("long").alias("n_words"))
    norm = F.when(F.col("low").rlike(VOCABULARY), F.concat(F.lit(" "), F.trim(F.regexp_replace("low", common.NON_WORD, " ")), F.lit(" ")))
    ready = low.select("doc_id", "n_words", F.explode(F.array(norm)).alias("norm"))
    matching = F.expr("filter(_rules, r -> contains(norm, r.keyword) AND norm RLIKE r.regex)")
    found = F.when(F.col("norm").isNotNull(), F.array_sort(F.flatten(F.transform("_matching", lambda r: _spans(F.col("norm"), r)))))
    ready = ready.withColumn("_rules", table).withColumn("_matching", matching)
    spans = ready.select("doc_id", "n_words", F.explode(F.array(F.coalesce(found, F.expr("cast(array() as array<struct<start:bigint,minus_end:bigint,minus_priority:int,label:string>>)")))).alias("spans"))
    return _decided(spans)


def _decided(spans: DataFrame) -> DataFrame:
    """Containment in one pass over the sorted spans: the farthest end so far, by priority above each."""
    base = F.filter("spans", lambda d: d["minus_priority"] == 0)
    start = F.expr("named_struct('far1', 0L, 'far2', 0L, 'far3', 0L, 'labels', cast(array() as array<string>), 'score', 0D)")
    covered = """
      CASE -d.minus_priority WHEN 3 THEN false WHEN 2 THEN acc.far3 >= -d.minus_end
        WHEN 1 THEN greatest(acc.far3, acc.far2) >= -d.minus_end ELSE greatest(acc.far3, acc.far2, acc.far1) >= -d.minus_end END"""
    weight = "CASE -d.minus_priority " + " ".join(f"WHEN {p} THEN {w}D" for p, w in SCORE.items()) + " END"
    kept = F.expr(f"""aggregate(spans, _start, (acc, d) -> named_struct(
        'far1', if(d.minus_priority = -1, greatest(acc.far1, -d.minus_end), acc.far1),
        'far2', if(d.minus_priority = -2, greatest(acc.far2, -d.minus_end), acc.far2),
        'far3', if(d.minus_priority = -3, greatest(acc.far3, -d.minus_end), acc.far3),
        'labels', if({covered}, acc.labels, array_union(acc.labels, array(d.label))),
        'score', if({covered}, acc.score, greatest(acc.score, {weight}))))""")
    facts = spans.withColumn("_start", start).select("doc_id", "n_words", "spans", base.alias("base"), F.explode(F.array(kept)).alias("kept"))
    base_labels = F.array_distinct(F.transform("base", lambda d: d["label"]))
    return facts.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).alias("first_word"), F.array_max(F.transform("base", lambda d: d["start"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept.labels"))), ",").alias("labels"),
        F.col("kept.score").alias("score"),
        F.transform("spans", lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"].alias("label"))).alias("detections"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("detections")
