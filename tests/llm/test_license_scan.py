import re

import oracle
from simloom.llm import license_scan, queries

SF = "/root/testdata/sf0.001"


def test_rules_are_ordered_and_many():
    rules = license_scan.rules()
    assert len(rules) >= 200 and [r[0] for r in rules] == list(range(len(rules)))


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "!!! \n"), (4, "MIT License"), (5, "mit license mit license"), (6, "the GNU General Public License, version 3."),
        (7, "Licensed under CC BY-NC 4.0."), (8, "Licensed under the Apache License, Version 2.0."), (9, "smit license"), (10, "license mit"),
        (11, "SPDX-License-Identifier: BSD-3-Clause"), (12, "word " * 20000 + "apache license"), (None, "mit license"), (4, "MIT License"), (13, "général public license"), (14, "nothing here"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, labels int")
    got = {r.doc_id: tuple(r)[1:7] for r in license_scan.scan(df).collect()}
    assert license_scan.scan(df).count() == len(rows)
    assert got[1] == got[2] == got[3] == (0, 0, None, None, "", "")
    assert got[4] == got[None] == (2, 1, 0, 0, "mit", "mit")
    assert got[5] == (4, 2, 0, 2, "mit", "mit")
    assert got[6] == (7, 1, 2, 2, "gpl", "gpl")
    assert got[7][1:] == (0, None, None, "", "cc-by-nc")
    assert got[8] == (8, 1, 3, 3, "apache", "apache")
    assert got[9][4] == "" and got[14] == (2, 0, None, None, "", "")
    assert got[10][1] == 0 and got[10][5] == "mit"
    assert got[11][5] == "bsd-3"
    assert got[12] == (20002, 1, 20000, 20000, "apache", "apache")
    assert got[13][4] == ""
    assert license_scan.scan(df.limit(0)).count() == 0


def test_containment_suppresses(spark):
    df = spark.createDataFrame([(1, "released under the apache license version 2 0")], "doc_id long, text string")
    found = license_scan.scan(df, with_detections=True).first().detections
    assert [(d.start, d.end, d.label, d.priority) for d in found] == [(0, 8, "apache", 1)]


def test_against_sql(spark):
    oracle.compare(spark, oracle.connect(SF), queries.op3_license_scan, license_scan.oracle_sql(), SF)


def spelled(pattern):
    """Every text a rule's pattern stands for; of digits 1 and 4, of \\w* none and two letters."""
    from re import _constants as c
    from re import _parser

    def of(items):
        out = [""]
        for op, arg in items:
            if op is c.LITERAL:
                more = [chr(arg)]
            elif op is c.IN:
                more = [x for o, a in arg for x in ([chr(a)] if o is c.LITERAL else map(chr, range(a[0], a[1] + 1)) if o is c.RANGE else ["1", "4"] if a is c.CATEGORY_DIGIT else ["a"])]
            elif op is c.BRANCH:
                more = [x for a in arg[1] for x in of(a)]
            elif op is c.SUBPATTERN:
                more = of(arg[3])
            elif op is c.MAX_REPEAT:
                more = ["", *(x * (1 if arg[1] == 1 else 2) for x in of(arg[2]))]
            else:
                raise AssertionError(op)
            out = [x + y for x in out for y in more]
        return out

    return sorted(set(of(_parser.parse(pattern))))


def test_every_alternative_is_found(spark):
    """No keyword gate may keep a text from a rule whose pattern it matches; of families with the same name the first counts."""
    first = {}
    for label, _, name, short in license_scan.FAMILIES:
        texts = [f for x in spelled(name) for f in (f"{x} license", f"licensed under {x}", f"license {x}")] + [f"SPDX-License-Identifier: {x}" for x in spelled(short)]
        for t in texts:
            first.setdefault(t, label.removesuffix("-short"))
    cases = [(i, label, t) for i, (t, label) in enumerate(first.items())]
    assert len(cases) > 500 and all(re.search(r"\w", t) for *_, t in cases)
    df = spark.createDataFrame([(i, t) for i, _, t in cases], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(df).collect()}
    assert [(t, label, got[i]) for i, label, t in cases if label not in got[i]] == []


def test_every_signature_is_found(spark):
    cases = []
    for label, _, word, body in license_scan.NOTICES:
        texts = [t.replace("@", "") for t in spelled(body) if re.fullmatch(body, t)]
        assert texts and "@" in body and all(word in t.split(" ") for t in texts), (word, body)
        cases += [(label, f"some words {t} and more") for t in texts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(df).collect()}
    assert len(cases) > 150 and [(t, label, got[i]) for i, (label, t) in enumerate(cases) if label not in got[i]] == []


def test_license_bodies(spark):
    rows = [
        ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("bsd,bsd-3", "Redistributions of source code must retain the above copyright notice. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
        ("apache", "you may not use this file except in compliance with the License."),
        ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3"),
        ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
        ("gpl", "either version 3 of the GPL"), ("gpl", "released under GPL v3"), ("public-domain", "The author has placed this file in the public domain."),
        ("unlicense", "This is free and unencumbered software released into the public domain."), ("no-warranty", "It comes with absolutely no warranty."), ("copyrighted", "(c) 2020. All rights reserved."), ("", "with your permission we begin"),
    ]
    df = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, (labels, t) in enumerate(rows):
        assert set(filter(None, labels.split(","))) <= set(got[i].labels.split(",")), (t, got[i].labels)
        assert (got[i].score > 0) == bool(labels) and (labels or got[i].labels == "")
