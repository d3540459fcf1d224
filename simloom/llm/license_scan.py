"""License detection by ordered signature rules, in DataFrame expressions only.

A text becomes lower-case words. Words such as ``license``, ``spdx``, ``gpl``,
``permission`` or ``redistribution`` are anchors; the words around an anchor
form its context, and a marker stands before the anchor itself. Two kinds of
rules look at contexts: names in a form (``licensed under the N``, ``N license
version 2``, SPDX lines), made for every family, and hand-written signatures of
license bodies, file headers and notices, which need no license word. Every
rule has a keyword (a form is a rule for each of its keywords, which cover all
its alternatives), a regular expression over the context that contains the
marker, a label, a priority and its place in the order. The keyword prefilter
is an equi-join between the context's words and the rule table, so a regular
expression runs only where its keyword stands. Detections are word intervals;
one that lies inside an interval of a rule of the same or a better priority is
suppressed.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS = (
    "license", "licence", "licensed", "licenced", "licenses", "licences", "licensing", "spdx", "copyleft", "permission", "redistribution", "redistributions", "redistribute",
    "advertising", "endorse", "compliance", "gpl", "gplv1", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3", "mpl", "wtfpl", "warranty", "warranties",
    "domain", "unencumbered", "waived", "reserved", "copyrighted",
)
GATE = r"(?i)licen[sc]|spdx|copyleft|permission|redistribut|advertising|endorse|compliance|gpl|mpl|wtfpl|warrant|domain|unencumbered|waived|reserved|copyrighted"
BEFORE, AFTER = 16, 22
MARK = "@"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases: the words before ``license`` and the label.
BASE = ((("mit",), "mit"), (("apache",), "apache"), (("general", "public"), "gpl"))

# Label, keywords of which every name holds one, name of the license as words, SPDX short names as words.
FAMILIES = (
    ("0bsd", "0bsd zero", r"0bsd|zero clause bsd", r"0bsd"),
    ("afl", "academic", r"academic free", r"afl (?:1|2|3) \d"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"agpl (?:1|3) 0(?: only| or later)?"),
    ("apache", "apache", r"apache(?: software)?(?: foundation)?", r"apache (?:1|2) \d"),
    ("apsl", "apple", r"apple public source", r"apsl (?:1|2) \d"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"artistic (?:1|2) 0(?: perl| cl8)?"),
    ("beerware", "beer beerware", r"beer ware|beerware", r"beerware"),
    ("blueoak", "blue", r"blue oak model", r"blueoak 1 0 0"),
    ("bsd-2", "clause simplified freebsd", r"(?:2|two) clause bsd|simplified bsd|bsd 2 clause|freebsd", r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3", "clause new modified revised", r"(?:3|three) clause bsd|new bsd|modified bsd|revised bsd|bsd 3 clause", r"bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4", "clause original", r"(?:4|four) clause bsd|original bsd|bsd 4 clause", r"bsd 4 clause(?: uc)?"),
    ("bsd", "bsd berkeley", r"bsd(?: style)?|berkeley software distribution", r"bsd"),
    ("bsl", "boost", r"boost software", r"bsl 1 0"),
    ("busl", "business", r"business source", r"busl 1 1"),
    ("cc-by", "cc commons", r"cc by|creative commons attribution", r"cc by (?:1|2|3|4) \d"),
    ("cc-by-nc", "nc commons", r"cc by nc|creative commons attribution non ?commercial", r"cc by nc (?:1|2|3|4) \d"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd", r"cc by nc nd (?:1|2|3|4) \d"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa", r"cc by nc sa (?:1|2|3|4) \d"),
    ("cc-by-nd", "nd commons", r"cc by nd|creative commons attribution no ?deriv\w*", r"cc by nd (?:1|2|3|4) \d"),
    ("cc-by-sa", "sa commons", r"cc by sa|creative commons attribution share ?alike", r"cc by sa (?:1|2|3|4) \d"),
    ("cc0", "cc0 zero", r"cc0|creative commons zero", r"cc0 1 0"),
    ("creative-commons", "commons", r"creative commons(?: attribution)?", r"creativecommons"),
    ("cddl", "cddl development", r"cddl|common development and distribution", r"cddl 1 \d"),
    ("cecill", "cecill", r"cecill(?: [bc])?", r"cecill (?:1|2) \d|cecill [bc]"),
    ("cpal", "cpal attribution", r"cpal|common public attribution", r"cpal 1 0"),
    ("cpl", "common", r"common public", r"cpl 1 0"),
    ("ecl", "educational", r"educational community", r"ecl (?:1|2) 0"),
    ("edl", "eclipse", r"eclipse distribution", r"edl 1 0"),
    ("efl", "eiffel", r"eiffel forum", r"efl (?:1|2) 0"),
    ("epl", "eclipse", r"eclipse public", r"epl (?:1|2) 0"),
    ("eupl", "european", r"european union public", r"eupl 1 [012]"),
    ("fdl", "documentation", r"(?:gnu )?free documentation", r"gfdl 1 [123](?: only| or later)?"),
    ("gpl", "general", r"(?:gnu )?general public", r"gpl (?:1|2|3) 0(?: only| or later)?"),
    ("gpl-short", "gpl gplv1 gplv2 gplv3 gpl1 gpl2 gpl3", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?", r"gpl ?v?[123]"),
    ("isc", "isc internet", r"isc|internet systems consortium", r"isc"),
    ("json", "json", r"json", r"json"),
    ("lgpl", "lesser library", r"(?:gnu )?(?:lesser|library) general public", r"lgpl (?:2|3) [01](?: only| or later)?"),
    ("lgpl-short", "lgpl lgplv2 lgplv3 lgpl2 lgpl3", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?", r"lgpl ?v?[23]"),
    ("lppl", "latex", r"latex project public", r"lppl 1 \d[abc]?"),
    ("mit", "mit expat", r"mit|expat", r"mit(?: 0| cmu| modern variant)?"),
    ("mpl", "mozilla", r"mozilla public", r"mpl (?:1|2) \d"),
    ("mpl-short", "mpl mplv1 mplv2 mpl1 mpl2", r"mpl(?: ?v?[12](?: \d)?)?", r"mpl"),
    ("ms-pl", "microsoft", r"microsoft public", r"ms pl"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal", r"ms rl"),
    ("mulan", "mulan", r"mulan(?: permissive software)?", r"mulanpsl (?:1|2) 0"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)?(?: open source)?", r"ncsa"),
    ("nasa", "nasa", r"nasa open source", r"nasa 1 3"),
    ("npl", "netscape", r"netscape public", r"npl 1 [01]"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database", r"odbl 1 0"),
    ("ofl", "font", r"(?:sil )?open font", r"ofl 1 [01]"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("osl", "open", r"open software", r"osl (?:1|2|3) \d"),
    ("php", "php", r"php", r"php 3 0\d?"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("psf", "python", r"python(?: software foundation)?", r"psf 2 0|python 2 0"),
    ("qpl", "qt q", r"qt? public|q public", r"qpl 1 0"),
    ("rpl", "reciprocal", r"reciprocal public", r"rpl 1 [15]"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("sleepycat", "sleepycat", r"sleepycat", r"sleepycat"),
    ("sspl", "server", r"server side public", r"sspl 1 0"),
    ("unicode", "unicode", r"unicode", r"unicode dfs 201[56]|unicode 3 0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("upl", "universal", r"universal permissive", r"upl 1 0"),
    ("vim", "vim", r"vim", r"vim"),
    ("w3c", "w3c", r"w3c(?: software)?", r"w3c(?: 20150513)?"),
    ("wtfpl", "wtfpl want", r"wtfpl|do what the f\w* you want to public", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("zpl", "zope", r"zope public", r"zpl (?:1|2) \d"),
)
# Label, priority, keyword and signature of license bodies, file headers and notices.
NOTICES = (
    ("mit", 1, "hereby", r"@permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 2, "substantial", r"above copyright notice and this @permission notice shall be included in all copies or substantial portions"),
    ("bsl", 1, "organization", r"@permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", 1, "fee", r"@permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee"),
    ("hpnd", 1, "fee", r"@permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: is hereby granted)? without fee"),
    ("ofl", 1, "font", r"@permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("unicode", 1, "data", r"@permission is hereby granted free of charge to any person obtaining a copy of(?: the)? (?:unicode )?data files"),
    ("bsd", 1, "binary", r"@redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "retain", r"@redistributions of source code must retain the(?: above)? copyright notice"),
    ("bsd", 2, "reproduce", r"@redistributions in binary form must reproduce the(?: above)? copyright notice"),
    ("bsd-3", 1, "endorse", r"(?:names? of (?:its|the|any) (?:\w+ ){0,4})?may (?:not )?be used to @endorse or promote products derived"),
    ("bsd-4", 1, "advertising", r"all @advertising materials mentioning features or use of this software must display"),
    ("apache", 1, "compliance", r"you may not use this file except in @compliance with the license"),
    ("apache", 2, "agreed", r"unless required by applicable law or agreed to in writing software distributed under the @license is distributed"),
    ("gpl", 1, "redistribute", r"(?:is free software )?you can @redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 1, "lesser", r"you can @redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", 1, "library", r"you can @redistribute it and or modify it under the terms of the gnu library general public license"),
    ("agpl", 1, "affero", r"you can @redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, "hope", r"distributed in the hope that it will be useful but without any @warranty"),
    ("gpl", 1, "gpl", r"(?:released|distributed|available|published|provided|covered|is) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@gpl(?: v?(?:ersion )?[123](?: 0)?)?(?: only| or later)?"),
    ("gpl", 1, "gplv1", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@gplv1(?: only| or later)?"),
    ("gpl", 1, "gplv2", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@gplv2(?: only| or later)?"),
    ("gpl", 1, "gplv3", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@gplv3(?: only| or later)?"),
    ("gpl", 2, "gpl", r"version [123](?: 0)? (?:or later )?of the (?:gnu )?@gpl"),
    ("gpl", 3, "gnu", r"gnu @gpl(?: v?(?:ersion )?[123])?"),
    ("gpl", 3, "gplv2", r"@gplv2(?: only| or later)?"),
    ("gpl", 3, "gplv3", r"@gplv3(?: only| or later)?"),
    ("lgpl", 1, "lgpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@lgpl(?: v?(?:ersion )?[23](?: [01])?)?(?: only| or later)?"),
    ("lgpl", 3, "lgplv2", r"@lgplv2(?: [01])?(?: only| or later)?"),
    ("lgpl", 3, "lgplv3", r"@lgplv3(?: only| or later)?"),
    ("agpl", 1, "agpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@agpl(?: v?(?:ersion )?3(?: 0)?)?(?: only| or later)?"),
    ("agpl", 3, "agplv3", r"@agplv3(?: only| or later)?"),
    ("mpl", 1, "mpl", r"under (?:the )?(?:terms of )?(?:the )?@mpl(?: v?[12](?: \d)?)?"),
    ("mpl", 1, "incompatible", r"incompatible with secondary @licenses"),
    ("zlib", 1, "express", r"provided as is without any express or implied @warranty in no event will the authors be held liable"),
    ("zlib", 2, "restrictions", r"alter it and @redistribute it freely subject to the following restrictions"),
    ("wtfpl", 1, "wtfpl", r"under (?:the )?(?:terms of )?(?:the )?@wtfpl"),
    ("unlicense", 1, "unencumbered", r"this is free and @unencumbered software released into the public domain"),
    ("public-domain", 1, "public", r"(?:released|dedicated|placed|put|committed)(?: \w+){0,4} (?:in|into|to) the public @domain"),
    ("public-domain", 2, "public", r"(?:is|are) (?:hereby )?(?:in )?(?:the )?public @domain"),
    ("cc0", 1, "extent", r"to the extent possible under law(?: \w+){0,8} @waived all copyright"),
    ("cc0", 2, "neighboring", r"@waived all copyright and related or neighboring rights"),
    ("openssl", 1, "whatsoever", r"@redistributions of any form whatsoever must retain the following acknowledg\w+"),
    ("php", 2, "php", r"@redistribution(?:s)? (?:\w+ ){1,12}php"),
    ("copyleft", 3, "copyleft", r"(?:strong |weak |partial )?@copyleft"),
    ("copyrighted", 3, "rights", r"all rights @reserved"),
    ("copyrighted", 3, "copyrighted", r"(?:is|are) @copyrighted (?:by|material|\d{4})"),
    ("no-warranty", 3, "conditions", r"without @warranties or conditions of any kind"),
    ("no-warranty", 3, "without", r"without @warranty of any kind"),
    ("no-warranty", 3, "without", r"without any @warranty"),
    ("no-warranty", 3, "implied", r"express or implied @warranties"),
    ("no-warranty", 3, "implied", r"implied @warranties of merchantability"),
    ("no-warranty", 3, "absolutely", r"absolutely no @warranty"),
)
#: Priority and pattern of each form a license is named in; N is the name, S the SPDX short name.
FORMS = (
    (1, r"@spdx license identifier (?:S)"),
    (1, r"(?:@licen[sc]ed|released|distributed|available|published|provided|covered|redistribut\w+) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:N)(?: (?:public )?@?licen[sc]e)?(?: version [1-4](?: [0-9])?| v?[1-4](?: [0-9])?)?"),
    (2, r"(?:N) @licen[sc]es?(?: version [1-4](?: [0-9])?| v[1-4](?: [0-9])?)?"),
    (3, r"@licen[sc](?:e|ed|es|ing)(?: (?:is|type|name|under|the|a|by|terms)){0,3} (?:N)"),
)


@cache
def rules() -> tuple[tuple[int, int, str, str, str], ...]:
    """(order, priority, label, keyword, pattern): every form of every family in the given order, then the signatures.

    A form is one rule for each keyword; where several stand, the second detection lies inside the first.
    """
    out = []
    for label, keywords, name, short in FAMILIES:
        for priority, form in FORMS:
            spdx = "(?:S)" in form
            body = form.replace("(?:N)", f"(?:{name})").replace("(?:S)", f"(?:{short})")
            # A context word may carry the marker (the anchor); names hold no anchor words.
            for word in ["identifier"] if spdx else keywords.split(" "):
                out.append((len(out), priority, label.removesuffix("-short"), word, f"(?:^| ){body}(?= |$)"))
    for label, priority, word, body in NOTICES:
        out.append((len(out), priority, label, word, f"(?:^| ){body}(?= |$)"))
    return tuple(out)


def _rule_table(spark: SparkSession) -> DataFrame:
    rows = [(o, p, lab, k, rx) for o, p, lab, k, rx in rules()]
    return F.broadcast(spark.createDataFrame(rows, "rule int, priority int, label string, keyword string, pattern string"))


def _is_any(word: Column, values) -> Column:
    return word.isin(*values)


def scan(docs: DataFrame, with_detections: bool = False) -> DataFrame:
    """Per row of ``docs``: word count, base places and labels, all labels, score.

    ``score`` is the share of the words that lie in unsuppressed detections,
    at most 1. Null and empty texts have no words, no labels and score 0;
    every row gives a row, whatever its doc_id; other columns are ignored.
    With ``with_detections`` the unsuppressed detections themselves come as a
    list of (start, end, label, priority, rule).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.regexp_count("t", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(F.col("t").rlike(GATE), F.split(F.trim(F.regexp_replace(F.translate("t", UPPER, LOWER), SEPARATOR, " ")), " ")).alias("w"),
    )
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: _is_any(F.get("w", i), ANCHORS))
    anchored = base.select("rid", "doc_id", "n_words", "w", F.explode_outer(F.when(F.col("w").isNotNull(), places)).alias("p"))
    before = F.slice("w", F.greatest(F.lit(1), F.col("p") + 1 - BEFORE), F.least(F.lit(BEFORE), F.col("p")))
    after = F.slice("w", F.col("p") + 1, AFTER)
    ends = lambda ws: F.lit(True) if not ws else (F.get("w", F.col("p") - len(ws)) == ws[0]) & ends(ws[1:])
    label = place = F.lit(None)
    for ws, name in BASE:
        hit = (F.get("w", F.col("p")) == "license") & (F.col("p") >= len(ws)) & ends(ws)
        label, place = F.when(hit, F.lit(name)).otherwise(label), F.when(hit, F.col("p") - len(ws)).otherwise(place)
    near = anchored.select(
        "rid", "doc_id", "n_words", "p",
        F.when(F.col("p").isNotNull(), F.array_join(F.concat(before, F.array(F.concat(F.lit(MARK), F.get("w", F.col("p")))), F.slice(after, 2, AFTER)), " ")).alias("ctx"),
        label.alias("base_label"), place.cast("long").alias("base_at"),
        F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(F.concat(before, after), F.array().cast("array<string>")))).alias("kws"),
    )
    keywords = sorted({k for _, _, _, k, _ in rules()})
    known = F.array(F.lit(""), *map(F.lit, keywords))
    gated = near.withColumn("keyword", F.explode(F.array_intersect(F.col("kws"), known))).drop("kws")
    hits = gated.join(_rule_table(spark), "keyword", "left")
    found = F.expr("regexp_extract(ctx, pattern, 0)")
    hits = hits.select("rid", "doc_id", "n_words", "p", "keyword", "base_label", "base_at", "rule", "priority", "label", F.trim(F.coalesce(found, F.lit(""))).alias("m"))
    hits = hits.where((F.col("keyword") == "") | (F.col("m") != ""))
    # The marker's word stands at p; words of the match before it lead back to the start.
    lead = F.size(F.split(F.substring_index("m", MARK, 1), " ")) - 1
    start = F.when(F.col("m") != "", F.col("p") - lead).cast("long")
    hits = hits.withColumn("start", start).withColumn("end", F.col("start") + F.size(F.split("m", " ")))
    order = Window.partitionBy("rid").orderBy(F.col("start"), F.col("end").desc(), F.col("priority"), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    reach = {k: F.max(F.when(F.col("priority") <= k, F.col("end"))).over(order) for k in (1, 2, 3)}
    covered = F.when(F.col("priority") == 1, reach[1]).when(F.col("priority") == 2, reach[2]).otherwise(reach[3])
    judged = hits.withColumn("alive", F.col("start").isNotNull() & (F.coalesce(covered, F.lit(-1)) < F.col("end")))
    anchor, alive = F.col("keyword") == "", F.col("alive")
    labels = lambda c: F.array_join(F.array_sort(c), ",")
    aggs = [
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(anchor, F.col("base_label"))).alias("n_base"),
        F.min("base_at").alias("first_word"),
        F.max("base_at").alias("last_word"),
        F.collect_set("base_label").alias("b"),
        F.collect_set(F.when(alive, F.col("label"))).alias("a"),
        F.sum(F.when(alive, F.col("end") - F.col("start"))).alias("inside"),
    ]
    if with_detections:
        aggs.append(F.array_sort(F.collect_list(F.when(alive, F.struct("start", "end", "label", "priority", "rule")))).alias("detections"))
    out = judged.groupBy("rid").agg(*aggs)
    score = F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.coalesce("inside", F.lit(0)) / F.col("n_words"))).otherwise(0.0)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", labels(F.col("b")).alias("base_labels"),
        labels(F.array_union("a", "b")).alias("labels"), F.round(score, 6).alias("score"), *(["detections"] if with_detections else []),
    )


def oracle_sql() -> str:
    """The same result in DuckDB: rules as VALUES, contexts as lists."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({o}, {p}, {q(lab)}, {q(k)}, {q(rx.replace('(?= |$)', '( |$)'))})" for o, p, lab, k, rx in rules())
    keywords = ", ".join(q(k) for k in sorted({k for _, _, _, k, _ in rules()}))
    anchors = ", ".join(map(q, ANCHORS))
    return rf"""
WITH rules(rule, priority, label, keyword, pattern) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
a AS (SELECT rid, w, unnest(range(0, len(w))) AS p FROM d),
n AS (SELECT rid, p, w[p+1] AS word, w[p] AS w1, CASE WHEN p >= 2 THEN w[p-1] END AS w2,
      w[greatest(1, p+1-{BEFORE}):p] AS bef, w[p+1:p+{AFTER}] AS aft FROM a WHERE w[p+1] IN ({anchors})),
c AS (SELECT *, array_to_string(list_concat(list_concat(bef, ['{MARK}' || word]), aft[2:]), ' ') AS ctx,
      CASE WHEN word = 'license' AND w1 = 'mit' AND p >= 1 THEN 'mit' WHEN word = 'license' AND w1 = 'apache' AND p >= 1 THEN 'apache'
           WHEN word = 'license' AND w1 = 'public' AND w2 = 'general' THEN 'gpl' END AS base_label FROM n),
b AS (SELECT rid, count(base_label) AS n_base, min(CASE WHEN base_label = 'gpl' THEN p - 2 WHEN base_label IS NOT NULL THEN p - 1 END) AS first_word,
      max(CASE WHEN base_label = 'gpl' THEN p - 2 WHEN base_label IS NOT NULL THEN p - 1 END) AS last_word, list(DISTINCT base_label) FILTER (WHERE base_label IS NOT NULL) AS bl FROM c GROUP BY rid),
h AS (SELECT c.rid, c.p, r.rule, r.priority, r.label, trim(regexp_extract(ctx, r.pattern, 0)) AS m
      FROM (SELECT *, unnest(list_distinct(list_concat(bef, aft))) AS keyword FROM c) c JOIN rules r USING (keyword)),
s AS (SELECT *, p - (len(string_split(m[:position('{MARK}' IN m) - 1], ' ')) - 1) AS st FROM h WHERE m <> ''),
e AS (SELECT *, st + len(string_split(m, ' ')) AS en FROM s),
k AS (SELECT *, coalesce(CASE WHEN priority = 1 THEN max(CASE WHEN priority <= 1 THEN en END) OVER o WHEN priority = 2 THEN max(CASE WHEN priority <= 2 THEN en END) OVER o
      ELSE max(en) OVER o END, -1) < en AS alive FROM e
      WINDOW o AS (PARTITION BY rid ORDER BY st, en DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rid, list(DISTINCT label) AS al, sum(en - st) AS inside FROM k WHERE alive GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(al, []), coalesce(bl, [])))), ','), '') AS labels,
       CASE WHEN len(w) > 0 THEN round(least(1.0::DOUBLE, coalesce(inside, 0)::DOUBLE / len(w)), 6) ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)"""
