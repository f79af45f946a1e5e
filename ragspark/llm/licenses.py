"""Licence scans by sentence rules, in DataFrame operations only.

A text is normalised to words and the ends of sentences, and sentences that are
known licence sentences become identifiers. The identifiers of a document, in
order, are matched against ordered rules; the first rule that holds for a
licence names it. No Python runs on the executors.

Full stops, exclamation and question marks before white space, and blank lines
are hard ends: no sentence goes on over them. Line ends, colons and semicolons
are soft: a sentence may begin and end there, and may as well go on, so notices
that are wrapped at some column, with or without comment marks, are found as
those on one line are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import table

#: Normalised sentences of public licences and notices, by identifier.
SENTENCES = (
    ("MIT_NAME", "the mit license"),
    ("MIT_NAME", "mit license"),
    ("MIT_NOTICE", "released under the mit license"),
    ("MIT_NOTICE", "licensed under the mit license"),
    ("MIT_NOTICE", "this project is licensed under the mit license"),
    ("MIT_NOTICE", "distributed under the mit license"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT_KEEP", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AS_IS", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("APACHE_NAME", "apache license version 2 0"),
    ("APACHE_NOTICE", "licensed under the apache license version 2 0"),
    ("APACHE_NOTICE", "licensed under the apache license version 2 0 the license"),
    ("APACHE_COMPLY", "you may not use this file except in compliance with the license"),
    ("APACHE_COPY", "you may obtain a copy of the license at"),
    ("GPL3_NOTICE", "this work is licensed under the gnu general public license version 3"),
    ("GPL3_NOTICE", "licensed under the gnu general public license version 3"),
    ("GPL2_NOTICE", "licensed under the gnu general public license version 2"),
    ("GPL_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL_HOPE", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("LGPL_NOTICE", "licensed under the gnu lesser general public license version 3"),
    ("AGPL_NOTICE", "licensed under the gnu affero general public license version 3"),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD_ENDORSE", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_ENDORSE", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AS_IS_BSD", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("MPL_NOTICE", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("CC0_NOTICE", "licensed under cc0 1 0"),
    ("CC_BY_NOTICE", "licensed under cc by 4 0"),
    ("CC_BY_SA_NOTICE", "licensed under cc by sa 4 0"),
    ("CC_BY_NC_NOTICE", "licensed under cc by nc 4 0"),
    ("CC_BY_NC_SA_NOTICE", "licensed under cc by nc sa 4 0"),
    ("CC_BY_ND_NOTICE", "licensed under cc by nd 4 0"),
)

#: Fixed values: (licence, identifiers that must follow one another in a document, others may stand between).
RULES = (
    ("MIT", ("MIT_GRANT", "MIT_KEEP", "AS_IS")),
    ("MIT", ("MIT_GRANT",)),
    ("MIT", ("MIT_NOTICE",)),
    ("MIT", ("MIT_NAME",)),
    ("ISC", ("ISC_GRANT",)),
    ("Apache-2.0", ("APACHE_NOTICE", "APACHE_COMPLY", "APACHE_COPY")),
    ("Apache-2.0", ("APACHE_NOTICE",)),
    ("Apache-2.0", ("APACHE_NAME",)),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_HOPE")),
    ("GPL-3.0-or-later", ("GPL_FREE",)),
    ("GPL-3.0", ("GPL3_NOTICE",)),
    ("GPL-2.0-or-later", ("GPL2_FREE",)),
    ("GPL-2.0", ("GPL2_NOTICE",)),
    ("LGPL-3.0", ("LGPL_NOTICE",)),
    ("AGPL-3.0", ("AGPL_NOTICE",)),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("MPL-2.0", ("MPL_NOTICE",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC0-1.0", ("CC0_NOTICE",)),
    ("CC-BY-4.0", ("CC_BY_NOTICE",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_NOTICE",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_NOTICE",)),
    ("CC-BY-NC-SA-4.0", ("CC_BY_NC_SA_NOTICE",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_NOTICE",)),
)

#: Licences that are not reported beside another whose rules hold all their sentences and more.
SUPERSEDED = (("BSD-2-Clause", "BSD-3-Clause"),)


def spdx_sentences(rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> tuple[tuple[str, str], ...]:
    """The tag lines of the rules' licences: "SPDX-License-Identifier: MIT" is a sentence with the identifier SPDX_MIT."""
    names = dict.fromkeys(name for name, _ in rules)
    forms = [(n, f) for n in names for f in ([n, f"{n}-only"] if n in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0") else [n])]
    return tuple((f"SPDX_{n}", f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', f.lower())}") for n, f in forms)


def spdx_rules(rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((name, (f"SPDX_{name}",)) for name in dict.fromkeys(name for name, _ in rules))


ALL_SENTENCES, ALL_RULES = (*SENTENCES, *spdx_sentences()), (*RULES, *spdx_rules())

#: How a lower-cased text is normalised, in this order: what is replaced by what. A hard end is written twice, so is a
#: soft one, that one sentence may end and the next begin at it.
HARD, SOFT = "\x01", "\x02"
STEPS = (
    (r"\bv\. ?([0-9])", r"v \1"),
    (r"[.!?][\"')\]]*[ \t\r\n]", HARD),
    (rf"\n[^a-z0-9\n{HARD}]*\n", HARD),
    (r"[\n\r:;]", SOFT),
    (rf"[^a-z0-9{HARD}{SOFT}]+", " "),
    (rf" ?{SOFT}[ {SOFT}]*", SOFT),
    (rf"[ {SOFT}]?{HARD}[ {HARD}{SOFT}]*", HARD),
    (SOFT, SOFT * 2),
    (HARD, HARD * 2),
)


def normalised(lowered: Column) -> Column:
    """Words with one space between, HARD and SOFT ends twice; ends stand at both ends of the text."""
    out = F.concat(F.lit("\n\n"), lowered, F.lit("\n\n"))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return out


def sentence_pattern(known: Iterable[str]) -> str:
    """Matches any known sentence with an end before and after it, a longer one first."""
    one = "|".join(s.replace(" ", f"(?: |{SOFT * 2})") for s in sorted(known, key=lambda s: (-len(s), s)))
    return f"[{HARD}{SOFT}](?:{one})[{HARD}{SOFT}]"


def _rule_sql(ids: Sequence[str]) -> str:
    """LIKE pattern of a rule over the identifiers written ``|A|B|``."""
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    sentences: Sequence[tuple[str, str]] = ALL_SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = ALL_RULES,
    superseded: Sequence[tuple[str, str]] = SUPERSEDED,
) -> DataFrame:
    """One row per (document, licence): ``key``, ``license``, ``rule``, ``sentence_ids``, ``n_sentences``.

    ``rule`` is the first rule, from 1 in the given order, that holds for the
    licence; ``sentence_ids`` has the document's identifiers in text order with
    repeats, ``n_sentences`` their number. Of each pair in ``superseded`` the
    first licence is left out where the second is found. A document is one row
    of ``docs``; its identifiers are made within the row, so rows with equal or
    null keys stay apart and nothing is shuffled. Null, empty and licence-free
    texts give no row. Whole texts are read. Other columns do not matter.
    """
    known = {}
    for name, sentence in sentences:
        known.setdefault(sentence, name)
    # Normalising leaves words as they are, so whatever holds no hint is spared the rest.
    hinted = docs.select(F.col(key), F.lower(F.col(text)).alias("_lower")).filter(F.col("_lower").rlike(_hint(known)))
    found = F.regexp_extract_all(normalised(F.col("_lower")), F.lit(sentence_pattern(known)), F.lit(0))
    plain = F.transform(found, lambda s: F.trim(F.regexp_replace(s, f"[{HARD}{SOFT}]+", " ")))

    def identified(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in sorted(set(known.values())):
            out = F.when(s.isin([k for k, v in known.items() if v == name]), F.lit(name)).otherwise(out)
        return out

    identities = (
        hinted.select(key, F.transform(plain, identified).alias("_ids"))
        .filter(F.size("_ids") > 0)
        .select(key, F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|")).alias("_path"),
                F.array_join("_ids", ",").alias("sentence_ids"), F.size("_ids").cast("long").alias("n_sentences"))
    )
    first = {}
    for licence in dict.fromkeys(name for name, _ in rules):
        first[licence] = F.lit(None).cast("int")
        for k, (name, wanted) in reversed(list(enumerate(rules, 1))):
            if name == licence:
                first[licence] = F.when(F.col("_path").like(_rule_sql(wanted)), F.lit(k)).otherwise(first[licence])
    hits = []
    for licence, rule in first.items():
        for less, more in superseded:
            if licence == less and more in first:
                rule = F.when(first[more].isNull(), rule)
        hits.append(F.struct(F.lit(licence).alias("license"), rule.alias("rule")))
    return (
        identities.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h.getField("rule").isNotNull())))
        .select(key, F.col("_hit.license").alias("license"), F.col("_hit.rule").alias("rule"), "sentence_ids", "n_sentences")
    )


def _hint(known: dict[str, str]) -> str:
    """A cheap pattern that every raw form of a known sentence holds: its longest word."""
    return "|".join(sorted({max(s.split(), key=lambda w: (len(w), w)) for s in known}))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _values(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _normal_sql(text: str) -> str:
    out = f"chr(10) || chr(10) || {text} || chr(10) || chr(10)"
    for pattern, by in STEPS:
        new = " || ".join(f"chr({ord(c)})" for c in by) if by[0] in (HARD, SOFT) else f"'{by}'"
        out = f"regexp_replace({out}, {_pattern_sql(pattern)}, {new}, 'g')"
    return out


def _pattern_sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace(HARD, r"\x01").replace(SOFT, r"\x02") + "'"


#: RE2 has no need of the hint; the result is the same without it.
OP8_SQL = f"""
WITH known(id, sentence) AS (VALUES {_values(ALL_SENTENCES)}),
rules(rule, license, pattern) AS (VALUES {_values([(k, n, _rule_sql(w)) for k, (n, w) in enumerate(ALL_RULES, 1)])}),
superseded(less, more) AS (VALUES {_values(SUPERSEDED)}),
cut AS (
  SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all({_normal_sql("lower(text)")}, {_pattern_sql(sentence_pattern({s for _, s in ALL_SENTENCES}))}) AS parts FROM documents)
),
found AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS sentence_ids,
    '|' || string_agg(id, '||' ORDER BY pos) || '|' AS path, count(*) AS n_sentences
  FROM (SELECT doc_id, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS n FROM cut) JOIN known ON n = sentence
  GROUP BY doc_id
),
held AS (
  SELECT doc_id, license, min(rule)::int AS rule, sentence_ids, n_sentences::bigint AS n_sentences
  FROM found JOIN rules ON path LIKE pattern
  GROUP BY ALL
)
SELECT * FROM held
WHERE NOT EXISTS (SELECT 1 FROM superseded JOIN held AS other ON other.license = more WHERE less = held.license AND other.doc_id = held.doc_id)
"""
