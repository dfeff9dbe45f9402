"""Licence scan by sentence rules.

A text is normalised (lower case, only letters and digits) with marks where a
sentence or line may end; a known licence sentence starts after a mark and may run
over marks (wrapped lines, 'free software: you can', 'v. 2.0'), but not over a blank
line. The ordered list of their identifiers, the text's signature, is matched
against rules: a rule fires where its identifiers occur in that order, with no
other licence sentence between them.

``op5_sql`` cuts at every line and sentence end, so it agrees where no known
sentence runs over one.

All in-row SQL on every text: no shuffle, no Python. The sentence table and the
rules are fixed and small, so they travel inside the plan.

Edge cases: NULL and empty texts and texts without a known sentence give no
rows; repeated rows give repeated results; a rule that occurs several times in
a text is reported once with its count; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEADS = ("licensed under", "released under", "distributed under", "this project is licensed under", "this work is licensed under", "this software is licensed under")


def _notices(*names: str) -> list[str]:
    return [f"{lead} {name}" for lead in _LEADS for name in names]


def _gnu_header(kind: str, version: str) -> list[str]:
    """First sentence of the GNU headers up to the version."""
    return [f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind} license as published by the free software foundation {either}version {version} of the license*" for what in ("program", "library") for either in ("either ", "")]


def _cc(short: str, *long: str) -> list[str]:
    return _notices(f"cc {short} 4 0", f"the cc {short} 4 0 license", *[f"a creative commons attribution {x} 4 0 international license*" for x in long])


#: Identifier -> normalised sentence, or its start where it ends in '*'.
SENTENCES = {
    "mit-name": ["mit license", "the mit license", "the mit license mit"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files*"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied*"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability*"],
    "apache2-notice": ["licensed under the apache license version 2 0*", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at*"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis*"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3*", "licensed under the gnu general public license version 3*", "released under the gnu general public license version 3*"],
    "gpl2-notice": _notices("the gnu general public license version 2*", "the gnu general public license v2*", "the gnu gpl v2*", "the gpl v2*"),
    "lgpl21-notice": _notices("the gnu lesser general public license version 2 1*", "the gnu lesser general public license v2 1*", "the gnu lgpl v2 1*", "the lgpl v2 1*"),
    "lgpl3-notice": _notices("the gnu lesser general public license version 3*", "the gnu lesser general public license v3*", "the gnu lgpl v3*", "the lgpl v3*"),
    "agpl3-notice": _notices("the gnu affero general public license version 3*", "the gnu affero general public license v3*", "the gnu agpl v3*", "the agpl v3*"),
    "gpl3-redistribute": _gnu_header("general public", "3"),
    "gpl2-redistribute": _gnu_header("general public", "2"),
    "lgpl21-redistribute": _gnu_header("lesser general public", "2 1"),
    "lgpl3-redistribute": _gnu_header("lesser general public", "3"),
    "agpl3-redistribute": _gnu_header("affero general public", "3"),
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license*"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty*", "this library is distributed in the hope that it will be useful but without any warranty*"],
    "lgpl-copy": ["you should have received a copy of the gnu lesser general public license along with this*"],
    "agpl-copy": ["you should have received a copy of the gnu affero general public license along with this*"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program*"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met*"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products*"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is*"],
    "isc-name": ["isc license", "the isc license"],
    "isc-notice": _notices("the isc license"),
    "isc-grant": [f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("or ", "")],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties*", "the software is provided as is and isc disclaims all warranties*"],
    "ccbyncsa4-notice": _cc("by nc sa", "noncommercial sharealike", "non commercial share alike"),
    "ccbyncnd4-notice": _cc("by nc nd", "noncommercial noderivatives", "non commercial no derivatives"),
    "ccbync4-notice": _cc("by nc", "noncommercial", "non commercial"),
    "ccbynd4-notice": _cc("by nd", "noderivatives", "no derivatives"),
    "ccby4-notice": ["this work is licensed under a creative commons attribution 4 0 international license*", "licensed under cc by 4 0"],
    "ccbysa4-notice": ["this work is licensed under a creative commons attribution sharealike 4 0 international license*", "licensed under cc by sa 4 0"],
    "cc0-notice": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work*"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0*"],
    "unlicense-notice": ["this is free and unencumbered software released into the public domain"],
    "all-rights-reserved": ["all rights reserved"],
    "copyright": ["copyright c*", "copyright 1*", "copyright 2*"],
}

#: Fixed values: (rule, licence, identifiers in order).
RULES = (
    ("mit-full", "MIT", ("mit-grant", "mit-condition", "as-is", "mit-liability")),
    ("mit-short-grant", "MIT", ("mit-grant", "mit-condition")),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-name", "MIT", ("mit-name",)),
    ("apache2-header", "Apache-2.0", ("apache2-notice", "apache2-use", "apache2-copy", "apache2-as-is")),
    ("apache2-notice", "Apache-2.0", ("apache2-notice",)),
    ("gpl3-header", "GPL-3.0", ("gpl3-redistribute", "gpl-warranty", "gpl-copy")),
    ("gpl3-notice", "GPL-3.0", ("gpl3-notice",)),
    ("gpl2-header", "GPL-2.0", ("gpl2-redistribute", "gpl-warranty", "gpl-copy")),
    ("gpl2-notice", "GPL-2.0", ("gpl2-notice",)),
    ("gpl-header", "GPL", ("gpl-redistribute", "gpl-warranty", "gpl-copy")),
    ("lgpl21-header", "LGPL-2.1", ("lgpl21-redistribute", "gpl-warranty", "lgpl-copy")),
    ("lgpl21-notice", "LGPL-2.1", ("lgpl21-notice",)),
    ("lgpl3-header", "LGPL-3.0", ("lgpl3-redistribute", "gpl-warranty", "lgpl-copy")),
    ("lgpl3-notice", "LGPL-3.0", ("lgpl3-notice",)),
    ("agpl3-header", "AGPL-3.0", ("agpl3-redistribute", "gpl-warranty", "agpl-copy")),
    ("agpl3-notice", "AGPL-3.0", ("agpl3-notice",)),
    ("isc-full", "ISC", ("isc-grant", "isc-as-is")),
    ("isc-notice", "ISC", ("isc-notice",)),
    ("isc-name", "ISC", ("isc-name",)),
    ("bsd3-full", "BSD-3-Clause", ("bsd-redistribute", "bsd-endorse", "bsd-as-is")),
    ("bsd2-full", "BSD-2-Clause", ("bsd-redistribute", "bsd-as-is")),
    ("ccby4-notice", "CC-BY-4.0", ("ccby4-notice",)),
    ("ccbysa4-notice", "CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("ccbync4-notice", "CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("ccbynd4-notice", "CC-BY-ND-4.0", ("ccbynd4-notice",)),
    ("ccbyncsa4-notice", "CC-BY-NC-SA-4.0", ("ccbyncsa4-notice",)),
    ("ccbyncnd4-notice", "CC-BY-NC-ND-4.0", ("ccbyncnd4-notice",)),
    ("cc0-notice", "CC0-1.0", ("cc0-notice",)),
    ("mpl2-notice", "MPL-2.0", ("mpl2-notice",)),
    ("unlicense-notice", "Unlicense", ("unlicense-notice",)),
    ("all-rights-reserved", "proprietary", ("all-rights-reserved",)),
)


def _triggers() -> tuple[str, ...]:
    """Words such that every known sentence holds one: the longest word of each
    sentence that holds none yet, shorter sentences first. Texts without any are
    skipped whole."""
    out: list[str] = []
    for form in sorted((f.rstrip("* ") for forms in SENTENCES.values() for f in forms), key=lambda f: (len(f.split()), f)):
        if not any(t in form for t in out):
            out.append(max(form.split(), key=len))
    return tuple(out)


TRIGGERS = _triggers()


def _tables() -> tuple[dict[str, str], list[tuple[str, str]]]:
    exact, prefix = {}, []
    for ident, forms in SENTENCES.items():
        for form in forms:
            if form.endswith("*"):
                prefix.append((form[:-1].strip(), ident))
            else:
                exact[form] = ident
    return exact, prefix


def _pattern(identifiers: tuple[str, ...]) -> str:
    return " " + "  ".join(identifiers) + " "


def _marked(text: Column) -> Column:
    """Words of a lower-case text between single spaces; '|' where a line ends or
    one of . ! ? ; : stands before white space, '#' for blank lines and the ends."""
    t = F.regexp_replace(text, r"[.!?;:][ \t]+", "\u0001")
    t = F.regexp_replace(t, "[^a-z0-9\n\u0001]+", " ")
    t = F.regexp_replace(t, "[ \u0001]*\n[ \u0001]*\n[ \n\u0001]*", " # ")
    t = F.regexp_replace(t, "[ \n\u0001]*[\n\u0001][ \n\u0001]*", " | ")
    return F.concat(F.lit("# "), F.trim(t), F.lit(" #"))


def _identifiers(marked: Column) -> Column:
    """Identifiers of the known sentences in order; the longest counts where several start."""
    exact, prefix = _tables()
    ident = {**dict(prefix), **exact}
    forms = [(f, " [|#]") for f in exact] + [(f, "") for f, _ in prefix]
    forms.sort(key=lambda x: -len(x[0]))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(ident.items())])
    any_form = "|".join(f.replace(" ", "(?: [|])? ") + (f"(?={end})" if end else "") for f, end in forms)
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[|#] )(?:{any_form})"), F.lit(0))
    return F.transform(found, lambda x: F.element_at(known, F.replace(x, F.lit(" |"), F.lit(""))))


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, license, rule, n_matches, signature): a row for each rule that
    fires and is not part of a longer rule of the same licence that fires too."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("_t"))
    trigger = F.col("_t").contains(TRIGGERS[0])
    for t in TRIGGERS[1:]:
        trigger = trigger | F.col("_t").contains(t)
    d = d.filter(trigger).select("doc_id", _identifiers(_marked(F.col("_t"))).alias("_ids")).filter(F.size("_ids") > 0)
    # two spaces between identifiers, one at each end of a pattern: equal
    # patterns side by side do not share a space
    d = d.select("doc_id", F.concat(F.lit("  "), F.array_join("_ids", "  "), F.lit("  ")).alias("_sig"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"), F.lit(_pattern(seq)).alias("pattern")) for name, lic, seq in RULES])
    d = d.withColumn("_fired", F.filter(rules, lambda r: F.col("_sig").contains(r["pattern"])))
    longest = F.filter("_fired", lambda r: ~F.exists("_fired", lambda o: (o["license"] == r["license"]) & (o["pattern"] != r["pattern"]) & o["pattern"].contains(r["pattern"])))
    d = d.select("doc_id", "_sig", F.explode(longest).alias("r"))
    left = F.length(F.replace("_sig", F.col("r.pattern"), F.lit("")))
    n = (F.length("_sig") - left) / F.length("r.pattern")
    signature = F.trim(F.replace("_sig", F.lit("  "), F.lit(" ")))
    return d.select("doc_id", F.col("r.license").alias("license"), F.col("r.rule").alias("rule"), n.cast("long").alias("n_matches"), signature.alias("signature"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op5_sql() -> str:
    """DuckDB SQL for ``license_scan`` over ``documents``."""
    exact, prefix = _tables()
    cases = [f"WHEN s = {_quoted(f)} THEN {_quoted(i)}" for f, i in exact.items()]
    cases += [f"WHEN starts_with(s, {_quoted(f)}) THEN {_quoted(i)}" for f, i in prefix]
    rules = ", ".join(f"({_quoted(n)}, {_quoted(lic)}, {_quoted(_pattern(seq))})" for n, lic, seq in RULES)
    return rf"""
WITH s AS (
  SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS raw,
         generate_subscripts(string_split(regexp_replace(lower(text), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)), 1) AS pos,
         rid
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
n AS (SELECT doc_id, rid, pos, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM s),
i AS (SELECT doc_id, rid, pos, CASE {' '.join(cases)} END AS ident FROM n),
g AS (SELECT any_value(doc_id) AS doc_id, rid, '  ' || string_agg(ident, '  ' ORDER BY pos) || '  ' AS sig FROM i WHERE ident IS NOT NULL GROUP BY rid),
r AS (SELECT * FROM (VALUES {rules}) AS v(rule, license, pattern)),
f AS (SELECT g.*, r.* FROM g JOIN r ON contains(g.sig, r.pattern))
SELECT doc_id, license, rule,
       ((length(sig) - length(replace(sig, pattern, ''))) / length(pattern))::BIGINT AS n_matches,
       trim(replace(sig, '  ', ' ')) AS signature
FROM f
WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.rid = f.rid AND o.license = f.license AND o.pattern <> f.pattern AND contains(o.pattern, f.pattern))
"""
