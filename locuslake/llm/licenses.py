"""License scans by sentence rules.

A text is cut into sentences, which are normalised (comment marks, case, punctuation and white space do not
count). A sentence is mapped to the identifier of the first known sentence it matches, and one that is wrapped
over several lines also to those that only its lines together match. The identifiers, in the order of the text,
form a sequence against which ordered licence rules are matched: a rule names a run of identifiers, longer rules
come first, and what a rule has matched is replaced by a gap before the next one, so that its neighbours do not
become a run. DataFrame functions only; the SQL form is made from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and pattern of known sentences, after normalisation, tried in this order.
SENTENCES = [
    ("negated", "(^| )(not|never|no longer) (be |been )?(licensed|released|distributed|available|covered) under"),
    ("mitOrApacheRef", "under (either )?(the )?(terms of )?(either )?(of )?(the )?(mit( license)? or (the )?apache( software)?( license)?( version)?( 2 0)?|apache( software)?( license)?( version)?( 2 0)? or (the )?mit)"),
    ("spdxMitOrApache", "spdx license identifier (mit or apache 2 0|apache 2 0 or mit)$"),
    ("spdxGplClasspath", "spdx license identifier gpl 2 0 (only |or later )?with classpath exception 2 0$"),
    ("spdxApacheLlvm", "spdx license identifier apache 2 0 with llvm exception$"),
    ("mitTitle", "^(the )?mit license( mit)?$"),
    ("mitPlain", "((licensed|released|distributed) under mit|(is|are) mit licensed)$"),
    ("apacheTitle", "^apache license version 2 0 january 2004"),
    ("gpl2Title", "^gnu general public license version 2 june 1991"),
    ("gpl3Title", "^gnu general public license version 3 29 june 2007"),
    ("lgplTitle", "^gnu lesser general public license version (2 1 february 1999|3 29 june 2007)"),
    ("agplTitle", "^gnu affero general public license version 3 19 november 2007"),
    ("mplTitle", "^mozilla public license version 2 0$"),
    ("mitGrant", "^permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mitNotice", "^the above copyright notice and this permission notice"),
    ("mitWarranty", "^the software is provided as is without warranty of any kind"),
    ("mitLiability", "^in no event shall the authors or copyright holders be liable"),
    ("bsdGrant", "^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsdSource", "redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsdEndorse", "neither the name of .* may be used to endorse or promote products"),
    ("bsdWarranty", "^this software is provided by .* as is and any express or implied warranties"),
    ("apacheGrant", "licensed under the apache license version 2 0 the license"),
    ("apacheCopy", "^you may obtain a copy of the license at"),
    ("apacheWarranty", "^unless required by applicable law or agreed to in writing software"),
    ("apacheRef", "(licensed|released|distributed) under the (terms of the )?apache (software )?license version 2 0"),
    ("gplFree2", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (either )?version 2 of the license"),
    ("gplFree3", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (either )?version 3 of the license"),
    ("gplFree", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gplWarranty", "^this program is distributed in the hope that it will be useful but without any warranty"),
    ("gplCopy", "^you should have received a copy of the gnu general public license"),
    ("lgplRef", "(licensed|released|distributed) under the (terms of the )?gnu lesser general public license"),
    ("agplRef", "(licensed|released|distributed) under the (terms of the )?gnu affero general public license"),
    ("gpl3Ref", "(licensed|released|distributed) under the (terms of the )?gnu general public license (version|v) ?3"),
    ("gpl2Ref", "(licensed|released|distributed) under the (terms of the )?gnu general public license (version|v) ?2"),
    ("mplRef", "(licensed|released|distributed|subject to) (under )?(the )?(terms of the )?mozilla public license (version|v) ?2 0"),
    ("ccByNcRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) (nc|noncommercial) 4 0"),
    ("ccBySaRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) (sa|sharealike) 4 0"),
    ("ccByRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) 4 0"),
    ("iscGrant", "^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("zeroBsdGrant", "^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted$"),
    ("iscWarranty", "^the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("zlibWarranty", "^this software is provided as is without any express or implied warranty"),
    ("zlibLiability", "^in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlibGrant", "^permission is granted to anyone to use this software for any purpose"),
    ("boostGrant", "^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicenseDedication", "^in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("lgplFree", "is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agplFree", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mplForm", "^this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("eplRef", "(made available|licensed|released|distributed) under the terms of the eclipse public license (version |v )?2 0"),
    ("boostRef", "(licensed|released|distributed) under the (terms of the )?boost software license"),
    ("cc0Ref", "(licensed|released|dedicated) under (the )?(terms of the )?(cc0|creative commons zero|cc zero)"),
    ("ccByNcSaRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) (nc|noncommercial) (sa|sharealike) 4 0"),
    ("ccByNcNdRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) (nc|noncommercial) (nd|noderivatives) 4 0"),
    ("ccByNdRef", "(licensed|released) under (a )?(cc|creative commons) (by|attribution) (nd|noderivatives) 4 0"),
    ("artisticRef", "under the (terms of the )?artistic license (version )?2 0"),
    ("iscRef", "(licensed|released|distributed) under the (terms of the )?isc license"),
    ("zlibRef", "(licensed|released|distributed) under the (terms of the )?zlib license"),
    ("unlicenseRef", "(licensed|released|distributed) under the (terms of the )?unlicense"),
    ("spdxMit", "spdx license identifier mit$"),
    ("spdxApache", "spdx license identifier apache 2 0$"),
    ("spdxBsd2", "spdx license identifier bsd 2 clause$"),
    ("spdxBsd3", "spdx license identifier bsd 3 clause$"),
    ("spdxIsc", "spdx license identifier isc$"),
    ("spdxGpl2", "spdx license identifier gpl 2 0( only| or later)?$"),
    ("spdxGpl3", "spdx license identifier gpl 3 0( only| or later)?$"),
    ("spdxLgpl", "spdx license identifier lgpl [23] [01]( only| or later)?$"),
    ("spdxAgpl", "spdx license identifier agpl 3 0( only| or later)?$"),
    ("spdxMpl", "spdx license identifier mpl 2 0$"),
    ("spdxCc0", "spdx license identifier cc0 1 0$"),
    ("mitRef", "(licensed|released|distributed) under the (terms of the )?mit license"),
    ("bsdRef", "(licensed|released|distributed) under the (terms of the )?(2 clause |3 clause |new |simplified )?bsd license"),
    ("allRights", "^all rights reserved$"),
    ("copyright", "^(copyright|c) (c )?[0-9]{4}"),
]
#: Licence rules in order; a rule is a run of identifiers.
RULES = [
    ("MIT", ["mitTitle", "copyright", "mitGrant", "mitNotice", "mitWarranty", "mitLiability"]),
    ("MIT", ["mitGrant", "mitNotice", "mitWarranty", "mitLiability"]),
    ("MIT", ["mitGrant", "mitNotice", "mitWarranty"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdEndorse", "bsdWarranty"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdWarranty"]),
    ("Apache-2.0", ["apacheGrant", "apacheCopy", "apacheWarranty"]),
    ("GPL-2.0", ["gplFree", "gplFree2", "gplWarranty", "gplCopy"]),
    ("GPL-3.0", ["gplFree", "gplFree3", "gplWarranty", "gplCopy"]),
    ("GPL-2.0", ["gplFree2", "gplWarranty", "gplCopy"]),
    ("GPL-3.0", ["gplFree3", "gplWarranty", "gplCopy"]),
    ("GPL", ["gplFree", "gplWarranty", "gplCopy"]),
    ("Zlib", ["zlibWarranty", "zlibLiability", "zlibGrant"]),
    ("ISC", ["iscGrant", "iscWarranty"]),
    ("0BSD", ["zeroBsdGrant", "iscWarranty"]),
    ("GPL-2.0", ["gplFree", "gplFree2"]),
    ("GPL-3.0", ["gplFree", "gplFree3"]),
    ("GPL-2.0", ["gplFree2"]),
    ("GPL-3.0", ["gplFree3"]),
    ("GPL", ["gplFree"]),
    ("LGPL", ["lgplFree"]),
    ("AGPL", ["agplFree"]),
    ("BSL-1.0", ["boostGrant"]),
    ("Unlicense", ["unlicenseDedication"]),
    ("MPL-2.0", ["mplForm"]),
    ("Apache-2.0", ["apacheGrant"]),
    ("Apache-2.0", ["apacheRef"]),
    ("AGPL", ["agplRef"]),
    ("LGPL", ["lgplRef"]),
    ("GPL-3.0", ["gpl3Ref"]),
    ("GPL-2.0", ["gpl2Ref"]),
    ("MPL-2.0", ["mplRef"]),
    ("EPL-2.0", ["eplRef"]),
    ("BSL-1.0", ["boostRef"]),
    ("CC0-1.0", ["cc0Ref"]),
    ("CC-BY-NC-SA-4.0", ["ccByNcSaRef"]),
    ("CC-BY-NC-ND-4.0", ["ccByNcNdRef"]),
    ("CC-BY-ND-4.0", ["ccByNdRef"]),
    ("Artistic-2.0", ["artisticRef"]),
    ("ISC", ["iscRef"]),
    ("Zlib", ["zlibRef"]),
    ("Unlicense", ["unlicenseRef"]),
    ("MIT", ["spdxMit"]),
    ("Apache-2.0", ["spdxApache"]),
    ("BSD-2-Clause", ["spdxBsd2"]),
    ("BSD-3-Clause", ["spdxBsd3"]),
    ("ISC", ["spdxIsc"]),
    ("GPL-2.0", ["spdxGpl2"]),
    ("GPL-3.0", ["spdxGpl3"]),
    ("LGPL", ["spdxLgpl"]),
    ("AGPL", ["spdxAgpl"]),
    ("MPL-2.0", ["spdxMpl"]),
    ("CC0-1.0", ["spdxCc0"]),
    ("CC-BY-NC-4.0", ["ccByNcRef"]),
    ("CC-BY-SA-4.0", ["ccBySaRef"]),
    ("CC-BY-4.0", ["ccByRef"]),
    ("MIT", ["mitRef"]),
    ("BSD", ["bsdRef"]),
    ("All-Rights-Reserved", ["allRights"]),
    ("Apache-2.0 OR MIT", ["mitOrApacheRef"]),
    ("Apache-2.0 OR MIT", ["spdxMitOrApache"]),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["spdxGplClasspath"]),
    ("Apache-2.0 WITH LLVM-exception", ["spdxApacheLlvm"]),
    ("MIT", ["mitTitle"]),
    ("MIT", ["mitPlain"]),
    ("Apache-2.0", ["apacheTitle"]),
    ("GPL-2.0", ["gpl2Title"]),
    ("GPL-3.0", ["gpl3Title"]),
    ("LGPL", ["lgplTitle"]),
    ("AGPL", ["agplTitle"]),
    ("MPL-2.0", ["mplTitle"]),
]
#: Sentences with one of these look like licensing: they are 'unknown' where no known sentence matches.
HINT = "(?i)licen[sc]e|permission|redistribut|copyright|warrant|liable|all rights reserved|free software|endorse"
#: Words one of which every known sentence holds, beside those of HINT; in a text without any there is nothing to find.
GATE = f"{HINT}|released|reserved|applicable|c[^a-z0-9]+[0-9]{{4}}"
#: Steps from text to sentences and from sentence to its normal form: pattern, replacement.
#: The mark after an abbreviated 'version' ends no sentence.
VERSION = ("\\b([vV])[.]([ \\t\\r]*\\n?[ \\t]*[#*;/]*[ \\t]*)([0-9])", ("1", "2", "3"))
WRAPS = ("[ \\t\\r]*\\n[ \\t]*(?:[#*;/]+[ \\t]*)?([a-z])", " ")
ENDS = ("([.!?])[ \\t]+", "\n")
NORMAL = "[^a-z0-9]+"
#: Stands where a rule has matched.
GAP = "<>"


def sentences(text: Column) -> Column:
    """The sentences of a text. Lines that go on in lower case are joined to the one before."""
    whole = F.regexp_replace(text, VERSION[0], "".join(f"${k}" for k in VERSION[1]))
    joined = F.regexp_replace(whole, WRAPS[0], f"{WRAPS[1]}$1")
    return F.split(F.regexp_replace(joined, ENDS[0], f"$1{ENDS[1]}"), "\n")


#: Sentences that end, and lines without letters or digits, end a wrapped sentence.
STOPS = [("([.!?][ \\t\\r]*)\n", "$1\n\n"), ("\n[^A-Za-z0-9]*\n", "\f")]


def wrapped(pattern: str) -> str:
    """A known sentence's pattern for lines that stand between bars instead of spaces."""
    return pattern.replace(" ", "[ |]").replace("^", "[|]").replace("$", "[|]")


def identifiers(text: Column) -> Column:
    """Identifiers of a text's sentences in order; 'unknown' for those that look like licensing and match no known one."""

    def normal(sentence: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(sentence), NORMAL, " "))

    def known(line: Column) -> Column:
        return _once(normal(line), _first_match)

    def together(lines: Column) -> Column:
        """Known ones of single lines, and those that begin in a line and match over its end."""
        own = F.transform(lines, lambda x, k: F.struct((k + 1).alias("at"), F.lit(-1).alias("rank"), known(x).alias("id")))
        own = F.filter(own, lambda x: x["id"].isNotNull())

        def over(own: Column) -> Column:
            def begins(bars: Column) -> Column:
                first = [F.struct(F.regexp_instr(bars, F.lit(wrapped(p))).alias("at"), F.lit(rank).alias("rank"), F.lit(name).alias("id")) for rank, (name, p) in enumerate(SENTENCES)]
                here = F.filter(F.array(*first), lambda x: (x["at"] > 0) & ~F.exists(lines, lambda line: _matches(normal(line), x["rank"])))
                return F.transform(here, lambda x: F.struct(F.length(F.regexp_replace(F.substring(bars, F.lit(1), x["at"]), "[^|]", "")).alias("at"), x["rank"].alias("rank"), x["id"].alias("id")))

            bars = F.concat(F.lit("|"), F.array_join(F.transform(lines, normal), "|"), F.lit("|"))
            more = _once(_once(bars, begins), lambda m: F.filter(m, lambda x: ~F.exists(m, lambda y: (y["at"] == x["at"]) & (y["rank"] < x["rank"]))))
            return F.transform(F.array_sort(F.concat(own, more)), lambda x: x["id"])

        return _once(own, over)

    def found(sentence: Column) -> Column:
        lines = F.split(sentence, "\n")
        ids = F.when(F.size(lines) == 1, F.array_compact(F.array(known(sentence)))).when(sentence.rlike(GATE), _once(lines, together)).otherwise(F.array().cast("array<string>"))
        return _once(ids, lambda x: F.when(F.size(x) > 0, x).when(sentence.rlike(HINT), F.array(F.lit("unknown"))).otherwise(x))

    joined = F.array_join(sentences(text), "\n")
    for pattern, to in STOPS:
        joined = F.regexp_replace(joined, pattern, to)
    return F.when(text.rlike(GATE), F.flatten(F.transform(F.split(joined, "\f"), found))).otherwise(F.array().cast("array<string>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_match(normal: Column) -> Column:
    first = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        first = F.when(normal.rlike(pattern), F.lit(name)).otherwise(first)
    return first


def _matches(normal: Column, rank: Column) -> Column:
    """Whether a line by itself matches the known sentence of that rank."""
    hit = F.lit(False)
    for k, (_, pattern) in enumerate(SENTENCES):
        hit = F.when(rank == k, normal.rlike(pattern)).otherwise(hit)
    return hit


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, sentence_ids, licenses and n_unknown.

    sentence_ids: identifiers in order, joined by spaces. licenses: the licences found, sorted, each once,
    joined by ' AND ', a choice between two as one name with ' OR '; 'NONE' without any. A sentence that denies a license gives none. n_unknown: license-like sentences that no known one matches. Null
    and empty texts have none of these; repeated rows get equal results; other columns are ignored; an empty table
    gives none. A text's sentences are held in one row, a few times its length.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), identifiers(F.coalesce(F.col(text), F.lit(""))).alias("_ids"))
    marked = lambda run: "".join(f"<{x}>" for x in run)
    known = F.array_join(F.transform(F.filter("_ids", lambda x: x != "unknown"), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    out = found.select("doc_id", F.array_join("_ids", " ").alias("sentence_ids"), F.size(F.filter("_ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"), known.alias("_left"))
    for k, (_, run) in enumerate(RULES):
        out = out.withColumns({f"_r{k}": F.contains("_left", F.lit(marked(run))), "_left": F.replace("_left", F.lit(marked(run)), F.lit(GAP))})
    names = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col(f"_r{k}"), F.lit(name)) for k, (name, _) in enumerate(RULES)]), lambda x: x.isNotNull())))
    return out.select("doc_id", "sentence_ids", F.when(F.size(names) == 0, F.lit("NONE")).otherwise(F.array_join(names, " AND ")).alias("licenses"), "n_unknown")


def sql(table: str = "documents") -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    case = " ".join(f"WHEN regexp_matches(n, {quote(p)}) THEN {quote(i)}" for i, p in SENTENCES)
    whole = f"regexp_replace(coalesce(text, ''), {quote(VERSION[0])}, {quote(''.join(chr(92) + k for k in VERSION[1]))}, 'g')"
    joined = f"regexp_replace({whole}, {quote(WRAPS[0])}, {quote(WRAPS[1] + chr(92) + '1')}, 'g')"
    cut = f"string_split(regexp_replace({joined}, {quote(ENDS[0])}, '\\1' || chr(10), 'g'), chr(10))"
    marked = lambda run: quote("".join(f"<{x}>" for x in run))
    steps = []
    for k, (_, run) in enumerate(RULES):
        steps.append(f"s{k + 1} AS (SELECT *, contains(t{k}, {marked(run)}) AS r{k}, replace(t{k}, {marked(run)}, {quote(GAP)}) AS t{k + 1} FROM s{k})")
    found = ", ".join(f"CASE WHEN r{k} THEN {quote(name)} END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH cut AS (SELECT doc_id, list_filter({cut}, lambda x: regexp_matches(x, {quote(HINT)})) AS s FROM {table}),
found AS (SELECT doc_id, list_transform(list_transform(s, lambda x: trim(regexp_replace(lower(x), {quote(NORMAL)}, ' ', 'g'))), lambda n: CASE {case} ELSE 'unknown' END) AS ids FROM cut),
s0 AS (SELECT *, coalesce(array_to_string(list_transform(list_filter(ids, lambda x: x <> 'unknown'), lambda x: '<' || x || '>'), ''), '') AS t0 FROM found),
{", ".join(steps)},
named AS (SELECT *, list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))) AS l FROM s{len(RULES)})
SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, CASE WHEN len(l) = 0 THEN 'NONE' ELSE array_to_string(l, ' AND ') END AS licenses,
  CAST(len(list_filter(ids, lambda x: x = 'unknown')) AS BIGINT) AS n_unknown FROM named"""
