"""Licence scans by sentence rules: normalised sentences become identifiers, and ordered rules match their sequence.

Only DataFrame functions: everything happens inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised (lower case, runs of other characters than a-z and 0-9 as one blank).
SENTENCES = {
    "apache_grant": "licensed under the apache license version 2 0",
    "apache_conditions": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_name": "released under the mit license",
    "mit_title": "the mit license",
    "mit_named": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd_name": "licensed under the bsd 3 clause license",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc_name": "licensed under cc by nc 4 0",
    "cc_by_name": "licensed under cc by 4 0",
    "cc_by_sa_name": "licensed under cc by sa 4 0",
    "mpl_name": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "gpl3_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "isc_title": "isc license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "all_rights": "all rights reserved",
}

# A licence is recognised where its sentences follow one another in this order, others between them
# allowed. A rule takes the sentences it matches, so that none tells for two licences; longer rules come first, and
# rules of one length in this order.
RULES = (
    ("Apache-2.0", "full", ("apache_grant", "apache_conditions", "apache_copy", "apache_as_is", "apache_see")),
    ("Apache-2.0", "named", ("apache_grant",)),
    ("MIT", "full", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", "named", ("mit_name",)),
    ("MIT", "named", ("mit_named",)),
    ("MIT", "named", ("mit_title", "mit_grant")),
    ("GPL-3.0-or-later", "full", ("gpl_free", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-or-later", "named", ("gpl_free",)),
    ("GPL-3.0", "named", ("gpl3_name",)),
    ("GPL-3.0-only", "full", ("gpl3_only", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-only", "named", ("gpl3_only",)),
    ("GPL-2.0-or-later", "full", ("gpl2_free", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-or-later", "named", ("gpl2_free",)),
    ("GPL-2.0-only", "full", ("gpl2_only", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-only", "named", ("gpl2_only",)),
    ("LGPL-3.0-or-later", "full", ("lgpl3_free", "lgpl_warranty", "lgpl_copy")),
    ("LGPL-3.0-or-later", "named", ("lgpl3_free",)),
    ("LGPL-2.1-or-later", "full", ("lgpl21_free", "lgpl_warranty", "lgpl_copy")),
    ("LGPL-2.1-or-later", "named", ("lgpl21_free",)),
    ("BSD-3-Clause", "full", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-3-Clause", "named", ("bsd_name",)),
    ("BSD-2-Clause", "full", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", "full", ("isc_grant", "isc_as_is")),
    ("ISC", "named", ("isc_title", "isc_grant")),
    ("CC-BY-NC-4.0", "named", ("cc_by_nc_name",)),
    ("CC-BY-4.0", "named", ("cc_by_name",)),
    ("CC-BY-SA-4.0", "named", ("cc_by_sa_name",)),
    ("MPL-2.0", "full", ("mpl_name", "mpl_copy")),
    ("MPL-2.0", "named", ("mpl_name",)),
)

#: Licences that an SPDX line may name: those with rules, each by a sentence and a rule of its own.
SPDX = tuple(sorted({licence for licence, _, _ in RULES} - {"GPL-3.0"} | {"LGPL-2.1-only", "LGPL-3.0-only"}))


def _spdx(licence: str) -> str:
    return "spdx_" + licence.lower().replace("-", "_").replace(".", "_")


SENTENCES |= {_spdx(x): "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ") for x in SPDX}
RULES += tuple((x, "named", (_spdx(x),)) for x in SPDX)

#: The sentence that licences also carry: beside the sentences of a recognised one it belongs to it, else it stands for itself.
RESERVED, ITS_LICENSE = "all_rights", "Proprietary"

# Other wordings of a sentence in published notices, normalised, and the sentence they count as.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": "apache_grant",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache_copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache_copy",
    "mit license": "mit_title",
    "mit license mit": "mit_title",
    "the isc license": "isc_title",
    "the mit license mit": "mit_title",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl_copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_only",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
}

#: Every known sentence holds one of these, so that texts without any need no normalising. No line end can cut a single word.
HINTS = ("licen", "warrant", "permi", "redistribut", "notice", "copyright", "reserved", "mpl")

#: Clauses end after . ! ? ; : where white space follows, and at line feeds. A sentence is one clause or several that
#: follow one another, so that neither a wrapped line nor punctuation inside a sentence cuts it; a line without
#: letters and digits ends every sentence.
CLAUSE = r"(?<=[.!?;:])[\x20\x09\x0B-\x0D]+"

#: An address inside a notice, normalised: a clause ends behind it, though no punctuation says so.
ADDRESS = "apache org licenses license 2 0"

#: Marks in normalised text, which has no upper-case letter of its own: end of a clause, end of a paragraph.
STOP, PARAGRAPH = "S", "P"


def normal(text: Column) -> Column:
    """Lower case, words of a-z and 0-9 with one character between them: a blank, or one of the two marks."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), CLAUSE, STOP), rf"[^a-z0-9\n{STOP}]+", " ")
    # each run of blanks, marks and line feeds is tried from its start only, so that long runs cost no more than their length
    apart = F.regexp_replace(marked, rf"(?<![ \n{STOP}])[ {STOP}]*+\n[ {STOP}]*+\n[ \n{STOP}]*+", PARAGRAPH)
    whole = F.trim(F.regexp_replace(apart, rf" ?[\n{STOP}][ \n{STOP}]*+", STOP))
    return F.replace(whole, F.lit(f" {ADDRESS} "), F.lit(f" {ADDRESS}{STOP}"))


WORDINGS = {sentence: name for name, sentence in SENTENCES.items()} | VARIANTS
LONGEST_FIRST = sorted(WORDINGS, key=len, reverse=True)


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; repetitions stay. Of sentences that begin at one
    place the longest counts, and what it holds does not count again."""
    known = F.create_map(*[F.lit(x) for pair in WORDINGS.items() for x in pair])
    between = rf"(?<![^{STOP}{PARAGRAPH}])(?:" + "|".join(s.replace(" ", f"[ {STOP}]") for s in LONGEST_FIRST) + rf")(?![^{STOP}{PARAGRAPH}])"
    found = F.regexp_extract_all(normal(text), F.lit(between), F.lit(0))
    return F.transform(found, lambda s: known[F.translate(s, STOP, " ")])


# For the rules every identifier is one sign, and so is every outcome (licence:strength).
OUTCOMES = sorted({f"{licence}:{degree}" for licence, degree, _ in RULES} | {f"{ITS_LICENSE}:named"})
SIGNS = {x: chr(0x4E00 + i) for i, x in enumerate([*SENTENCES, *OUTCOMES])}


def consumption() -> list[tuple[str, int, str]]:
    """The rules as replacements in the string of signs, in their order: pattern, number of gaps that stay, and the
    sign of the outcome, which takes the place of the sentences. The last ones are about the reserved sentence."""
    steps = []
    for licence, degree, order in sorted(RULES, key=lambda r: -len(r[2])):
        steps.append(("(.*?)".join(SIGNS[x] for x in order), len(order) - 1, SIGNS[f"{licence}:{degree}"]))
    kept, own = SIGNS[RESERVED], SIGNS[f"{ITS_LICENSE}:named"]
    # the gaps that a rule leaves stand behind its outcome, so that what lay inside a licence is beside it
    outcomes = "".join(SIGNS[x] for x in OUTCOMES if SIGNS[x] != own)
    return [*steps, (f"{kept}*([{outcomes}]){kept}*", 1, ""), (kept, 0, own)]


def outcomes_of(names: Column) -> Column:
    """``licence:strength`` of each recognised licence, sorted, from identifiers in order: the best strength of each."""
    signs = F.create_map(*[F.lit(x) for name in SENTENCES for x in (name, SIGNS[name])])
    line = F.array_join(F.transform(names, lambda x: signs[x]), "")
    for pattern, gaps, sign in consumption():
        line = F.regexp_replace(line, pattern, sign + "".join(f"${i + 1}" for i in range(gaps)))
    left = F.split(line, "")
    told = F.create_map(*[F.lit(x) for o in OUTCOMES for x in (SIGNS[o], o)])
    every = F.array_distinct(F.filter(F.transform(left, lambda x: told[x]), lambda x: x.isNotNull()))
    full = F.transform(F.filter(every, lambda x: x.endswith(":full")), lambda x: F.replace(x, F.lit(":full"), F.lit(":named")))
    return F.sort_array(F.array_except(every, full))


def _hinted(lowered: Column) -> Column:
    hit = F.lit(False)
    for hint in HINTS:
        hit = hit | lowered.contains(hint)
    return hit


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_sentences`` (known licence sentences, repetitions counted),
    ``sequence`` (their identifiers in order, comma-joined), ``licenses`` (recognised licences, sorted,
    comma-joined) and ``strength`` (licence:full or licence:named, sorted, comma-joined).

    A null or empty text has no sentence and no licence. Repeated rows give repeated rows. Other columns of ``docs``,
    whatever their names, are not used; an empty table gives an empty one. SPDX lines count when they name one licence.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<string>")
    found = docs.select(F.col(key), F.when(_hinted(F.lower(value)), identifiers(value)).otherwise(empty).alias("names"))
    rated = found.select(F.col(key), "names", F.when(F.size("names") > 0, outcomes_of(F.col("names"))).otherwise(empty).alias("levels"))
    return rated.select(
        key, F.size("names").cast("long").alias("n_sentences"), F.array_join("names", ",").alias("sequence"),
        F.array_join(F.transform("levels", lambda x: F.substring_index(x, ":", 1)), ",").alias("licenses"),
        F.array_join("levels", ",").alias("strength"),
    )


def scan_sql() -> str:
    """The same in SQL over ``documents``, for comparison. Its patterns know no look around: marks are doubled, and a
    sentence takes one on each side."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    replaced = lambda value, pattern, by: f"regexp_replace({value}, {quoted(pattern)}, {quoted(by)}, 'g')"
    mapped = lambda pairs: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs) + "}"
    marked = replaced(replaced("lower(coalesce(text, ''))", CLAUSE.replace("(?<=[.!?;:])", "[.!?;:]"), STOP), rf"[^a-z0-9\n{STOP}]+", " ")
    apart = replaced(marked, rf"[ {STOP}]*\n[ {STOP}]*\n[ \n{STOP}]*", PARAGRAPH)
    whole = f"trim({replaced(apart, rf' ?[\n{STOP}][ \n{STOP}]*', STOP)})"
    doubled = replaced(f"replace({whole}, ' {ADDRESS} ', ' {ADDRESS}{STOP}')", f"([{STOP}{PARAGRAPH}])", r"\1\1")
    sentence = f"(?:^|[{STOP}{PARAGRAPH}])(" + "|".join(s.replace(" ", f"(?: |{STOP}{STOP})") for s in LONGEST_FIRST) + f")(?:[{STOP}{PARAGRAPH}]|$)"
    line = "array_to_string([signs[x] FOR x IN names], '')"
    for pattern, gaps, sign in consumption():
        line = replaced(line, pattern, sign + "".join(rf"\{i + 1}" for i in range(gaps)))
    return f"""
    WITH tables AS MATERIALIZED (SELECT {mapped(WORDINGS.items())} AS known, {mapped((n, SIGNS[n]) for n in SENTENCES)} AS signs, {mapped((SIGNS[o], o) for o in OUTCOMES)} AS told),
    found AS (SELECT doc_id, regexp_extract_all({doubled}, {quoted(sentence)}, 1) AS sentences FROM documents),
    named AS (SELECT doc_id, [known[replace(x, '{STOP}{STOP}', ' ')] FOR x IN sentences] AS names FROM found, tables),
    lined AS (SELECT doc_id, names, {line} AS line FROM named, tables),
    every AS (SELECT doc_id, names, list_distinct([told[x] FOR x IN string_split(line, '') IF told[x] IS NOT NULL]) AS levels FROM lined, tables),
    rated AS (SELECT doc_id, names, list_sort([x FOR x IN levels IF NOT list_contains(levels, replace(x, ':named', ':full')) OR x LIKE '%:full']) AS best FROM every)
    SELECT doc_id, CAST(len(names) AS BIGINT) AS n_sentences, array_to_string(names, ',') AS sequence,
      array_to_string([string_split(x, ':')[1] FOR x IN best], ',') AS licenses,
      array_to_string(best, ',') AS strength
    FROM rated"""
