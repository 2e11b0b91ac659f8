"""Licence scans by sentence rules: sentences become identifiers, sequences of identifiers become licences.

Only SQL functions, row by row, without a shuffle. The whole text is normalised: A-Z in lower case, comment
marks and list letters at the start of a line dropped, every run of other characters than letters a-z and digits
one blank. A known sentence begins and ends at a sentence mark, a paragraph or a line end; it may run over
several lines, but over no sentence mark or paragraph. Of several that begin at a place, the longest counts.
Known sentences map to identifiers, all else is dropped, and what is left is a sequence in text order. The
rules are tried in their order; a rule that occurs as a run of adjacent identifiers names its licence, and its
identifiers are used up, so that later and shorter rules do not count them again.

Defined cases: null, empty and wordless texts have no sentences and no licences; a licence named twice is
listed once; known sentences that no rule used are counted, also one such as "MIT" that is a sentence by itself
and names a licence only behind its tag; the holder's name in a clause has up to ``SOME_WORDS`` characters, a clause
with a longer one is unknown; a kept column with the name of an added
one is replaced; rows are judged one by one, so repeated rows get equal results; an empty table gives an empty
result, and texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import LOWER, UPPER, quoted, without

# Wording of public licences and notices, one identifier and sentence a line.
SENTENCES = """
gpl3work This work is licensed under the GNU General Public License, version 3.
gpl2work This work is licensed under the GNU General Public License, version 2.
gplfree This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
gpl2free This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
gplhope This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
gplsee See the GNU General Public License for more details.
mitname Released under the MIT License.
mitlong Licensed under the MIT License.
mitgrant Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
mitnotice The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
apachename Licensed under the Apache License, Version 2.0.
apachelong Licensed under the Apache License, Version 2.0 (the "License");
apacheuse you may not use this file except in compliance with the License.
bsdname Licensed under the BSD License.
bsdgrant Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
bsdsource Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
bsdbinary Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
ccbync Licensed under CC BY-NC 4.0.
ccby Licensed under CC BY 4.0.
ccbysa Licensed under CC BY-SA 4.0.
cczero Licensed under CC0 1.0.
mplform This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
public This work is in the public domain.
reserved All rights reserved.
lgplfree This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
lgplthree This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
lgplhope This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
lgplsee See the GNU Lesser General Public License for more details.
agplfree This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
agplsee See the GNU Affero General Public License for more details.
iscgrant Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
iscold Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
unlicence This is free and unencumbered software released into the public domain.
mitfile Licensed under the MIT License - see LICENSE.
mitproject This project is licensed under the MIT License.
mitdetails This project is licensed under the MIT License - see the LICENSE file for details.
apacheproject This project is licensed under the Apache License, Version 2.0.
spdxmit SPDX-License-Identifier: MIT
spdxapache SPDX-License-Identifier: Apache-2.0
spdxgpl2 SPDX-License-Identifier: GPL-2.0-only
spdxgpl2old SPDX-License-Identifier: GPL-2.0
spdxgpl2later SPDX-License-Identifier: GPL-2.0-or-later
spdxgpl3 SPDX-License-Identifier: GPL-3.0-only
spdxgpl3later SPDX-License-Identifier: GPL-3.0-or-later
spdxlgpl SPDX-License-Identifier: LGPL-2.1-or-later
spdxagpl SPDX-License-Identifier: AGPL-3.0-or-later
spdxbsd2 SPDX-License-Identifier: BSD-2-Clause
spdxbsd3 SPDX-License-Identifier: BSD-3-Clause
spdxisc SPDX-License-Identifier: ISC
spdxmpl SPDX-License-Identifier: MPL-2.0
spdxzero SPDX-License-Identifier: CC0-1.0
spdxunlicense SPDX-License-Identifier: Unlicense
"""

# Ordered rules: a licence and the identifiers that name it, the longer ones first.
RULES = """
GPL-3.0-or-later gplfree gplhope gplsee
GPL-2.0-or-later gpl2free gplhope gplsee
GPL-3.0-or-later gplfree
GPL-2.0-or-later gpl2free
GPL-3.0 gpl3work
GPL-2.0 gpl2work
MIT mitgrant mitnotice
MIT mitname
MIT mitlong
Apache-2.0 apachelong apacheuse
Apache-2.0 apachename
Apache-2.0 apachelong
BSD-2-Clause bsdgrant bsdsource bsdbinary
BSD bsdname
CC-BY-NC-4.0 ccbync
CC-BY-SA-4.0 ccbysa
CC-BY-4.0 ccby
CC0-1.0 cczero
MPL-2.0 mplform
Public-Domain public
LGPL-2.1-or-later lgplfree lgplhope lgplsee
LGPL-3.0-or-later lgplthree lgplhope lgplsee
AGPL-3.0-or-later agplfree gplhope agplsee
LGPL-2.1-or-later lgplfree
LGPL-3.0-or-later lgplthree
AGPL-3.0-or-later agplfree
ISC iscgrant
ISC iscold
Unlicense unlicence
MIT mitfile
MIT mitproject
MIT mitdetails
Apache-2.0 apacheproject
MIT spdxmit
Apache-2.0 spdxapache
GPL-2.0 spdxgpl2
GPL-2.0 spdxgpl2old
GPL-2.0-or-later spdxgpl2later
GPL-3.0 spdxgpl3
GPL-3.0-or-later spdxgpl3later
LGPL-2.1-or-later spdxlgpl
AGPL-3.0-or-later spdxagpl
BSD-2-Clause spdxbsd2
BSD-3-Clause spdxbsd3
ISC spdxisc
MPL-2.0 spdxmpl
CC0-1.0 spdxzero
Unlicense spdxunlicense
All-Rights-Reserved reserved
"""

# Fixed values like the above. The SQL below does not know these sentences and rules. A star stands for some words, such as the name of a holder.
CLAUSES = """
bsdads All advertising materials mentioning features or use of this software must display the following acknowledgement:
bsdendorse Neither the name of * nor the names of * contributors may be used to endorse or promote products derived from this software without specific prior written permission.
bsdauthor The name of * may not be used to endorse or promote products derived from this software without specific prior written permission.
"""
CLAUSE_RULES = """
BSD-4-Clause bsdgrant bsdsource bsdbinary bsdads bsdendorse
BSD-4-Clause bsdgrant bsdsource bsdbinary bsdads bsdauthor
BSD-3-Clause bsdgrant bsdsource bsdbinary bsdendorse
BSD-3-Clause bsdgrant bsdsource bsdbinary bsdauthor
"""

# What a line may begin with besides its words: comment marks, words that mark comments, a letter or digit of a list.
LINE_START = r"(?md)^[^a-z0-9\n]*+(?:(?:dnl|rem)\b[^a-z0-9\n]*+)?(?:[a-z0-9]\)[ \t]*+)?"
# Words that a star stands for, in a normalised text with its borders.
SOME_WORDS = "[a-z0-9SL ]{1,200}?"

# A blank behind one of these marks ends a sentence, and so does the end of a line; full stops within
# a version number do not.
SENTENCE_END = r"([.!?:;])[ \t\r\n]+"


def entries(text: str = SENTENCES) -> dict[str, list[str]]:
    """By identifier, its normalised sentences: one, or several where the split cuts the entry."""
    found = {}
    for line in text.strip().splitlines():
        name, _, wording = line.partition(" ")
        parts = [normal(p) for p in re.sub(SENTENCE_END, "\\1\n", wording).split("\n")]
        found[name] = [p for p in parts if p]
    return found


def sentence_ids(text: str = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence. Parts of an entry are numbered; one that two entries share has the
    identifier of the first."""
    found: dict[str, str] = {}
    for name, parts in entries(text).items():
        for k, part in enumerate(parts, 1):
            found.setdefault(part, name if len(parts) == 1 else f"{name}.{k}")
    return found


def normal(sentence: str) -> str:
    """The normalised form, for the fixed table alone; texts are normalised by ``_bordered``."""
    lower = sentence.translate(str.maketrans(UPPER, LOWER))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in lower).split())


def rule_table(rules: str = RULES, sentences: str = SENTENCES) -> list[tuple[str, str]]:
    """(licence, pattern) in order; a pattern is the identifiers as they stand in a sequence."""
    by_text, parts = sentence_ids(sentences), entries(sentences)
    table = []
    for line in rules.strip().splitlines():
        licence, *names = line.split()
        table.append((licence, "".join(f"<{by_text[p]}>" for n in names for p in parts[n])))
    return table


def _bordered(text: Column) -> Column:
    """The normalised text with its borders: S for sentence marks and paragraphs, L for other line ends."""
    lower = F.regexp_replace(F.translate(text, UPPER, LOWER), LINE_START, "")
    ends = F.regexp_replace(F.regexp_replace(lower, SENTENCE_END, "S"), r"\n[ \t\r\n]*\n", "S")
    words = F.regexp_replace(F.translate(ends, "\n", "L"), "[^a-z0-9SL]+", " ")
    return F.concat(F.lit("S"), words, F.lit("S"))


def _known(bordered: Column, sentences: str) -> Column:
    """Identifiers of the known sentences of a bordered text, in order."""
    starred = [[normal(p) for p in line.split(" ", 1)[1].split("*")] for line in sentences.strip().splitlines() if "*" in line]
    forms = {" ".join(parts): parts for parts in starred}
    patterns = []
    for sentence in sorted(sentence_ids(sentences), key=lambda s: (-len(s), s)):
        parts = [p.replace(" ", "[ L]+") for p in forms.get(sentence, [sentence])]
        patterns.append(f"[ L]+{SOME_WORDS}[ LS]+".join(parts))
    found = F.regexp_extract_all(bordered, F.lit(f"(?<=[SL]) ?({'|'.join(patterns)}) ?(?=[SL])"), F.lit(1))

    def identifier(match: Column) -> Column:
        plain = F.regexp_replace(match, "[ LS]+", " ")
        for parts in forms.values():
            plain = F.regexp_replace(plain, f"^{' .+ '.join(f'({p})' for p in parts)}$", " ".join(f"${k + 1}" for k in range(len(parts))))
        return F.try_element_at(by_text, plain)

    by_text = F.create_map(*[F.lit(x) for pair in sentence_ids(sentences).items() for x in pair])
    return F.transform(found, identifier)


def scan(
    docs: DataFrame,
    keep: Sequence[str],
    sentences: str = SENTENCES + CLAUSES.lstrip(),
    rules: str = CLAUSE_RULES + RULES.lstrip(),
    text: str = "text",
) -> DataFrame:
    """The kept columns with ``sentence_ids`` (sequence of identifiers), ``licences`` (in rule order) and
    ``n_unmatched`` (known sentences that no rule used)."""
    kept = without(keep, ["sentence_ids", "licences", "n_unmatched"])
    ids = _known(_bordered(F.coalesce(quoted(text), F.lit(""))), sentences)
    table = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(p).alias("pattern")) for n, p in rule_table(rules, sentences)])
    read = docs.select(*[quoted(c).alias(f"_keep_{i}") for i, c in enumerate(kept)], ids.alias("_ids"))
    sequence = F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    # What a rule uses up leaves a bar, so that identifiers around it do not become adjacent.
    used = F.aggregate(
        table,
        start,
        lambda so_far, rule: F.when(
            F.contains(so_far["left"], rule["pattern"]),
            F.struct(
                F.replace(so_far["left"], rule["pattern"], F.lit("|")).alias("left"),
                F.array_append(so_far["found"], rule["licence"]).alias("found"),
            ),
        ).otherwise(so_far),
    )
    nothing = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("found"))
    matched = read.withColumn("_used", F.when(F.size("_ids") > 0, used).otherwise(nothing))
    return matched.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_ids").alias("sentence_ids"),
        F.array_distinct(F.col("_used.found")).alias("licences"),
        (F.length("_used.left") - F.length(F.replace("_used.left", F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"),
    )


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB SQL, one step a rule; only sentences of one line, without ``CLAUSES``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = sentence_ids()
    keys = ", ".join(map(quote, ids))
    values = ", ".join(map(quote, ids.values()))
    steps, last = [], "s0"
    for k, (licence, pattern) in enumerate(rule_table(), 1):
        steps.append(
            f"s{k} AS (SELECT doc_id, ids, replace(rest, {quote(pattern)}, '|') AS rest, CASE WHEN contains(rest,"
            f" {quote(pattern)}) THEN list_append(found, {quote(licence)}) ELSE found END AS found FROM {last})"
        )
        last = f"s{k}"
    tail = "".join(f",\n{s}" for s in steps)
    return f"""
WITH lines AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)) AS parts
  FROM documents
),
known AS (SELECT map([{keys}], [{values}]) AS by_text),
named AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: by_text[trim(regexp_replace(
    translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids
  FROM lines, known
),
s0 AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS rest,
    CAST([] AS VARCHAR[]) AS found
  FROM named
){tail}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licences,
  CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched
FROM {last}
"""
