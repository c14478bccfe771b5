"""Licence recognition by sentences and rules (operator 9). DataFrame functions only.

Method: a text is normalised (lower case, every run of other characters than a-z and
0-9 one space, or a mark where the run holds the end of a sentence or line). A known
licence sentence is found where its words stand between two marks; marks among its words
are passed over, so it may be wrapped over lines, with or without comment signs, and hold
punctuation, but not a blank line. The first and longest is taken, and the search goes on
after it, which gives the sequence of their identifiers in the text. The ordered rules
each name a licence and a sequence of identifiers; a rule holds if its sequence stands
in the text's sequence without a gap, and the first rule that holds gives the licence.

Defined results for odd input: null or empty text has an empty sequence and no
licence; sentences repeated side by side stay repeated; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier.
SENTENCES = {
    "all-rights": "all rights reserved",
    "mit-tag": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-tag": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc0": "released under cc0 1 0",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-title": "mozilla public license version 2 0",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache-title": "apache license version 2 0 january 2004",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl2-title": "eclipse public license v 2 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-tag": "distributed under the boost software license version 1 0",
    "wtfpl": "do what the fuck you want to public license",
    "mit-title": "the mit license",
    "mit-short-title": "mit license",
    "isc-title": "isc license",
    "cc0-title": "cc0 1 0 universal",
    "cc-by-4-title": "creative commons attribution 4 0 international public license",
    "cc-by-sa-4-title": "creative commons attribution sharealike 4 0 international public license",
    "cc-by-nc-4-title": "creative commons attribution noncommercial 4 0 international public license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-gpl3-only": "spdx license identifier gpl 3 0 only",
    "spdx-gpl2": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl2-only": "spdx license identifier gpl 2 0 only",
    "spdx-mpl2": "spdx license identifier mpl 2 0",
    "spdx-isc": "spdx license identifier isc",
}

#: Rules in order: the first that holds decides.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-tag"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-tag"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["zero-bsd-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense"]),
    ("EPL-2.0", ["epl2"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("Apache-2.0", ["apache-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-tag"]),
    ("WTFPL", ["wtfpl"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-title"]),
    ("CC-BY-4.0", ["cc-by-4-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
    ("GPL-3.0", ["spdx-gpl3-only"]),
    ("GPL-2.0-or-later", ["spdx-gpl2"]),
    ("GPL-2.0-only", ["spdx-gpl2-only"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("ISC", ["spdx-isc"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-short-title"]),
    ("ISC", ["isc-title"]),
    ("proprietary", ["all-rights"]),
]

#: Words of which every known sentence of this module has one: a text without any holds no known sentence.
TELLING = ["license", "licensed", "permission", "software", "reserved", "notice", "licence", "redistribution", "redistributions", "warranty", "cc0", "contributors", "materials"]

BOUNDARY = "[.!?;:]+[ \t\r\n\f]+|\n+"
OTHER = "[^a-z0-9]+"


#: Two line ends with neither a letter nor a digit between, and what follows.
PARAGRAPH = "\n[^a-z0-9\n]*\n[^a-z0-9]*"


def telling_words(sentences: dict[str, str]) -> list[str]:
    """The telling words of a set of sentences: the given ones if they do, else as few as are found by taking the commonest long ones."""
    left = [set(s.split()) for s in sentences.values()]
    chosen = [w for w in TELLING if any(w in s for s in left)]
    left = [s for s in left if not s & set(chosen)]
    while left:
        word = max(sorted(set().union(*left)), key=lambda w: (len(w) > 4, sum(w in s for s in left)))
        chosen.append(word)
        left = [s for s in left if word not in s]
    return chosen


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order. Most texts have no telling word, and are not searched."""
    some = text.rlike(f"(?iu)(?:{'|'.join(telling_words(sentences))})")
    return F.when(some, _search(text, sentences)).otherwise(F.array().cast("array<string>"))


def _search(text: Column, sentences: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for id_, s in sentences.items() for x in (s, id_)])
    # upper-case letters mark the ends of paragraphs (P) and sentences or lines (S)
    marked = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PARAGRAPH, "P"), BOUNDARY, "S")
    normal = F.concat(F.lit("P"), F.regexp_replace(marked, "[^a-z0-9PS]+", " "), F.lit("P"))
    longest_first = sorted(sentences.values(), key=lambda s: (-len(s), s))
    any_known = "|".join(s.replace(" ", "[ S]+") for s in longest_first)
    found = F.regexp_extract_all(normal, F.lit(f"[PS] ?({any_known})(?= ?[PS])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[ S]+", " ")))


def recognise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """The id, sentence_ids (joined by commas), n_known, rule (1 for the first; null: none) and licence. Map only."""
    found = df.select(F.col(id_col), sentence_ids(F.col(text_col), sentences).alias("__ids"))
    joined = F.concat(F.lit(","), F.array_join("__ids", ","), F.lit(","))
    # coalesce takes the first rule that holds; texts without any known sentence ask no rule
    rule = F.when(F.size("__ids") > 0, F.coalesce(*[F.when(F.contains(joined, F.lit("," + ",".join(ids) + ",")), F.lit(i + 1)) for i, (_, ids) in enumerate(rules)]))
    names = F.array(*[F.lit(name) for name, _ in rules])
    out = found.withColumn("__rule", rule)
    return out.select(F.col(id_col), F.array_join("__ids", ",").alias("sentence_ids"), F.size("__ids").cast("long").alias("n_known"), F.col("__rule").cast("long").alias("rule"), F.try_element_at(names, F.col("__rule")).alias("licence"))
