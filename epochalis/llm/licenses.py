"""Licence scan by sentence rules, in DataFrame expressions alone.

A text is cut into sentences, sentences are normalised, and those that look like
licence language are mapped to identifiers of known licence sentences. A text's
sequence of identifiers is then matched against ordered licence rules: each rule
is a pattern over the sequence, and what it matches is taken out before the next
rule is tried, so that the most specific licence wins and several can be found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: fixed values: identifier -> pattern of the whole normalised sentence (lower case, one blank, no marks but . and -)
SENTENCES = {
    "AllRights": r"all rights reserved",
    "Copyright": r"(?:portions )?copyright (?:c )?(?:\d{4}.*|.*)",
    "SpdxMIT": r"spdx-license-identifier mit",
    "SpdxApache2": r"spdx-license-identifier apache-2\.0",
    "SpdxGPL3": r"spdx-license-identifier gpl-3\.0(?:-only|-or-later)?",
    "SpdxGPL2": r"spdx-license-identifier gpl-2\.0(?:-only|-or-later)?",
    "SpdxBSD3": r"spdx-license-identifier bsd-3-clause",
    "SpdxAGPL3": r"spdx-license-identifier agpl-3\.0(?:-only|-or-later)?",
    "SpdxLGPL": r"spdx-license-identifier lgpl-.+",
    "SpdxBSD2": r"spdx-license-identifier bsd-2-clause",
    "SpdxMPL2": r"spdx-license-identifier mpl-2\.0",
    "SpdxISC": r"spdx-license-identifier isc",
    "SpdxEPL2": r"spdx-license-identifier epl-2\.0",
    "SpdxBSL1": r"spdx-license-identifier bsl-1\.0",
    "SpdxUnlicense": r"spdx-license-identifier unlicense",
    "SpdxZlib": r"spdx-license-identifier zlib",
    "SpdxOther": r"spdx-license-identifier .+",
    "MITRef": r"(?:this .*is |it is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: license)?",
    "MITTitle": r"(?:the )?mit license(?: mit)?",
    "MITPerm": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "MITNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AsIs": r"(?:the|this) software is provided (?:by .+)?as is.*",
    "NoLiability": r"in no event (?:shall|will) .+",
    "ApacheRef": r"(?:this .*is )?(?:licensed|released|distributed) under the apache license version 2\.0(?: the license.*)?",
    "ApacheTitle": r"apache license(?: version 2\.0.*)?",
    "ApacheUse": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at.*",
    "ApacheLaw": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "GPL3Ref": r"(?:this .*is |it is )?(?:licensed|released|distributed) under the gnu general public license version 3(?:\.0)?(?: or any later version)?",
    "GPL2Ref": r"(?:this .*is |it is )?(?:licensed|released|distributed) under the gnu general public license version 2(?:\.0)?(?: or any later version)?",
    "AGPLTitle": r"gnu affero general public license.*",
    "LGPLTitle": r"gnu (?:lesser|library) general public license.*",
    "AGPLRedist": r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*",
    "LGPLRedist": r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license.*",
    "GPL3Redist": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3.*",
    "GPL2Redist": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2.*",
    "GPLCopy": r"you should have received a copy of the gnu .*license along with.*",
    "LGPLHope": r"this library is distributed in the hope that it will be useful.*",
    "ISCPerm": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISCDisclaim": r"the software is provided as is and the author disclaims all warranties with regard to this software.*",
    "ISCTitle": r"(?:the )?isc license(?: isc)?",
    "UnlicenseFree": r"this is free and unencumbered software released into the public domain",
    "UnlicenseAnyone": r"anyone is free to copy modify publish use compile sell or distribute this software.*",
    "BSLTitle": r"boost software license - version 1\.0.*",
    "BSLPerm": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*",
    "EPL2Ref": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2\.0.*",
    "EPL2Title": r"eclipse public license - v 2\.0",
    "ZlibPerm": r"permission is granted to anyone to use this software for any purpose including commercial applications.*",
    "ZlibAsIs": r"this software is provided as-is without any express or implied warranty",
    "MPL2Title": r"mozilla public license (?:version )?2\.0",
    "GPLTitle": r"gnu general public license.*",
    "GPLRedist": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*",
    "GPLHope": r"this program is distributed in the hope that it will be useful.*",
    "LGPLRef": r"(?:this .*is )?(?:licensed|released|distributed) under the gnu lesser general public license.*",
    "CCBYNC4": r"(?:this .*is )?licensed under (?:a )?(?:cc by-nc 4\.0|creative commons attribution-noncommercial 4\.0 international)(?: license)?",
    "CCBYSA4": r"(?:this .*is )?licensed under (?:a )?(?:cc by-sa 4\.0|creative commons attribution-sharealike 4\.0 international)(?: license)?",
    "CCBY4": r"(?:this .*is )?licensed under (?:a )?(?:cc by 4\.0|creative commons attribution 4\.0 international)(?: license)?",
    "CC0": r"(?:this .*is )?(?:licensed|released|dedicated) .*(?:cc0.*|public domain)",
    "BSDRedist": r"redistribution and use in source and binary forms with or without modification are permitted provided that.*",
    "BSDSource": r"redistributions of source code must retain the above copyright notice.*",
    "BSDBinary": r"redistributions in binary form must reproduce the above copyright notice.*",
    "BSDEndorse": r"neither the name of .+may be used to endorse or promote products.*",
    "BSDRef": r"(?:this .*is )?(?:licensed|released|distributed) under (?:the|a) (?:3-clause )?bsd(?: 3-clause)?(?:-style)?(?: license)?",
    "MPL2Ref": r"this source code form is subject to the terms of the mozilla public license v\.? ?2\.0",
    "Proprietary": r"(?:proprietary|confidential)(?: and (?:proprietary|confidential))?",
}
#: fixed values: rules in order; a rule is a sequence of identifiers, ``?`` marks one that may lack
RULES = (
    ("MIT", ("MITPerm", "MITNotice", "AsIs?", "NoLiability?")),
    ("MIT", ("MITTitle", "MITPerm")),
    ("BSD-3-Clause", ("BSDRedist", "BSDSource", "BSDBinary", "BSDEndorse", "AsIs?", "NoLiability?")),
    ("BSD-2-Clause", ("BSDRedist", "BSDSource", "BSDBinary", "AsIs?", "NoLiability?")),
    ("ISC", ("ISCPerm", "ISCDisclaim?", "AsIs?", "NoLiability?")),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone?", "AsIs?", "NoLiability?")),
    ("BSL-1.0", ("BSLTitle?", "BSLPerm", "AsIs?", "NoLiability?")),
    ("Zlib", ("ZlibAsIs?", "NoLiability?", "ZlibPerm")),
    ("EPL-2.0", ("EPL2Ref",)),
    ("AGPL-3.0", ("AGPLRedist", "GPLHope?", "GPLCopy?")),
    ("LGPL", ("LGPLRedist", "LGPLHope?", "GPLHope?", "GPLCopy?")),
    ("GPL-3.0", ("GPL3Redist", "GPLHope?", "GPLCopy?")),
    ("GPL-2.0", ("GPL2Redist", "GPLHope?", "GPLCopy?")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse?", "ApacheCopy?", "ApacheLaw?")),
    ("GPL", ("GPLRedist", "GPLHope?", "GPLCopy?")),
    ("GPL-3.0", ("GPL3Ref",)),
    ("GPL-2.0", ("GPL2Ref",)),
    ("LGPL", ("LGPLRef",)),
    ("MIT", ("MITRef",)),
    ("BSD", ("BSDRef",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC0-1.0", ("CC0",)),
    ("MIT", ("SpdxMIT",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("GPL-3.0", ("SpdxGPL3",)),
    ("GPL-2.0", ("SpdxGPL2",)),
    ("BSD-3-Clause", ("SpdxBSD3",)),
    ("AGPL-3.0", ("SpdxAGPL3",)),
    ("LGPL", ("SpdxLGPL",)),
    ("BSD-2-Clause", ("SpdxBSD2",)),
    ("MPL-2.0", ("SpdxMPL2",)),
    ("ISC", ("SpdxISC",)),
    ("EPL-2.0", ("SpdxEPL2",)),
    ("BSL-1.0", ("SpdxBSL1",)),
    ("Unlicense", ("SpdxUnlicense",)),
    ("Zlib", ("SpdxZlib",)),
    ("MIT", ("MITTitle",)),
    ("ISC", ("ISCTitle",)),
    ("BSL-1.0", ("BSLTitle",)),
    ("EPL-2.0", ("EPL2Title",)),
    ("MPL-2.0", ("MPL2Title",)),
    ("AGPL-3.0", ("AGPLTitle",)),
    ("LGPL", ("LGPLTitle",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("GPL", ("GPLTitle",)),
    ("Proprietary", ("AllRights", "Proprietary")),
    ("AllRightsReserved", ("AllRights",)),
)
#: a text without any of these has no licence sentence
SIGNS = r"(?i:licen[sc]e|copyright|all rights reserved|permission is hereby|public domain|redistribut|cc0|proprietary|confidential|software is provided|in no event (?:shall|will)|free software|hope that it will|mit license|neither the name|permission to use|permission is granted|unencumbered|anyone is free|accompanying materials)"


#: comment marks at the beginnings and ends of lines
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+(?=[ \t]|$)|//+|#+|--(?= )|<!--|dnl\b)[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$"
#: a line end inside a sentence: the line is not short and no sentence ends there, and the next is no list item and no known beginning
WRAP = r"(?<=[^\n]{40})(?<!(?<!\b[vV])[.!?:])(?<!SPDX-License-Identifier: [^\n]{1,40})[ \t]*\n[ \t]*(?=\S)(?!(?:[*\-]|\d+[.)]) |Licensed |Released |Distributed |Copyright |SPDX-|All rights |Permission is |Redistribution |Proprietary|Confidential|This )"


def sentences(text: Column) -> Column:
    """Sentences of a text that show a sign of licence language.

    Comment marks at the beginnings of lines go; a line is joined with the one before
    unless that is blank or a whole sentence, or the line starts a list item or a known
    title. Sentences end at full stops before a blank, but not after ``v.`` or at ``;``.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), COMMENT, "")
    joined = F.regexp_replace(bare, WRAP, " ")
    parts = F.split(joined, r"\n+|(?<=[.!?])(?<!\b[vV]\.)\s+|(?<=;)\s+(?=Licensed |Released |Distributed |Copyright |All rights )")
    return F.filter(parts, lambda s: s.rlike(SIGNS))


def normalised(sentence: Column) -> Column:
    """Lower case, marks other than stops and hyphens inside words dropped, single blanks."""
    low = F.lower(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    bare = F.regexp_replace(low, r"[^\p{L}\p{N}.\- ]+|\t", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[.\-]+(?= |$)|(?<= |^)[.\-]+", " "), " +", " "), "^ ", ""))


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, or ``Unknown``."""
    return reduce(lambda rest, k: F.when(sentence.rlike(f"^(?:{SENTENCES[k]})$"), k).otherwise(rest), reversed(list(SENTENCES)), F.lit("Unknown"))


def rule_pattern(sequence: tuple[str, ...]) -> str:
    return "".join(f"(?:{s[:-1]},)?" if s.endswith("?") else f"{s}," for s in sequence)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, licenses, sentence_ids, n_unknown``, a row for each row of ``docs``.

    ``licenses`` has each licence once, in the order of the rules; ``n_unknown``
    counts sentences of licence language that are no known sentence. A null or
    empty text has none. Columns of other names don't matter.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    none = F.array().cast("array<string>")
    held = rows.select("_id", F.when(F.col("_text").rlike(SIGNS), sentences(F.col("_text"))).otherwise(none).alias("_sentences"))
    ids = held.select("_id", F.transform(F.transform("_sentences", normalised), identifier).alias("_ids"))
    # the rules rewrite the sequence one after the other: a fold over a constant array keeps the plan small
    start = F.struct(F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(",")).alias("left"), none.alias("found"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"(?<=,){rule_pattern(s)}").alias("pattern")) for name, s in RULES])
    step = lambda acc, r: F.when(F.regexp_like(acc["left"], r["pattern"]), F.struct(F.regexp_replace(acc["left"], r["pattern"], F.lit("")).alias("left"), F.concat(acc["found"], F.array(r["name"])).alias("found"))).otherwise(acc)
    done = ids.withColumn("_r", F.when(F.size("_ids") > 0, F.aggregate(table, start, step)).otherwise(start))
    return done.select(F.col("_id").alias(id_col), F.array_distinct(F.col("_r.found")).alias("licenses"), F.col("_ids").alias("sentence_ids"), F.size(F.filter("_ids", lambda s: s == "Unknown")).cast("bigint").alias("n_unknown"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unknown", (F.size("licenses") > 0).alias("has_license"))
