"""Licence scan by canonical digest, DataFrame functions only.

A text is brought to a canonical form (lower case, copyright lines removed, punctuation
and white space as single spaces, equivalent spellings as one) and hashed. Digests are
looked up in a table of known licence texts by a hash join. The whole text is one unit;
each of its lines that speaks of a licence is another, since notices stand as a line of
their own in longer texts. Whole licences are the files of ``licence_texts``, named by
their SPDX ids; notices are made of usual openings and names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.llm.common import text_of

# Spellings taken as the same word.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

# Licence notices and short licence texts in their public wording.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

# The lines that stand above a licence's own text, if any.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
    ),
}

# How notices open, and what they call a licence.
OPENINGS = (
    "Licensed under", "Released under", "Distributed under", "Published under", "Available under", "Made available under",
    "Provided under", "Shared under", "This work is licensed under", "This software is licensed under",
    "This project is licensed under", "This program is licensed under", "This document is licensed under",
    "This article is licensed under", "This text is licensed under", "This content is licensed under",
    "This work is released under", "This software is released under", "This project is released under", "License:",
)
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause",
    ),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "0BSD License", "0BSD"),
    "Unlicense": ("Unlicense",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 License", "CC0", "CC0 1.0 Universal", "Creative Commons Zero 1.0", "Creative Commons CC0 1.0 Universal"),
}
_GNU = {
    "GPL": ("General", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("3.0",)),
}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _names() -> Iterator[tuple[str, str]]:
    """Licence and what notices call it."""
    for licence, names in NAMES.items():
        yield from ((licence, x) for x in names)
    for short, (kind, versions) in _GNU.items():
        for full in versions:
            v = full.removesuffix(".0")
            for name in (f"GNU {kind} Public License", f"GNU {short}", short):
                for version in dict.fromkeys((f"version {v}", v, full)):
                    yield f"{short}-{full}", f"{name} {version}"
                yield f"{short}-{full}-or-later", f"{name} version {v} or later"
            yield f"{short}-{full}-or-later", f"{short} {full} or later"
            for later in (
                f"either version {v} or later", f"version {v} or any later version",
                f"either version {v} of the License, or (at your option) any later version",
            ):
                yield f"{short}-{full}-or-later", f"GNU {kind} Public License {later}"
            yield f"{short}-{full}", f"{short}v{v}"
            yield f"{short}-{full}-or-later", f"{short}v{v} or later"
    for short, kind in _CC.items():
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            licence = f"CC-{short}-{version}"
            yield from ((licence, x) for x in (f"CC {short} {version}", f"CC {short} {version} License"))
            for name in (f"Creative Commons {kind} {version}", f"Creative Commons {kind} {version} {place}"):
                yield from ((licence, x) for x in (name, f"{name} License"))


def _notices() -> Iterator[tuple[str, str]]:
    """Licence and notice: openings with names, and SPDX lines."""
    licences = set()
    for licence, name in _names():
        licences.add(licence)
        # A name alone is a notice only if it says that it is a licence.
        if "License" in name:
            yield licence, name
        if name.startswith("Creative"):
            articles = ("a ", "the ")
        elif name.startswith(("GNU", "CC")) or "GPL" in name:
            articles = ("", "the ")
        else:
            articles = ("", "the ", "the terms of the ")
        if name.startswith("GNU"):
            yield from ((licence, f"{opening} the terms of the {name}") for opening in OPENINGS[:3])
        yield from ((licence, f"{opening} {x}{name}") for opening in OPENINGS for x in articles)
    for licence in licences:
        yield licence, f"SPDX-License-Identifier: {licence}"
        if licence.endswith("-or-later"):
            yield licence.removesuffix("-or-later"), f"SPDX-License-Identifier: {licence.removesuffix('-or-later')}-only"


def _whole() -> Iterator[tuple[str, str]]:
    """Licence and whole text, with and without what may stand above or below it."""
    texts = [x for x in KNOWN if len(x[1]) > 200]
    for file in resources.files(__package__).joinpath("licence_texts").iterdir():
        if file.name.endswith(".txt"):
            texts.append((file.name.removesuffix(".txt"), file.read_text("utf-8")))
    # Clauses are numbered or starred.
    texts += [(name, re.sub(r"(?m)^[0-9]\. ", "* ", x)) for name, x in texts if name.startswith("BSD-")]
    for licence, text in texts:
        for title in ("", *TITLES.get(licence, ())):
            for rights in ("", "All rights reserved."):
                yield licence, f"{title}\n{rights}\n{text}"
        end = "END OF TERMS AND CONDITIONS"
        if end in text:
            before = text[: text.index(end)]
            yield from ((licence, x) for x in (before, before + end))

# Known texts beyond this many are joined by a shuffle, not broadcast.
_BROADCAST = 10_000
# What a line must hold to be looked up, and versions of which a plus means any later one.
_MARK = r"licen[cs]|creative commons|\bcc(?:0|[ -]by)\b|gpl"
_PLUS = r"(gpl[ -]?(?:version |v)?[0-9](?:\.[0-9])?)\+"
# A line is dropped as a copyright line when it opens with one of these.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*+(?:\(c\)|©|copyright\s++(?:\(c\)|©|[0-9]|by\b|[\[<{]))[^\n]*+$"


def canonical(text: Column) -> Column:
    """The canonical form of a text; texts that differ only in form have the same one."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, " "), _PLUS, "$1 or later")
    # Two spaces between words, one at either end: each word has a space of its own
    # on both sides, so that neighbours are replaced alike.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        wide = (f" {x.replace(' ', '  ')} " for x in (spelling, usual))
        out = F.replace(out, *map(F.lit, wide))
    return F.regexp_replace(F.trim(out), " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """``licence, text``: the licences that are known without a table of one's own."""
    rows = dict.fromkeys((*KNOWN, *_notices(), *_whole()))
    return spark.createDataFrame(list(rows), "licence string, text string")


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``digest``, ``licence``, ``notices``, ``n_notices``.

    ``digest`` is that of the whole canonical text, ``licence`` the known licence the
    whole text is (null: none), ``notices`` the licences that single lines are, each
    once, in order, comma-joined (empty: none), ``n_notices`` the lines that are one.
    A null text counts as empty; texts without a letter or digit match nothing. Rows
    that repeat an id or have none stay rows of their own. If two known licences share
    a digest the smallest name holds. Extra columns of either table are ignored.
    """
    table = (
        known.select(F.col("licence").alias("_licence"), digest(text_of("text")).alias("_digest"))
        .where((F.col("_digest") != F.sha2(F.lit(""), 256)) & F.col("_licence").isNotNull())
        .groupBy("_digest")
        .agg(F.min("_licence").alias("_licence"))
    )
    if table.count() <= _BROADCAST:
        table = F.broadcast(table)
    # Whole text as unit 0, then its lines that name a licence.
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.lower(x).rlike(_MARK))
    units = (
        docs.select("doc_id", text_of("text").alias("_text"))
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_row", "doc_id", F.posexplode(F.concat(F.array("_text"), lines)).alias("_unit", "_part"))
        .select("_row", "doc_id", "_unit", digest(F.col("_part")).alias("_digest"))
    )
    whole, line = F.col("_unit") == 0, F.col("_unit") > 0
    return (
        units.join(table, "_digest", "left")
        .groupBy("_row", "doc_id")
        .agg(
            F.min(F.when(whole, F.col("_digest"))).alias("digest"),
            F.min(F.when(whole, F.col("_licence"))).alias("licence"),
            F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("_licence")))), ",").alias("notices"),
            F.count(F.when(line, F.col("_licence"))).alias("n_notices"),
        )
        .drop("_row")
    )
