"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A line (or some joined lines, or a whole file) is a vector of term counts times inverse document frequencies, over the
corpus for the terms of the templates and the highest for any other term. A text or line is looked at if it holds an
anchor: anchors are chosen so that a line without any can't reach the threshold with any template, and a template is
left out only if the text's terms can't make up the threshold, so this loses nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, map_texts, materialize, scratch
from .license_texts import WHOLE

#: Lines that name a license.
HEADERS = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. ",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.",
)


def _gnu(name: str, version: str) -> tuple[str, str]:
    """The first paragraph of the header, and the whole."""
    return _GNU[0].format(name, version), "".join(_GNU).format(name, version)


#: How license files begin, and the headers that licenses ask files to bear. Those of other versions keep them apart from the ten of HEADERS.
TEXTS = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",),
    "Apache-2.0": (
        "You may not use this file except in compliance with the License, a copy of the Apache License is at www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", *_gnu("General Public License", "3")),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "CC-BY-NC-4.0": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "Proprietary": ("Proprietary and confidential, unauthorized copying of this file is strictly prohibited",),
}
COSINE = 0.75
#: A template of more terms than this is held only against what has half as many terms at least: a few frequent words come near a long text.
SHORT = 40
#: Anchors are first chosen among terms that at most this share of the rows holds.
RARE = 0.01
#: A whole text this near to one of TEXTS or WHOLE is a license file, whatever its name.
FILE_COSINE = 0.8
FILE_NAME = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$")
TERM = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


#: Whole licenses come last.
TEMPLATES = (*((k, x) for k, group in HEADERS.items() for x in group), *((k, x) for k, group in TEXTS.items() for x in group), *WHOLE.items())
VOCABULARY = tuple(sorted({t for _, x in TEMPLATES for t in terms(x)}))


def rounded(cosine: float) -> float:
    """To nine digits, so that equal cosines are equal however they were summed."""
    return round(min(1.0, cosine), 9)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of docs and, for each template term, the rows that hold it: sums over all rows, as many as the vocabulary."""
    known = frozenset(VOCABULARY)

    def run(batches):
        rows, held = 0, Counter()
        for b in batches:
            for t in b.column(0):
                rows += 1
                held.update(known.intersection(TERM.findall((t.as_py() or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *held], pa.string()), pa.array([rows, *held.values()], pa.int64())], names=["term", "n"])

    got = dict(docs.select(docs[text].cast("string").alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    return got.pop("", 0), got


class Matcher:
    """Templates as unit vectors by term, and the anchors."""

    def __init__(self, rows: int, held: dict[str, int], threshold: float = COSINE, file_threshold: float = FILE_COSINE):
        self.threshold = threshold
        self.floor = min(threshold, file_threshold)
        self.highest = log(rows + 1) + 1
        self.idf = {t: log((rows + 1) / (held.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.known = frozenset(VOCABULARY)
        self.names, self.by_term, self.vectors, self.sizes = [], {}, [], []
        self.first_text = sum(map(len, HEADERS.values()))  # templates from here on are TEXTS and WHOLE
        self.first_whole = len(TEMPLATES) - len(WHOLE)
        for name, x in TEMPLATES:
            counts = terms(x)
            v = {t: c * self.idf[t] for t, c in counts.items()}
            size = sqrt(sum(w * w for w in v.values()))
            self.vectors.append({t: w / size for t, w in v.items()})
            for t, w in self.vectors[-1].items():
                self.by_term.setdefault(t, []).append((len(self.names), w))
            self.names.append(name)
            self.sizes.append(sum(counts.values()))
        self.least = [n // 2 if n > SHORT else 1 for n in self.sizes]
        anchors: set[str] = set()
        for v in self.vectors:
            for t, _ in sorted(v.items(), key=lambda x: (held.get(x[0], 0) > RARE * rows, -x[1], x[0])):
                if sqrt(sum(w * w for u, w in v.items() if u not in anchors)) < self.floor:
                    break
                anchors.add(t)
        self.anchors = frozenset(anchors)

    def nearest(self, counts: Counter, first: int = 0) -> tuple[float, int]:
        """The greatest cosine to a template from `first` on, and its number or -1; of equal ones the first name."""
        dots: dict[int, float] = {}
        square = 0.0
        size = sum(counts.values())
        for t, c in counts.items():
            w = c * self.idf.get(t, self.highest)
            square += w * w
            for i, x in self.by_term.get(t, ()):
                if i >= first and size >= self.least[i]:
                    dots[i] = dots.get(i, 0.0) + w * x
        if not dots:
            return 0.0, -1
        cosine, _, i = min((-rounded(d / sqrt(square)), self.names[i], i) for i, d in dots.items())
        return -cosine, i

    def best(self, text: str, first: int = 0) -> tuple[float, str | None]:
        """The greatest cosine to a template from `first` on, and its license; of equal ones the first name."""
        cosine, i = self.nearest(terms(text), first)
        return cosine, self.names[i] if i >= 0 else None

    def joined(self, lines: list[tuple[int, int, list[str]]], i: int) -> tuple[float, int, int]:
        """Of runs of two lines or more about as long as template i, the greatest cosine to it, start and end (0, -1, -1 if none reaches the threshold).

        For each last line these are the runs of the template's number of terms or just over, and just under.
        """
        v, most, least = self.vectors[i], self.sizes[i], self.least[i]
        counts: Counter = Counter()
        dot = square = 0.0
        total = first = 0
        top = (0.0, -1, -1)
        for last, (_, end, added) in enumerate(lines):
            for t in added:
                w = self.idf.get(t, self.highest)
                square += (2 * counts[t] + 1) * w * w
                dot += w * v.get(t, 0.0)
                counts[t] += 1
            total += len(added)
            while first < last:
                if total >= least and dot > 0 and (cosine := rounded(dot / sqrt(square))) >= self.threshold and cosine > top[0]:
                    top = cosine, lines[first][0], end
                if total <= most:
                    break
                for t in lines[first][2]:
                    w = self.idf.get(t, self.highest)
                    counts[t] -= 1
                    square -= (2 * counts[t] + 1) * w * w
                    dot -= w * v.get(t, 0.0)
                    if not counts[t]:
                        del counts[t]
                total -= len(lines[first][2])
                first += 1
        return top

    def scan(self, text: str | None) -> tuple[str | None, float, int, int, float, str | None]:
        """(license, cosine, start, end) of the best line or run of lines at or over the threshold (of ties the first line; code points), else (None, 0, -1, -1); then the whole text's cosine to TEXTS and WHOLE, and license.

        A reservation of all rights, customary above free licenses too, gives way to the text of a license, and a line
        within a whole license (licenses share some) to that license.
        """
        text = text or ""
        none = (None, 0.0, -1, -1)
        present = self.known.intersection(TERM.findall(text.lower()))
        if present.isdisjoint(self.anchors):
            return *none, 0.0, None
        covered: dict[int, float] = {}
        for t in present:
            for i, w in self.by_term[t]:
                covered[i] = covered.get(i, 0.0) + w * w
        near = sorted(i for i, x in covered.items() if x >= self.floor**2 - 1e-9)
        if not near:
            return *none, 0.0, None
        lines, start = [], 0
        for line in text.split("\n"):
            if held := TERM.findall(line.lower()):
                lines.append((start, start + len(line), held))
            start += len(line) + 1
        found = given = full = none  # given: by the text of a license; full: by a whole one

        def take(cosine: float, i: int, start: int, end: int) -> None:
            nonlocal found, given, full
            if cosine > found[1]:
                found = self.names[i], cosine, start, end
            if i >= self.first_text and self.names[i] != "Proprietary" and cosine > given[1]:
                given = self.names[i], cosine, start, end
            if i >= self.first_whole and cosine > full[1]:
                full = self.names[i], cosine, start, end

        for start, end, held in lines:
            if not self.anchors.isdisjoint(held):
                cosine, i = self.nearest(Counter(held))
                if cosine >= self.threshold:
                    take(cosine, i, start, end)
        if len(lines) > 1:
            for i in near:
                cosine, start, end = self.joined(lines, i)
                if start >= 0:
                    take(cosine, i, start, end)
        if found[0] == "Proprietary" and given[0]:
            found = given
        if full[0] and full[2] <= found[2] and found[3] <= full[3]:
            found = full
        cosine, i = self.nearest(Counter(t for _, _, held in lines for t in held), self.first_text)
        return *found, cosine, self.names[i] if i >= 0 else None


FIELDS = [("own_license", T.StringType(), pa.string()), ("own_cosine", T.DoubleType(), pa.float64()), ("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("whole_cosine", T.DoubleType(), pa.float64()), ("whole_license", T.StringType(), pa.string())]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", threshold: float = COSINE, file_threshold: float = FILE_COSINE) -> DataFrame:
    """One row per row of docs: doc_id, license, origin (own, inherited, none), cosine, start, end, license_dir.

    own: the text's best line or run of lines reaches the threshold. Else inherited: the nearest directory at or above the file's that
    holds a license file (by its name, with such a line, or by its whole text, which is held against TEXTS and WHOLE) gives its license; of several license
    files in a directory the one of highest cosine counts, then the least name. Paths are split at "/"; a null path is
    in no directory and inherits nothing. A null text counts as empty. start and end are code points, -1 if not own.
    Repeated rows get equal results, also as license files; of equally near templates the least name counts, of equal
    lines the first. Very long texts are read whole, line by line. Other columns are not read, whatever their names; an
    empty table gives an empty result.
    """
    matcher = Matcher(*document_frequencies(docs, text), threshold, file_threshold)
    with scratch() as keep:
        cols = docs.select(docs[doc_id].alias("doc_id"), docs[path].cast("string").alias("path"), docs[text].cast("string").alias("text"))

        def make():
            return lambda texts: list(zip(*map(matcher.scan, texts), strict=True)) if texts else [[] for _ in FIELDS]

        seen = map_texts(cols, make, FIELDS, "text", ["doc_id", "path"])
        up = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        seen = keep(materialize(seen.withColumn("dir", F.when(F.col("path").isNotNull(), up)), "license-lines"))
        by_name = F.col("path").rlike(FILE_NAME.pattern) & F.col("own_license").isNotNull()
        by_text = F.col("whole_cosine") >= file_threshold
        files = seen.where(F.col("dir").isNotNull() & (by_name | by_text))
        given = F.when(by_text, F.struct((-F.col("whole_cosine")).alias("c"), F.col("whole_license").alias("name"))).otherwise(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("name")))
        files = materialize(files.groupBy(F.col("dir").alias("license_dir")).agg(F.min(given).alias("given")), "license-files")
        # directories, not files, look for their ancestors; a directory may have a third of all files, and a root is above all
        dirs = materialize(seen.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n")), "license-dirs")
        steps = F.split("dir", "/")
        above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("up"))
        below = materialize(above.groupBy(F.col("up").alias("b_up")).agg(F.count("*").alias("below")), "license-below")
        givers = materialize(files.join(below, F.col("license_dir") == F.col("b_up")).select(F.col("b_up").alias("up"), "below", "given"), "license-givers")
        met = join_hot(above, givers, "up", "below", below.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0])
        near = met.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), F.col("up").alias("license_dir"), "given")).alias("best"))
        near = near.join(dirs.withColumnRenamed("dir", "d"), F.col("dir") == F.col("d")).select("dir", "n", "best.license_dir", F.col("best.given.name").alias("dir_license"), (-F.col("best.given.c")).alias("dir_cosine"))
        near = keep(materialize(near, "license-near"))
        out = join_hot(seen, near, "dir", "n", dirs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "left")
    own = F.col("own_license").isNotNull()
    origin = F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", F.coalesce("own_license", "dir_license").alias("license"), origin.alias("origin"), F.when(own, F.col("own_cosine")).otherwise(F.coalesce("dir_cosine", F.lit(0.0))).alias("cosine"), "start", "end", F.when(~own, F.col("license_dir")).alias("license_dir"))
