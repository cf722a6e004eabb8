"""License scans with DataFrame operations only: MinHash bands retrieve templates, exact containment verifies.

Texts are lower-cased words of letters and digits. A template is one part, or several where it is longer than the longest
window holds: its five-word shingles are dealt to parts in their order. Overlapping windows of six lengths are laid so that
any part lies whole in a window at most four times as rich in shingles. Windows have one-row MinHash bands: 64 for the
shortest (Jaccard >= 1/4 for a verbatim part: a band is shared with probability 1 - 0.75^64 > 1 - 2e-8), 32 for the
others (Jaccard >= 1/3: > 1 - 3e-6; >= 1/4 where a fifth of the shingles differ: > 1 - 2e-4). Where bands meet and the
window holds NEAR_SHARE of the part, every window that begins within a stride of it is verified with the exact share of the
part's shingles, so the grid of the search leaves no trace in the result. A template is there if its parts, each
with PART_SHARE at least if there are several, together hold MIN_SHARE of its shingles.

A lossless gate spares the rest: a window that holds MIN_SHARE of a part's shingles holds one of its anchor words,
chosen so that without them too few shingles are left. Only windows around anchor words are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
MIN_SHARE, PART_SHARE, NEAR_SHARE = 0.8, 0.5, 0.35
#: (window words, stride): a part of up to window - stride + 1 words lies whole in one.
WINDOWS = ((8, 2), (16, 4), (32, 8), (64, 16), (128, 32), (256, 64))
BANDS = {8: 64}
OTHER_BANDS = 32

#: Short notices, openings and full texts of public licenses.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause/clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0/sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0/notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT/full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense/full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/opening": "This is free and unencumbered software released into the public domain.",
}


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """The distinct five-word shingles; fewer words make one shingle, none make none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def bands(hashes: Column, window: Column) -> Column:
    """One MinHash per band of the shingles' hashes, tagged with the band's number."""
    count = F.lit(OTHER_BANDS)
    for w, n in BANDS.items():
        count = F.when(window == w, n).otherwise(count)
    least = lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.xxhash64(b, least(b)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often later expressions use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parts_of(templates: dict[str, str]) -> list[tuple[str, int, int, list[str], list[str]]]:
    """(template, part, window, shingles, anchor words) of all templates: shingles dealt in order to as few parts as fit the
    longest window. Anchors: of a part's words so many, greedily, that MIN_SHARE of its shingles cannot do without any."""
    import re

    out, longest = [], WINDOWS[-1][0] - WINDOWS[-1][1] + 1
    for name, text in sorted(templates.items()):
        words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
        if not words:
            continue
        every = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
        n = -(-len(every) // (longest - SHINGLE + 1))
        for k in range(n):
            mine = every[len(every) * k // n : len(every) * (k + 1) // n]
            size = len(mine) + len(mine[-1]) - 1
            window = next(w for w, s in WINDOWS if size <= w - s + 1)
            left = {tuple(s) for s in mine}
            total, anchors = len(left), []
            while len(left) >= MIN_SHARE * total:
                # the word that most remaining shingles hold; long words first, as they are rare
                best = max(sorted({w for s in left for w in s}), key=lambda w: (sum(w in s for s in left) * (len(w) > 5), len(w)))
                anchors.append(best)
                left = {s for s in left if best not in s}
            out.append((name, k, window, list(dict.fromkeys(" ".join(s) for s in mine)), anchors))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, template, share (of its shingles, in each part's best window), first_word (that
    window's first word, from 0; the earliest of equals, and of parts). One row per doc_id and template found; whole texts,
    templates of any length.

    Null, empty and wordless texts have no rows; rows that repeat a doc_id are read together; a null doc_id
    is a doc_id of its own; empty tables give no rows. min_share is MIN_SHARE or more.
    """
    spark = docs.sparkSession
    parts = parts_of(templates)
    anchors = sorted({a for *_, found in parts for a in found})
    gate = F.lower("text").rlike("|".join(anchors))
    gated = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(gate)
    words = _once(gated.select("doc_id", "text"), "words", normal_words(F.col("text"))).select("doc_id", "words")
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    words = _once(words, "spots", spots).where(F.size("spots") > 0)
    known = spark.createDataFrame([p[:4] for p in parts], "template string, part int, window int, wanted array<string>")
    known = _once(known, "hashes", F.transform("wanted", lambda s: F.xxhash64(s))).select("template", "part", "window", "wanted", F.explode(bands(F.col("hashes"), F.col("window"))).alias("band"))
    plans = F.array(*(F.struct(F.lit(w).alias("window"), F.lit(s).alias("stride")) for w, s in WINDOWS if any(p[2] == w for p in parts)))
    at = words.select("doc_id", "words", "spots", F.explode(plans).alias("p")).select("doc_id", "words", "spots", "p.window", "p.stride")
    stride, window = F.col("stride"), F.col("window")
    last = F.floor(F.greatest(F.size("words") - window + stride - 1, F.lit(0)) / stride)
    around = lambda i: F.sequence(F.least(F.ceil(F.greatest(i - window + 1, F.lit(0)) / stride), last), F.least(F.floor(i / stride), last))
    starts = F.array_distinct(F.flatten(F.transform("spots", around)))
    # a window and a stride of words on both sides; no row holds more of the text
    near = lambda k: F.greatest(k * stride - stride, F.lit(0)).cast("int")
    cut = at.select("doc_id", "window", "stride", F.explode(F.transform(starts, lambda k: F.struct((k * stride).cast("int").alias("start"), near(k).alias("from"), F.slice("words", near(k) + 1, window + 2 * stride).alias("near")))).alias("c"))
    cut = cut.select("doc_id", "window", "stride", "c.start", "c.from", "c.near")
    cut = _once(cut, "held", shingles(F.slice("near", F.col("start") - F.col("from") + 1, window)))
    cut = _once(cut, "hashes", F.transform("held", lambda s: F.xxhash64(s)))
    likely = cut.select("doc_id", "window", "stride", "start", "from", "near", "held", F.explode(F.array_distinct(bands(F.col("hashes"), window))).alias("band"))
    met = likely.join(F.broadcast(known), ["window", "band"])  # some hundred rows: parts times bands
    share = lambda held: F.size(F.array_intersect("wanted", held)) / F.size("wanted")
    met = met.where(share(F.col("held")) >= NEAR_SHARE).drop("band", "held").dropDuplicates(["doc_id", "template", "part", "start"])
    # every window that begins within a stride: the best share, then the earliest
    offsets = F.sequence(F.lit(0), F.greatest(F.size("near") - window, F.lit(0)))
    tried = F.transform(offsets, lambda o: F.struct(share(shingles(F.slice("near", o + 1, window))).alias("share"), (-(F.col("from") + o)).alias("back")))
    best = met.select("doc_id", "template", "part", F.size("wanted").alias("n"), F.array_max(tried).alias("best"))
    best = best.groupBy("doc_id", "template", "part", "n").agg(F.max("best").alias("best"))
    sizes: dict[str, tuple[int, int]] = {}
    for name, _, _, wanted, _ in parts:
        n, m = sizes.get(name, (0, 0))
        sizes[name] = (n + len(wanted), m + 1)
    totals = F.broadcast(spark.createDataFrame([(k, *v) for k, v in sizes.items()], "template string, total int, parts int"))  # one row a template
    whole = best.join(totals, "template").where((F.col("parts") == 1) | (F.col("best.share") >= PART_SHARE))
    out = whole.groupBy("doc_id", "template", "total").agg(F.sum(F.col("best.share") * F.col("n")).alias("held"), F.min(-F.col("best.back")).cast("long").alias("first_word"))
    out = out.withColumn("share", F.round(F.col("held") / F.col("total"), 6)).where(F.col("share") >= min_share)
    return out.select("doc_id", "template", "share", "first_word")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql_licenses() -> str:
    """Brute force: every part against the windows of its length at every word; no grid, no gate and no MinHash."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {part}, {window}, [{', '.join(map(quote, wanted))}])" for name, part, window, wanted, _ in parts_of(TEMPLATES))
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    cut = "list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: array_to_string(list_slice({0}, i, i + 4), ' '))"
    return f"""
WITH parts AS (SELECT * FROM (VALUES {values}) AS v(template, part, size, wanted)),
docs AS (SELECT doc_id, {words.format('text')} AS words FROM documents WHERE text IS NOT NULL),
every AS MATERIALIZED (SELECT doc_id, words, {cut.format('words')} AS shingles FROM docs WHERE len(words) > 0),
hopeful AS MATERIALIZED (SELECT e.doc_id, e.shingles, len(e.words) AS n, p.template, p.part, p.size, p.wanted FROM every e, parts p WHERE len(list_intersect(list_distinct(e.shingles), p.wanted)) >= 0.4 * len(p.wanted)),
spots AS (SELECT doc_id, template, part, size, n, wanted, unnest(list_filter(range(1, len(shingles) + 1), lambda i: list_contains(wanted, shingles[i]))) AS spot, shingles FROM hopeful),
windows AS (SELECT DISTINCT doc_id, template, part, size, unnest(range(greatest(0, spot - size + 4), least(spot - 1, greatest(0, n - size)) + 1)) AS start FROM spots),
shares AS (SELECT w.doc_id, w.template, w.part, w.start, len(h.wanted) AS m, len(list_intersect(h.wanted, list_distinct(list_slice(h.shingles, w.start + 1, greatest(w.start + w.size - 4, w.start + 1)))))::DOUBLE / len(h.wanted) AS share
           FROM windows w JOIN hopeful h USING (doc_id, template, part)),
best AS (SELECT doc_id, template, part, m, max(share) AS share, arg_min(start, (-share, start)) AS start FROM shares GROUP BY ALL),
sizes AS (SELECT template, sum(len(wanted)) AS total, count(*) AS parts FROM parts GROUP BY 1),
whole AS (SELECT doc_id, template, total, sum(share * m) AS held, min(start) AS start FROM best JOIN sizes USING (template) WHERE parts = 1 OR share >= {PART_SHARE} GROUP BY ALL)
SELECT doc_id, template, round(held / total, 6) AS share, start::BIGINT AS first_word FROM whole WHERE round(held / total, 6) >= {MIN_SHARE}"""
