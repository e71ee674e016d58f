"""License scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are lines; a notice that is wrapped over lines is scanned as well, as a line that
has a weighted n-gram together with the next WRAPPED words of the lines that follow without
a blank one between. Such a window counts if it is confirmed and has no line and no earlier
window in it that is. A multinomial logistic regression over word unigrams and bigrams,
made sparse by L1, tells license families and an unknown class apart. It learns from the
templates below, varied by dropped words and surrounding text, and from a bounded sample of
the corpus' own lines, from anywhere in its texts, as unknown. L1 is applied as a proximal
step, which leaves most weights at zero. A temperature and a least probability are set on
rows held out of training: the least probability above which at most one in a thousand
unknown lines, and never less than a half, is named a known family. A prediction counts as confirmed if the paragraph holds enough of one template's
n-grams of the predicted family; a template of few n-grams, such as a phrase that other
sentences hold as well, must also be a fair share of the paragraph's.

Scoring is DataFrame operations alone, inside the row: n-grams without weight are dropped
by a literal set, which changes no sum, and the rest look their weights up in a literal map
(n-grams of the templates alone). Only a document's best paragraphs are shuffled.

Defined cases: null and empty texts have no paragraphs and are unknown with score 0; rows
that repeat a document are scored each; of equally likely paragraphs the first counts;
extra columns are not carried.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Public license notices and paragraphs of license texts, by family: fixed values.
TEMPLATES = {
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0. You should have received a copy of the GNU Affero General Public License along with this program.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL-2.0. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL-3.0. See the GNU Lesser General Public License for more details.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the MPL 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
}
UNKNOWN = "unknown"
#: Bounds: corpus lines learned as unknown, variants of a template.
SAMPLE_LINES, VARIANTS = 3000, 40
BUCKETS = 256
EPOCHS, BATCH, L1, LIFT, SEED = 10, 32, 2e-4, 5.0, 3
CONFIRMED = 0.6
#: A template of fewer n-grams confirms only paragraphs of which it is at least one part in so many.
EVIDENCE, PARTS = 9, 3
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words of the longest template, which a window takes from the lines after its first.
WRAPPED = max(len(re.findall(WORDS, t.lower())) for ts in TEMPLATES.values() for t in ts)


def grams(line: str) -> list[str]:
    w = re.findall(WORDS, line.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


def _similarity(have: set[str], want: set[str]) -> float:
    return len(have & want) / max(1, len(want))


def _variants(lines: list[str], rng: np.random.Generator) -> list[tuple[set[str], str]]:
    """Rows to learn from: (n-grams, family)."""
    known = [set(grams(t)) for ts in TEMPLATES.values() for t in ts]
    rows = [(g, UNKNOWN) for g in (set(grams(x)) for x in lines) if g and max(_similarity(g, k) for k in known) < CONFIRMED / 2]
    filler = [w for x in lines for w in re.findall(WORDS, x.lower())][:200_000] or ["text"]
    for family, ts in TEMPLATES.items():
        for t in ts:
            w = re.findall(WORDS, t.lower())
            for k in range(VARIANTS):
                kept = [x for x in w if rng.random() > (0.12 if k and len(w) > 6 else 0)]
                before, after = (rng.integers(0, len(filler) - n + 1) if len(filler) >= n else 0 for n in (8, 30))
                kept = filler[before : before + int(rng.integers(0, 9))] * (k % 2) + kept + filler[after : after + int(rng.integers(0, 31))] * (k % 3 > 0)
                rows.append((set(grams(" ".join(kept))), family))
    return rows


def train(lines: list[str], seed: int = SEED) -> dict:
    """weights {n-gram: one a class}, bias, temperature and least probability; classes end with unknown."""
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    rows = _variants(lines, rng)
    held = rng.random(len(rows)) < 0.25
    own = np.flatnonzero(~held)
    rows_of, df = Counter(rows[i][1] for i in own), Counter((g, rows[i][1]) for i in own for g in rows[i][0])
    share = lambda g, f: df[g, f] / max(1, rows_of[f])
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)})
    vocabulary = [g for g in vocabulary if max(share(g, f) for f in TEMPLATES) > LIFT * share(g, UNKNOWN)]
    index = {g: i for i, g in enumerate(vocabulary)}
    x = [np.array(sorted(index[g] for g in gs if g in index), int) for gs, _ in rows]
    y = np.array([classes.index(f) for _, f in rows])
    w, b = np.zeros((len(index), len(classes))), np.zeros(len(classes))
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)

    def logits(k: np.ndarray) -> np.ndarray:
        return np.stack([w[x[i]].sum(axis=0) for i in k]) + b if len(k) else np.zeros((0, len(classes)))

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for lo in range(0, len(order), BATCH):
            k = order[lo : lo + BATCH]
            d = softmax(logits(k))
            d[np.arange(len(k)), y[k]] -= 1
            d /= len(k)
            at = np.concatenate([x[i] for i in k])
            u, back = np.unique(at, return_inverse=True)
            g = np.zeros((len(u), len(classes)))
            np.add.at(g, back, np.repeat(d, [len(x[i]) for i in k], axis=0))
            gw[u] += g**2
            gb += d.sum(axis=0) ** 2
            rate = 0.3 / np.sqrt(gw[u])
            w[u] -= rate * g
            w[u] = np.sign(w[u]) * np.maximum(np.abs(w[u]) - rate * L1, 0)
            b -= 0.3 * d.sum(axis=0) / np.sqrt(gb)
    z, t = logits(np.flatnonzero(held)), y[held]
    loss = {s: -np.log(softmax(z / s)[np.arange(len(t)), t] + 1e-12).mean() if len(t) else 0 for s in np.arange(0.5, 4.01, 0.25)}
    temperature = float(min(loss, key=loss.get))
    p = softmax(z / temperature)[:, :-1].max(axis=1) if len(t) else np.zeros(0)
    wrong = p[t == len(classes) - 1] if len(t) else p
    least = max(0.5, float(np.quantile(wrong, 0.999))) if len(wrong) else 0.5
    return {"classes": classes, "weights": {g: w[i].tolist() for g, i in index.items() if w[i].any()}, "bias": b.tolist(), "temperature": temperature, "least": least}


def training_lines(docs: DataFrame, n: int = SAMPLE_LINES) -> list[str]:
    """At most n lines of the corpus, those with the least hashes of place in document: from n documents, three of each."""
    place = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    ids = docs.filter(F.length("text") > 0).select("doc_id").distinct().orderBy(*place).limit(n)  # ids first: tasks send no texts that go
    lines = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    first = F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(SEED), "doc_id", "pos").alias("h"), "pos", "line")))
    picked = lines.groupBy("doc_id").agg(F.slice(first, 1, 3).alias("l")).select("doc_id", F.explode("l").alias("l"))
    return [r["line"] for r in picked.orderBy("l.h", "doc_id").limit(n).select("l.line").collect()]


def _literal(value: object, kind: str) -> Column:
    """A constant of any size as one expression, which folds; built up from literals it would take a call an element."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_paragraphs(docs: DataFrame, model: dict) -> DataFrame:
    """One row a line that has a weighted n-gram, one a confirmed window of lines, and one with null pos for a document without: _rid, doc_id, n_paragraphs, pos, last (of a window), family, score, similarity, licensed."""
    classes, known = model["classes"], list(model["weights"])
    unseen = np.array(model["bias"]) / model["temperature"]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_rid"), F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_extract_all(x, F.lit(f"({WORDS})"), F.lit(1)).alias("w"))), lambda p: F.size(p["w"]) > 0).alias("_lines"))
    rows = rows.withColumn("_lines", F.transform("_lines", lambda p, k: F.struct(p["pos"].alias("pos"), p["w"].alias("w"), (p["pos"] - k).alias("gap"))))
    rows = rows.withColumn("n_paragraphs", F.size("_lines").cast("long"))
    grams_of = lambda w: f"concat({w}, transform(filter(sequence(0, size({w}) - 1), i -> i < size({w}) - 1), i -> concat({w}[i], ' ', {w}[i + 1])))"
    listed = ", ".join(f"'{g}'" for g in known or [""])  # of letters, digits, dots, hyphens and spaces
    hits = f"array_distinct(filter(p.grams, g -> g in ({listed}))) as hits"
    rows = rows.withColumn("_own", F.expr(f"transform(_lines, (p, at) -> struct(p.pos as pos, cast(null as int) as last, at, p.w as w, {grams_of('p.w')} as grams))"))
    rows = rows.withColumn("_own", F.expr(f"filter(transform(_own, p -> struct(p.pos as pos, p.last as last, p.at as at, p.w as w, p.grams as grams, {hits})), p -> size(p.hits) > 0)"))
    after = f"""aggregate(filter(slice(_lines, p.at + 2, {WRAPPED}), l -> l.gap = p.pos - p.at),
      named_struct('w', cast(array() as array<string>), 'last', p.pos), (a, l) -> if(size(a.w) < {WRAPPED}, named_struct('w', concat(a.w, l.w), 'last', l.pos), a))"""
    rows = rows.withColumn("_wrapped", F.expr(f"transform(_own, p -> struct(p.pos as pos, size(p.hits) as n, p.w as w, {after} as more))"))
    rows = rows.withColumn("_wrapped", F.expr(f"transform(filter(_wrapped, p -> size(p.more.w) > 0), p -> struct(p.pos as pos, p.more.last as last, p.n as n, concat(p.w, slice(p.more.w, 1, {WRAPPED})) as w))"))
    rows = rows.withColumn("_wrapped", F.expr(f"transform(_wrapped, p -> struct(p.pos as pos, p.last as last, p.n as n, {grams_of('p.w')} as grams))"))
    rows = rows.withColumn("_wrapped", F.expr(f"filter(transform(_wrapped, p -> struct(p.pos as pos, p.last as last, p.n as n, p.grams as grams, {hits})), p -> size(p.hits) > p.n)"))
    slim = lambda c: F.transform(c, lambda p: F.struct(*[p[x].alias(x) for x in ("pos", "last", "grams", "hits")]))
    rows = rows.withColumn("_p", F.explode_outer(F.concat(slim("_own"), slim("_wrapped")))).select("_rid", "doc_id", "n_paragraphs", F.col("_p.pos").alias("pos"), F.col("_p.last").alias("last"), F.col("_p.grams").alias("grams"), F.coalesce("_p.hits", F.array().cast("array<string>")).alias("hits"))
    scaled = {g: [float(v) / model["temperature"] for v in w] for g, w in model["weights"].items()}
    # A map is searched in order, so n-grams are spread over many; all fold to one literal.
    spread: list[dict] = [{} for _ in range(BUCKETS)]
    for g, w in scaled.items():
        spread[zlib.crc32(g.encode()) % BUCKETS][g] = w
    tables = _literal(spread, "array<map<string,array<double>>>")
    weights_of = lambda g: F.element_at(F.get(tables, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")), g)
    start = F.array(*[F.lit(float(v)) for v in unseen])
    z = F.aggregate("hits", start, lambda total, g: F.zip_with(total, weights_of(g), lambda x, y: x + y))
    # Generators, so that filters on what follows aren't pushed below it and don't work it out again for every mention.
    once = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    made = once(rows, _z=z)
    made = once(made, _top=F.array_max("_z"), _known=F.array_max(F.slice("_z", 1, len(classes) - 1)))
    likely = F.exp(F.col("_known") - F.col("_top")) / F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top")))
    made = once(made, score=F.when(F.col("pos").isNotNull(), likely).otherwise(F.lit(0.0)))
    named = (F.col("score") >= model["least"]) & (F.col("_known") == F.col("_top"))
    made = once(made, family=F.when(named, F.element_at(F.array(*map(F.lit, classes)), F.array_position("_z", F.col("_known")).cast("int"))).otherwise(F.lit(UNKNOWN)))
    # A template's n-grams are literals too: the largest share of one template of the family.
    held = lambda g: F.size(F.array_intersect("grams", _literal(g, "array<string>")))
    whole = F.size(F.array_distinct("grams"))
    fair = lambda g: held(g) / len(g) if len(g) >= EVIDENCE else F.when(PARTS * held(g) >= whole, held(g) / len(g))
    shares = [(f, F.greatest(*[fair(g) for g in map(grams, ts)], F.lit(0.0))) for f, ts in TEMPLATES.items()]
    similarity = F.lit(0.0)
    for f, share in shares:
        similarity = F.when(F.col("family") == f, share).otherwise(similarity)
    made = once(made, similarity=similarity)
    made = made.withColumn("licensed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= CONFIRMED))
    return made.filter(F.col("last").isNull() | F.col("licensed")).select("_rid", "doc_id", "n_paragraphs", "pos", "last", "family", "score", "similarity", "licensed")


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """One row a document: doc_id, n_paragraphs, n_licensed, family, score, similarity, confirmed."""
    found, line = F.struct("family", "score", "similarity", "licensed"), F.col("last").isNull()
    best = F.max_by(F.when(line, found), F.when(line, F.struct("licensed", F.col("family") != UNKNOWN, "score", -F.col("pos"))))
    per = scan_paragraphs(docs, model).groupBy("_rid", "doc_id", "n_paragraphs").agg(
        F.collect_list(F.when(line & F.col("licensed"), F.col("pos"))).alias("_own"), best.alias("_best"),
        F.array_sort(F.collect_list(F.when(~line, F.struct("pos", "last", found.alias("found"))))).alias("_windows"),
    )
    per = per.withColumn("_windows", F.expr("filter(_windows, p -> not exists(_own, x -> x between p.pos and p.last))"))
    # Windows in order; one that begins before the last counted one's end is the same notice.
    n = F.expr("aggregate(_windows, named_struct('n', 0L, 'last', -1), (a, p) -> if(p.pos > a.last, named_struct('n', a.n + 1, 'last', p.last), a), a -> a.n)")
    top = F.expr("aggregate(_windows, _best, (a, p) -> if(not a.licensed or p.found.score > a.score or (p.found.score = a.score and p.found.similarity > a.similarity), p.found, a))")
    per = per.withColumns({"n_licensed": F.size("_own") + n, "_best": top})
    return per.select("doc_id", "n_paragraphs", "n_licensed", "_best.family", "_best.score", "_best.similarity", F.col("_best.licensed").alias("confirmed"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(training_lines(docs)))
