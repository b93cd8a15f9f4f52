"""License scans (9): a trained paragraph classifier over word n-grams, with templates to confirm what it predicts.

Multinomial logistic regression learns licence families and an unknown class
from sparse n-grams; only DataFrame functions and Spark ML.
"""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

UNKNOWN = "unknown"

#: Wordings of public licences and of the notices that name them, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "isc": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Released under the Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under The Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
        "This software is proprietary; no license is granted.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: How the families are called in short notices, and the forms of such notices.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT", "the MIT License", "Expat"),
    "apache": ("Apache 2.0", "the Apache License", "Apache-2.0"),
    "gpl": ("GPL", "the GNU GPL", "GPLv3", "GPL-2.0", "the GNU General Public License"),
    "lgpl": ("LGPL", "the GNU Lesser GPL", "LGPL-3.0", "the GNU Lesser General Public License"),
    "agpl": ("AGPL", "the GNU Affero GPL", "AGPLv3", "the GNU Affero General Public License"),
    "mpl": ("MPL 2.0", "the Mozilla Public License", "MPL-2.0"),
    "bsd": ("BSD", "the BSD License", "BSD-2-Clause", "the 3-clause BSD license", "the new BSD license"),
    "isc": ("ISC", "the ISC License"),
    "cc0": ("CC0", "CC0 1.0", "the CC0 public domain dedication"),
    "cc-by": ("CC BY 4.0", "CC-BY", "the Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 3.0", "CC-BY-SA", "the Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC-SA 3.0", "the Creative Commons NonCommercial License"),
    "unlicense": ("the Unlicense", "Unlicense"),
    "proprietary": ("a proprietary license", "a commercial license"),
}
NOTICES = ("Licensed under {}.", "Released under {}", "Distributed under the terms of {}.", "Available under {}.", "License: {}", "The code is licensed under {}.", "{} licensed", "{} applies", "Published under {}, see LICENSE.")
#: Sentences with the words of licences that license nothing.
OTHERS = (
    "The driver lost her license after the accident.",
    "A fishing license is required on this lake.",
    "The bar has no license to sell spirits.",
    "Researchers at MIT built a new robot.",
    "The Apache helicopter landed near the village.",
    "The Apache people lived in the mountains.",
    "The gnu is a large antelope of the general plains.",
    "Copyright law was changed by the new government.",
    "The software was released in the spring of that year.",
    "We released the bird under a tree.",
    "The public square is open to the general public.",
    "She asked for permission to leave the room.",
    "The work is done under the terms of the contract.",
    "The creative writing class and the commons were full.",
    "Version 2 of the report was distributed to all members.",
    "All rights of workers are protected by the union.",
    "The source of the river is in the hills.",
    "He may obtain a copy of the map at the station.",
    "The notice above the door shall be read by all.",
    "Mozilla and other firms held a conference.",
)
#: Common words for sentences without licence words.
COMMON = "a i me us our am an being if only nor both each such own too can s t just don now he she her hers him his la le les de des du un une et en est que qui pour dans sur par el los las y no se con der die das und ist nicht mit von zu auf für im dem ein eine sich auch als nach wie the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house don world going want".split()

PIECE = r"[\p{L}\p{N}]+(?:[.'’+-][\p{L}\p{N}]+)*"
MAX_GRAM = 3
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)


def normal_words(text: Column) -> Column:
    """Lower-case words; versions and numbers become `#`."""
    words = F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))
    return F.transform(words, lambda w: F.when(w.rlike(r"^v?[0-9][0-9.]*$"), "#").otherwise(w))


def grams(words: Column, sizes: range) -> Column:
    """Distinct word n-grams."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def templates() -> dict[str, tuple[str, ...]]:
    """All wordings by family: TEMPLATES, and each short notice with each name."""
    return {f: (*own, *(n.format(name) for name in NAMES[f] for n in NOTICES)) for f, own in TEMPLATES.items()}


def training_paragraphs(seed: int = 9) -> list[tuple[str, str, bool]]:
    """(text, family, held out): templates in varied company, and paragraphs that license nothing. A wording is held out with all its variants."""
    rng = random.Random(seed)
    filler = lambda n: " ".join(rng.choice(COMMON) for _ in range(n)).capitalize() + "."
    out = []
    for family, texts in templates().items():
        for at, text in enumerate(texts):
            for k in range(6 if text in TEMPLATES[family] else 3):
                words = text.split()
                shape = rng.random()
                if k and shape < 0.35:
                    text_k = f"{filler(rng.randint(2, 9))} {text}"
                elif k and shape < 0.6:
                    text_k = f"{text} {filler(rng.randint(2, 9))}"
                elif k and len(words) > 6 and shape < 0.85:
                    drop = rng.randrange(len(words))
                    text_k = " ".join(words[:drop] + words[drop + 1 :])
                else:
                    text_k = text
                out.append((re.sub(r"\d", lambda m: str(rng.randint(1, 4)) if rng.random() < 0.3 else m[0], text_k), family, at % 4 == 1))
    for k, text in enumerate(OTHERS):
        out += [(x, UNKNOWN, k % 4 == 1) for x in (text, f"{filler(5)} {text}", f"{text} {filler(6)}")]
    out += [(filler(rng.randint(1, 30)), UNKNOWN, k % 3 == 0) for k in range(600)]
    return out


class Scanner:
    """The trained classifier: n-gram weights by family, relative to the unknown class, and the words that a licence needs."""

    def __init__(self, spark: SparkSession, seed: int = 9):
        rows = training_paragraphs(seed)
        made = spark.createDataFrame(rows, "text string, family string, held boolean").select("family", "held", grams(normal_words(F.col("text")), range(1, MAX_GRAM + 1)).alias("g")).collect()
        licence = {g for r in made if r.family != UNKNOWN for g in r.g if " " not in g}
        plain = {g for r in made if r.family == UNKNOWN for g in r.g if " " not in g} - {w for t in OTHERS for w in re.findall(r"[\w]+", t.lower())} | set(COMMON)
        marked = licence - plain - {"#"}  # words that only licences, and sentences with their words, use
        count: dict[str, int] = {}
        for r in made:
            for g in r.g:
                count[g] = count.get(g, 0) + 1
        self.features = sorted(g for g, n in count.items() if n >= 3 and any(w in marked for w in g.split()))
        self.triggers = sorted({w for g in self.features for w in g.split() if w in marked})
        number = {g: k for k, g in enumerate(self.features)}
        self.families = [UNKNOWN, *TEMPLATES]
        at = {f: k for k, f in enumerate(self.families)}
        vector = lambda r: Vectors.sparse(len(number), sorted((number[g], 1.0) for g in r.g if g in number))

        def fitted(rows: list) -> tuple[np.ndarray, np.ndarray]:
            train = spark.createDataFrame([(float(at[r.family]), vector(r)) for r in rows], ["label", "features"]).coalesce(1)
            model = LogisticRegression(family="multinomial", regParam=0.003, maxIter=80, standardization=False).fit(train)
            w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
            return w - w[0], b - b[0]

        # the temperature and the accuracy come from wordings that this fit has not seen; the scanner's own has seen all
        weight, bias = fitted([r for r in made if not r.held])
        held = [r for r in made if r.held]
        x = np.zeros((len(held), len(number)))
        for k, r in enumerate(held):
            x[k, [number[g] for g in r.g if g in number]] = 1.0
        z, y = x @ weight.T + bias, np.array([at[r.family] for r in held])
        loss = {t: float(np.mean(np.logaddexp.reduce(z / t, axis=1) - (z / t)[np.arange(len(y)), y])) for t in TEMPERATURES}
        self.temperature = min(loss, key=loss.get)
        self.held_accuracy = float((z.argmax(axis=1) == y).mean())
        self.weight, self.bias = fitted(made)
        # a paragraph without a feature has the bias alone; if that were no plain unknown, leaving it out would be wrong
        assert self.bias.argmax() == 0

    def trigger_pattern(self) -> str:
        """A pattern for the trigger words, by first letter: a paragraph without a match has no feature."""
        groups = [f"{k}(?:{'|'.join(re.escape(w[1:]) for w in sorted(ws, key=lambda w: -len(w)))})" for k, ws in itertools.groupby(self.triggers, key=lambda w: w[0])]
        return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(groups)})(?![\p{{L}}\p{{N}}])"


#: A line break inside a paragraph: the line before has words and does not end like a sentence, and the next one has words.
SOFT_BREAK = r"([^\s.!?:;])[ \t\r]*\n[ \t]*(?=\S)"


def paragraphs(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, _text, paragraph, line, text) of what matches: the lines of each paragraph, and the paragraph itself (line null) where it is wrapped over several."""
    cut = docs.filter(F.col("text").rlike(pattern)).select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(F.split(F.regexp_replace(F.translate("text", "\x01", " "), SOFT_BREAK, "$1\x01"), r"\n")).alias("paragraph", "p"))
    cut = cut.filter(F.translate("p", "\x01", " ").rlike(pattern)).withColumn("lines", F.split("p", "\x01"))
    entry = lambda line, text: F.struct(line.cast("int").alias("line"), text.alias("text"))
    whole = F.when(F.size("lines") > 1, F.array(entry(F.lit(None), F.translate("p", "\x01", " ")))).otherwise(F.array().cast("array<struct<line:int,text:string>>"))
    each = cut.select("doc_id", "_text", "paragraph", F.explode(F.concat(whole, F.transform("lines", lambda x, k: entry(k, x)))).alias("e")).select("doc_id", "_text", "paragraph", "e.*")
    return each.filter(F.col("text").rlike(pattern)).distinct()


def scan(docs: DataFrame, least: float = 0.5, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph, line, text, family, probability, template, likeness, confirmed.

    A paragraph is a line, or several lines of which all but the last end within
    a sentence. Its lines are judged each, and the whole where it is wrapped:
    confirmed lines stand for it, else the whole if that is confirmed, else the
    unconfirmed lines or whole. line is null for a whole. The family is the
    likeliest class unless that is the unknown class or has a calibrated
    probability under `least`. likeness is the greatest share, over the family's
    templates, of a template's word pairs found in the paragraph, or of a shorter
    paragraph's in it; confirmed means `confirm` or more; of equal likeness the
    last template by order is named. Null and blank texts have no paragraphs;
    texts are read whole, however long; repeated rows are reported once; rows with
    a null id are reported under null; an empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    s = scanner or Scanner(spark)
    cut = paragraphs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), s.trigger_pattern())
    cut = written(cut.withColumn("words", normal_words(F.col("text"))).withColumn("_row", F.monotonically_increasing_id()))
    names = [f"w{k}" for k in range(1, len(s.families))]
    table = spark.createDataFrame([(g, *map(float, s.weight[1:, k])) for k, g in enumerate(s.features)], "gram string, " + ", ".join(f"{n} double" for n in names))
    hit = cut.select("_row", F.explode(grams(F.col("words"), range(1, MAX_GRAM + 1))).alias("gram")).join(F.broadcast(table), "gram")  # the training text bounds the table
    sums = hit.groupBy("_row").agg(*[F.sum(n).alias(n) for n in names])
    z = F.array(F.lit(0.0), *[(F.col(n) + float(b)) / s.temperature for n, b in zip(names, s.bias[1:])])
    scores = sums.select("_row", z.alias("z")).withColumn("top", F.array_max("z"))
    scores = scores.withColumn("probability", F.expr("1D / aggregate(z, 0D, (t, x) -> t + exp(x - top))")).withColumn("family", F.element_at(F.array(*map(F.lit, s.families)), F.array_position("z", F.col("top")).cast("int")))
    said = scores.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least)).select("_row", "family", "probability")
    forms = spark.createDataFrame([(f, t) for f, ts in templates().items() for t in ts], "family string, template string").withColumn("pairs", grams(normal_words(F.col("template")), range(2, 3)))
    met = cut.join(said, "_row").withColumn("own", grams(F.col("words"), range(2, 3))).join(F.broadcast(forms), "family")
    shared = F.size(F.array_intersect("own", "pairs")) / F.greatest(F.least(F.size("own"), F.size("pairs")), F.lit(1))
    carried = ("doc_id", "_text", "paragraph", "line", "text", "family", "probability")
    near = met.withColumn("likeness", shared).groupBy("_row").agg(F.max(F.struct("likeness", "template")).alias("n"), *[F.first(c).alias(c) for c in carried])
    near = near.withColumn("confirmed", F.col("n.likeness") >= confirm)
    rank = F.when(F.col("confirmed"), F.when(F.col("line").isNotNull(), 3).otherwise(2)).otherwise(F.when(F.col("line").isNotNull(), 1).otherwise(0))
    best = near.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(Window.partitionBy("doc_id", "_text", "paragraph"))).filter("_rank = _best")
    return best.select("doc_id", "paragraph", "line", "text", "family", "probability", F.col("n.template").alias("template"), F.col("n.likeness").alias("likeness"), "confirmed")


def by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, families (confirmed, sorted), unconfirmed, probability (greatest), n_paragraphs (rows of scan).

    Rows without licences, null and blank texts have empty lists and zeros. Rows of
    one id, repeated or of different texts, all get what the id's texts hold, null
    ids too; very long texts are read whole; an empty table gives no rows; other
    columns are not read.
    """
    found = scan(docs, id_col=id_col, text_col=text_col)
    each = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.array_sort(F.collect_set(F.when(~F.col("confirmed"), F.col("family")))).alias("unconfirmed"),
        F.max("probability").alias("probability"),
        F.count("*").alias("n_paragraphs"),
    )
    out = docs.select(F.col(id_col).alias("doc_id")).join(each, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce("families", none).alias("families"), F.coalesce("unconfirmed", none).alias("unconfirmed"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
