"""License scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over sparse word n-grams (one to three
words) names the licence family of a paragraph, ``unknown`` for a licence of no family,
or ``none``. Its temperature and the threshold under which a family becomes
``unknown`` too are calibrated on held-out rows, the threshold on wordings of
strange licences that training never sees. A prediction counts as confirmed when the
paragraph holds enough of a template of that family. The model is fitted on
the driver from a bounded set of labelled rows made from the templates here;
paragraphs are scored in SQL: n-grams are joined with the weights.

Paragraphs are blocks of lines between blank ones. A licence may be a line of
its own among others or a text wrapped over many, so each line of a block is
classified, and the block as a whole; the whole counts where a template
confirms it.

Every n-gram that can carry a weight contains an anchor, so paragraphs without
one score the bias alone (``none``) and need no scoring.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.spans import let

from .common import literal_table, written

# Wordings of the licence families.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "licensed under the mit license see the license file for details",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "this project is available under the terms of the mit license",
        "veroffentlicht unter der mit lizenz es gilt die mit lizenz",
        "publie sous licence mit voir la licence mit",
        "publicado bajo la licencia mit vea la licencia mit",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "in no event shall the authors be liable",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "spdx license identifier mit released under the mit license",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "released under the apache 2.0 license",
        "veroffentlicht unter der apache lizenz 2.0 es gilt die apache lizenz",
        "publie sous licence apache 2.0 voir la licence apache",
        "publicado bajo la licencia apache 2.0 vea la licencia apache",
        "spdx license identifier apache 2.0 apache license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability",
        "you should have received a copy of the gnu general public license along with this program",
        "released under the gpl version 2 or later license",
        "distributed under gpl v2.1 this file is gpl 3",
        "this library is licensed under the gnu lesser general public license",
        "veroffentlicht unter der gpl lizenz es gilt die gpl lizenz",
        "publie sous licence gpl voir la licence gpl",
        "publicado bajo la licencia gpl vea la licencia gpl",
        "spdx license identifier gpl 3.0 or later",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "licensed under the bsd 3-clause license",
        "use of this source code is governed by a bsd style license",
        "veroffentlicht unter der bsd lizenz es gilt die bsd lizenz",
        "publie sous licence bsd voir la licence bsd",
        "publicado bajo la licencia bsd vea la licencia bsd",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "veroffentlicht unter der mozilla lizenz es gilt die mozilla lizenz",
        "publie sous licence mozilla voir la licence mozilla",
        "publicado bajo la licencia mozilla vea la licencia mozilla",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "text is available under the creative commons attribution license",
        "dieser text steht unter der creative commons lizenz namensnennung",
        "ce texte est sous licence creative commons attribution",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "licensed under cc by-sa 4.0",
        "text is available under the creative commons attribution-sharealike license",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under cc by-nc 4.0",
        "licensed under cc by-nc-sa 4.0",
    ),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related rights under cc0",
        "licensed under cc0 1.0 universal public domain dedication license",
    ),
    "proprietary": (
        "copyright all rights reserved",
        "all rights reserved",
        "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",
        "this software is proprietary and confidential unauthorized copying is prohibited copyright",
        "todos los derechos reservados",
        "tous droits reserves",
        "alle rechte vorbehalten",
        "este software es propietario todos los derechos reservados",
    ),
}
#: Licence-like wordings of no family, and plain sentences with the anchors.
STRANGE = (
    "licensed under the harbour community license version 7",
    "released under the open weights permissive license 1.1",
    "distributed under the terms of the vendor source license",
    "use is governed by the blue sky research license agreement",
    "this dataset is licensed under a custom data license",
    "made available under the river valley license",
    "distributed under the artistic license 2.0",
    "you may use this file under the terms of the sample vendor license",
    "licensed under the academic research license see the license text",
    "veroffentlicht unter der hafen gemeinschaft lizenz es gilt die hafen lizenz",
    "publie sous licence ouverte du port voir la licence ouverte",
    "publicado bajo la licencia comunitaria del puerto vea la licencia comunitaria",
)
PLAIN = (
    "she renewed her driving license last week and drove home",
    "he asked for permission to leave the table",
    "the warranty on the kettle ran out in june",
    "creative work needs quiet mornings",
    "apache helicopters flew over the river",
    "the house of commons sat until midnight",
    "a table was reserved for six at eight",
    "the licence fee rose again and viewers complained",
    "copyright lawyers met for lunch",
    "the wealth was redistributed among the heirs",
    "the driver was held liable for the damage to the fence",
    "she was liable to forget the keys",
    "guests are liable for late fees",
    "the court found them liable",
    "der trainer verlor seine lizenz im herbst",
    "unter der lizenz fuhr er weiter",
    "la mesa estaba reservada para las ocho",
    "les places sont reserves aux enfants",
    "der zutritt bleibt mitgliedern vorbehalten",
    "perdio su licencia de conducir en mayo",
    "il a perdu sa licence de football",
)
NONE, UNKNOWN = "none", "unknown"
CLASSES = (*TEMPLATES, UNKNOWN, NONE)
ANCHOR = (
    r"licen[sc]|lizenz|copyright|urheberrecht|warrant|permission|redistribut|apache|(?<![a-z0-9])(?:bsd|gpl|mpl)(?![a-z0-9])|mozilla|creative|commons|(?<![a-z0-9])cc by|(?<![a-z0-9])cc0"
    r"|reserved|reservad|reserves|vorbehalten|proprietary|proprietaire|propietari|attribution|namensnennung|(?<![a-z0-9])liable|liabilit|merchantab|noninfring"
)
#: The same over raw text: whatever the n-gram form has, this has.
GATE = (
    r"(?iu)licen[sc]|lizenz|copyright|urheberrecht|warrant|permission|redistribut|apache|bsd|gpl|mpl(?![a-z])|mozilla|creative|commons|cc[^a-z0-9]+by|cc[^a-z0-9]?0"
    r"|reserved|reservad|r[eé]serv[eé]s|vorbehalten|proprietary|propri[eé]taire|propietari|attribution|namensnennung|liable|liabilit|merchantab|noninfring"
)
#: Letters with marks lose them, and spellings of one licence become one.
MARKED, BARE = "äöüàáâçèéêëîïíñóôùúû", "aouaaaceeeeiiinoouuu"
SPELLINGS = (
    (r"(?<![a-z0-9])[al]?gpl-?v?(?![a-z])", "gpl "),
    (r"(?<![a-z0-9])cc[^a-z0-9]+by", "cc by"),
    (r"(?<![a-z0-9])cc[^a-z0-9]0(?![.0-9])", "cc0"),
    (r"-(?=lizenz|licen[sc])", " "),
    (r"(?:(?<=licen[sc]e)|(?<=apache)|(?<=mpl))-", " "),
)
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Labelled rows that the model is fitted on, at most.
TRAINING_ROWS, SEED, PASSES = 1800, 11, 40
COVERED = 60  # percent of a template's n-grams
HELD_STRANGE = 4  # of the strange wordings, for the threshold alone
FALSE_KNOWN = 0.02  # share of held-out strangers that may pass as known


def grams(tokens: list[str]) -> set[str]:
    """N-grams of one to three words that hold an anchor."""
    every = {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}
    return {g for g in every if re.search(ANCHOR, g)}


def tokens_of(text: str) -> list[str]:
    text = text.lower().translate(str.maketrans(MARKED, BARE))
    for pattern, spelling in SPELLINGS:
        text = re.sub(pattern, spelling, text)
    return re.findall(TOKEN, text)


def _varied(pool: list[tuple[str, str]], n: int, seed: int) -> list[tuple[str, list[str]]]:
    """(family, tokens): wordings with words lost, swapped and put around them."""
    rng = random.Random(seed)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        family, text = pool[i % len(pool)]
        words = [w for w in text.split() if rng.random() > 0.08] or text.split()
        if rng.random() < 0.15:
            words.insert(rng.randrange(len(words) + 1), rng.choice(noise))
        before, after = ([rng.choice(noise) for _ in range(rng.choice((0, 0, 4, 20)))] for _ in range(2))
        rows.append((family, before + words + after))
    return rows


def training_rows(n: int = TRAINING_ROWS, seed: int = SEED, strange: tuple[str, ...] = STRANGE) -> list[tuple[str, list[str]]]:
    return _varied([(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in strange] + [(NONE, t) for t in PLAIN], n, seed)


def _softmax(score: dict[str, float], heat: float = 1.0) -> dict[str, float]:
    top = max(score.values())
    up = {k: math.exp((v - top) / heat) for k, v in score.items()}
    total = sum(up.values())
    return {k: v / total for k, v in up.items()}


@lru_cache(maxsize=4)
def fit(n: int = TRAINING_ROWS, seed: int = SEED) -> tuple[dict[tuple[str, str], float], dict[str, float], float, float, float]:
    """Weights by (family, n-gram), biases, temperature, threshold, held-out accuracy.

    A third of the rows is held out for the temperature. The threshold comes
    from rows of their own, made of strange wordings that no other row has: few
    of them may pass as a family.
    """
    rows = [(f, grams(t)) for f, t in training_rows(n, seed, STRANGE[:-HELD_STRANGE])]
    random.Random(seed).shuffle(rows)
    held, train = rows[: n // 3], rows[n // 3 :]
    strangers = [grams(t) for _, t in _varied([(UNKNOWN, t) for t in STRANGE[-HELD_STRANGE:]], n // 6, seed + 1)]
    classes = CLASSES
    weights: dict[tuple[str, str], float] = {}
    # Without any n-gram a paragraph is no licence, whatever its length.
    bias = {c: 0.0 for c in classes} | {NONE: 2.0}

    def score(features: set[str]) -> dict[str, float]:
        return {c: bias[c] + sum(weights.get((c, g), 0.0) for g in features) for c in classes}

    for step in range(PASSES):
        rate = 0.3 / (1 + 0.1 * step)
        for family, features in train:
            chance = _softmax(score(features))
            scale = rate / math.sqrt(max(1, len(features)))
            for c in classes:
                error = (c == family) - chance[c]
                for g in features:
                    weights[c, g] = weights.get((c, g), 0.0) * (1 - 1e-4) + scale * error
    known = [(f, score(g)) for f, g in held]
    heat = min((x / 4 for x in range(2, 21)), key=lambda h: -sum(math.log(max(1e-12, _softmax(s, h)[f])) for f, s in known))
    best = sorted(max((p, c) for c, p in _softmax(score(g), heat).items() if c in TEMPLATES)[0] for g in strangers)
    threshold = max(0.5, best[min(len(best) - 1, int((1 - FALSE_KNOWN) * len(best)))])
    right = sum(max(s, key=s.get) == f for f, s in known) / max(1, len(known))
    kept = {k: round(w, 6) for k, w in weights.items() if abs(w) >= 0.02}
    return kept, bias, heat, threshold, right


def model_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Weights (gram, w: map by family) and templates (gram, template, family, size)."""
    weights, *_ = fit()
    classes = CLASSES
    by: dict[str, list[float]] = {}
    for (c, g), w in weights.items():
        by.setdefault(g, [0.0] * len(classes))[classes.index(c)] = w
    held = []
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            own = sorted(grams(text.split()))
            held += [(g, f"{family}/{i}", family, len(own)) for g in own]
    return literal_table(spark, sorted(by.items()), "gram string, w array<double>"), literal_table(spark, held, "gram string, template string, family string, size int")


def paragraph_grams(text: Column) -> Column:
    """Distinct n-grams with an anchor, as ``grams`` finds them."""
    plain = F.translate(F.lower(text), MARKED, BARE)
    for pattern, spelling in SPELLINGS:
        plain = F.regexp_replace(plain, pattern, spelling)
    tokens = F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))
    def every(t: Column) -> Column:
        # Past the end zip_with meets a null, and so does what it makes.
        spaced = lambda a, b: F.concat(a, F.lit(" "), b)
        two = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), spaced)
        three = F.zip_with(two, F.slice(t, F.lit(3), F.size(t)), spaced)
        return F.array_distinct(F.filter(F.concat(t, two, three), lambda g: g.rlike(ANCHOR)))

    return let(tokens, every)


def classify_paragraphs(paragraphs: DataFrame, key: str = "digest", text: str = "paragraph") -> DataFrame:
    """``key``, ``family``, ``confidence`` and ``confirmed`` of each distinct paragraph.

    Both tables that are broadcast come from ``TRAINING_ROWS`` short rows at
    most, so they have a fixed bound (under 2 MB) at any input size.
    """
    spark = paragraphs.sparkSession
    weights, templates = model_tables(spark)
    _, bias, heat, threshold, _ = fit()
    classes = CLASSES
    found = paragraphs.select(key, F.explode(paragraph_grams(F.col(text))).alias("gram"))
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(classes))]
    scored = found.join(F.broadcast(weights), "gram").groupBy(key).agg(*sums)
    scores = F.array(*[(F.col(f"s{i}") + bias[c]) / heat for i, c in enumerate(classes)])
    scored = scored.select(key, scores.alias("s")).withColumn("top", F.array_max("s"))
    scored = scored.withColumn("z", F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    chosen = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("s", F.col("top")).cast("int") - 1)
    scored = scored.select(key, chosen.alias("best"), (1 / F.col("z")).alias("confidence"))
    covers = found.join(F.broadcast(templates), "gram").groupBy(key, "family", "template").agg((100 * F.count(F.lit(1))).alias("n"), F.max("size").alias("size"))
    covers = covers.where(F.col("n") >= COVERED * F.col("size")).select(key, "family").distinct().withColumn("confirmed", F.lit(True))
    joined = scored.join(covers.withColumnRenamed("family", "best"), [key, "best"], "left")
    family = F.when(F.col("best").isin(NONE, UNKNOWN), F.col("best")).when(F.col("confirmed") | (F.col("confidence") >= threshold), F.col("best")).otherwise(UNKNOWN)
    return joined.withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).select(key, family.alias("family"), "confidence", "confirmed")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``licenses`` (sorted families, ``unknown``
    among them), ``n_paragraphs`` that are licence-like, ``confirmed`` (all known
    ones match a template) and the lowest ``confidence``.

    Paragraphs are blocks of lines between blank ones; ``n_paragraphs`` counts
    those with a licence. Where a template confirms a block as a whole, its
    lines that are of no family are parts of it and don't count as ``unknown``.
    A null or empty text has none: no licences, null confidence. Each distinct
    line and block is classified once. Repeated rows and repeated keys are
    treated row by row.
    """
    unit = "struct<digest:string,paragraph:string,whole:boolean>"
    made = lambda p, whole: F.struct(F.sha2(p, 256).alias("digest"), p.alias("paragraph"), F.lit(whole).alias("whole"))

    def units(block: Column) -> Column:
        return let(
            F.filter(F.split(block, "\n", -1), lambda p: p.rlike("\\S")),
            lambda lines: F.concat(
                F.transform(F.filter(lines, lambda p: p.rlike(GATE)), lambda p: made(p, False)),
                F.when(F.size(lines) > 1, F.array(made(F.array_join(lines, " "), True))).otherwise(F.array().cast(f"array<{unit}>")),
            ),
        )

    blocks = F.filter(F.split(F.col(text), r"\n[ \t\r\f\x0B]*\n", -1), lambda p: p.rlike(GATE))
    own = F.when(F.col(text).rlike(GATE), F.transform(blocks, units))
    gated = written(docs.select(F.col(key).alias("_key"), F.coalesce(own, F.array().cast(f"array<array<{unit}>>")).alias("blocks")).withColumn("_row", F.monotonically_increasing_id()), "licenses")
    parts = gated.select("_row", F.posexplode("blocks").alias("_block", "x")).select("_row", "_block", F.inline("x"))
    distinct = parts.groupBy("digest").agg(F.first("paragraph").alias("paragraph"))
    # Written, so that the join below has a known size and can split a hot paragraph.
    families = written(classify_paragraphs(distinct).where(F.col("family") != NONE), "families")
    judged = parts.select("_row", "_block", "digest", "whole").join(families, "digest")
    sure = F.col("whole") & F.col("confirmed") & (F.col("family") != UNKNOWN)
    judged = judged.where(~F.col("whole") | sure).withColumn("_sure", F.max(F.col("whole")).over(Window.partitionBy("_row", "_block")))
    judged = judged.where(~(F.col("_sure") & (F.col("family") == UNKNOWN)))
    per = judged.groupBy("_row").agg(
        F.sort_array(F.collect_set("family")).alias("licenses"),
        F.size(F.collect_set("_block")).alias("n_paragraphs"),
        F.bool_and((F.col("family") == UNKNOWN) | F.col("confirmed")).alias("confirmed"),
        F.round(F.min("confidence"), 4).alias("confidence"),
    )
    out = gated.select("_row", "_key").join(per, "_row", "left")
    return out.select(
        F.col("_key").alias(key),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        "confidence",
    )
