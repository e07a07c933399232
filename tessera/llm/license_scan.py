"""Operator 5: licences of files, from their own words or from the nearest directory above.

1. Document frequencies of all terms (hashed to ``DIMS`` places) are counted over the whole
   corpus; idf = ln((1 + N) / (1 + df)) + 1.
2. Units of a file are its lines, windows of up to ``WINDOW`` lines with terms (notices that are
   wrapped, empty comment lines or not), paragraphs and runs of up to ``RUN`` of them, comment
   blocks and the whole file.  Units are compared by sparse TF-IDF cosine with the notices of
   ``TEMPLATES``, and all but lines and windows with the standard texts in ``licences``, there with
   1 + ln(count) for the count, as the common words of a long text would rule it.  The best of at
   least ``LEAST`` is the file's own licence; a standard text goes before the notices, as licence
   texts quote notices.  A unit's cosine is at most the length of the part of a template whose terms
   the file has, so files in which no template keeps LEAST of its length are passed over; a line or
   window can only reach it if it has one of a notice's anchor terms (without these the notice keeps
   less than LEAST), and only those are weighed.  None that could match is passed over.
3. A file of which the licence's unit makes up at least ``SHARE`` of the terms, or which is named
   like one, is a licence file.  A directory's licence is that of most of its licence files (ties:
   the alphabetically first).
4. A file without a licence of its own gets that of the nearest directory on its path, itself
   included, which has one: the distinct directories' ancestors are joined with the licensed
   directories, and the files with the result.

Null and empty texts have no licence of their own; a null path counts as the empty one, whose
directory is the root.  Equal similarities: the alphabetically first licence.  Repeated paths
are files of their own.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files as package_files

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, table
from tessera.llm.toxicity import BETWEEN
from tessera.llm.words import hash_words, spans, utf8
from tessera.session import materialize

DIMS = 1 << 18
LEAST = 0.7
SHARE = 0.5
WINDOW = 8             # lines
RUN = 6                # paragraphs; MIT, BSD and ISC texts have fewer
TERMS = 1 << 20        # of units weighed at once
COMMENT = re.compile(rb"\s*(//|#|\*|;|--|%|!|'|dnl\b|rem\b)", re.IGNORECASE)
OPENS, CLOSES = re.compile(rb"\s*(/\*|<!--|\(\*|\{-)"), (b"*/", b"-->", b"*)", b"-}")
NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

# (licence, notice), fixed values: notices as files carry them
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("BSD-2-Clause", "Use of this source code is governed by a two-clause BSD style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def standard_texts() -> list[tuple[str, str]]:
    """(licence, whole text).  The AGPL's is the GPL's with its name and its section on networks."""
    texts = {f.name[:-4]: f.read_text() for f in package_files("tessera.llm").joinpath("licences").iterdir() if f.name.endswith(".txt")}
    affero = re.sub(r"(?i)\bGNU general", "GNU Affero General", texts["GPL-3.0"])
    texts["AGPL-3.0"] = affero + """
Remote Network Interaction; if you modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the
Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""
    return sorted(texts.items())


def units_of(text: bytes, line: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) term of the lines and windows that hold an anchor, and of the larger units.

    ``line`` has the line of each term, ``held`` says which are anchors.
    """
    used, start = np.unique(line, return_index=True)
    start = np.append(start, len(line))
    n, small = len(used), []
    anchors = np.concatenate([[0], np.cumsum(held)])
    for k in range(1, min(WINDOW, n) + 1):
        pairs = np.stack([start[: n - k + 1], start[k:]], axis=1)
        small.append(pairs[anchors[pairs[:, 1]] > anchors[pairs[:, 0]]])
    # paragraphs end at lines without terms; comment blocks go on over these
    cut = np.concatenate([[0], np.flatnonzero(np.diff(used) > 1) + 1, [n]])
    large = [(cut[i], cut[min(i + k, len(cut) - 1)]) for k in range(1, RUN + 1) for i in range(len(cut) - 1)]
    inside, first = b"", -1
    for at, one in enumerate([*text.split(b"\n"), b""]):
        opens = None if inside else OPENS.match(one)
        if first < 0 and (opens or COMMENT.match(one)):
            first = at
        elif first >= 0 and not (inside or opens or COMMENT.match(one)):
            large.append((np.searchsorted(used, first), np.searchsorted(used, at)))
            first = -1
        if opens:
            inside = CLOSES[(b"/*", b"<!--", b"(*", b"{-").index(opens[1])]
        if inside and inside in one:
            inside = b""
    if first >= 0:
        large.append((np.searchsorted(used, first), n))
    large = np.unique(np.array([*large, (0, n)]), axis=0)
    return np.concatenate(small), start[large[large[:, 1] > large[:, 0]]]


def places_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and first byte of every term, border of each text's terms, and the bytes."""
    data, offsets = utf8(texts)
    first, last, borders = spans(data, offsets, BETWEEN)
    place = (hash_words(data, first, last)[0] >> np.uint64(40)).astype(np.int64) & (DIMS - 1)
    return place, first, borders, data


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place is, and the number of texts; DIMS rows at most reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for b in batches:
            place, _, borders, _ = places_of(b.column(0))
            both = np.unique(np.repeat(np.arange(b.num_rows), np.diff(borders)) * DIMS + place)
            df += np.bincount(both % DIMS, minlength=DIMS)
            n += b.num_rows
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["place", "df"])

    got = texts.mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIMS, dtype=np.int64)
    real = got[got["place"] >= 0]
    df[real["place"]] = real["df"]
    return df, int(got.loc[got["place"] < 0, "df"].sum())


class Templates:
    """TF-IDF vectors of the notices and of the standard texts, and the notices' anchor terms."""

    def __init__(self, templates, df: np.ndarray, n: int, least: float) -> None:
        self.idf, self.least = np.log((1 + n) / (1 + df)) + 1, least
        texts = standard_texts()
        self.notices, self.names = len(templates), [name for name, _ in [*templates, *texts]]
        place, _, borders, _ = places_of(pa.array([text for _, text in [*templates, *texts]], pa.string()))
        self.terms = np.unique(place)
        self.number = np.full(DIMS, -1, dtype=np.int64)
        self.number[self.terms] = np.arange(len(self.terms))
        self.matrix = np.zeros((len(self.names), len(self.terms)))
        self.anchor = np.zeros(DIMS, dtype=bool)
        for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            own, count = np.unique(place[a:b], return_counts=True)
            self.matrix[i][self.number[own]] = (count if i < self.notices else 1 + np.log(count)) * self.idf[own]
            self.matrix[i] /= np.linalg.norm(self.matrix[i])
            if i < self.notices:
                # heaviest terms, until the others cannot reach ``least`` (Cauchy-Schwarz)
                order = np.argsort(-self.matrix[i], kind="stable")
                rest = np.sqrt(np.maximum(1 - np.cumsum(self.matrix[i][order] ** 2), 0))
                self.anchor[self.terms[order[: int(np.argmax(rest < least)) + 1]]] = True
        self.square = np.ascontiguousarray((self.matrix ** 2).T)

    def possible(self, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The rows that have enough of a template's terms for one of their units to match it."""
        known = np.flatnonzero(self.number.take(place) >= 0)
        both = np.unique(row[known] * len(self.terms) + self.number.take(place[known]))
        row, term = both // len(self.terms), both % len(self.terms)
        out = []
        start = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for a, b in zip(start[:-1], start[1:], strict=True):
            if self.square[term[a:b]].sum(axis=0).max() >= self.least ** 2 - 1e-9:
                out.append(int(row[a]))
        return np.array(out, dtype=np.int64)

    def best(self, mine: np.ndarray, units: np.ndarray, texts: bool) -> list[tuple[float, str, int]]:
        """(-cosine, licence, -terms) of the units that match a notice or a standard text."""
        found = []
        size = units[:, 1] - units[:, 0]
        border = np.concatenate([[0], np.cumsum(size)])
        which = slice(self.notices, None) if texts else slice(0, self.notices)
        a = 0
        while a < len(units):
            b = max(a + 1, int(np.searchsorted(border, border[a] + TERMS, "right")) - 1)
            unit = np.repeat(np.arange(b - a), size[a:b])
            at = np.arange(len(unit)) + np.repeat(units[a:b, 0] - (border[a:b] - border[a]), size[a:b])
            both, count = np.unique(unit * DIMS + mine[at], return_counts=True)
            unit, place = both // DIMS, both % DIMS
            weight = (1 + np.log(count) if texts else count) * self.idf[place]
            norm = np.sqrt(np.bincount(unit, weights=weight ** 2, minlength=b - a))
            known = self.number[place] >= 0
            unit, term, weight = unit[known], self.number[place[known]], weight[known]
            for name, vector in zip(self.names[which], self.matrix[which], strict=True):
                cosine = np.bincount(unit, weights=vector[term] * weight, minlength=b - a) / norm
                found += [(-round(float(cosine[i]), 12), name, -int(size[a + i])) for i in np.flatnonzero(cosine >= self.least)]
            a = b
        return found

    def scan(self, texts: pa.Array) -> list[tuple[str | None, float, float]]:
        """(licence, cosine, share of the terms in the licence's unit) of each text."""
        place, first, borders, data = places_of(texts)
        ends = utf8(texts)[1]
        out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * len(texts)
        for row in self.possible(place, np.repeat(np.arange(len(texts)), np.diff(borders))).tolist():
            mine, at = place[borders[row]: borders[row + 1]], first[borders[row]: borders[row + 1]] - ends[row]
            span = data[ends[row]: ends[row + 1]]
            small, large = units_of(span.tobytes(), np.searchsorted(np.flatnonzero(span == 10), at), self.anchor.take(mine))
            good = self.best(mine, large, True) or self.best(mine, np.concatenate([small, large]), False)
            if good:
                c, name, s = min(good)
                out[row] = (name, -c, -s / len(mine))
        return out


def own_licences(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files`` (path, text, ...) with own_license, own_similarity and own_share in place of text."""
    spark = files.sparkSession
    arrow_limits(spark)
    df, n = frequencies(files.select("text"))
    shared = spark.sparkContext.broadcast(Templates(templates, df, n, least))

    @F.pandas_udf("license string, similarity double, share double")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts in batches:
            yield pd.DataFrame(shared.value.scan(pa.array(texts, pa.large_string(), from_pandas=True)),
                               columns=["license", "similarity", "share"])

    return (files.withColumn("own", scan(F.col("text").cast("string"))).drop("text")
            .select("*", F.col("own.license").alias("own_license"), F.col("own.similarity").alias("own_similarity"),
                    F.col("own.share").alias("own_share")).drop("own"))


def parent(path) -> F.Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, id_col: str, path_col: str = "path", text_col: str = "text", templates=TEMPLATES,
                 least: float = LEAST, share: float = SHARE) -> DataFrame:
    """(id, path, own_license, own_similarity, license, license_from) for every row of ``files``."""
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = materialize(own_licences(rows, templates, least), "license-files").withColumn("dir", parent(F.col("path")))
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(NAMES)
    whole = found.filter(F.col("own_license").isNotNull() & ((F.col("own_share") >= share) | named))
    votes = whole.groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    licensed = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("v"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("v.own_license").alias("license"))
    # each distinct directory with all directories above it, itself included
    parts = F.split("dir", "/")
    above = found.select("dir").distinct().select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("above")).distinct()
    near = (above.join(licensed, "above").groupBy("dir")
            .agg(F.max(F.struct(F.length("above").alias("far"), "above", "license")).alias("m"))
            .select("dir", F.col("m.above").alias("above"), F.col("m.license").alias("license")))
    own = F.col("own_license").isNotNull()
    return (found.join(near, "dir", "left")
            .select("id", "path", "own_license", "own_similarity", F.coalesce("own_license", "license").alias("license"),
                    F.when(own, F.col("path")).otherwise(F.col("above")).alias("license_from")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the directories source/lang."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text")
    return license_scan(files, "doc_id").withColumnRenamed("id", "doc_id")
