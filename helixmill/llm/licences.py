"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units of a text are its lines, its paragraphs and the whole of it. A unit's terms are weighted by term frequency times
inverse document frequency, which is counted over all documents for the templates' terms; other terms weigh as the rarest.
The best cosine of a unit to a template of at least THRESHOLD gives the file's own licence. A file is a licence file if
the unit holds at least FILE_SHARE of its words.

A unit without any of a template's anchor terms can't reach the threshold: anchors are the heaviest terms, taken until the
weight of the rest, over the template's norm, is below it. So texts without an anchor are skipped without loss.

A licence file covers its directory and all below: the distinct directories are expanded to their ancestors, joined with
the licence files' directories by path, and the deepest match wins; files then join their directory's result.

Defined cases: null or blank text has no licence of its own; a null path is in the root directory; ties of cosine go to
the template first in order, ties of licence files in a directory to the higher cosine, then the smaller path; rows are
judged one by one, whatever their ids. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, join_hot, small_batches

THRESHOLD = 0.6
FILE_SHARE = 0.5
KNOWN = 300_000  # words remembered in a task; more are looked up again
#: Short notices in common use, by licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Scanner:
    """Templates under given document frequencies."""

    def __init__(self, templates: tuple[tuple[str, str], ...], n_docs: int, docs_of: dict[str, int], threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        self.rarest = math.log(1 + n_docs) + 1
        vocab = {t for _, text in templates for t in terms(text)}
        self.idf = {t: math.log((1 + n_docs) / (1 + docs_of.get(t, 0))) + 1 for t in vocab}
        self.vectors, anchors = [], set()
        for _, text in templates:
            v = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            self.vectors.append({t: w / norm for t, w in v.items()})
            rest = 1.0
            for t, w in sorted(self.vectors[-1].items(), key=lambda x: (-x[1], x[0])):
                if rest < threshold * threshold * 0.999:
                    break
                anchors.add(t)
                rest -= w * w
        self.threshold, self.anchors = threshold, frozenset(anchors)
        self.holds: dict[str, bool] = {}  # whether a word between white space holds an anchor

    def words_with_anchor(self, text: str) -> set[str]:
        """The words between white space of a lower-case text that hold an anchor; no term crosses white space."""
        if len(self.holds) > KNOWN:
            self.holds.clear()
        words, holds = set(text.split()), self.holds
        for w in words.difference(holds):
            holds[w] = w in self.anchors if w.isalnum() and w.isascii() else not self.anchors.isdisjoint(TERM.findall(w))
        return {w for w in words if holds[w]}

    def cosine(self, words: list[str]) -> tuple[float, int]:
        """Best cosine of a unit to a template, and the template."""
        v = {t: n * self.idf.get(t, self.rarest) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        best, at = 0.0, -1
        for k, template in enumerate(self.vectors):
            c = round(sum(w * v[t] for t, w in template.items() if t in v) / norm, 9)
            if c > best:
                best, at = c, k
        return best, at

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """Licence, cosine and the share of the text's words in the unit that gave it."""
        text = (text or "").lower()
        some = self.words_with_anchor(text)
        if not some:
            return None, 0.0, 0.0
        best, at, size = 0.0, -1, 0
        units = [text.split("\n"), [p for p in re.split(r"\n\s*\n", text) if "\n" in p.strip()], [text]]
        for unit in (u for kind in units for u in kind):
            if not some.isdisjoint(unit.split()):
                words = terms(unit)
                c, k = self.cosine(words)
                if c > best:
                    best, at, size = c, k, len(words)
        if best < self.threshold:
            return None, best, 0.0
        return self.names[at], best, size / max(1, len(terms(text)))


def _document_counts(files: DataFrame, vocab: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and for each of the templates' terms the documents that hold it; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    found.update({w for raw in set(text.lower().split()) for w in ((raw,) if raw in vocab else TERM.findall(raw) if not raw.isalpha() else ()) if w in vocab})
        rows = [("", n), *found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([c for _, c in rows], pa.int64())], names=["term", "n"])

    got = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per term of the templates
    counts = {r.term: r.n for r in got}
    return counts.pop("", 0), counts


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """(id, path, own_licence, cosine, licence, inherited_from) of files (id, path, text)."""
    small_batches(files.sparkSession)
    n_docs, docs_of = _document_counts(files, frozenset(t for _, text in templates for t in terms(text)))
    scanner = Scanner(templates, n_docs, docs_of, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([round(f[1], 6) for f in found], pa.float64()), pa.array([bool(f[0]) and f[2] >= file_share for f in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "path", "own_licence", "cosine", "covers"])

    kind = files.schema["id"].dataType.simpleString()
    rows = files.select("id", "path", "text").mapInArrow(run, f"id {kind}, path string, own_licence string, cosine double, covers boolean")
    rows = durable(rows.withColumn("dir", F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", "")), "licences")
    covers = rows.where("covers").groupBy("dir").agg(F.min_by(F.struct("own_licence", "path"), F.struct(-F.col("cosine"), F.col("path"))).alias("of"))
    dirs = durable(rows.groupBy("dir").agg(F.count("*").alias("n")), "directories")
    names = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("up")))
    steps = durable(dirs.select("dir", F.inline(above)).where((F.col("up") != "") | (F.col("depth") == 0)), "ancestors")
    # the root and other high directories are met by most directories, a full one by many files: such keys are hot
    met = steps.groupBy("up").agg(F.count("*").alias("m")).withColumnRenamed("up", "top")
    high = durable(met.join(covers.withColumnRenamed("dir", "d"), F.col("top") == F.col("d")).select("top", "m", "of"), "covering")
    near = join_hot(steps, high, "up", "top", "m", steps.count()).groupBy("dir").agg(F.max_by("of", "depth").alias("of"))
    known = dirs.withColumnRenamed("dir", "d").join(near, F.col("d") == F.col("dir"), "left").select("d", "n", "of")
    out = join_hot(rows, durable(known, "inherited"), "dir", "d", "n", rows.count())
    takes = F.col("own_licence").isNull()
    return out.select("id", "path", "own_licence", "cosine", F.coalesce("own_licence", "of.own_licence").alias("licence"), F.when(takes, F.col("of.path")).alias("inherited_from"))


def document_path(id_col: str = "doc_id") -> Column:
    """Where a document stands in a tree of uneven depth: source/language, up to three numbered directories, the id."""
    i = F.coalesce(F.col(id_col), F.lit(0))
    steps = F.array((F.floor(i / 4) % 7).cast("string"), (F.floor(i / 28) % 5).cast("string"), F.floor(i / 1000).cast("string"))
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.slice(steps, 1, F.pmod(i, F.lit(4)).cast("int")), F.col(id_col).cast("string"))
