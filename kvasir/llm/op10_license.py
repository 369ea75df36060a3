"""License scans by conditional compression.

A candidate block is a line that holds a cue, a run of such lines with what lies between them, and the
lines around either that the longest template can take.  For each template, windows of a block's words twice as
long as a match can be, overlapping by as much, are compressed alone and with the template's words as a zstandard
raw dictionary.  A template that saves bytes of a window is proposed there, however many others save more, and nothing else is.
Each proposal is judged by its exact wording: the template's words are aligned with the window's, and what is missing, added or changed is
counted and named.  Around a match templates are ranked by the bytes that they save of its text, white space collapsed.  A template is found if at most ``DIFFERENCES`` of its words are missing, as many words
are added within, and no number in it (a version) differs.

Defined results: a null or empty text has no block; every place that a template matches is a row with the
lines of its words, but where all its words are also a match's of more words, or some are another match's
of the same template; bytes saved and rank are those of the match with a template's length around it; rows that repeat a doc_id are scanned
each; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm.common import sliced, table

#: The wording of public license notices, by SPDX identifier and form.
TEMPLATES = {
    ("MIT", "notice"): "Released under the MIT License.",
    ("MIT", "grant"): (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    ("GPL-3.0-only", "notice"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-2.0-only", "notice"): "This work is licensed under the GNU General Public License, version 2.",
    ("GPL-3.0-or-later", "header"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    ("BSD-3-Clause", "notice"): "Released under the BSD 3-Clause License.",
    ("BSD-2-Clause", "grant"): (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    ("MPL-2.0", "header"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ("CC-BY-4.0", "notice"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "notice"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0.",
    ("CC0-1.0", "notice"): "Released under CC0 1.0 Universal.",
    ("Unlicense", "notice"): "This is free and unencumbered software released into the public domain.",
}

#: Strings, in lower case, one of which a notice holds; a line may end between their words.
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "mozilla public", "released under", "free software")
GAP = 12
DIFFERENCES = 0.2
LEVEL = 3
#: Proposals parse optimally: at lower levels the greedy parse can hide what a short template saves.
PROPOSE = 19

_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")
_CUE = re.compile("|".join(r"\s+".join(map(re.escape, c.split())) for c in CUES))
#: Words that a match can take.
REACH = max(n + int(max(2, DIFFERENCES * n)) for n in (len(_WORD.findall(t.lower())) for t in TEMPLATES.values()))


def blocks_of(text: str | None, gap: int = GAP) -> list[tuple[int, int, str]]:
    """(first line, lines, text) of each candidate block; a cue line alone, its run if it is in one, and what a match may reach around it."""
    if not text:
        return []
    low = text.lower()
    cues = [m.span() for m in _CUE.finditer(low)]
    if not cues:
        return []
    lines = low.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", low))]
    hits = sorted({bisect_right(starts, at) - 1 for a, b in cues for at in (a, b - 1)})
    out = [(i, 1, lines[i]) for i in hits]
    k = 0
    while k < len(hits):
        j = k
        while j + 1 < len(hits) and hits[j + 1] - hits[j] <= gap:
            j += 1
        if j > k:
            first, last = hits[k], min(len(lines) - 1, hits[j] + 2)
            out.append((first, last - first + 1, "\n".join(lines[first : last + 1])))
        k = j + 1

    def reach(i: int, step: int) -> int:
        held = 0
        while 0 <= i + step < len(lines) and held < REACH:
            i += step
            held += len(_WORD.findall(lines[i]))
        return i

    wide: list[list[int]] = []
    for i in hits:
        first, last = reach(i, -1), reach(i, 1)
        if wide and first <= wide[-1][1]:
            wide[-1][1] = max(last, wide[-1][1])
        else:
            wide.append([first, last])
    known = {block[:2] for block in out}
    return out + [(a, b - a + 1, "\n".join(lines[a : b + 1])) for a, b in wide if (a, b - a + 1) not in known]


class Scanner:
    def __init__(self, templates: dict[tuple[str, str], str] = TEMPLATES):
        import zstandard

        self.names = list(templates)
        normal = [" ".join(t.lower().split()) for t in templates.values()]
        self.words = [_WORD.findall(t) for t in normal]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        with_dict = lambda level, t: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.given = [with_dict(LEVEL, t) for t in normal]
        self.propose, self.proposers = zstandard.ZstdCompressor(level=PROPOSE), [with_dict(PROPOSE, " ".join(w)) for w in self.words]
        self.size = lru_cache(maxsize=2_000)(lambda raw: len(self.propose.compress(raw)))
        self.scan = lru_cache(maxsize=20_000)(self._scan)

    def saved(self, block: str) -> list[int]:
        """Bytes that each template saves as a dictionary."""
        raw = block.encode()
        size = len(self.alone.compress(raw))
        return [size - len(c.compress(raw)) for c in self.given]

    def proposed(self, k: int, words: list[str]) -> bool:
        """Whether the template saves bytes of the words."""
        raw = " ".join(words).encode()
        return len(self.proposers[k].compress(raw)) < self.size(raw)

    def wording(self, k: int, words: list[str]) -> tuple[int, int, int, str, list[int]] | None:
        """Template words found, missing, words added within, the differences in words, and the found words' places; None if too many."""
        want = self.words[k]
        if sum((Counter(want) & Counter(words)).values()) < len(want) - DIFFERENCES * len(want):
            return None
        whole = [m for m in SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if m.size]
        # words far off that chance to fit an end are left out if all together are too many
        parts = sorted(((i, j) for i in range(len(whole)) for j in range(i + 1, len(whole) + 1)), key=lambda p: p[0] - p[1])
        return next((got for i, j in parts if (got := self._judged(want, words, whole[i:j]))), None)

    @staticmethod
    def _judged(want: list[str], words: list[str], runs: list) -> tuple[int, int, int, str, list[int]] | None:
        found = sum(m.size for m in runs)
        missing = len(want) - found
        if missing > DIFFERENCES * len(want):
            return None
        first, last = runs[0].b, runs[-1].b + runs[-1].size
        extra = last - first - found
        if extra > max(2, DIFFERENCES * len(want)):
            return None
        kept = {i for m in runs for i in range(m.a, m.a + m.size)}
        lost = [w for i, w in enumerate(want) if i not in kept]
        if any(c.isdigit() for w in lost for c in w) or (missing and len(want) < 6):
            return None
        own = [i for m in runs for i in range(m.b, m.b + m.size)]
        inside = set(own)
        new = [words[i] for i in range(first, last) if i not in inside]
        return found, missing, extra, " ".join([*("-" + w for w in lost), *("+" + w for w in new)]), own

    def matches(self, k: int, words: list[str]) -> list[tuple]:
        """``wording`` of each place that the template matches, in windows twice as long as a match can be of which it saves bytes."""
        want = self.words[k]
        span, out, todo = len(want) + int(max(2, DIFFERENCES * len(want))), [], [(0, len(words))]
        need = set(want)
        while todo:
            lo, hi = todo.pop()
            for at in range(lo, max(hi - span, lo + 1), span):
                upto = min(at + 2 * span, hi)
                if self.proposed(k, words[at:upto]) and len(need.intersection(words[at:upto])) >= len(need) - DIFFERENCES * len(want) and (got := self.wording(k, words[at:upto])):
                    own = [at + i for i in got[4]]
                    out.append((*got[:4], own))
                    todo += [(max(lo, at - span), own[0]), (own[-1] + 1, hi)]
                    break
        return out

    def _scan(self, block: str) -> list[tuple]:
        """``license, form, saved, rank, found, missing, added, wording``, and the places of the found words, of each match."""
        places = [m.span() for m in _WORD.finditer(block)]
        words = [block[a:b] for a, b in places]
        out = []
        for k in range(len(self.words)):
            for *got, own in self.matches(k, words):
                lo, hi = max(0, own[0] - len(self.words[k])), min(len(words), own[-1] + 1 + len(self.words[k]))
                near = block if (lo, hi) == (0, len(words)) else block[places[lo][0] : places[hi - 1][1]]
                gains = self.saved(" ".join(near.split()))
                rank = 1 + sum((-g, i) < (-gains[k], k) for i, g in enumerate(gains))
                out.append((*self.names[k], gains[k], rank, *got, [places[i][0] for i in own]))
        return out


_SCANNER: list[Scanner] = []


def licenses(docs: DataFrame) -> DataFrame:
    """A row for each place that a template matches: ``doc_id, first_line, n_lines, license, form, saved, rank, n_found, n_missing, n_added, wording``."""
    schema = "doc_id long, first_line int, n_lines int, license string, form string, saved int, rank int, n_found int, n_missing int, n_added int, wording string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan
        for batch in sliced(batches, 1):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, found = None, []
                for first, _, block in blocks_of(text):
                    for *got, own in scan(block):
                        starts = starts or [0, *(m.end() for m in re.finditer("\n", text.lower()))]
                        found.append((got, [starts[first] + i for i in own]))
                # a shorter template's words within a longer one's are the longer one's
                seen: list[tuple[list, set[int]]] = []
                for got, own in sorted(found, key=lambda f: (-f[0][4], f[0][5] + f[0][6], -f[0][2], f[1][0])):
                    words = set(own)
                    if not any(words <= held or (got[:2] == other and words & held) for other, held in seen):
                        seen.append((got[:2], words))
                        first, last = (bisect_right(starts, own[i]) - 1 for i in (0, -1))
                        out.append((doc_id, first, last - first + 1, *got))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 5, pa.string()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license": op10_license}
SQL: dict[str, str] = {}
