"""License scan: exact set-similarity join between text blocks and license templates.

Blocks slide over the whole word sequence of a text; line breaks don't end one. A template of L words
has blocks of W words, W being twice L, rounded up to a power of two, every W / 2 words: any stretch of
up to W / 2 words, and so any whole copy of the template, lies whole in some block. A block matches a
template if it holds at least 0.8 of the template's distinct words. The words of all templates are put
in one global order, rarest first, by the number of documents of the whole corpus that hold them; both
templates and blocks are read in it. A block that meets the threshold

- must share one of the template's ``size - need + 1`` rarest words (prefix filter);
- must have ``need`` different template words at all (length filter);
- and after the k-th shared word, at place i of the template and place j of the block, what follows
  both places must suffice: k + min(size - i - 1, block - j - 1) >= need (positional filter).

What is left is verified by counting: ``found`` holds every template that some block matches. The templates
are a fixed list, so they go to every task.

Which matches become labels is judged by words and places, over blocks of all widths. Templates that differ
by few words would match each other's texts (the GPL's notice holds seven of the eight words of the LGPL's):
where the text of one template alone would match another, a match of the other must hold all the words that
tell them apart. And a match gives no label if another one accounts for it: one of a better template (larger
share, or as large a share of more words) that has all its matched words, or one whose telling words (``lesser``
in the GPL's own sentence) are there. It accounts for a match if, without the words between the first and the
last of the other's, too few are left to match. So two licenses are both reported where they stand apart;
two of one family within a few words of each other may be reported as the one with the telling word.

Besides, three base phrases are searched as consecutive words of the whole text.

Defined results: a null text is empty; n_words 0, no places, null first and last word, no labels
and score 0 for texts without words; the score is 1 with a base phrase, else the largest
containment that meets the threshold, else 0; repeated rows are scanned one by one; a template
without words is an error; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, words

BASE = {
    (b"cc", b"by"): "cc-by",
    (b"general", b"public", b"license"): "gpl",
    (b"all", b"rights", b"reserved"): "reserved",
}
#: Sentences of public license texts and of the notices that go with them.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0",
    "artistic-2.0": "this work is distributed under the terms of the artistic license 2 0",
    "boost": "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "licensed under the gnu lesser general public license",
    "lgpl-text": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
    "as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "reserved": "copyright all rights reserved",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
    "arising from the use of this software",
}
THRESHOLD = 0.8


def width(n_words: int) -> int:
    """Words of the blocks for a template of so many words."""
    return 1 << (2 * n_words - 1).bit_length()


class Index:
    """Templates by their rarest words, for one global order of words."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        own = {label: words(text.encode()) for label, text in templates.items()}
        if empty := [label for label, w in own.items() if not w]:
            raise ValueError(f"templates without words: {empty}")
        order = sorted({w for t in own.values() for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.width = {label: width(len(w)) for label, w in own.items()}
        self.ranks = {label: sorted({self.rank[x] for x in w}) for label, w in own.items()}
        self.need = {label: math.ceil(threshold * len(r) - 1e-9) for label, r in self.ranks.items()}
        self.words = {label: frozenset(r) for label, r in self.ranks.items()}
        #: For each template the words it has beyond each one whose own text would match it.
        self.apart = {a: [self.words[a] - self.words[b] for b in self.words if b != a and self.need[a] <= len(self.words[a] & self.words[b]) < len(self.words[a])] for a in self.words}
        #: For each template those whose match its own text would be, but for these words: if they are there, it is the other's text.
        self.tells = {
            a: {b: self.words[b] - self.words[a] for b in self.words if b != a and self.need[b] <= len(self.words[a] & self.words[b]) < min(len(self.words[b]), self.need[a])} for a in self.words
        }
        self.by_rank: dict[int, list[str]] = {}
        for label, r in self.ranks.items():
            for word in r[: len(r) - self.need[label] + 1]:
                self.by_rank.setdefault(word, []).append(label)
        self.prefix = frozenset(order[k] for k in self.by_rank)
        #: Pairs of block and template after the prefix, length and positional filter, and matches.
        self.passed = Counter()

    def shared(self, label: str, block: list[int]) -> int:
        """How many words the block (ranks in order) shares with the template; 0 where a filter says too few."""
        own, need = self.ranks[label], self.need[label]
        self.passed["prefix"] += 1
        if len(block) < need:
            return 0
        self.passed["length"] += 1
        i = j = k = 0
        while i < len(own) and j < len(block):
            if own[i] < block[j]:
                i += 1
            elif own[i] > block[j]:
                j += 1
            else:
                i, j, k = i + 1, j + 1, k + 1
                if k + min(len(own) - i, len(block) - j) < need:
                    return 0
                if k == 1:
                    self.passed["position"] += 1
        if k < need:
            return 0
        self.passed["match"] += 1
        return k

    def labelled(self, text: list[bytes], matches: dict[str, list[tuple]]) -> set[str]:
        """The templates to report, of all matches (first word, word after the last, share, matched words) by template."""
        rank, labels, starts = self.rank, set(), {label: [m[0] for m in own] for label, own in matches.items()}

        def explained(label: str, match: tuple) -> bool:
            first, after, share, mine = match
            for other, theirs in matches.items():
                within, told = mine <= self.words[other], self.tells[label].get(other)
                if other == label or not within and told is None:
                    continue
                lo = bisect_left(starts[other], first - self.width[other])
                for at, end, their_share, held in theirs[lo : bisect_left(starts[other], after)]:
                    better = within and (their_share, len(self.ranks[other])) > (share, len(self.ranks[label]))
                    if end <= first or not better and (told is None or not told <= held):
                        continue
                    stand = [k for k in range(at, end) if rank.get(text[k]) in self.words[other]]
                    apart = {rank[text[k]] for k in range(first, after) if not stand[0] <= k <= stand[-1] and text[k] in rank}
                    if len(apart & self.words[label]) < self.need[label]:
                        return True
            return False

        for label, own in matches.items():
            if any(all(told <= m[3] for told in self.apart[label]) and not explained(label, m) for m in own):
                labels.add(label)
        return labels

    def scan(self, text: list[bytes]) -> tuple[dict[str, float], set[str]]:
        """The largest containment of every template that some block matches, and the labels to report."""
        rank, asked = self.rank, {}
        for at, word in enumerate(text):
            if word in self.prefix:
                for label in self.by_rank[rank[word]]:
                    step = (w := self.width[label]) // 2
                    for b in {at // step, max(0, at // step - 1)}:
                        if b == 0 or (b + 1) * step < len(text):
                            asked.setdefault((w, b), set()).add(label)
        matches: dict[str, list[tuple]] = {}
        for (w, b), some in sorted(asked.items()):
            first, after = b * w // 2, min(len(text), b * w // 2 + w)
            held = {rank[x] for x in text[first:after] if x in rank}
            block = sorted(held)
            for label in some:
                if n := self.shared(label, block):
                    matches.setdefault(label, []).append((first, after, n / len(self.ranks[label]), held & self.words[label]))
        return {label: max(m[2] for m in own) for label, own in matches.items()}, self.labelled(text, matches)


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands; a row per word comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                n.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in counted.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: the columns of the contract, and ``found`` (label and containment by template)."""
    bounded_batches(docs.sparkSession)
    templates = templates or TEMPLATES
    vocabulary = frozenset(w for t in templates.values() for w in words(t.encode()))
    index = Index(templates, document_frequency(docs, vocabulary), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column("text")):
                own = words(text)
                places, base, seen = [], set(), frozenset(own)
                for phrase, label in BASE.items():
                    if not seen.issuperset(phrase):
                        continue
                    n = len(phrase)
                    at = [i for i, w in enumerate(own) if w == phrase[0] and tuple(own[i : i + n]) == phrase]
                    if at:
                        base.add(label)
                        places += at
                found, labels = index.scan(own) if not index.prefix.isdisjoint(seen) else ({}, set())
                labels |= base
                rows.append((
                    len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(labels)), 1.0 if base else max(found.values(), default=0.0), sorted(found.items()),
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["doc_id", *names]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, found map<string,double>",
    )
