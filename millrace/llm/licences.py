"""Licence scans: a generalised suffix automaton over the words of licence notices.

The automaton holds every run of words of every template. A text's words are streamed through
it; at each word the automaton knows the longest run ending there that some template contains
(matching statistics). Maximal runs of ``MIN_RUN`` words or more are chained per template, in
order on both sides, into spans; a template whose words are covered to ``MIN_COVER`` or more
gives its label.

Defined cases. Null text: empty, no words, score 0. A text of any length is streamed whole.
Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import by_slice, id_and_text

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence notices, as their licences print them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
        "Released under the Apache License, Version 2.0.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ],
    "cc-by-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY 4.0.",
    ],
}

MIN_RUN = 4  # words; shorter matches are chance
MIN_COVER = 0.5  # share of a template's words

# ASCII capitals to small letters, every other ASCII character outside a word to a blank
_FOLD = bytes(
    v + 32 if 0x41 <= v <= 0x5A else v if 0x30 <= v <= 0x39 or 0x61 <= v <= 0x7A or v >= 0x80 else 0x20
    for v in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; code points above ASCII all belong to words."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; each state keeps where it first ended."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]

    def add(self, tokens, owner: int) -> None:
        last = 0
        for at, token in enumerate(tokens):
            last = self._extend(last, token)
            state = last
            while state > 0 and owner not in self.ends[state]:  # every suffix of what was read ends here too
                self.ends[state][owner] = at + 1
                state = self.link[state]

    def _new(self, length, link, edges, ends) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, state, token, target) -> int:
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]), dict(self.ends[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last, token) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        state = self._new(self.length[last] + 1, 0, {}, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][token]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, token, target)
        return state

    def statistics(self, tokens):
        """Yield (length, state) of the longest known run that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield length, state


class Scanner:
    """Compiled templates and phrases; one per task."""

    def __init__(self, templates=None, phrases=None, min_run=MIN_RUN, min_cover=MIN_COVER):
        templates = TEMPLATES if templates is None else templates
        self.phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.min_run, self.min_cover = min_run, min_cover
        self.automaton, self.labels, self.sizes = SuffixAutomaton(), [], []
        vocabulary: dict[bytes, int] = {}
        sequences = []
        for label, texts in templates.items():
            for text in texts:
                sequences.append([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)])
                self.labels.append(label)
                self.sizes.append(len(sequences[-1]))
        for phrase, _ in self.phrases:
            for w in phrase:
                vocabulary.setdefault(w, len(vocabulary))
        for owner, tokens in enumerate(sequences):
            self.automaton.add(tokens, owner)
        self.vocabulary = vocabulary
        self.coded = [([vocabulary[w] for w in phrase], label) for phrase, label in self.phrases]

    def runs(self, ids: np.ndarray):
        """(start, stop) of maximal stretches of template words that are long enough to match."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        return [(int(a), int(b)) for a, b in known.reshape(-1, 2) if b - a >= self.min_run]

    def maximal(self, ids: np.ndarray):
        """(start, length, state) of matches that the next word does not prolong."""
        found = []
        for a, b in self.runs(ids):
            held = (0, 0)
            for at, (length, state) in enumerate(self.automaton.statistics(ids[a:b].tolist()), a):
                if length != held[0] + 1 and held[0] >= self.min_run:
                    found.append((at - held[0], *held))
                held = (length, state)
            if held[0] >= self.min_run:
                found.append((b - held[0], *held))
        return found

    def chain(self, matches):
        """Best chain of matches per template: (owner, words covered, first word, end word).

        Matches follow each other in the text and in the template; overlaps are cut. A gap in the
        text longer than the template ends a chain.
        """
        best: dict[int, tuple] = {}
        open_: dict[int, tuple] = {}  # owner: (covered, template end, first, text end)
        for start, length, state in matches:
            for owner, end in self.automaton.ends[state].items():
                here = (length, end, start, start + length)
                if (held := open_.get(owner)) and start - held[3] <= self.sizes[owner]:
                    cut = max(0, held[1] - (end - length), held[3] - start)
                    if end > held[1] and cut < length:
                        here = (held[0] + length - cut, end, held[2], start + length)
                open_[owner] = here
                if owner not in best or here[0] > best[owner][0]:
                    best[owner] = here
        return [(o, c, first, stop) for o, (c, _, first, stop) in best.items()]

    def scan(self, text: str) -> dict:
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        places, base = [], set()
        for code, label in self.coded:
            n = len(ids) - len(code) + 1
            if n <= 0:
                continue
            hit = ids[:n] == code[0]
            if not hit.any():
                continue
            for k, token in enumerate(code[1:], 1):
                hit &= ids[k : n + k] == token
            at = np.flatnonzero(hit)
            if len(at):
                places.append(at)
                base.add(label)
        found, score, spans = set(base), 1.0 if base else 0.0, []
        for owner, covered, first, stop in self.chain(self.maximal(ids)):
            share = min(1.0, covered / self.sizes[owner])
            score = max(score, share)
            if share >= self.min_cover:
                found.add(self.labels[owner])
                spans.append((self.labels[owner], first, stop))
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": int(places.min()) if len(places) else None,
            "last_word": int(places.max()) if len(places) else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(found)),
            "score": float(score),
            "template_spans": [{"label": a, "first_word": b, "end_word": c} for a, b, c in sorted(set(spans))],
        }


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, template_spans array<struct<label: string, first_word: bigint, end_word: bigint>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
_KINDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "template_spans": _SPANS,
}


def scan_licences(docs: DataFrame, templates=None, phrases=None, min_run: int = MIN_RUN, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: base places and labels, the method's labels, spans and best coverage."""

    def make():
        scanner = Scanner(templates, phrases, min_run, min_cover)

        def apply(batch):
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id")] + [pa.array([r[c] for r in rows], type=k) for c, k in _KINDS.items()]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *_KINDS])

        return apply

    return by_slice(id_and_text(docs), make, SCHEMA)


def licence_labels(docs: DataFrame) -> DataFrame:
    return scan_licences(docs).drop("template_spans")
