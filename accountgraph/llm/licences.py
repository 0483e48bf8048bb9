"""Licence scans by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of all templates, with the places where
it ends in them. Reading a text through it yields, at each word, the longest run
of words up to there that some template has, and by the suffix links the longest
of every other template. Long runs that cannot be extended are chained in the
order of their template, each of whose words counts once. A chain is a span when
it covers enough of its template, has the words that tell the licence from its
kin, and no such word of another one in its gaps.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from accountgraph.llm.common import computed

# Words of licence texts (fixed pattern).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that always count, with their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Families of licences with one wording: label, name and version, or short name (fixed values).
_GNU = [
    ("gpl-2", "General", "2"),
    ("gpl-3", "General", "3"),
    ("lgpl-2.1", "Lesser General", "2.1"),
    ("lgpl-3", "Lesser General", "3"),
    ("agpl-3", "Affero General", "3"),
]
_CC = [
    ("cc-by", "Attribution", "BY"),
    ("cc-by-nc", "Attribution-NonCommercial", "BY-NC"),
    ("cc-by-sa", "Attribution-ShareAlike", "BY-SA"),
    ("cc-by-nd", "Attribution-NoDerivatives", "BY-ND"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)

# Notices and texts of public licences, by label (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    *[(label, f"This work is licensed under the GNU {name} Public License, version {version}.") for label, name, version in _GNU],
    *[
        (
            label,
            f"This {'library' if 'Lesser' in name else 'program'} is free software: you can redistribute it and/or modify it under the "
            f"terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the "
            f"License, or (at your option) any later version. This {'library' if 'Lesser' in name else 'program'} is distributed in "
            "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.",
        )
        for label, name, version in _GNU
    ],
    *[
        (label, f"This work is licensed under a Creative Commons {name} {version} License.")
        for label, name, _ in _CC
        for version in ("4.0 International", "3.0 Unported")
    ],
    *[(label, f"Licensed under CC {short} 4.0.") for label, _, short in _CC],
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("cc0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("bsd-2", _BSD),
    (
        "bsd-3",
        _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]

# Words of the shortest run that is chained, the most words of a text between two
# runs of a chain, and the share of its template that a chain must cover.
LEAST_RUN = 3
GAP = 8
LEAST_SHARE = 0.7

# Words that tell a licence from its kin: a template's own ones must be covered, and
# no other one may lie between a chain's runs. Numbers (versions) and names of
# licences must be covered as well (fixed values).
KIN = frozenset(
    "noncommercial sharealike noderivatives noderivs nc sa nd lesser affero endorse public domain zero".split()
)
NAMES = frozenset("mit apache gnu mozilla mpl creative commons cc cc0 isc bsd warranty".split())


def words_of(text: str) -> list[str]:
    # Lower-casing bytes changes A to Z only.
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Automaton(NamedTuple):
    """States with transitions by word number, suffix links and lengths, and the ends ``(template, word)`` of each state's runs."""

    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[tuple[tuple[int, int], ...]]
    numbers: dict[str, int]
    labels: list[str]
    words: list[list[str]]

    def must(self, template: int) -> set[int]:
        """Words of a template, by place, that a span must cover."""
        return {i for i, w in enumerate(self.words[template]) if w in KIN or w in NAMES or w.isdigit()}


def build(templates: list[tuple[str, str]] = TEMPLATES) -> Automaton:
    """Generalised suffix automaton of the templates' words."""
    step: list[dict[int, int]] = [{}]
    link, length, own = [-1], [0], [[]]
    numbers: dict[str, int] = {}

    def state(size: int, moves: dict[int, int], back: int) -> int:
        step.append(moves), link.append(back), length.append(size), own.append([])
        return len(step) - 1

    def split(p: int, q: int, word: int) -> int:
        """The state for the run that ends in ``word`` after ``p``, cut off from ``q`` where ``q`` is longer."""
        if length[q] == length[p] + 1:
            return q
        part = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = part
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = part
            p = link[p]
        return part

    words = [words_of(text) for _, text in templates]
    for template, tokens in enumerate(words):
        last = 0
        for place, token in enumerate(tokens):
            word = numbers.setdefault(token, len(numbers))
            p = last
            if word in step[p]:
                last = split(p, step[p][word], word)
            else:
                last = state(length[p] + 1, {}, 0)
                while p >= 0 and word not in step[p]:
                    step[p][word] = last
                    p = link[p]
                if p >= 0:
                    link[last] = split(p, step[p][word], word)
            own[last].append((template, place + 1))
    # A run ends wherever a longer run ends that it is the end of.
    for s in sorted(range(1, len(step)), key=lambda s: -length[s]):
        own[link[s]] += own[s]
    ends = [tuple(sorted(set(e))) for e in own]
    return Automaton(step, link, length, ends, numbers, [label for label, _ in templates], words)


def matching_statistics(automaton: Automaton, numbers: list[int]) -> list[tuple[int, int]]:
    """For each word the length of the longest run ending there that a template has, and the run's state."""
    step, link, length = automaton.next, automaton.link, automaton.length
    out, s, n = [], 0, 0
    for word in numbers:
        while s and word not in step[s]:
            s = link[s]
            n = length[s]
        if word in step[s]:
            s, n = step[s][word], n + 1
        else:
            s = n = 0
        out.append((n, s))
    return out


class Run(NamedTuple):
    """Words ``start`` to ``end`` of a text that are words ``at`` onward of a template."""

    start: int
    end: int
    at: int


def runs(automaton: Automaton, words: list[str]) -> dict[int, list[Run]]:
    """By template its runs of at least ``LEAST_RUN`` words in a text that neither side continues, by start."""
    found: dict[int, list[Run]] = {}
    get = automaton.numbers.get
    numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    # Only stretches of template words can hold a run.
    known = np.concatenate([[0], (numbers >= 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < LEAST_RUN:
            continue
        for i, (n, s) in enumerate(matching_statistics(automaton, numbers[a:b].tolist())):
            end, seen = a + i + 1, set()
            following = words[end] if end < len(words) else None
            # The links lead to shorter and shorter runs, which more templates have.
            while n >= LEAST_RUN:
                for template, at in automaton.ends[s]:
                    if (template, at) not in seen:
                        seen.add((template, at))
                        own = automaton.words[template]
                        if at == len(own) or own[at] != following:
                            found.setdefault(template, []).append(Run(end - n, end, at - n))
                s = automaton.link[s]
                n = automaton.length[s]
    for own in found.values():
        own.sort()
    return found


def chains(found: list[Run]) -> list[tuple[int, list[Run]]]:
    """Best chains of a template's runs: words covered and runs, more words first, none over words of a text that one before has.

    A chain goes forward in text and template. What a run shares with the one
    before it, on either side, is cut off its front, and at most ``GAP`` words
    of the text lie between two runs.
    """
    best: list[tuple[int, int | None, Run]] = []
    longest = max((r.end - r.start for r in found), default=0)
    for j, run in enumerate(found):
        score = (run.end - run.start, None, run)
        for i in range(j - 1, -1, -1):
            if found[i].start + longest + GAP < run.start:
                break
            covered, _, cut = best[i]
            shared = max(0, cut.end - run.start, cut.at + cut.end - cut.start - run.at)
            if shared < run.end - run.start and run.start + shared - cut.end <= GAP:
                rest = Run(run.start + shared, run.end, run.at + shared)
                if covered + rest.end - rest.start > score[0]:
                    score = (covered + rest.end - rest.start, i, rest)
        best.append(score)
    out: list[tuple[int, list[Run]]] = []
    taken: list[tuple[int, int]] = []
    for j in sorted(range(len(best)), key=lambda j: (-best[j][0], j)):
        chain, k = [], j
        while k is not None:
            chain.append(best[k][2])
            k = best[k][1]
        chain.reverse()
        a, b = chain[0].start, chain[-1].end
        at = bisect(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            out.append((best[j][0], chain))
    return out


def clusters(found: list[Run]) -> list[list[Run]]:
    """Runs by start, apart where a gap is too wide for any chain."""
    out: list[list[Run]] = []
    reach = 0
    for run in found:
        if not out or run.start - reach > GAP:
            out.append([])
        out[-1].append(run)
        reach = max(reach, run.end)
    return out


class Span(NamedTuple):
    label: str
    start: int
    end: int
    share: float


def spans(automaton: Automaton, words: list[str]) -> list[Span]:
    """Chains that cover enough of their template and are no kin's; one inside a chain of another label that covers more is left out."""
    found: list[tuple[int, Span]] = []
    for template, own in runs(automaton, words).items():
        size = len(automaton.words[template])
        for cluster in clusters(own):
            if sum(r.end - r.start for r in cluster) < LEAST_SHARE * size:
                continue
            for covered, chain in chains(cluster):
                if covered < LEAST_SHARE * size:
                    break
                places = {r.at + k for r in chain for k in range(r.end - r.start)}
                between = {w for r, after in zip(chain, chain[1:]) for w in words[r.end : after.start]}
                if automaton.must(template) <= places and not between & KIN:
                    found.append((covered, Span(automaton.labels[template], chain[0].start, chain[-1].end, covered / size)))
    found.sort(key=lambda f: f[1].start)
    starts = [s.start for _, s in found]
    widest = max((s.end - s.start for _, s in found), default=0)

    def around(s: Span) -> list[tuple[int, Span]]:
        return found[bisect_left(starts, s.start - widest) : bisect(starts, s.start)]

    return sorted(
        s for covered, s in found if not any(t.label != s.label and more > covered and s.end <= t.end for more, t in around(s))
    )


def phrase_places(words: list[str]) -> list[tuple[int, str]]:
    """Start and label of every place of a phrase."""
    out = []
    present = set(words)
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        if not present.issuperset(parts):
            continue
        rarest = min(range(len(parts)), key=lambda i: words.count(parts[i]))
        at = -1
        for _ in range(words.count(parts[rarest])):
            at = words.index(parts[rarest], at + 1)
            if at >= rarest and words[at - rarest : at - rarest + len(parts)] == parts:
                out.append((at - rarest, label))
    return sorted(out)


FIELDS = {
    "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
    "labels": "string", "score": "double", "span_labels": "array<string>", "span_starts": "array<int>", "span_ends": "array<int>",
}


def scan(texts: list[str], automaton: Automaton) -> dict[str, list]:
    """``FIELDS`` of each text."""
    rows = []
    for text in texts:
        words = words_of(text)
        places, found = phrase_places(words), spans(automaton, words)
        base = {label for _, label in places}
        starts = [start for start, _ in places]
        rows.append(
            (
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s.label for s in found})), 1.0 if base else max((s.share for s in found), default=0.0),
                [s.label for s in found], [s.start for s in found], [s.end for s in found],
            )
        )
    return dict(zip(FIELDS, map(list, zip(*rows))))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id`` and ``FIELDS`` of every row; null and empty texts have no words, no labels and score 0.

    ``score`` is 1 for a text with a phrase, else the largest share of a
    template that a span covers. Word numbers count from 0, ends are exclusive.
    Of spans that cover equally many words in one place all count. Equal texts have
    equal rows, repeated rows stay repeated, and an empty table stays empty;
    whole texts are read however long, and other columns are not.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build(templates))
    return computed(docs, lambda texts: scan(texts, automaton.value), FIELDS)
