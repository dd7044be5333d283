"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the
words joined by one space, so punctuation, line breaks and spacing never matter. A rule
is tried only where one of its family's keywords occurs. Detections overlap ("apache
license" lies in "licensed under the apache license version 2 0"); the rule order is the
priority: a detection that lies inside one of higher priority is suppressed, and of
two equal spans only the first rule's stays. Base phrases are reported whatever is
suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidewatch.llm.common import arrow_map, one_text_per_id, per_task

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: What is a word: ASCII letters (lower-cased), digits and every character beyond ASCII.
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))

#: Ways in which a grant names a license, the most explicit first: (prefix, suffix, score).
_FORMS = [
    (r"(?:is |are )?(?:released|licen[sc]ed|distributed|made available|published|provided) under (?:the |a )?(?:terms of the )?(?:conditions of the )?", "", 1.0),
    (r"(?:subject to|under|governed by) (?:the )?(?:terms (?:and conditions )?of the |terms of )?", "", 0.95),
    (r"spdx license identifier ", "", 1.0),
    (r"licen[sc]es? ", "", 0.85),
    ("", r" licen[sc]e text", 0.8),
    ("", "", 0.7),
]

_V = r"(?: (?:v|version|ver))? ?"

#: (keyword, label, name pattern) by family; more specific names stand first.
_NAMES = [
    *(("gnu", f"agpl-{v}", rf"gnu (?:affero general public|agpl) licen[sc]e{_V}{v}(?: 0)?") for v in (1, 3)),
    *(("gnu", f"lgpl-{v.replace(' ', '.')}", rf"gnu (?:lesser|library) general public licen[sc]e{_V}{v}(?: 0)?") for v in ("2 1", "2", "3")),
    *(("gnu", f"gpl-{v}-or-later", rf"gnu general public licen[sc]e{_V}{v}(?: 0)? or(?: \(?at your option\)?)?(?: any)? later(?: version)?") for v in (1, 2, 3)),
    *(("gnu", f"gpl-{v}", rf"gnu general public licen[sc]e{_V}{v}(?: 0)?") for v in (1, 2, 3)),
    *(("gpl", f"{k}gpl-{v}", rf"{k}gpl{_V}{v}(?: 0)?") for k in ("a", "l", "") for v in (1, 2, 3)),
    ("gnu", "gfdl", rf"gnu free documentation licen[sc]e(?:{_V}1 [123])?"),
    ("gnu", "gpl", "gnu general public licen[sc]e"),
    *(("apache", f"apache-{v.replace(' ', '.')}", rf"apache (?:software )?licen[sc]e{_V}{v}") for v in ("1 0", "1 1", "2 0")),
    ("apache", "apache-2.0", r"apache (?:licen[sc]e )?(?:v |version )?2(?: 0)?"),
    *(("cc", f"cc-by{k.replace(' ', '-')}-{v.replace(' ', '.')}", rf"cc by{k} {v}") for k in (" nc sa", " nc nd", " nc", " sa", " nd", "") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")),
    *(("cc", f"cc-by{k.replace(' ', '-')}", rf"cc by{k}") for k in (" nc sa", " nc nd", " nc", " sa", " nd", "")),
    *(
        ("creative", f"cc-by{k}", rf"creative commons attribution{n}(?: (?:international|unported))?(?: licen[sc]e)?(?:{_V}[1-4](?: [05])?)?")
        for k, n in (("-nc-sa", " non ?commercial share ?alike"), ("-nc-nd", " non ?commercial no ?deriv(?:ative)?s"), ("-nc", " non ?commercial"), ("-sa", " share ?alike"), ("-nd", " no ?deriv(?:ative)?s"), ("", ""))
    ),
    ("cc0", "cc0-1.0", r"cc0(?: 1 0)?(?: universal)?"),
    ("creative", "cc0-1.0", r"creative commons zero(?: 1 0)?"),
    *(("bsd", f"bsd-{n}", rf"(?:{n}|{w}) clause bsd(?: licen[sc]e)?|bsd {n} clause") for n, w in ((0, "zero"), (2, "two"), (3, "three"), (4, "four"))),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mit", "mit-0", r"mit no attribution(?: licen[sc]e)?"),
    ("mit", "mit", r"mit licen[sc]e"),
    ("mozilla", "mpl", rf"mozilla public licen[sc]e(?:{_V}[12] [01])?"),
    ("mpl", "mpl", rf"mpl{_V}[12] [01]"),
    ("eclipse", "epl", rf"eclipse public licen[sc]e(?:{_V}[12] 0)?"),
    ("boost", "bsl-1.0", rf"boost software licen[sc]e(?:{_V}1 0)?"),
    ("artistic", "artistic", rf"artistic licen[sc]e(?:{_V}[12] 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("european", "eupl", rf"european union public licen[sc]e(?:{_V}1 [0-2])?"),
    ("common", "cddl", rf"common development and distribution licen[sc]e(?:{_V}1 [01])?"),
    ("open", "ofl", rf"(?:sil )?open font licen[sc]e(?:{_V}1 [01])?"),
    ("open", "odbl", r"open (?:data commons open )?database licen[sc]e"),
    ("python", "psf", r"python software foundation licen[sc]e"),
    ("public", "public-domain", r"(?:dedicated to|in|released into) the public domain"),
    ("all", "proprietary", r"all rights reserved"),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    keyword: str
    label: str
    pattern: str
    score: float


def rules() -> list[Rule]:
    """Every name in every form, explicit grants before bare names."""
    out = []
    for prefix, suffix, score in _FORMS:
        for keyword, label, name in _NAMES:
            out.append(Rule(len(out), keyword, label, rf"(?<![^ ]){prefix}(?:{name}){suffix}(?![^ ])", score))
    return out


def to_words(text: str) -> bytes:
    """The words joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())


def detections(line: str, ruleset: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) that no detection of higher priority contains, by start."""
    found = []
    present: dict[str, bool] = {}
    for rule, pattern in ruleset:
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in line
        if present[rule.keyword]:
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(line)]
    # by start and then the longest: whatever contains a detection stands before it
    found.sort(key=lambda d: (d[0], -d[1], d[2].priority))
    kept: list[tuple[int, int, Rule]] = []
    open_spans: list[tuple[int, int, Rule]] = []
    for d in found:
        open_spans = [o for o in open_spans if o[1] > d[0]]
        if not any(o[1] >= d[1] and o[2].priority <= d[2].priority for o in open_spans):
            kept.append(d)
            open_spans.append(d)
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases and detected licenses.

    Empty and NULL texts give 0 words, no phrase (first_word and last_word NULL), empty
    labels and score 0. Repeated ids are scanned row by row. Only doc_id and text are
    read. ``detections`` holds label, start and end word (exclusive) of what stays.
    """

    @per_task
    def factory():
        ruleset = [(r, re.compile(r.pattern)) for r in rules()]
        words = sorted({r.keyword.encode() for r, _ in ruleset})
        gate = re.compile(b"|".join(words))
        base = [(f" {p} ".encode(), label) for p, label in BASE.items()]

        def rows(cols):
            out = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for doc, text in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist()):
                line = to_words(text)
                n_words = line.count(b" ") + 1 if line else 0
                places, base_labels, found = [], set(), []
                if gate.search(line):
                    padded = b" " + line + b" "
                    for phrase, label in base:
                        at = padded.find(phrase)
                        while at >= 0:
                            places.append(padded.count(b" ", 0, at))
                            base_labels.add(label)
                            at = padded.find(phrase, at + 1)
                    s = line.decode("utf-8", "surrogatepass")
                    found = [(r.label, s.count(" ", 0, a), s.count(" ", 0, z) + 1, r.score) for a, z, r in detections(s, ruleset)]
                out["doc_id"].append(doc)
                out["n_words"].append(n_words)
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base_labels)))
                out["labels"].append(",".join(sorted(base_labels | {f[0] for f in found})))
                out["score"].append(max([f[3] for f in found] + [0.7 * bool(places)]))
                out["detections"].append([{"label": f[0], "first": f[1], "end": f[2]} for f in found])
            return out

        return rows

    return arrow_map(
        one_text_per_id(docs),
        factory,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, detections array<struct<label:string,first:long,end:long>>",
    )
