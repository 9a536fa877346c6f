"""All detection rules over a text in one pass of an Arrow function.

The column expressions of ``quillon.operators.detect`` say what is found; they are
interpreted rule by rule, and cost some eight times as much a text.  Here the same
rules, tables and overlap scan run on Arrow batches; a rule is only tried where the literals
or the shape of a text allow a match to start, and texts are looked through many at a
time, each a line of its own: a rule sees the end of its text as the end, and a line's end before it, where
no rule tells that from the text's start.  Null texts count as empty.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import accumulate
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions.spans import SPAN

#: What ``\\s`` matches in ASCII.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f "
#: Literals that every match of a rule starts with one of; an address starts behind its label.
_HEADS = {
    "file": ["CDSCO"], "drug": ["IND"], "mrn": ["MRN"], "url": ["http"], "date_month": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "titled_name": "Dr Mr Ms Shri Smt Prof Adv".split(), "narrative_name": "Patient Dr Mr Ms Shri Smt".split(), "inline_patient": ["Patient"], "inline_title": "Dr Mr Ms Shri Smt".split(),
    "labelled_name": "Patient Name Inspector Officer Applicant Investigator Sponsor Reporter Doctor Physician Nurse".split(),
    "field_name": ["patient", "name"], "field_doctor": ["doctor", "physician", "treating"], "field_hospital": ["hospital"], "field_address": ["address"], "field_phone": ["phone"],
    "field_aadhaar": ["aadhaar"], "field_email": ["email"], "field_reporter": ["reporter"], "address_label": ["Address: "],
}
#: Whole words that every match of a rule starts with one of.
_FIRST = {r.name: frozenset(w.split("\\s+")[0] for w in words.split("|")) for r, words in ((P.HOSPITAL_RULES[1], P._KNOWN.lower()), (P.CITY_RULES[0], P.CITIES))}
#: The same in the shape of an ASCII text: letters as a and A, digits as 0, all else as blanks, with a blank around.
_SHAPES = {
    "aadhaar": [" 0000 0000 0000 ", " 000000000000 ", " 0000 00000000 ", " 00000000 0000 "], "pan": [" AAAAA0000A "], "ifsc": [" AAAA0"], "passport": [" A0000000 "], "pin": [" 000000 "],
}
#: Shapes of many lengths, as patterns of the blank and the first sign of a match.
_LIKE = {
    "date_ymd": " 0(?=000 00? 0)", "date_dmy": " 0(?=0? 00? 00)", "ip": " 0(?=0{0,2} 00?0? 00?0? 0)", "context_name": " A(?=aa+ +Aaa+ +(?:Aaa+ +)?a)",
}
#: What a matching text has somewhere: literals, or parts of its shape.
_NEEDS = {
    "email": ["@"], "context_name": [v.split("\\")[0] for v in P._VERB_OR_AGE.split("|")], "date_dmy": ["/", "-", "."], "date_ymd": ["/", "-", "."], "ip": ["."],
    "hospital": "Hospital Clinic Medical Institute Health Nursing Pharma Laborator Lab Research Foundation".split(),
}
_PARTS = {"phone": ["0" * 10], "phone_split": ["00000 00000"], "address_pin": ["000000 "]}
#: How far before such a part a match can start: nothing, 0, +91 or +91 and a sign.
_BEFORE = {"phone": (4, 3, 1, 0), "phone_split": (4, 3, 1, 0)}
#: All signs that a match can have, where it can have a text around it without them.
_ALPHABET = {
    "email": f"{ascii_letters}{digits}._%+-@", "address_pin": f"{ascii_letters}{digits},/-{_BLANKS}", "hospital": f"{ascii_letters}{_BLANKS}", "card": f"{digits} -",
}
_OUTSIDE = {k: bytes(97 if chr(c) in v else 32 for c in range(256)) for k, v in _ALPHABET.items()}
_SHAPE = bytes(48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c == 95 else 32 for c in range(256))
_APART = bytes(32 if _SHAPE[c] == 32 else c for c in range(256))
_DIGIT, _SPACED, _FIRST_WORD = re.compile(r"\d"), re.compile(P.SPACED_LETTERS), re.compile(r"\s*(\S+)")
#: Characters of texts that are scanned in one pass, the last text whole: what a pass costs for itself is shared by some hundred short texts.
_AT_ONCE = 1 << 16
#: Rules that cannot match without a digit.
_DIGITS = {r.name for r in P.REGEX_RULES} - {"email", "file", "url"}


class _Seen:
    """What is looked up in texts before the rules; a line's end stands between the texts."""

    def __init__(self, *texts: str):
        text = self.text = "\n".join(texts)
        self.ends = list(accumulate(len(t) + 1 for t in texts))  # of each text and its line's end
        self.starts = [0, *self.ends[:-1]]
        self.ascii, self.digits = text.isascii(), _DIGIT.search(text) is not None
        if self.ascii:
            self.data, self.lower = text.encode("ascii"), text.lower()
            self.shape, apart = f" {self.data.translate(_SHAPE).decode('ascii')} ", self.data.translate(_APART)
            self.words = set(apart.decode("ascii").split())
            self.lower_words = {w.lower() for w in self.words}
        else:
            self.whole = [(a, b - 1) for a, b in zip(self.starts, self.ends, strict=True)]
            self.numbered = [(a, b) for a, b in self.whole if _DIGIT.search(text, a, b)]

    def around(self, places: Iterable[int], alphabet: bytes) -> Iterator[tuple[int, int]]:
        """Start and end of the pieces of texts with these places, as far as their signs are of an alphabet, and one sign more."""
        signs, last = self.data.translate(alphabet), 0
        for at in places:
            if at >= last:
                i = bisect_right(self.starts, at) - 1
                start, end = self.starts[i], self.ends[i] - 1
                stop = signs.find(b" ", at, end)
                last = end if stop < 0 else stop + 1
                yield max(start, signs.rfind(b" ", start, at) + 1), last

    @cached_property
    def long_runs(self) -> list[int]:
        """Where 13 digits are parted by nothing else than blanks and hyphens."""
        runs = self.data.translate(_SHAPE, b" -")  # what parts other runs stays, and so do line ends
        found = _places(runs, [b"0" * 13])
        if not found:
            return found
        octets = np.frombuffer(self.data, np.uint8)
        return np.flatnonzero((octets != 32) & (octets != 45))[found].tolist()


def _places(where, parts: Iterable) -> list[int]:
    """Where the parts stand, in order."""
    out = []
    for part in parts:
        at = where.find(part)
        while at >= 0:
            out.append(at)
            at = where.find(part, at + 1)
    out.sort()
    return out


class _Compiled:
    """A rule, and where its matches can start."""

    def __init__(self, rule: P.Rule, order: int):
        self.name, self.pattern, self.group, self.entity, self.score, self.order = rule.name, re.compile(rule.pattern, re.I if rule.ignore_case else 0), rule.group, rule.entity, rule.score, order
        self.fold, self.numeric, self.card = rule.ignore_case, rule.name in _DIGITS, rule.name == "card"
        self.heads, self.first, self.shapes, self.needs, self.parts = (x.get(rule.name) for x in (_HEADS, _FIRST, _SHAPES, _NEEDS, _PARTS))
        self.like, self.before, self.outside = re.compile(_LIKE[rule.name]) if rule.name in _LIKE else None, _BEFORE.get(rule.name), _OUTSIDE.get(rule.name)

    def spans(self, seen: _Seen) -> list[tuple[int, int]]:
        """Start and end of what is found: the group, or the match."""
        return [m.span(self.group) for m in self.matches(seen)]

    def matches(self, seen: _Seen) -> Iterable[re.Match]:
        """All matches, as ``finditer`` gives them for each text."""
        text = seen.text
        if self.numeric and not seen.digits or self.needs and not any(x in text for x in self.needs):
            return ()
        if self.name == "address_label":
            return self._at(seen, [at + len(self.heads[0]) for at in _places(text, self.heads)])
        if not seen.ascii:  # letters of other scripts fold, and count as digits, in ways of their own
            if self.heads and not self.fold:
                return self._at(seen, _places(text, self.heads))
            inside = seen.numbered if self.numeric else seen.whole
            if self.needs:
                inside = [(a, b) for a, b in inside if any(text.find(x, a, b) >= 0 for x in self.needs)]
            return (m for a, b in inside for m in self.pattern.finditer(text, a, b))
        if self.like:
            return self._at(seen, [m.start() for m in self.like.finditer(seen.shape)])
        if self.shapes:
            return self._at(seen, _places(seen.shape, self.shapes))
        if self.before:  # the shape has a blank before the texts
            return self._at(seen, sorted({max(at - 1 - n, 0) for at in _places(seen.shape, self.parts) for n in self.before}))
        heads = self.first & (seen.lower_words if self.fold else seen.words) if self.first else self.heads
        if heads is not None:
            return self._at(seen, _places(seen.lower if self.fold else text, heads))
        places = seen.long_runs if self.card else [at - 1 for at in _places(seen.shape, self.parts)] if self.parts else _places(text, self.needs)
        return (m for start, end in seen.around(places, self.outside) for m in self.pattern.finditer(text, start, end))

    def _at(self, seen: _Seen, starts: list[int]) -> list[re.Match]:
        out, end, text, ends, i, match = [], 0, seen.text, seen.ends, 0, self.pattern.match
        for at in starts:
            if at >= end:
                while at >= ends[i]:
                    i += 1
                if m := match(text, at, ends[i] - 1):
                    end = m.end()
                    out.append(m)
        return out


def _compiled(rules: list[P.Rule], first: int) -> list[_Compiled]:
    return [_Compiled(r, first + i) for i, r in enumerate(rules)]


_RULES = [*_compiled(P.REGEX_RULES, 0), *_compiled(P.NAME_RULES, 200), *_compiled(P.HOSPITAL_RULES, 300), *_compiled(P.CITY_RULES, 400)]
_FIELDS, _INLINE = _compiled(P.FIELD_RULES, 500), _compiled(P.INLINE_RULES, 600)
_ALL = [*_RULES, *_FIELDS, *_INLINE]
_ENTITIES, _SCORES = pa.array([r.entity for r in _ALL]), np.array([r.score for r in _ALL])
_NAMES = ["start", "end", "entity", "text", "score", "ord"]
_SKIP, _INLINE_SKIP = frozenset(P.NAME_SKIP), frozenset(P.INLINE_SKIP)
_PAGE, _NUMBER = re.compile(r"\s*:\s*\d+\s*$"), re.compile(r"\s+\d{1,3}\s*$")


def joined(text: str | None) -> str:
    """Runs of single capitals joined."""
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text or "")


def _real(order: int, value: str) -> bool:
    """False for what the name and hospital layers drop."""
    if not 200 <= order < 400:
        return True
    if len(value) < 3:
        return False
    return order >= 300 or (value.upper() != value and _FIRST_WORD.match(value)[1] not in _SKIP)


#: Start, end, rule and ord of spans.
_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _found(rules: list[_Compiled], seen: _Seen, real: Callable[[_Compiled, list[tuple[int, int]]], list[tuple[int, int]]]) -> _Found:
    lists = [real(r, r.spans(seen)) for r in rules]
    ends = np.fromiter((x for spans in lists for span in spans for x in span), np.int64)
    sizes = [len(x) for x in lists]
    return ends[::2], ends[1::2], np.repeat([_ALL.index(r) for r in rules], sizes), np.repeat([r.order for r in rules], sizes)


def _resolved(found: _Found) -> _Found:
    """The greedy scan; only spans that overlap are looked at one by one."""
    start, end, rule, order = found
    by = np.lexsort((order, start - end, start))
    start, end, score = start[by], end[by], _SCORES[rule[by]]
    apart = np.flatnonzero(np.r_[True, start[1:] >= np.maximum.accumulate(end)[:-1]][: len(by)])
    until = np.r_[apart[1:], len(by)]
    alone, kept, starts, ends, scores = until - apart == 1, [], start.tolist(), end.tolist(), score.tolist()
    for a, b in zip(apart[~alone].tolist(), until[~alone].tolist(), strict=True):
        last = a
        for i in range(a + 1, b):
            if starts[i] >= ends[last]:
                kept.append(last)
                last = i
            elif (scores[i], ends[i] - starts[i]) > (scores[last], ends[last] - starts[last]):
                last = i
        kept.append(last)
    chosen = by[np.sort(np.r_[apart[alone], np.array(kept, np.int64)])]
    return tuple(c[chosen] for c in found)


def _general(seen: _Seen) -> _Found:
    """Resolved spans of all rules, in order."""
    text = seen.text
    return _resolved(_found(_RULES, seen, lambda r, spans: [(a, b) for a, b in spans if _real(r.order, text[a:b])] if 200 <= r.order < 400 else spans))


def _field(entity: str, value: str) -> str:
    """A field's value without what follows it on its line."""
    value = value.strip()
    if entity != "PERSON":
        return value
    return "" if re.fullmatch(r"\d+", value.replace(" ", "")) else _NUMBER.sub("", _PAGE.sub("", value))


def _report(seen: _Seen) -> _Found:
    """The same with the label fields and inline names of reports, resolved once more."""
    text = seen.text

    def fields(r: _Compiled, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        sized = [(a, len(_field(r.entity, text[a:b]))) for a, b in spans]
        return [(a, a + n) for a, n in sized if n >= 2]

    start, end, rule, _ = _general(seen)
    own = np.searchsorted(seen.starts, start, "right")
    number = np.arange(len(start)) - np.searchsorted(own, own)  # of a span within its text
    inline = _found(_INLINE, seen, lambda r, spans: [(a, b) for a, b in spans if text[a:b].split(None, 1)[0] not in _INLINE_SKIP])
    parts = zip((start, end, rule, number), _found(_FIELDS, seen, fields), inline, strict=True)
    return _resolved(tuple(map(np.concatenate, parts)))


def _together(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts that are scanned in one pass: some thousand characters, ASCII or not."""
    numbers, sizes = ([], []), [0, 0]
    for i, t in enumerate(texts):
        kind = t.isascii()
        numbers[kind].append(i)
        sizes[kind] += len(t)
        if sizes[kind] > _AT_ONCE:
            yield numbers[kind][:]
            numbers[kind].clear()
            sizes[kind] = 0
    yield from filter(None, numbers)


def _listed(texts: list[str], rules: Callable[[_Seen], _Found]) -> pa.ListArray:
    """The spans of each text."""
    order, sizes, columns, values = [], [np.zeros(1, np.int64)], [[np.zeros(0, np.int64)] for _ in range(4)], []
    for numbers in _together(texts):
        seen = _Seen(*[texts[i] for i in numbers])
        start, end, rule, at = rules(seen)
        values += [seen.text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        own = np.searchsorted(seen.starts, start, "right") - 1
        order += numbers
        sizes.append(np.bincount(own, minlength=len(numbers)))
        before = np.array(seen.starts)[own]
        for column, x in zip(columns, (start - before, end - before, rule, at), strict=True):
            column.append(x)
    start, end, rule, at = map(np.concatenate, columns)
    spans = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), _ENTITIES.take(pa.array(rule)), pa.array(values, pa.string()), pa.array(_SCORES[rule]), pa.array(at, pa.int32())]
    offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(spans, names=_NAMES))
    return lists if order == list(range(len(texts))) else lists.take(pa.array(np.argsort(order)))


def spans_of(text: str) -> list[tuple[int, int, str, str, float, int]]:
    """Resolved spans (start, end, entity, text, score, ord) of a normalised text."""
    return [tuple(s.values()) for s in _listed([text], _general)[0].as_py()]


def report_spans_of(text: str) -> list[tuple[int, int, str, str, float, int]]:
    """The same with the label fields and inline names of reports, resolved once more."""
    return [tuple(s.values()) for s in _listed([text], _report)[0].as_py()]


def _scanning(rules: Callable[[_Seen], _Found]):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield _listed(batch.to_pylist(), rules)

    return run


scan, scan_report = _scanning(_general), _scanning(_report)


def scanned(text: Column, report: bool = False) -> Column:
    """The spans that ``detect`` (or ``detect_report``) finds in a normalised text."""
    return F.arrow_udf(scan_report if report else scan, f"array<{SPAN}>")(F.coalesce(text, F.lit("")))
