"""Licence scan by a positional index of rare words.

Templates are public licence texts and notices with mandatory key phrases. The
index holds, for every key phrase, postings ``word -> (phrase, place)`` of its
rarest words, rarity being the inverse document frequency over all documents
scanned. A file looks up its licence words, highest IDF first: each opens the
phrases of which it is the rarest word, the places of the phrase's other rare
words are intersected with it by relative position, and the phrase is verified
word by word at the places left. In a phrase of ``GAPPED`` words or more, one
foreign word may stand between two words. A template is found where its first
key phrase stands and every other one follows at its distance in the template,
give or take ``SLACK`` words and a quarter of that distance.

As the rare words are words of the phrase, rarity decides how few places are
looked at, never what is found. A file's score is the largest share of a found
template's distinct words that it holds.

Words are lower-cased (A to Z only) runs of digits, letters and characters
beyond ASCII. Base phrases, without foreign words, are searched besides.

Cases: a null or empty text has no words, no labels, score 0 and null places; a
text of any length is scanned whole; of words equally rare, the earlier in the
phrase goes first, which changes no result; repeated rows each get their
result, so do rows of a null key; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellstrata.llm.licence_texts import TEMPLATES

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Key phrases of at least so many words may have one foreign word between two words.
GAPPED = 8

#: Words, besides a quarter of the distance, by which a later key phrase may stand off.
SLACK = 8

#: Bytes that are not part of a word become blanks; the rest stay.
_BLANKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_BLANKS).split() if text else []


class Phrase:
    """A mandatory phrase: its words, its distance from the first one, and foreign words allowed between two of its own."""

    def __init__(self, ws: list[bytes], distance: int):
        self.words, self.distance, self.gap = ws, distance, int(len(ws) >= GAPPED)
        self.slack = SLACK + distance // 4

    def starts(self, ws: list[bytes], q: int, at: int) -> set[int]:
        """Places in ``ws`` where the phrase starts if its word ``q`` is the one at ``at``."""
        return self._walk(ws, at, range(q - 1, -1, -1), -1) if self._walk(ws, at, range(q + 1, len(self.words)), 1) else set()

    def _walk(self, ws: list[bytes], at: int, order: range, way: int) -> set[int]:
        reached = {at}
        for q in order:
            word = self.words[q]
            reached = {p for e in reached for d in range(1, self.gap + 2) if 0 <= (p := e + way * d) < len(ws) and ws[p] == word}
            if not reached:
                break
        return reached


class Template:
    def __init__(self, label: str, text: str):
        self.label, self.words, self.phrases = label, [], []
        for n, part in enumerate(re.split(r"[\[\]]", text)):
            if n % 2:
                self.phrases.append((len(self.words), words(part)))
            self.words += words(part)
        first = self.phrases[0][0]
        self.phrases = [Phrase(ws, at - first) for at, ws in self.phrases]
        self.distinct = frozenset(self.words)


def parsed() -> list[Template]:
    return [Template(*t) for t in TEMPLATES]


def document_frequency(documents: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many of them hold each template word (a table as small as the templates)."""
    vocabulary = frozenset(w for t in parsed() for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for value in batch.column(0):
                total += 1
                for w in vocabulary.intersection(words(value.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *[w.decode() for w in seen]], "n": [total, *seen.values()]})

    rows = documents.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


def _any(places: list[int], low: int, high: int) -> bool:
    """Whether one of the sorted ``places`` lies in ``low`` to ``high``."""
    n = bisect_left(places, low)
    return n < len(places) and places[n] <= high


class Index:
    """Postings of the ``rare`` highest-IDF words of every key phrase."""

    def __init__(self, total: int, frequency: dict[bytes, int], rare: int = 3):
        self.templates = parsed()
        self.idf = lambda w: math.log((1 + total) / (1 + frequency.get(w, 0)))
        self.phrases = [p for t in self.templates for p in t.phrases]
        self.rare = [self._rarest(p.words)[: max(1, rare)] for p in self.phrases]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for f, (phrase, places) in enumerate(zip(self.phrases, self.rare)):
            for q in places:
                self.postings.setdefault(phrase.words[q], []).append((f, q))
        self.base = [(phrase.encode().split(), label) for phrase, label in BASE.items()]
        self.anchors = [self._rarest(phrase)[0] for phrase, _ in self.base]
        for (phrase, _), q in zip(self.base, self.anchors):
            self.postings.setdefault(phrase[q], [])

    def _rarest(self, ws: list[bytes]) -> list[int]:
        return sorted(range(len(ws)), key=lambda q: (-self.idf(ws[q]), q))

    def _starts(self, f: int, ws: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
        """Sorted places at which phrase ``f`` starts: its rare words' places intersected by distance, then every word."""
        phrase, (q, *others) = self.phrases[f], self.rare[f]
        found: set[int] = set()
        for at in places[phrase.words[q]]:
            for other in others:
                near, far = other - q, (other - q) * (1 + phrase.gap)
                if not _any(places.get(phrase.words[other], []), at + min(near, far), at + max(near, far)):
                    break
            else:
                found |= phrase.starts(ws, q, at)
        return sorted(found)

    def scan(self, ws: list[bytes]) -> dict:
        """Labels, base places and score of one file."""
        places: dict[bytes, list[int]] = {}
        for p, w in enumerate(ws):
            if w in self.postings:
                places.setdefault(w, []).append(p)
        base = []
        for (phrase, label), q in zip(self.base, self.anchors):
            base += [(p - q, label) for p in places.get(phrase[q], ()) if p >= q and ws[p - q : p - q + len(phrase)] == phrase]
        starts: dict[int, list[int]] = {}
        for w in sorted(places, key=lambda w: (-self.idf(w), w)):
            for f, q in self.postings[w]:
                if q == self.rare[f][0]:
                    starts[f] = self._starts(f, ws, places)
        found: list[tuple[int, str, float]] = []
        held, f = None, 0
        for t in self.templates:
            at = [starts.get(f + i, []) for i in range(len(t.phrases))]
            f += len(t.phrases)
            if not all(at):
                continue
            begins = [s for s in at[0] if all(_any(a, s + p.distance - p.slack, s + p.distance + p.slack) for a, p in zip(at[1:], t.phrases[1:]))]
            if begins:
                held = frozenset(ws) if held is None else held
                score = len(t.distinct & held) / len(t.distinct)
                found += [(s, t.label, score) for s in begins]
        labels = {label for _, label in base}
        return {
            "n_words": len(ws),
            "n_base": len(base),
            "first_word": min((p for p, _ in base), default=None),
            "last_word": max((p for p, _ in base), default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {label for _, label, _ in found})),
            "score": max((s for _, _, s in found), default=0.0),
            "spans": [{"label": label, "start": p, "score": s} for p, label, s in sorted(found)],
        }


_FIELDS = (
    "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, "
    "spans: array<struct<label: string, start: long, score: double>>>"
)
_ARROW = pa.struct(
    [
        *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))),
    ]
)


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 3) -> DataFrame:
    """Labels, base places, score and spans of every document."""
    index = Index(*document_frequency(documents, text), rare)

    @F.arrow_udf(_FIELDS)
    def scanned(batch: pa.Array) -> pa.Array:
        return pa.array((index.scan(words(value.as_py())) for value in batch), _ARROW)

    return documents.select(key, scanned(F.col(text)).alias("found")).select(key, "found.*")


def op7_licences(documents: DataFrame) -> DataFrame:
    return scan(documents).drop("spans")
