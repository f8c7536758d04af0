"""Speech levels by marker words, of texts with and without spaces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels in the order in which markers are looked for; in the order in which ties are settled; and the least length of a marker in a text without spaces.
SEARCHED, TIES, LONG = ("krama", "madya", "ngoko"), ("ngoko", "madya", "krama"), 5
# fixed values: the affixes of krama, the least length of a word that has one, and the letters that lose their marks
SUFFIX, PREFIX, AFFIXED = "ipun", "dipun", 6
PLAIN = str.maketrans("éèêëôâāīū", "eeeeoaaiu")
SCHEMA = "key string, ngoko long, madya long, krama long, level string, confidence string, spaced boolean, evidence array<string>"


class Markers:
    """Marker words by level, and an automaton that finds the long ones in one pass over a text."""

    def __init__(self, markers: list[tuple[str, str]]):
        import ahocorasick

        self.level: dict[str, str] = {}
        for level in SEARCHED:  # a word of two levels belongs to the first searched
            for word, own in markers:
                if own == level:
                    self.level.setdefault(word, level)
        self.long = [w for level in SEARCHED for w, own in markers if own == level and len(w) >= LONG]
        self.long = list(dict.fromkeys(self.long))
        self.found = ahocorasick.Automaton()
        for rank, w in enumerate([*self.long, SUFFIX]):
            if w not in self.found:
                self.found.add_word(w, (rank, w))
        self.found.make_automaton()

    def in_words(self, words: list[str]) -> list[tuple[str, str]]:
        out = []
        for w in words:
            level = self.level.get(w) or ("krama" if len(w) >= AFFIXED and (w.endswith(SUFFIX) or w.startswith(PREFIX)) else None)
            if level:
                out.append((w, level))
        return out

    def in_run(self, letters: str) -> list[tuple[str, str]]:
        """Markers in letters without spaces: earlier ranks take their places first, from the left; what they took is gone for later ones."""
        taken = bytearray(len(letters))
        out = []
        for rank, start, w in sorted((rank, end - len(w) + 1, w) for end, (rank, w) in self.found.iter(letters)):
            if not any(taken[start : start + len(w)]):
                taken[start : start + len(w)] = b"\x01" * len(w)
                out.append(("-" + w, "krama") if rank == len(self.long) else (w, self.level[w]))
        return out


def decide(n: dict[str, int]) -> str | None:
    """Null without markers; mixed where ngoko and the polite levels have two each and the lesser a quarter; else the most frequent."""
    polite, total = n["krama"] + n["madya"], sum(n.values())
    if not total:
        return None
    if min(n["ngoko"], polite) >= 2 and 4 * min(n["ngoko"], polite) >= total:
        return "campur"
    return max(TIES, key=lambda level: n[level])


def judged(text: str | None, markers: Markers) -> tuple:
    """(ngoko, madya, krama, level, confidence, spaced, evidence) of one text; null is empty."""
    own = unicodedata.normalize("NFC", text or "").lower().translate(PLAIN)
    words = re.findall("[a-z]+", own)
    spaced = len(words) > 1 and " " in (text or "").strip()
    evidence = markers.in_words(words) if spaced else markers.in_run("".join(words))
    n = {level: sum(own == level for _, own in evidence) for level in TIES}
    return *(n[x] for x in TIES), decide(n), "cukup" if spaced and len(evidence) >= 3 else "rendah", spaced, [w for w, _ in evidence]


def speech_levels(texts: DataFrame, key: str, text: str, markers: list[tuple[str, str]]) -> DataFrame:
    """(key, counts, level, confidence, spaced, evidence) of every text, by (word, level) markers.

    Texts with spaces are judged word by word, with the affixes of krama; texts without by markers of LONG letters or more, and their
    confidence is always low. Texts travel in Arrow batches; the markers are a small list that goes with the tasks.
    """
    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in TIES], ("level", pa.string()), ("confidence", pa.string()), ("spaced", pa.bool_()), ("evidence", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Markers(markers)
        for batch in batches:
            rows = [(k, *judged(t, known)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return texts.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
