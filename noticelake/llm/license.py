"""License scans by template markup.

A template is wording in which `<<beginOptional>>...<<endOptional>>` may be left out (also at its start, and nested) and
`<<var;words=a-b>>` stands for a to b words of any kind. It is compiled into token automata that accept word sequences whose
mandatory wording matches exactly. Texts are lower-cased (A-Z) and cut into words of 0-9, a-z and non-ASCII characters.
Templates are files in `templates/`: whole texts of short licenses and of one long one, and the notices by which files name
long ones; a text with the opening of a license and other wording after it does not match.

Nulls: a null text is empty: no words, no labels, score 0. Repeated rows are scanned each; a null doc_id stays null. An
empty table gives an empty result; extra columns are ignored. Very long texts are worked through whole, in one pass.
"""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, batch_of

# Phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

FOLDER = Path(__file__).parent / "templates"


#: How a license is told: its text, its notice, a line that names it.
FORMS = re.compile("-(?:text|notice|line)$")


def license_of(name: str) -> str:
    """The license of a template: its name without the form."""
    return FORMS.sub("", name)


def read_templates(folder: str | Path = FOLDER) -> dict[str, str]:
    """Markup by label from a folder's .txt files, read on the driver. A file's name is the label."""
    return {f.stem: f.read_text() for f in sorted(Path(folder).glob("*.txt"))}


def as_template(text: str) -> str:
    """A plain license text as markup: what numbers or bullets a line may be left out, and so may a copyright line."""
    out = []
    for line in text.split("\n"):
        line = re.sub(r"^(\s*)(\(?[0-9a-z]{1,2}[.)])(?=\s)", r"\1<<beginOptional>>\2<<endOptional>>", line)
        out.append(f"<<beginOptional>>{line}<<endOptional>>" if re.match(r"\s*copyright\b.*[0-9]{4}", line, re.I) else line)
    return "\n".join(out)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<struct<label:string,start:bigint,stop:bigint>>"
#: Stands for a word of any kind (None, as that is the same object in every process).
ANY = None


def parsed(label: str, markup: str) -> list[tuple]:
    """Elements in order: ("word", w), ("any", least, most) and ("maybe", elements); optional regions may hold others."""
    stack: list[list[tuple]] = [[]]
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            if len(stack) < 2:
                raise ValueError(f"template {label}: an optional region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif found := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", part):
            stack[-1].append(("any", int(found[1]), int(found[2])))
        else:
            stack[-1] += [("word", w) for w in WORD.findall(part.lower())]
    if len(stack) > 1:
        raise ValueError(f"template {label}: an optional region does not end")
    return stack[0]


def turned(elements: list[tuple]) -> list[tuple]:
    return [("maybe", turned(e[1])) if e[0] == "maybe" else e for e in reversed(elements)]


class Machine:
    """A token automaton: states 0..end; step[s] has (word or ANY, next); skip[s] has states reached without a word."""

    def __init__(self, elements: list[tuple]):
        self.step: dict[int, list[tuple[object, int]]] = defaultdict(list)
        self.skip: dict[int, list[int]] = defaultdict(list)
        self.end = self.add(elements, 0)

    def add(self, elements: list[tuple], state: int) -> int:
        for e in elements:
            if e[0] == "word":
                self.step[state].append((e[1], state + 1))
                state += 1
            elif e[0] == "maybe":
                after = self.add(e[1], state)
                self.skip[state].append(after)
                state = after
            else:
                ends = []
                for k in range(e[2]):
                    if k >= e[1]:
                        ends.append(state)
                    self.step[state].append((ANY, state + 1))
                    state += 1
                for s in ends:
                    self.skip[s].append(state)
        return state

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def longest(self, word_at, start: int, stop: int, by: int = 1) -> int | None:
        """Where the longest match that begins at `start` ends, going by 1 or -1 until `stop`; None if there is none."""
        states, found, at = self.closed({0}), None, start
        while states:
            if self.end in states:
                found = at
            if at == stop:
                break
            word = word_at(at)
            states = self.closed({t for s in states for w, t in self.step.get(s, ()) if w is ANY or w == word})
            at += by
        return found


class Automaton:
    """A template: automata of what follows its anchor, read forwards, and of what precedes it, read backwards.

    The anchor is a mandatory word, the longest of those that stand in the template least often. Any match has it, so texts are
    searched only where it stands; optional regions may come before and after.
    """

    def __init__(self, label: str, markup: str, base: bool = False):
        self.label, self.base = label, base
        elements = parsed(label, markup)
        words = [e[1] for e in elements if e[0] == "word"]
        if not words:
            raise ValueError(f"template {label}: no mandatory word")
        every = WORD.findall(re.sub(r"<<[^>]*>>", " ", markup.lower()))
        self.anchor_word = min(words, key=lambda w: (every.count(w), -len(w), words.index(w)))
        at = elements.index(("word", self.anchor_word))
        self.after, self.before = Machine(elements[at + 1 :]), Machine(turned(elements[:at]))

    def match(self, word_at, at: int, low: int, high: int) -> tuple[int, int] | None:
        """Begin and end of the longest match with its anchor at `at`, within low and high."""
        end = self.after.longest(word_at, at + 1, high)
        if end is None:
            return None
        begin = self.before.longest(word_at, at - 1, low - 1, -1)
        return None if begin is None else (begin + 1, end)


def compiled(templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> list[Automaton]:
    own = read_templates() if templates is None else templates
    return [Automaton(label, phrase, True) for phrase, label in (BASE if base is None else base).items()] + [Automaton(label, markup) for label, markup in own.items()]


def scanner(automata: list[Automaton]):
    by_anchor: dict[str, list[Automaton]] = defaultdict(list)
    for a in automata:
        by_anchor[a.anchor_word].append(a)
    anchors = pa.array(list(by_anchor), pa.string())
    lists = list(by_anchor.values())

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), WORD_TABLE)
        kind = pc.fill_null(pc.index_in(words.dictionary, value_set=anchors), -1).to_numpy(zero_copy_only=False)
        of_word = kind[words.ids] if len(kind) else np.zeros(0, np.int32)
        hits = np.flatnonzero(of_word >= 0)
        docs = np.searchsorted(words.offsets, hits, side="right") - 1
        word_at = lambda i: words.dictionary[int(words.ids[i])].as_py()
        places: dict[int, list[tuple[int, int, Automaton]]] = defaultdict(list)
        for at, doc in zip(hits.tolist(), docs.tolist()):
            low, high = int(words.offsets[doc]), int(words.offsets[doc + 1])
            for a in lists[of_word[at]]:
                if (found := a.match(word_at, at, low, high)) is not None:
                    places[doc].append((found[0] - low, found[1] - low, a))
        n = batch.num_rows
        counts = words.counts
        n_base, first, last, base_labels, labels, score, listed = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]
        for doc, found in places.items():
            starts = [s for s, _, a in found if a.base]
            n_base[doc] = len(starts)
            if starts:
                first[doc], last[doc] = min(starts), max(starts)
            base_labels[doc] = ",".join(sorted({a.label for _, _, a in found if a.base}))
            labels[doc] = ",".join(sorted({license_of(a.label) for _, _, a in found}))
            covered, reach = 0, 0
            for s, e, _ in sorted(found, key=lambda x: x[:2]):
                covered += max(0, e - max(s, reach))
                reach = max(reach, e)
            score[doc] = covered / int(counts[doc])
            listed[doc] = [{"label": a.label, "start": s, "stop": e} for s, e, a in sorted(found, key=lambda x: (x[0], x[1], x[2].label))]
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        return batch_of(
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            [batch.column("doc_id"), counts, pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(listed, kind)],
        )

    return scan


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """A row for each document: words, places of base phrases, labels (licenses), the share of words that matches cover, all places
    (with the templates' names)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(narrow, scanner(compiled(templates, base)), SCHEMA)
