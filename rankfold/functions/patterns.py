"""Search for many words at once: an automaton that reads a text a single time.

Only word tables of a checked size are sent to the tasks; ``operators.matching``
and ``operators.rule_tables`` have a join for larger ones.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark import cloudpickle

SUBSTRING, WORD, EXACT = "substring", "word", "exact"
_GLUED = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Words:
    """Automaton over distinct non-empty words; built where it is first used."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words) - {""})
        self._automaton = None

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.words, self._automaton = words, None

    @property
    def automaton(self):
        if self._automaton is None and self.words:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, word in enumerate(self.words):
                self._automaton.add_word(word, i)
            self._automaton.make_automaton()
        return self._automaton

    def any_in(self, text: str) -> bool:
        return bool(self.words) and next(self.automaton.iter(text), None) is not None

    def found_in(self, text: str) -> dict[int, bool]:
        """Numbers of the words in a text, and whether one stands apart from letters and digits."""
        found: dict[int, bool] = {}
        if not self.words or not text:
            return found
        for last, i in self.automaton.iter(text):
            if not found.get(i, False):
                first = last - len(self.words[i])
                found[i] = not (first >= 0 and text[first] in _GLUED) and not (last + 1 < len(text) and text[last + 1] in _GLUED)
        return found


class RuleWords:
    """Inverted index: which rules a word speaks for or against, by field of the text.

    Entries are (field, word, mode, cancels, rule); a rule is hit where a word of its
    own is found and no word that cancels it.
    """

    def __init__(self, entries: Iterable[tuple[str, str, str, bool, int]], fields: Sequence[str]):
        self.fields = list(fields)
        by_field: dict[str, dict[str, list]] = {f: defaultdict(list) for f in fields}
        for field, word, mode, cancels, rule in entries:
            by_field[field][word].append((mode, cancels, rule))
        self.words = {f: Words(by_field[f]) for f in fields}
        self.entries = {f: [by_field[f][w] for w in self.words[f].words] for f in fields}

    def rules_of(self, texts: Sequence[str]) -> list[int]:
        """Numbers of the rules that the texts of one row, one per field, hit."""
        hit, cancelled = set(), set()
        for field, text in zip(self.fields, texts):
            words = self.words[field]
            for i, apart in words.found_in(text or "").items():
                for mode, cancels, rule in self.entries[field][i]:
                    if mode == SUBSTRING or (apart if mode == WORD else text == words.words[i]):
                        (cancelled if cancels else hit).add(rule)
        return sorted(hit - cancelled)


# Ship this module's classes with the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
