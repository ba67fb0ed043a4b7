"""Texts cut into parts that are encoded once each.

The public pre-tokenising pattern lets a blank stand only in front of a run of letters, digits or other
signs, or in a run of white space.  So there is a cut before each blank that a non-blank follows, and a text's
ids are those of its parts, one after another.  A whole Arrow column is cut, its distinct parts are encoded,
and the ids of all rows are gathered by one `take`.  Nothing is kept from one column to the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?:\s|\Z)")
_WORD = r"^(?P<stem>\pL+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_LINES = r"^[^\s]*[!-~\pL]\n[!-~\pL][^\s]*$"


def cut(text: str) -> list[str]:
    """Parts of the text; all but the first begin with a blank.  ''.join(parts) is the text."""
    if not text:
        return []
    found = _CUT.split(text) if _RUN.search(text) else text.split(" ")
    parts = [" " + p for p in found]
    parts[0] = found[0]
    return parts if parts[0] else parts[1:]


class Parts:
    """Encodes texts to 32-bit ids by way of their parts.

    `split` gives the pre-tokens of a part; `solve` the id bytes of each of a list of distinct pre-tokens; `words`
    those of an array of distinct words of letters, with a blank in front of each or none.
    """

    def __init__(self, split: Callable[[str], list[str]], solve: Callable[[list[str]], list[bytes]],
                 words: Callable[[pa.Array, str], pa.Array] | None = None):
        self.split, self.solve = split, solve
        self.words = words or (lambda stems, blank: pa.array(solve([blank + x for x in stems.to_pylist()]), pa.large_binary()))
        self.line = pa.array(solve(["\n"]), pa.large_binary())

    def of(self, parts: list[str]) -> list[bytes]:
        """The id bytes of each part."""
        cut_up = [self.split(p) for p in parts]
        distinct = list(dict.fromkeys(t for tokens in cut_up for t in tokens))
        known = dict(zip(distinct, self.solve(distinct), strict=True))
        return [b"".join([known[t] for t in tokens]) for tokens in cut_up]

    def text(self, text: str) -> bytes:
        return b"".join(self.of(cut(text)))

    def _distinct(self, names: pa.Array, blank: str, lines: bool) -> pa.Array:
        coded = names.dictionary_encode()
        return self._values(coded.dictionary, blank, lines).take(coded.indices)

    def _values(self, names: pa.Array, blank: str, lines: bool = True) -> pa.Array:
        """The id bytes of distinct parts, given without the blank that they begin with.

        The pattern takes letters with a blank before them whole, signs behind them up to the part's end as one, and
        a line end between two characters that are no white space by itself; other parts are cut by the pattern."""
        word = pc.extract_regex(names, _WORD)
        simple = word.is_valid()
        stems, tails = (word.field(i).filter(simple).dictionary_encode() for i in (0, 1))
        none = pa.scalar(b"", pa.large_binary())
        signs = pa.array(self.of(tails.dictionary.to_pylist()), pa.large_binary())
        found = [pc.binary_join_element_wise(self.words(stems.dictionary, blank).take(stems.indices), signs.take(tails.indices), none)]
        kind = np.where(simple.to_numpy(zero_copy_only=False), 0, 2)
        if lines:
            kind[pc.match_substring_regex(names, _LINES).to_numpy(zero_copy_only=False) & (kind == 2)] = 1
            both = pc.split_pattern(names.filter(pa.array(kind == 1)), "\n").flatten()
            at = np.arange(0, len(both), 2)
            left, right = self._distinct(both.take(pa.array(at)), blank, False), self._distinct(both.take(pa.array(at + 1)), "", False)
            found.append(pc.binary_join_element_wise(left, right, self.line[0]))
        others = names.filter(pa.array(kind == 2)).to_pylist()
        found.append(pa.array(self.of([blank + x for x in others]), pa.large_binary()))
        at = np.empty(len(names), np.int64)
        at[np.argsort(kind, kind="stable")] = np.arange(len(names))
        return pa.concat_arrays(found).take(pa.array(at))

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column without nulls, one after another, and where each row's ids end."""
        rows = len(column)
        if not rows:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lists = pc.split_pattern(column, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        names, index, first = coded.dictionary, coded.indices.to_numpy().copy(), bounds[:-1]
        heads = names.take(pa.array(index[first])).dictionary_encode()
        # A blank in front of white space or the end is no cut: rows that have one are cut one by one.
        run = pc.or_(pc.equal(pc.binary_length(names), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(names, 0, 1)))
        run = run.to_numpy(zero_copy_only=False)[index]
        run[first] = False
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(run), side="right") - 1).tolist()
        led = np.ones(len(index), bool)
        led[first] = False
        for row in odd:
            led[bounds[row] : bounds[row + 1]] = False
        place = np.zeros(len(names), np.int32)
        used = np.zeros(len(names), bool)
        used[index[led]] = True
        at = np.flatnonzero(used)
        place[at] = np.arange(len(at), dtype=np.int32)
        values = [self._values(names.take(pa.array(at)), " "), self._values(heads.dictionary, ""),
                  pa.array([*[self.text(column[row].as_py()) for row in odd], b""], pa.large_binary())]
        total = sum(map(len, values))
        index = np.where(led, place[index], np.int32(total - 1))
        index[first] = len(at) + heads.indices.to_numpy()
        index[bounds[odd]] = total - 1 - len(odd) + np.arange(len(odd))
        taken = pa.concat_arrays(values).take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(index) + 1][bounds[1:]] // 4
        return np.frombuffer(taken.buffers()[2], np.uint32)[: ends[-1]] if ends[-1] else np.empty(0, np.uint32), ends
