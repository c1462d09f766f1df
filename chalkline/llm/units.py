"""Cutting texts where no token can lie across, so that each distinct piece is encoded once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space apart from the blank and the newline.
_OTHER = "[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_OTHER_SPACE = re.compile(_OTHER)
#: Texts that split(" ") does not cut rightly, for RE2.
_ODD = r"\A\z|[ \n][ \n]|\A[ \n]|[ \n]\z|" + _OTHER
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MARKS = ".,;:!?#$%&*|\"()[]"
LITERAL = "\0"


def units(text: str) -> list[str]:
    """Keys of the units of a text, whose own encodings concatenate to that of the text.

    A blank or newline between two characters that are no white space starts a
    new piece of the tokenizer's pattern. Keys: LITERAL + text, "\\n" + text,
    or text that a blank precedes. Texts with other white space, or with runs
    of it, are cut where the neighbours allow it.
    """
    if not text:
        return []
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _OTHER_SPACE.search(text):
        return [LITERAL + x for x in _CUT.split(text)]
    out = text.replace("\n", " \n").split(" ")
    out[0] = LITERAL + out[0]
    return out


def unit_array(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The units of all texts, one after another, and how many there are up to the end of each text."""
    odd = pc.match_substring_regex(texts, _ODD)
    cut = pc.split_pattern(pc.binary_join_element_wise(LITERAL, pc.replace_substring(texts, "\n", " \n"), ""), " ")
    keys, stops = cut.values, cut.offsets.to_numpy()
    parts, counts, at = [], np.diff(stops), 0
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        own = units(texts[i].as_py())
        parts += [keys[stops[at] : stops[i]], pa.array(own, pa.string())]
        counts[i], at = len(own), i + 1
    return pa.concat_arrays([*parts, keys[stops[at] : stops[-1]]]), np.cumsum(counts, dtype=np.int64)


def unit_text(key: str) -> str:
    return key[1:] if key[0] == LITERAL else key if key[0] == "\n" else " " + key
