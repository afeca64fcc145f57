"""Vocabulary of the engine: labels, leans, token codes, error codes, thresholds. NULL means not measured."""

from __future__ import annotations

import math
import re

#: Labels, leans and decision constants.
EXTRACT, DO_NOT_EXTRACT, REVIEW = "EXTRACT-CANDIDATE", "DO-NOT-EXTRACT", "REVIEW"
TOWARD_EXTRACT, TOWARD_DO_NOT, NEITHER = "toward-extract", "toward-do-not-extract", "neither"
SAME, SEPARATE, UNDECIDABLE = "same", "separate", "undecidable"
STRUCTURAL, IMPORTS, DISTANCE = "structural_similarity", "import_overlap", "module_distance"
STRUCTURAL_THRESHOLD, SHARED_IMPORTS, DISTANT_STEPS, PAIR_CAP = 0.85, 0.5, 2, 200_000

#: Reserved words that a token keeps; all other words are identifiers.
KEYWORDS = (
    "as async await break case catch class const continue debugger default delete do else enum export extends false finally for"
    " function if implements import in instanceof interface let new null of package private protected public readonly return"
    " static super switch this throw true try typeof var void while with yield"
).split()

#: A control word first in a line tells a block from a function.
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "do", "else")
#: Folders that aren't searched, and what a source file's name ends with.
PRUNED, SOURCES = ("node_modules", ".git", "dist", "build"), (".ts", ".tsx")

MISSING_SEPARATOR, EMPTY_PATH, NOT_A_NUMBER, ZERO, OUT_OF_RANGE = "MissingSeparator", "EmptyPath", "NotANumber", "Zero", "OutOfRange"
LINE_BEYOND, NO_FUNCTION, UNPARSABLE = "LineBeyondSource", "NoEnclosingFunction", "UnparsableFunction"
UNREADABLE, SOURCE_UNPARSABLE, CHUNKING_FAILED = "SourceUnreadable", "SourceUnparsable", "ChunkingFailed"

FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.I)


def threshold(value: float | str) -> float:
    """A number from 0 to 1, of a number or its text."""
    if isinstance(value, str):
        if not FLOAT.fullmatch(value):
            raise ValueError(f"{NOT_A_NUMBER}: {value}")
        value = float(value)
    if math.isnan(value) or not 0.0 <= value <= 1.0:
        raise ValueError(f"{OUT_OF_RANGE}: {value}")
    return float(value)


def shown(value: float) -> str:
    """A threshold as it was typed: without a fraction that is zero."""
    return repr(value).removesuffix(".0")
