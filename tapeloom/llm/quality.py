"""Line-first quality rules.

Every line is judged on its own: symbol noise, navigation, shouting, boilerplate phrases, repetition.
Failing lines are taken out; a document that loses too large a share of its words goes. Base figures
(word and repetition counts) come from the same pass over the whole text.

Null and empty texts have no words and are rejected by the base rule. Lines without a word are kept
as they are and count for nothing. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType

from tapeloom.llm.common import per_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
SHOUT = re.compile(r"!!")
#: Phrases of page furniture; a short line that holds one fails.
BOILERPLATE = re.compile(
    r"lorem ipsum|enable javascript|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|"
    r"click here|sign up|log ?in|read more|share this|subscribe (?:now|to)|skip to (?:main )?content", re.I)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: symbols per word from which a line is noise
    line_symbols: float = 0.3
    #: share of words that are separators from which a line is navigation
    line_separators: float = 0.2
    #: share of words that end in a doubled exclamation mark
    line_shouts: float = 0.5
    #: share of the commonest word in a line of at least ``line_long`` words
    line_one_word: float = 0.5
    line_long: int = 10
    #: words of a line up to which a boilerplate phrase fails it
    boilerplate_words: int = 12
    #: share of the words that may be lost
    max_lost: float = 0.5


def line_fails(line: str, words: list[str], rules: Rules) -> bool:
    """Whether one line with words is furniture or noise."""
    n = len(words)
    if len(SYMBOL.findall(line)) > rules.line_symbols * n:
        return True
    if sum(w in ("|", "»", "›", "·", "•", ">") for w in words) > rules.line_separators * n:
        return True
    if line.count("!!") > rules.line_shouts * n:
        return True
    if n <= rules.boilerplate_words and BOILERPLATE.search(line):
        return True
    return n >= rules.line_long and max(Counter(words).values()) > rules.line_one_word * n


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(text: str, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines failed, cleaned text)."""
    words = WORD.findall(text)
    n = len(words)
    repeats = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    seen: set[str] = set()
    dups = failed = lost = 0
    kept_lines = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                dups += 1
            seen.add(line)
            if line_fails(line, own, rules):
                failed += 1
                lost += len(own)
                continue
        kept_lines.append(line)
    kept = not base_failed and lost <= rules.max_lost * n
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dups, repeats, base_failed, kept, failed, "\n".join(kept_lines)


def quality(df: DataFrame, carry: list[str] | None = None, text_col: str = "text", rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """Carried columns (``doc_id``), the figures, the verdict and, if asked for, the cleaned text."""

    def make():
        width = 9 if with_text else 8
        return lambda text: judge(text, rules)[:width]

    longs = [(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    outputs = longs + [("base_failed", BooleanType()), ("kept", BooleanType()), ("n_failed_lines", LongType())]
    return per_row(df, text_col, carry or ["doc_id"], make, outputs + [("cleaned", StringType())] * with_text)
