"""Filter predicates of the register, as Columns.

``not_in`` drops rows whose value is null, as SQL's NOT IN does; ``differs``
keeps them, as IS DISTINCT FROM does.  Pages use the first, the facet counts of
the register's server use the second; both are needed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Trimmed, with single spaces, in lower case."""
    return F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", " "))


def not_in(c: str | Column, values: Sequence) -> Column:
    return ~col(c).isin(*values)


def differs(c: str | Column, value) -> Column:
    return ~col(c).eqNullSafe(F.lit(value))


def null_or_in(c: str | Column, values: Sequence) -> Column:
    """Unresolved is not foreign: null passes."""
    return col(c).isNull() | col(c).isin(*values)


def search(columns: Sequence[str], term: str) -> Column:
    """Any column holds the term in any case; spaces are collapsed, quotes and backslashes dropped, % and _ stay wildcards."""
    clean = " ".join(term.replace('"', "").replace("\\", "").split())
    return reduce(or_, [F.col(c).ilike(f"%{clean}%") for c in columns])


def loosely_equal(c: str | Column, value: str) -> Column:
    """Equal but for case and spacing of the value; wildcards in it are literal."""
    clean = " ".join(value.split())
    escaped = clean.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col(c).ilike(escaped)


def folded_in(c: str | Column, values: Sequence[str]) -> Column:
    return fold(c).isin(*{" ".join(v.split()).lower() for v in values})


def recent_or_undated(c: str | Column, cutoff) -> Column:
    return col(c).isNull() | (col(c) >= F.lit(cutoff))


# Fixed value: punctuation that may stand inside a word without making it another.
INTRA_WORD = "[-\u2010-\u2015_'\u2018\u2019./]"


def fold_punctuation(c: str | Column) -> Column:
    """Without the punctuation that stands inside words ('theme-park' and "O'Hare" as one word)."""
    return F.regexp_replace(col(c), INTRA_WORD, "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_word(c: str | Column, words: Sequence[str], folded_text: Column | None = None) -> Column:
    """Whether one of the words stands alone in the text, in any case, as written or with punctuation folded on both sides.

    ``folded_text`` is the text with its punctuation folded, where that is there already.
    """
    plain = fold_punctuation(c) if folded_text is None else folded_text

    def pattern(found: Sequence[str]) -> str:
        return r"(?i)\b(?:" + "|".join(re.escape(w) for w in found) + r")\b"

    folded = [f for w in words if (f := re.sub(INTRA_WORD, "", w))]
    return col(c).rlike(pattern(words)) | (plain.rlike(pattern(folded)) if folded else F.lit(False))


def whole_word(c: str | Column, word: str) -> Column:
    """The word stands alone in the text, in any case."""
    return any_word(c, [word])


def word_hits(c: str | Column, words: Sequence[str]) -> Column:
    """The listed words that the text holds, in list order."""
    found = lambda t: F.array_compact(F.array(*[F.when(any_word(t["text"], [w], t["folded"]), F.lit(w)) for w in words]))
    return let(F.struct(col(c).alias("text"), fold_punctuation(c).alias("folded")), found)


def as_written(c: str | Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in the text exactly as written but for case; null for a null text.

    Only ASCII letters, digits and the underscore make a word longer, and a
    long s is an s, a Kelvin sign a k: what RE2 means by ``(?i)\\b(...)\\b``.
    """
    told = "|".join(re.sub("[skSK]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0].lower()], re.escape(w)) for w in words)
    end = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    return col(c).rlike(f"(?i){end}(?:{told}){end}")


@dataclass
class RecordQuery:
    """A flat, declarative filter; ``Column`` by ``compile``.  None leaves an axis open, ``NULL`` asks for nulls."""

    equal: dict[str, object] = field(default_factory=dict)
    among: dict[str, Sequence] = field(default_factory=dict)
    without: dict[str, Sequence] = field(default_factory=dict)
    least: dict[str, object] = field(default_factory=dict)
    most: dict[str, object] = field(default_factory=dict)
    before: dict[str, object] = field(default_factory=dict)
    nulls: Sequence[str] = ()
    loose: dict[str, str] = field(default_factory=dict)
    term: str | None = None
    term_columns: Sequence[str] = ()

    def predicates(self) -> dict[str, list[Column]]:
        """Predicates by the axis they filter."""
        out: dict[str, list[Column]] = {}
        add = lambda c, p: out.setdefault(c, []).append(p)
        for c, v in self.equal.items():
            add(c, F.col(c) == F.lit(v))
        for c, v in self.among.items():
            add(c, F.col(c).isin(*v))
        for c, v in self.without.items():
            add(c, not_in(c, v))
        for c, v in self.least.items():
            add(c, F.col(c) >= F.lit(v))
        for c, v in self.most.items():
            add(c, F.col(c) <= F.lit(v))
        for c, v in self.before.items():
            add(c, F.col(c) < F.lit(v))
        for c in self.nulls:
            add(c, F.col(c).isNull())
        for c, v in self.loose.items():
            add(c, loosely_equal(c, v))
        if self.term:
            add("", search(self.term_columns, self.term))
        return out

    def compile(self, skip: str | None = None) -> Column:
        """All predicates together, without those of the axis ``skip``."""
        found = [p for axis, ps in self.predicates().items() if axis != skip for p in ps]
        return reduce(and_, found) if found else F.lit(True)
