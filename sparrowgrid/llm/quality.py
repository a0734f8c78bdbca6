"""Line-first quality rules.

Every line is judged on its own by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too large a share of
its words is rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowgrid.llm.common import bounded

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
# Phrases and words that mark boilerplate and navigation lines, in the languages of the corpus.
BOILERPLATE = (
    "all rights reserved", "licensed under", "license, version", "terms of service", "terms of use", "terms and conditions", "privacy policy",
    "cookie policy", "uses cookies", "use of cookies", "accept cookies", "subscribe to our", "sign up for our", "enable javascript",
    "copyright ©", "© copyright", "powered by", "click here to", "distributed under the",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies",
    "abonnez-vous à", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "verwendet cookies",
    "newsletter abonnieren", "klicken sie hier",
    "todos los derechos reservados", "política de privacidad", "términos y condiciones", "condiciones de uso", "utiliza cookies",
    "suscríbete a", "haga clic aquí",
)
NAVIGATION = {
    "home", "menu", "next", "previous", "prev", "login", "logout", "register", "search", "share", "contact", "about",
    "sitemap", "back", "top", "more", "skip", "print", "tweet", "comments",
    "accueil", "suivant", "précédent", "connexion", "déconnexion", "inscription", "rechercher", "partager", "retour", "imprimer", "commentaires",
    "startseite", "weiter", "zurück", "anmelden", "abmelden", "registrieren", "suche", "teilen", "kontakt", "drucken", "kommentare", "impressum",
    "inicio", "menú", "siguiente", "anterior", "entrar", "salir", "registrarse", "buscar", "compartir", "contacto", "volver", "imprimir", "comentarios",
}
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SYMBOLS = re.compile("[" + re.escape(SYMBOLS) + "]")
_ENDS = tuple(".!?…:;\"'”’»)]。！？؟۔।॥")


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Share of a line's words that may hold a symbol, or end in two exclamation marks.
    max_noisy: float = 0.3
    #: Lines of at least so many words must hold a word that ends in punctuation.
    prose_words: int = 12
    #: Share of navigation words, and separators, that make a line navigation.
    navigation: float = 0.5
    separators: int = 2
    #: A document that loses more than this share of its words goes.
    max_lost: float = 0.4


def has_end(line: str) -> bool:
    """Whether a word of the line ends in punctuation that closes something."""
    return any(w.endswith(_ENDS) for w in WORD.findall(line))


def line_fault(line: str, rules: Rules = Rules(), wrapped: bool = False) -> str | None:
    """The first rule the line fails: navigation, punctuation or boilerplate; None for good and for empty lines.

    ``wrapped`` lines are parts of a paragraph whose neighbouring line closes a
    sentence, and need not close one themselves.
    """
    words = WORD.findall(line)
    n = len(words)
    if not n:
        return None
    bars = sum(w in ("|", "»", "›", "•", "·", ">", "/") for w in words)
    if bars >= rules.separators and 4 * bars >= n:
        return "navigation"
    if n <= 12 and sum(w.strip(".,:").lower() in NAVIGATION for w in words) >= max(1, rules.navigation * n):
        return "navigation"
    noisy = sum(1 for w in words if w.endswith("!!")) if "!!" in line else 0
    if _SYMBOLS.search(line):
        noisy += sum(1 for w in words if _SYMBOLS.search(w))
    if noisy > rules.max_noisy * n:
        return "punctuation"
    if n >= rules.prose_words and not wrapped and not any(w.endswith(_ENDS) for w in words):
        return "punctuation"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return 0
    size = len(codes)
    pairs = ids[:-2] * size + ids[1:-1]
    if size < 1_000_000:
        windows = pairs * size + ids[2:]
    else:  # the product could overflow: number the pairs first
        windows = np.unique(pairs, return_inverse=True)[1].astype(np.int64) * size + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, cleaned)."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = text.split("\n")
    with_words = [line for line in lines if WORD.search(line)]
    n_dup = len(with_words) - len(set(with_words))
    n_repeat = repeated_words(words)
    base_failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
    good, lost, kinds = [], 0, Counter()
    for k, line in enumerate(lines):
        fault = line_fault(line, rules)
        if fault == "punctuation" and any(has_end(x) for x in (*lines[max(0, k - 1) : k], *lines[k + 1 : k + 2])):
            fault = line_fault(line, rules, wrapped=True)
        if fault:
            kinds[fault] += 1
            lost += len(WORD.findall(line))
        else:
            good.append(line)
    kept = not base_failed and lost <= rules.max_lost * n
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, kept, lost,
        kinds["punctuation"], kinds["navigation"], kinds["boilerplate"], "\n".join(good),
    )


FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("lost_words", T.LongType()), ("bad_punctuation", T.LongType()), ("bad_navigation", T.LongType()),
    ("bad_boilerplate", T.LongType()), ("cleaned", T.StringType()),
)


def quality(df: DataFrame, text: str = "text", rules: Rules = Rules(), cleaned: bool = True) -> DataFrame:
    """``df`` with the verdict's columns (``FIELDS``) added; every row stays.

    A null text counts as empty: no words, so the base rules fail.  Repeated
    rows are judged alike and all stay.  Columns of ``df`` that are called like
    an output are replaced.  ``cleaned=False`` leaves the cleaned text out.
    """
    fields = FIELDS if cleaned else FIELDS[:-1]
    keep = [c for c in df.columns if c not in {name for name, _ in fields}]
    if text not in keep:
        raise ValueError(f"the text column may not be called {text!r}")
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in fields)])
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for part in bounded(batches, text):
            rows = [judge(x, rules) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            made = [pa.array(c, arrow[t.simpleString()]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*keep, *(n for n, _ in fields)])

    return df.select(*keep).mapInArrow(run, schema)


def filter_documents(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, with failing lines taken out of ``text`` and ``n_chars`` brought up to date."""
    out = quality(df, "text", rules).where("kept")
    replaced = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*(replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns))
