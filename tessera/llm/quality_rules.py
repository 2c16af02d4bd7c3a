"""Line-first quality rules.

Each line is judged on its own: navigation (menus of short parts), boilerplate (notices
that sites repeat, in the corpus's four languages) and punctuation (no letters; most words
end in runs of signs; or a line of a few words that no closing mark ends, as headings,
buttons and link lists are). Failing lines are removed; a document that loses more than
half of its word characters that way is rejected, as is one that fails the base rules
(too short, or mostly repeated windows).

Null texts are empty: no words, so the base rules fail. Repeated rows are judged alone,
each with the same result. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, strings

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.5
#: Parts that separate a menu's entries, and notices that sites repeat.
SEPARATORS = re.compile(r"\s[|»›·•]\s")
NOTICES = [
    "all rights reserved", "terms of (?:use|service)", "privacy policy", "(?:accept|uses?|use of)(?: all)? cookies", "cookie (?:policy|settings)", "subscribe to our", "sign (?:up|in) (?:for|to) (?:our|your)",
    "click here", "skip to (?:main )?content", "powered by", "lorem ipsum", "javascript (?:is|must be)", "share (?:this|on)", "read more", "back to top",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz(?:erklärung|richtlinie)", "(?:verwendet|akzeptieren|verwendung von)(?: alle)? cookies", "newsletter (?:abonnieren|anmelden)", "hier klicken", "klicken sie hier",
    "zum inhalt springen", "weiterlesen", "impressum", "nach oben",
    "tous droits réservés", "conditions d['’]utilisation", "politique de confidentialité", "(?:utilise|accepter|utilisation de)(?: tous les| des)? cookies", "(?:abonnez|inscrivez)-vous", "cliquez ici", "aller au contenu", "lire la suite",
    "mentions légales", "haut de page",
    "todos los derechos reservados", "términos (?:de uso|y condiciones)", "política de privacidad", "(?:utiliza|aceptar|uso de)(?: todas las)? cookies", "suscríb(?:ete|ase)", "haga? cli[ck]+ aquí", "(?:ir|saltar) al contenido", "leer más",
    "aviso legal", "volver arriba",
]
BOILERPLATE = re.compile("|".join(NOTICES), re.I)
#: What may close a line: marks, closing quotes and brackets.
CLOSING = ".!?…:;。！？\"'”’»)]"
#: Words up to which a line must end in a closing mark; longer ones may be cut text.
SHORT_LINE = 8
SYMBOL = re.compile(r"[#*$%&|<>]")
#: A word that ends in a run of signs of which at least two are no marks of a sentence.
GLUED = re.compile(r"\w(?:[.,]?[#*$%&!<>=~^]{2,})(?=\s|$)")
LETTER = re.compile(r"[^\W\d_]")
SPACES = dict.fromkeys([0x20, *range(0x09, 0x0E)])


def line_fails(line: str, words: int) -> str:
    """The rule that a line with words fails, or ''."""
    if len(SEPARATORS.findall(line)) >= 3 and words <= 8 * (len(SEPARATORS.findall(line)) + 1):
        return "navigation"
    if words <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    if not LETTER.search(line) or 2 * len(GLUED.findall(line)) > words or (words <= SHORT_LINE and line.rstrip()[-1] not in CLOSING):
        return "punctuation"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    key = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:  # so that three numbers always fit 63 bits
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, float, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost share, cleaned text."""
    words = text.encode().split()  # bytes.split knows just the six ASCII spaces
    n = len(words)
    word_chars = len(text.translate(SPACES))
    lines, seen, dup, lost, left = text.split("\n"), set(), 0, 0, []
    for line in lines:
        count = len(line.encode().split())
        if count:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, count):
                lost += len(line.translate(SPACES))
                continue
        left.append(line)
    repeat = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    share = lost / word_chars if word_chars else 0.0
    return n, word_chars, len(SYMBOL.findall(text)), dup, repeat, failed, not failed and share <= MAX_LOST, share, "\n".join(left)


def clean(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text", cleaned: bool = True) -> DataFrame:
    """`keep`, the counts, base_failed, kept, lost_share and, if asked, cleaned_text: all lines that pass."""
    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_share double"
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.string()] * cleaned

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [judge(t) for t in strings(batch, text)]
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return work

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), make, schema + ", cleaned_text string" * cleaned, list(keep))
