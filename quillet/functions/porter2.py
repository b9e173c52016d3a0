"""The English (Porter2) stemmer, from its published description (snowballstem.org/algorithms/english)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
DONE_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def regions(w: str) -> tuple[int, int]:
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    after = lambda at: (m.end() if (m := re.compile(r"[aeiouy][^aeiouy]").search(w, at)) else len(w))
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = regions(w)
    for end in ("'s'", "'s", "'"):  # step 0
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in DONE_AFTER_1A:
        return w.lower()
    # step 1b
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # step 2: the longest ending, if in R1
    for end, new in sorted([*STEP2, ("ogi", "og"), ("li", "")], key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] and w[-3] in "cdeghkmnrt"):
                w = w[: -len(end)] + new
            break
    # step 3
    for end, new in sorted([*STEP3, ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    # step 4
    for end in sorted([*STEP4, "ion"], key=lambda x: -len(x)):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    # step 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem_column(term: Column | str) -> Column:
    """Stems in Arrow batches; meant for distinct terms. Said to be non-deterministic, else a condition on stems is moved below what makes terms distinct, and each token is stemmed."""

    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(stem, na_action="ignore")

    return run.asNondeterministic()(term)
