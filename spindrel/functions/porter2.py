"""The English (Porter2) stemmer, after its published definition."""

from __future__ import annotations

import re

# Fixed values of the algorithm: exceptional forms, and those left alone after step 1a.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if r1 is None:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; one of at most two letters is its own."""
    word = word.replace("’", "'")
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub("'(?:s'?)?$", "", word)

    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in UNCHANGED:
        return word

    # 1b
    if word.endswith(("eedly", "eed")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end := next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None):
        rest = word[: -len(end)]
        if re.search("[aeiouy]", rest):
            word = rest
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif r1 >= len(word) and _SHORT.search(word):
                word += "e"

    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    # 2
    if found := next(((e, to) for e, to in STEP2 if word.endswith(e)), None):
        end, to = found
        at = len(word) - len(end)
        ok = {"ogi": word[at - 1 : at] == "l", "li": word[at - 1 : at] in tuple("cdeghkmnrt")}.get(end, True)
        if at >= r1 and ok:
            word = word[:at] + to

    # 3
    if found := next(((e, to) for e, to in STEP3 if word.endswith(e)), None):
        end, to = found
        at = len(word) - len(end)
        if at >= (r2 if end == "ative" else r1):
            word = word[:at] + to

    # 4
    if end := next((e for e in STEP4 if word.endswith(e)), None):
        at = len(word) - len(end)
        if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
            word = word[:at]

    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
