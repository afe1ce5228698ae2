"""English stems by the published Porter2 rules."""

from __future__ import annotations

import re

# Fixed values of the published algorithm: exceptions and endings.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FIXED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
#: Words that carry no meaning in a search.
STOP_WORDS = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else (m.end() if (m := re.search(r"[aeiouy][^aeiouy]", w)) else len(w))
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    w = word.lower().lstrip("'")
    if len(w) <= 2 or w in _FIXED:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search(r"(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search(r"(us|ss)$", w) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if re.search(r"(at|bl|iz)$", w):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if len(w) > 2 and re.search(r"[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in set("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], r1))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
