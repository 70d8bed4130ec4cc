"""Place names as Latin sound forms: scripts, spellings, level words. Shared by the name matchers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters of two Indic scripts in Latin. Vowel signs and letters, then consonants.
DEVANAGARI = dict(zip("अआइईउऊएऐओऔ", ["a", "a", "i", "i", "u", "u", "e", "ai", "o", "au"], strict=True)) | {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
DEVANAGARI_SIGNS = dict(zip("ािीुूेैोौृ", ["a", "i", "i", "u", "u", "e", "ai", "o", "au", "ri"], strict=True))
TAMIL = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔ", ["a", "a", "i", "i", "u", "u", "e", "e", "ai", "o", "o", "au"], strict=True)) | {
    "க": "k", "ங": "n", "ச": "ch", "ஞ": "n", "ட": "t", "ண": "n", "த": "t", "ந": "n", "ப": "p", "ம": "m",
    "ய": "y", "ர": "r", "ல": "l", "வ": "v", "ழ": "l", "ள": "l", "ற": "r", "ன": "n", "ஜ": "j", "ஷ": "sh", "ஸ": "s", "ஹ": "h",
}
TAMIL_SIGNS = dict(zip("ாிீுூெேைொோௌ", ["a", "i", "i", "u", "u", "e", "e", "ai", "o", "o", "au"], strict=True))
#: Words that say what kind of place a name is, by level.
LEVEL_WORDS = {
    "unit": "block blk blk. taluk taluka tahsil tehsil mandal firka subdivision watershed ब्लॉक तहसील तालुका मंडल खंड வட்டம் ஒன்றியம் மண்டலம்".split(),
    "district": "district dist dist. distt distt. zila zilla jila जिला ज़िला மாவட்டம்".split(),
    "state": "state rajya pradesh-state राज्य மாநிலம்".split(),
}
#: Words around a name that are no part of it.
ASIDES = "old new side area near region the of in purana naya पुराना नया क्षेत्र பழைய புதிய பகுதி".split()
_LEVEL = {w: level for level, words in LEVEL_WORDS.items() for w in words}
_LEETS = str.maketrans("03457", "oeast")


def _letters(text: str) -> str:
    out: list[str] = []
    open_a = False
    for c in "".join(c if "\u0900" <= c <= "\u0dff" else unicodedata.normalize("NFD", c) for c in unicodedata.normalize("NFC", text)):
        if c in DEVANAGARI_SIGNS or c in TAMIL_SIGNS:
            out.append(DEVANAGARI_SIGNS.get(c) or TAMIL_SIGNS[c])
            open_a = False
        elif c in "्்":
            open_a = False
        elif c in "ंँ":
            out.append(("a" if open_a else "") + "n")
            open_a = False
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Cf"):
            continue
        else:
            if open_a:
                out.append("a")
            latin = DEVANAGARI.get(c) or TAMIL.get(c)
            open_a = bool(latin) and latin[-1] not in "aeiou"
            out.append(latin or c)
    final = open_a and out and "".join(out[-2:]).isascii() and any("஀" <= c <= "௿" for c in text)
    return "".join(out) + ("a" if final else "")


@lru_cache(1 << 16)
def latin(text: str) -> str:
    """Lower-case Latin words of a name in any of the scripts, without marks and signs."""
    text = unicodedata.normalize("NFKC", text)
    words = []
    for w in re.split(r"[\s/|]+", text):
        w = _letters(w).lower()
        if re.search(r"[a-z]", w):
            w = re.sub(r"1+", lambda m: "l" if m.group() == "1" and m.start() and w[m.start() - 1] in "aeiou" and w[m.end() : m.end() + 1] not in ("", *"bcdfghjkmnpqrstvwxz") else "lli" if len(m.group()) == 3 else "li" if len(m.group()) == 2 else "i", w).translate(_LEETS)
        w = re.sub(r"[^\w]|_", "", w)
        if w:
            words.append(w)
    return " ".join(words)


def strip_levels(text: str) -> tuple[str, str | None]:
    """``text`` without words of kind and asides, and the level that the word of kind names."""
    level, kept = None, []
    cut = re.sub(r",.*$", "", text) if re.search(r"\w", text.split(",")[0]) else text
    for w in cut.split():
        bare = w.lower().strip(".,;:()[]")
        if bare in _LEVEL:
            level = level or _LEVEL[bare]
        elif bare not in ASIDES:
            kept.append(w)
    rest = text[len(cut) :].lower().replace(",", " ").split()
    level = level or next((_LEVEL[w.strip(".,;:()")] for w in rest if w.strip(".,;:()") in _LEVEL), None)
    return (" ".join(kept) or cut), level


_SOUNDS = [("chh", "c"), ("ch", "c"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"), ("jh", "j"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("aa", "a"), ("ai", "e"), ("au", "o"), ("ow", "av"), ("ae", "e"), ("w", "v"), ("q", "k"), ("x", "ks"), ("z", "j"), ("y", "y")]


#: Spellings of name endings that stand for one another.
_ENDINGS = [(r"gh?ara?m$", "gar"), (r"n[ae]gger$", "nagar"), (r"(?:pore|poor|pour|paure)$", "pur"), (r"ally$", "alli"), (r"ttah$", "ttai"), (r"ga(?:m|nv|av|v|um|un)$", "gaon"), (r"gon$", "gaon"), (r"gar?dh?$", "garh"), (r"ganz$", "ganj"), (r"wad[hi]?$|vad[hi]?$", "wadi")]


@lru_cache(1 << 16)
def sound(name: str) -> str:
    """The sound form of Latin words: vowel length, aspiration, doubled letters and blanks dropped."""
    s = name.replace(" ", "")
    for a, b in _ENDINGS:
        s = re.sub(a, b, s)
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


_VOICE = str.maketrans("gdbjcs", "ktpsss")


def voiceless(form: str) -> str:
    """A sound form without voice and with one sibilant, as scripts without these letters write it."""
    return re.sub(r"(.)\1+", r"\1", form.translate(_VOICE).replace("h", ""))


def slips(a: str, b: str, most: int = 2) -> int:
    """Letters added, lost, changed or swapped between two strings; ``most + 1`` when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, 0  # equal beginnings and ends take no part
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    width, before, last = len(b), None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * width
        for j in range(max(1, i - most), min(width, i + most) + 1):
            y = b[j - 1]
            best = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[width], most + 1)
