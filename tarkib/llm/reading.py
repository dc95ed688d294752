"""How well a text in one script reads a text in another: consonant skeletons and their distance."""

from __future__ import annotations

from .common import letters

# --- Fixed values: sound classes of consonants; vowels, h and aspiration are left out ----------
URDU_SOUNDS = dict(
    zip(
        "بپتٹثجچخدڈذرڑزژسشصضطظغفقکگلمن",
        "bpttsjckddzrrzzssszttgpkkglmn",
        strict=True,
    )
) | {"ظ": "z", "ں": "n", "ذ": "z", "ز": "z", "ض": "z", "ژ": "z", "ط": "t"}
DEVA_SOUNDS = dict(
    zip(
        "कखगघङचछजझञटठडढणतथदधनपफबभमरलळशषस",
        "kkggnccjjnttddnttddnppbbmrllsss",
        strict=True,
    )
) | {"ं": "n", "ँ": "n"}
#: With a nukta: z for j, r for the flapped d; the others keep their class.
NUKTA_SOUNDS = {"j": "z", "d": "r"}


def urdu_skeleton(word: str) -> str:
    return _classes("".join([URDU_SOUNDS.get(c, "") for c in word]))


def deva_skeleton(word: str) -> str:
    out: list[str] = []
    for c in word:
        if c == "़":
            if out and out[-1] in NUKTA_SOUNDS:
                out[-1] = NUKTA_SOUNDS[out[-1]]
        elif c in DEVA_SOUNDS:
            out.append(DEVA_SOUNDS[c])
    return _classes("".join(out))


def _classes(s: str) -> str:
    """z and j are one class, as are r and d: nuktas may be lost."""
    return s.replace("z", "j").replace("r", "d")


def skeletons(text: str | None) -> list[str]:
    """The skeleton of each word of a text in Urdu, Devanagari or both."""
    out = []
    for w in (letters(text, True) or "").split():
        deva = sum("ऀ" <= c <= "ॿ" for c in w)
        out.append(deva_skeleton(w) if deva * 2 > len(w) else urdu_skeleton(w))
    return out


def distance(a: str, b: str) -> int:
    """Edit distance."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    """1 for equal skeletons, 0 for wholly different ones; two empty ones are alike."""
    most = max(len(a), len(b))
    return 1.0 if most == 0 else 1 - distance(a, b) / most
