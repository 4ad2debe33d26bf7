"""Words as a search index keeps them: stop words go, inflected forms meet in one stem. Small functions of one word; their callers remember the answers.

English and French follow the published Snowball descriptions; Arabic is a light stemmer of the usual prefixes and suffixes. ``simple`` keeps every word."""

from __future__ import annotations

import re
from collections.abc import Callable

# Stop words.
ENGLISH_STOP = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
FRENCH_STOP = frozenset("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y étée étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant eu eue eues eus ai avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent".split())

# Fixed values of English: words with a stem of their own, words that don't change, and words that are left after their plural is gone.
ENGLISH_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | dict.fromkeys(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
ENGLISH_LEFT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
ENGLISH_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
ENGLISH_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
ENGLISH_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\Z")


_VOWEL, _LEADING_Y, _REGION = re.compile("[aeiouy]"), re.compile(r"(?:\A|(?<=[aeiouy]))y"), re.compile("[aeiouy][^aeiouy]")
#: What a word must end in for any ending to be taken off; the others are their own stems. Of each step, its endings.
_ENGLISH_ENDS, _E1, _E2, _E3 = "sdgynlimretc", ("eedly", "ingly", "edly", "eed", "ing", "ed"), tuple(ENGLISH_2), tuple(ENGLISH_3)


def _after(word: str, region: re.Pattern, start: int = 0) -> int:
    """Where the region behind the first consonant after a vowel begins."""
    found = region.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, ends: dict[int, frozenset[str]], room: int) -> str:
    """The longest of the endings (by length, longest first) that the word has in its last ``room`` letters."""
    for n, these in ends.items():
        if n <= room and (end := word[-n:]) in these:
            return end
    return ""


def _by_length(*ends: str) -> dict[int, frozenset[str]]:
    return {n: frozenset(e for e in ends if len(e) == n) for n in sorted({len(e) for e in ends}, reverse=True)}


def english(word: str) -> str | None:
    if word in ENGLISH_STOP:
        return None
    if len(word) < 3:
        return word
    if word in ENGLISH_OWN:
        return ENGLISH_OWN[word] or word
    if word[-1] not in _ENGLISH_ENDS:
        return word.lower()
    w = _LEADING_Y.sub("Y", word) if "y" in word else word
    if w.startswith(("gener", "commun", "arsen")):
        r1 = 6 if w.startswith("commun") else 5
    else:
        r1 = _after(w, _REGION)
    r2 = _after(w, _REGION, r1)
    vowel = lambda s: _VOWEL.search(s) is not None
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in ENGLISH_LEFT:
        return w
    end = next((e for e in _E1 if w.endswith(e)), "") if w.endswith(_E1) else ""
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = next((e for e in ENGLISH_2 if w.endswith(e)), None) if w.endswith(_E2) else None
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + ENGLISH_2[end]
    end = next((e for e in ENGLISH_3 if w.endswith(e)), None) if w.endswith(_E3) else None
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + ENGLISH_3[end]
    end = next((e for e in ENGLISH_4 if w.endswith(e)), None) if w.endswith(ENGLISH_4) else None
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Fixed values of French: endings by step.
FRENCH_VOWELS = "aeiouyâàëéêèïîôûù"
_F_PLAIN = ("ances", "iqUes", "ismes", "ables", "istes", "ance", "iqUe", "isme", "able", "iste", "eux")
_F_VERB_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_F_VERB_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_F_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_F_FIRST = _by_length(*_F_PLAIN, *"atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses amment emment ment ments issement issements".split())
_F_I, _F_REST, _F_LAST = _by_length(*_F_VERB_I), _by_length("ions", *_F_VERB_E, *_F_VERB_A), _by_length("ion", "ier", "ière", "Ier", "Ière", "e", "ë")
_F_HELD, _F_GLIDE, _F_REGION = re.compile(f"(?<=[{FRENCH_VOWELS}])([ui])(?=[{FRENCH_VOWELS}])"), re.compile(f"(?<=[{FRENCH_VOWELS}])y|y(?=[{FRENCH_VOWELS}])"), re.compile(f"[{FRENCH_VOWELS}][^{FRENCH_VOWELS}]")
_F_TWO, _F_VOWEL, _F_ACCENT = re.compile(f"[{FRENCH_VOWELS}]{{2}}"), re.compile(f"[{FRENCH_VOWELS}]"), re.compile(f"[éè]([^{FRENCH_VOWELS}]+)\\Z")
#: As _ENGLISH_ENDS, for words without an accent that may fall.
_FRENCH_ENDS = "".join({e[-1] for ends in (_F_FIRST, _F_I, _F_REST, _F_LAST) for these in ends.values() for e in these} | set("sntl"))


def french(word: str) -> str | None:
    if word in FRENCH_STOP:
        return None
    if word[-1:] not in _FRENCH_ENDS and "é" not in word and "è" not in word:
        return word.lower()
    v = FRENCH_VOWELS
    w = word.replace("qu", "qU")
    w = _F_HELD.sub(lambda m: m[1].upper(), w)
    w = _F_GLIDE.sub("Y", w) if "y" in w else w
    if _F_TWO.match(w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = _after(w, _F_VOWEL, 1)
    r1 = _after(w, _F_REGION)
    r2 = _after(w, _F_REGION, r1)
    inside = lambda end, at: w.endswith(end) and len(w) - len(end) >= at
    given, verbs = w, False

    end = _longest(w, _F_FIRST, len(w))
    cut = w[: len(w) - len(end)]
    if end in _F_PLAIN:
        w = cut if inside(end, r2) else w
    elif end in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if inside(end, r2):
            w = cut
            if w.endswith("ic"):
                w = w[:-2] if inside("ic", r2) else w[:-2] + "iqU"
    elif end in ("logie", "logies"):
        w = cut + "log" if inside(end, r2) else w
    elif end in ("usion", "ution", "usions", "utions"):
        w = cut + "u" if inside(end, r2) else w
    elif end in ("ence", "ences"):
        w = cut + "ent" if inside(end, r2) else w
    elif end in ("ement", "ements"):
        if inside(end, rv):
            w = cut
            if inside("iv", r2):
                w = w[:-2]
                w = w[:-2] if inside("at", r2) else w
            elif w.endswith("eus"):
                w = w[:-3] if inside("eus", r2) else w[:-1] + "x" if inside("eus", r1) else w
            elif inside("abl", r2) or inside("iqU", r2):
                w = w[:-3]
            elif inside("ièr", rv) or inside("Ièr", rv):
                w = w[:-3] + "i"
    elif end in ("ité", "ités"):
        if inside(end, r2):
            w = cut
            if w.endswith("abil"):
                w = w[:-4] if inside("abil", r2) else w[:-2] + "l"
            elif w.endswith("ic"):
                w = w[:-2] if inside("ic", r2) else w[:-2] + "iqU"
            elif inside("iv", r2):
                w = w[:-2]
    elif end in ("if", "ive", "ifs", "ives"):
        if inside(end, r2):
            w = cut
            if inside("at", r2):
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if inside("ic", r2) else w[:-2] + "iqU"
    elif end == "eaux":
        w = cut + "eau"
    elif end == "aux":
        w = cut + "al" if inside(end, r1) else w
    elif end in ("euse", "euses"):
        w = cut if inside(end, r2) else cut + "eux" if inside(end, r1) else w
    elif end in ("issement", "issements"):
        w = cut if inside(end, r1) and cut[-1:] and cut[-1] not in v else w
    elif end == "amment":
        w, verbs = (cut + "ant", True) if inside(end, rv) else (w, False)
    elif end == "emment":
        w, verbs = (cut + "ent", True) if inside(end, rv) else (w, False)
    elif end in ("ment", "ments"):
        if inside(end, rv) and len(cut) > rv and cut[-1] in v:
            w, verbs = cut, True
    if w == given or verbs:
        before = w
        end = _longest(w, _F_I, len(w) - rv)
        if end and len(w) - len(end) > rv and w[-len(end) - 1] not in v:
            w = w[: -len(end)]
        if w == before:
            end = _longest(w, _F_REST, len(w) - rv)
            if end == "ions":
                w = w[:-4] if inside(end, r2) else w
            elif end in _F_VERB_E:
                w = w[: -len(end)]
            elif end:
                w = w[: -len(end)]
                w = w[:-1] if inside("e", rv) else w
    if w != given:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès") and len(w) > 1:
            w = w[:-1]
        end = _longest(w, _F_LAST, len(w) - rv)
        if end == "ion":
            w = w[:-3] if inside(end, r2) and len(w) - 4 >= rv and w[-4] in "st" else w
        elif end in ("e", "ë"):
            w = w[:-1] if end == "e" or w.endswith("guë") else w
        elif end:
            w = w[: -len(end)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = _F_ACCENT.sub(r"e\1", w) if "é" in w or "è" in w else w
    return w.lower()


# Fixed values of Arabic: marks that aren't letters, forms of alef, prefixes and suffixes, longest first.
_A_MARKS = re.compile("[ـً-ْٰ]")
_A_SOME = re.compile("[ء-يٱ]")
_A_ALEF = str.maketrans("أإآٱىؤئ", "ااااييي")
_A_PREFIXES = ("وال", "بال", "كال", "فال", "ولل", "ال", "لل", "و")
_A_SUFFIXES = ("تها", "هما", "كما", "ها", "هم", "هن", "كم", "كن", "نا", "ان", "ات", "ون", "ين", "ية", "ه", "ة", "ي")


def arabic(word: str) -> str:
    if not _A_SOME.search(word):
        return word
    w = _A_MARKS.sub("", word).translate(_A_ALEF)
    if not re.search("[ء-ي]", w):
        return word
    for p in _A_PREFIXES:
        if w.startswith(p) and len(w) - len(p) >= 3:
            w = w[len(p) :]
            break
    for s in _A_SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def simple(word: str) -> str:
    return word


DICTIONARIES: dict[str, Callable[[str], str | None]] = {"simple": simple, "english": english, "french": french, "arabic": arabic}
