"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return set()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(sets):
    """Smallest key that links reach, by key; sets: key -> shingle set."""
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {key: find(key) for key in sets}


TOKEN = re.compile(r"[^\W_]+(?:[.,][0-9]+)*")


def contaminated(docs, items, units, window=8, least=5):
    """{(doc, item): (windows, changed)} by trying every alignment; ASCII digits only."""

    def form(word, names):
        if re.fullmatch(r"[0-9][0-9.,]*", word):
            return "<num>"
        if word.lower() in units:
            return "<unit>"
        return "<name>" if names and word != word.lower() else word.lower()

    def formed(text):
        words = TOKEN.findall(text or "")
        return words, [form(w, True) for w in words], [form(w, False) for w in words]

    bodies = {doc: formed(body) for doc, body in docs.items()}
    found = {}
    for item, text in items.items():
        theirs, *wanted = formed(text)
        size = min(window, len(theirs))
        if size < least:
            continue
        for doc, (ours, *given) in bodies.items():
            starts = {}
            for a, b in zip(wanted, given):
                for at in range(len(a) - size + 1):
                    run = a[at : at + size]
                    if 2 * sum(not w.startswith("<") for w in run) < size:
                        continue
                    for place, word in enumerate(b[: len(b) - size + 1]):
                        if word == run[0] and b[place : place + size] == run:
                            starts.setdefault(place - at, set()).add(at)
            best = None
            for shift, places in starts.items():
                covered = sorted({at + k for at in places for k in range(size)})
                slots = {
                    (theirs[at].lower(), ours[at + shift].lower())
                    for at in covered
                    if wanted[0][at].startswith("<")
                }
                one_to_one = len({x for x, _ in slots}) == len({y for _, y in slots}) == len(slots)
                share = len(places) / (len(theirs) - size + 1)
                if one_to_one and (len(covered) >= 13 or share >= 0.5):
                    changed = sum(x != y for x, y in slots)
                    best = max(best or (0, -1e9), (len(places), -changed))
            if best:
                found[doc, item] = (best[0], -best[1])
    return found


def phrases(text):
    """Phrase set of a Lempel-Ziv (1978) parse."""
    known, phrase = set(), ""
    for character in text:
        phrase += character
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return host.translate(LOWER), path
