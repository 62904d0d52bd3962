"""Plain versions of the conversation operators and of the search, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np

BLANK = re.compile(r"[\x20\x09-\x0D]*")


def spaced(value):
    return " " if value is None else value


def damage(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return found


def faults(own):
    seen, found = set(), []
    for _, role, text in own:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(roles, faults, inserts=2):
    """(cost, audit, roles) over every way to edit, each held against the expression."""
    best = None
    choices = [
        [("D", 2, None)]
        if fault in ("blank", "duplicate")
        else [("D", 2, None)]
        + [("K", 5 * (fault is not None), role), ("R", 1 + 5 * (fault is not None), "user")]
        + [("R", 1 + 5 * (fault is not None), "assistant")]
        for role, fault in zip(roles, faults)
    ]
    gaps = [[()] + [(a,) for a in ("user", "assistant")] + ([("user", "assistant")] if inserts > 1 else [])]
    for pick in product(*(x for c in choices for x in (gaps[0], c)), gaps[0]):
        cost, audit, final = 0, "", []
        for i, step in enumerate(pick):
            if i % 2 == 0:
                cost += 5 * len(step)
                audit += "I" * len(step)
                final += step
            else:
                cost += step[1]
                audit += step[0]
                final += [step[2]] if step[0] != "D" else []
        if (best is None or (cost, audit) < best[:2]) and re.fullmatch(
            "(s?(ua)+)?", "".join(r[:1] for r in final)
        ) and all(final):
            best = (cost, audit, final)
    return best


def by_strings(roles, faults):
    """The same by dynamic programming over whole strings."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    name = {"u": "user", "a": "assistant"}

    def grow(table):
        for _ in range(2):
            for state, (cost, audit, final) in list(table.items()):
                offer(table, step[state], (cost + 5, audit + "I", final + ((None, name[step[state]]),)))

    for i, (role, fault) in enumerate(zip(roles, faults)):
        grow(best)
        after = {}
        for state, (cost, audit, final) in best.items():
            offer(after, state, (cost + 2, audit + "D", final))
            if fault in ("blank", "duplicate"):
                continue
            more, first = 5 * (fault is not None), role[:1]
            if first == step[state] or state == "" and first == "s":
                offer(after, first, (cost + more, audit + "K", final + ((i, role),)))
            to = step[state]
            offer(after, to, (cost + 1 + more, audit + "R", final + ((i, name[to]),)))
        best = after
    grow(best)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows):
    """{conv_id: the columns of the query}."""
    found = {}
    convs = {conv for conv, *_ in rows}
    after = damage(rows)
    for conv in convs:
        own = after[conv]
        kinds = faults(own)
        cost, audit, final = by_strings([r[1] for r in own], kinds)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        text = "\n".join(f"{role}:{own[i][2] if i is not None else ''}" for i, role in final)
        found[conv] = (
            gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def trie(rows, heads=6):
    """Rows of the prefix trie."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, tie, text))
    turns = {c: [(r[2], r[4]) for r in sorted(o)] for c, o in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for conv, mine in turns.items():
        h = zlib.crc32(str(conv).encode()) % heads
        whole = tuple(turns.get(conv - int(np.fmod(conv, 100)), [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(conv)
        ends[whole].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    found = []

    def sums(node):
        leaves, saved = (0, 0) if children[node] else (1, 0)
        for child in children[node]:
            more = sums(child)
            leaves, saved = leaves + more[0], saved + more[1]
        saved += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ids = ",".join(map(str, sorted(ends[node])))
        found.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None,
            len(members[node]), len(children[node]), leaves, saved,
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
        return leaves, saved

    if turns:
        sums(())
    return sorted(found, key=str)


def neighbours(rows, k=5, every=50):
    """{position of a query: [(score, vec_id)]}, exact; None for rows that take no part."""
    found = {}
    fine = [
        (i, one, np.array(v, float))
        for i, (one, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    for i, one, v in fine:
        if one is None or one % every:
            continue
        scores = sorted(
            (-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), other is None, other or 0)
            for j, other, w in fine
            if j != i and len(w) == len(v)
        )
        found[i] = [(-s, None if n else o) for s, n, o in scores[:k]]
    return found
