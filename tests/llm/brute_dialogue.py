"""Conversation repair by plain loops: all audits of a row, the cheapest kept for each role sequence state."""

import hashlib
import re
import zlib
from collections import defaultdict

LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def identity(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def best(rows, faults):
    """(cost, audit, lines) of the cheapest repair, extending every prefix by every edit."""
    found = {"": (0, "", ())}  # by the kept initials' last letter

    def offer(table, state, cost, audit, lines):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, lines)

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                offer(table, role[0], cost + 3, audit + "I", (*lines, f"{role}:"))
        return table

    for (_, role, text), fault in zip(rows, faults):
        found, after = inserted(found), {}
        for state, (cost, audit, lines) in found.items():
            offer(after, state, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            following = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] in following and role:
                offer(after, role[0], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            new = "assistant" if state == "u" else "user"
            offer(after, new[0], cost + more + 3, audit + "R", (*lines, f"{new}:{text}"))
        found = after
    found = inserted(found)
    return min(found[s] for s in ("", "a") if s in found)


def report(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, identity(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(kept, kept[1:]))
        cost, audit, lines = best(kept, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out
