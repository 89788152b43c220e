"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def personal(text):
    t, out = text or "", []
    for kind, p in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        for m in p.finditer(t):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= n <= 19 and luhn(m[0])):
                continue
            if kind == "phone" and not 10 <= n <= 15:
                continue
            out.append((m.start(), KINDS.index(kind), m.end()))
    out.sort()
    spelled = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == i for _, k, _ in out) for i in range(4)], hashlib.sha256(spelled.encode()).hexdigest(), spelled


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def simhash(text):
    import xxhash
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    """For each fingerprint, the first place of its component."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root
