"""Plain versions of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re

SF = "/root/testdata/sf0.001"

#: Rows that every operator over documents must stand: NULLs everywhere, blanks, repeated rows,
#: ties, a very long text, and extra columns whose names clash with those of results.
COPY = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
ODD = [
    (1, COPY, "en", "a"), (1, COPY, "en", "a"), (2, COPY, "en", "a"), (3, COPY + " Fifteen.", "en", "b"),
    (4, "", "en", "b"), (5, None, None, None), (None, "No id here but some words that stand alone.", "de", None),
    (None, None, None, "a"), (6, " \t\n\x0b \r\n", "fr", "b"), (7, "a", "en", "a"),
    (8, "token = \"0123456789abcdef0123\" and mail a@b.co, ünïcode 😀 ip 1.2.3.4 +49 30 1234567 4111 1111 1111 1111", "de", "c"),
    (9, "word " * 60_000 + "end.", "en", "c"), (10, "x" * 300_000, "en", "c"), (11, "É" * 50 + "\n\n" + "ß ." * 9, "fr", "a"),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SECRET = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    out = []
    for rank, (kind, e) in enumerate(SECRET.items()):
        for m in e.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def personal(text):
    out = []
    for kind, e in PII.items():
        for m in e.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(texts: dict):
    """doc_id -> (n_shingles, component_id) with every pair compared."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    tried = set()
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
