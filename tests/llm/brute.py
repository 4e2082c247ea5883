"""Plain versions of the operators, one row at a time."""

import re
from hashlib import sha256


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


SECRET = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(SECRET, text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def sha(text):
    return sha256(text.encode()).hexdigest()


def repeats(docs, length=13):
    """docs: [(doc_id, text)] -> [(doc_id, n_words, n_removed, sha)]."""
    words = [(k, re.findall("[^\x20\x09-\x0d]+", t or "")) for k, t in docs]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - length + 1):
                g = tuple(w[i : i + length])
                first[g] = min(first.get(g, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if k is not None and first[tuple(w[i : i + length])] < k:
                gone.update(range(i, i + length))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(docs, least=0.8):
    """docs: {doc_id: text} -> {doc_id: (class_id, n_links)}."""
    sets = {k: shingles(t) for k, t in docs.items()}
    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    links = {k: set() for k in docs}
    for k, s in sets.items():
        shared = {}
        for g in s:
            for o in holders[g]:
                shared[o] = shared.get(o, 0) + 1
        links[k] = {o for o, n in shared.items() if o != k and n >= least * (len(s) + len(sets[o]) - n) - 1e-9}
    root = {k: k for k in docs}
    for k in sorted(docs):
        if root[k] == k:
            todo = [k]
            while todo:
                x = todo.pop()
                for o in links[x]:
                    if root[o] > k:
                        root[o] = k
                        todo.append(o)
    return {k: (root[k], len(links[k])) for k in docs}
