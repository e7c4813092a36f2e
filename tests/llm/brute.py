"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n=3, percent=85):
    """doc_id -> (set size, least id reachable)."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def suffixes(rows, length=200):
    """(bytes, removed, spans, digest of the rest) of each text, in order."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    """All levels of a tree, runs of three hashed together, up to the level of one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text, other text).  Of each: leaf, subroot, root, digest of the proof, folded root."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h(map(show, (*r[:4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[5])))
        trees[s] = _levels([leaf(r, r[4]) for r in by[s]])
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            other, proof = leaf(r, r[5]), []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    other = _h([*run[: at % 3], other, *run[at % 3 + 1 :]])
                    at //= 3
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], _h(proof), other))
    return out


def damage(rows):
    """conv_id -> [(turn, role, text)] after damage."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        show = lambda v: " " if v is None else v
        role, text, n = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        kept += [(turn, "user" if n == 4 else role, text)] * {0: 0, 3: 2}.get(n, 1)
    return out


def mend(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows; every way is tried."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal, known = re.compile("(s?(ua)+)?"), {}
    begun = lambda initials: any(legal.fullmatch(initials + more) for more in ("", "a", "ua"))

    def go(i, tail):
        """Least (cost, audit, lines) of rows i on, when the initials so far end in ``tail``."""
        if (i, tail) in known:
            return known[i, tail]
        ways = [(0, "", ())] if i == len(rows) and legal.fullmatch(tail) else []
        for inserted in range(4):
            lines, initials = (), tail
            for _ in range(inserted):
                role = "assistant" if initials.endswith("u") else "user"
                lines, initials = (*lines, f"{role}:"), initials + role[0]
            cost, audit = 3 * inserted, "I" * inserted
            if i == len(rows):
                if legal.fullmatch(initials):
                    ways.append((cost, audit, lines))
                continue
            _, role, text = rows[i]
            for edit, price, to in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant"), ("D", 4, None)):
                if edit != "D" and faults[i] in ("blank", "duplicate"):
                    continue
                after = initials + (to[:1] if to is not None else "")
                if to == "" or not begun(after):
                    continue
                price += 3 if edit != "D" and faults[i] == "truncated" else 0
                rest = go(i + 1, after)
                if rest:
                    ways.append((cost + price + rest[0], audit + edit + rest[1], (*lines, *([f"{to}:{text}"] if to is not None else []), *rest[2])))
        known[i, tail] = min(ways) if ways else None
        return known[i, tail]

    best = go(0, "")
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda f: faults.count(f)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def fingerprint(text, n=4):
    w = words(text)
    grams = [" ".join(w)] if 0 < len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def close_components(rows, prints, radius=4):
    """Least doc_id that links of close fingerprints reach, for each row."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [least.get(root(i)) for i in range(len(rows))]
