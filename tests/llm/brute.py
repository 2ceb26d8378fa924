"""Brute-force versions of the operators, over lists of rows."""

import collections
import hashlib
import re


def repeats(rows, length):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by listing all strings of ``length`` bytes."""
    texts = [(i, (x or "").encode()) for i, x in rows]
    starts = collections.Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def near_duplicates(rows, part=85, whole=100):
    """``doc_id, n_shingles, component_id, kept`` by comparing all pairs that share a shingle."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for _, x in rows:
        w = word.findall((x or "").encode().lower())
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, s in enumerate(sets):
        for j in range(k):
            both = len(s & sets[j])
            if both and whole * both >= part * (len(s) + len(sets[j]) - both):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    of = [least.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))]
    return sorted(((rows[k][0], len(sets[k]), of[k], rows[k][0] == of[k]) for k in range(len(rows))), key=str)


def top_k(rows, k=20, scale=64, every=20):
    from fractions import Fraction
    from math import floor, isfinite, isinf

    whole = lambda x: floor(Fraction(x) * scale) if isinf(x * scale) else floor(x * scale)
    good = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    # Scores that are no longs count as the nearest one.
    score = lambda v, w: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        found = sorted((-score(v, w), j is None, j or 0, b) for b, (j, w) in enumerate(good) if b != a)[:k]
        out += [(i, r + 1, good[b][0], -s) for r, (s, _, _, b) in enumerate(found)]
    return sorted(out, key=str)


def licenses(rows, templates, threshold=0.8):
    """``(doc_id, license)`` -> best Dice over the whole text, paragraphs and lines."""
    words = lambda x: re.sub(r"[\W_]+", " ", x.lower()).split()
    grams = lambda w: collections.Counter(zip(w, w[1:]))
    known = [(n, grams(words(t))) for n, t in templates]
    out = {}
    for i, x in rows:
        x = x or ""
        for unit in [x, *re.split(r"\n\s*\n", x), *x.split("\n")]:
            g = grams(words(unit))
            for n, t in known:
                if g and t:
                    dice = 2 * sum((g & t).values()) / (sum(g.values()) + sum(t.values()))
                    if dice >= threshold:
                        out[i, n] = max(out.get((i, n), 0), round(dice, 6))
    return out


def leaks(docs, items, width=8, coverage=0.5):
    """``(doc_id, item_id)`` that share half of the item's windows of plain lower-case words."""
    words = lambda x: re.findall(r"\w+", (x or "").lower())
    out = set()
    for d, x in docs:
        w = words(x)
        have = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
        for i, y in items:
            v = words(y)
            n = len(v) - width + 1
            if n > 0 and sum(tuple(v[j : j + width]) in have for j in range(n)) >= coverage * n:
                out.add((d, i))
    return out


def template_leaks(docs, items, width=8, coverage=0.5, consistency=0.8, shortest=5):
    """``(doc_id, item_id)`` by comparing each document's templates with each item's, window by window and slot by slot."""
    import regex

    from depinfer.llm.op2_decontaminate import UNITS

    number = r"\p{N}+(?:[.,]\p{N}+)*"
    name, opener = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+", r"(?<![\p{L}\p{M}\p{N}\x01-\x05])\p{Lu}\p{Ll}+"
    between = r"[^\p{L}\p{M}\p{N}\x01-\x05]+"
    cut = lambda x: [w for w in regex.split(between, x.lower()) if w]

    def words(x):
        """For each word its template, its template as an opener, and its value with its kind."""
        typed = regex.sub(opener, "\x05\\g<0>", regex.sub(name, "\x02", x))
        typed = cut(regex.sub(number, "\x01", regex.sub(rf"({number}) ?({UNITS})\b", "\x01 \x03", typed)))
        said = regex.sub(opener, "\x05\\g<0>", regex.sub(name, "\x02\\g<0>", x))
        said = cut(regex.sub(r"(?<=\p{N})[.,](?=\p{N})", "\x04", regex.sub(rf"({number}) ?({UNITS})\b", r"\1 \x03\2", said)))
        return [(t.replace("\x05", ""), regex.sub("\x05.*", "\x02", t), v) for t, v in zip(typed, said)]

    def templates(w, n):
        """Template of a window -> its places, and whether it needs an opener to be a slot."""
        out = collections.defaultdict(set)
        for a in range(len(w) - n + 1):
            plain, opened = tuple(x[0] for x in w[a : a + n]), tuple(x[1] for x in w[a : a + n])
            out[plain].add((a, False))
            if opened != plain and any(x > "\x05" for x in opened):
                out[opened].add((a, True))
        return out

    asked = {(i, x): words(x) for i, x in ((i, x or "") for i, x in items)}
    ordinary = {t[0] for w in asked.values() for t, (raw, _, v) in ((x, x) for x in w) if not v.startswith("\x05") and raw >= "\x06"}
    out = set()
    for d, text in docs:
        w, lines = words(text or ""), [cut(x) for x in (text or "").split("\n")]
        for (i, x), v in asked.items():
            if len(v) < shortest:
                out |= {(d, i)} if v and cut(x) in lines else set()
                continue
            n = min(width, len(v))
            have, met = templates(w, n), collections.defaultdict(set)
            plain = set()
            for t, places in templates(v, n).items():
                for p, opened in places:
                    for at, also in have.get(t, ()):
                        met[at - p].add(p)
                        plain |= set() if opened or also else {p}
            total = len(v) - n + 1
            if len(set().union(*met.values())) < coverage * total:
                continue
            order = sorted(met, key=lambda s: (-len(met[s]), abs(s), -s))
            values, back = collections.defaultdict(list), collections.defaultdict(set)
            for k, (_, _, value) in enumerate(v):
                kind = value[0]
                if not (kind in "\x02\x03" or regex.search(r"\p{N}", value) or kind == "\x05" and len(plain) < coverage * total):
                    continue
                shift = next((s for s in order if any(p <= k < p + n for p in met[s])), None)
                if shift is None or not 0 <= k + shift < len(w):
                    continue
                bare, other = (y.translate({2: None, 5: None}) for y in (value, w[k + shift][2]))
                values[bare].append((kind, other))
                if kind == "\x02":
                    back[other].add(bare)
            fine = slots = 0
            for value, found in values.items():
                others, opener_only = {o for _, o in found}, all(k == "\x05" for k, _ in found)
                if opener_only and not ((len(found) > 1 or len(v) < width) and (len(others) > 1 or others != {value})):
                    continue
                slots += 1
                other = min(others)
                wrong = any(k == "\x02" for k, _ in found) and len(back.get(other, ())) > 1
                common = len(v) < width and opener_only and (value in ordinary or other in ordinary)
                fine += len(others) == 1 and not wrong and not common
            if fine >= consistency * slots:
                out.add((d, i))
    return out
