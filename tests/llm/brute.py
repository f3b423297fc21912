"""Plain Python versions of the operators' results, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = words(lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size, percent):
    """(doc_id, text) -> [component id of each row]: all pairs are compared."""
    sets, parent = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(root(i), [])
        ids += [doc] if doc is not None else []
    return [(min(least[root(i)]) if least[root(i)] else None) if sets[i] else rows[i][0] for i in range(len(rows))]


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(digits) <= 19 and luhn(digits) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def chains(text, anchors):
    """Each anchor before a content word with it and the next one; the words, or the text itself, where there are none."""
    text = text or ""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = set()
    for i, x in enumerate(w):
        if x in anchors and i + 1 < len(w) and w[i + 1] not in anchors:
            found.add((x, *[y for y in w[i + 1 : i + 20_000] if y not in anchors][:2]))
    return found or ({tuple(w)} if w else {text} if text else set())


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def altered_words(rows):
    """(doc_id, text) -> Counter of the words of at least 6 code points, those with at least 5 occurrences."""
    seen = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """One inserted, deleted or replaced code point makes a and b equal."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants(seen):
    """word -> (form, root, n, n_near, form_n)"""
    near = {w: [x for x in seen if one_edit(w, x)] for w in seen}
    best = {w: min(xs, key=lambda x: (-seen[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if seen[x] >= 5 * seen[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), seen[form[w]] if w in form else None) for w, n in seen.items()}


def without_repeats(texts, size):
    """(words, kept words) of each text: words go that a window covers which also starts elsewhere."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def alignments(rows, encode_a, encode_b, bytes_a, bytes_b):
    """(doc_id, text) -> [(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)]: all
    pairs of a text's tokens are compared."""
    aligned, counts = [], Counter()
    for _, text in rows:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        spelled = text and b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode()
        if not spelled:
            aligned.append(None)
            continue
        at_a, at_b = ends(map(bytes_a, a)), ends(map(bytes_b, b))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(at_a) for j, (x, y) in enumerate(at_b) if s < y and x < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, done = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, at_a) if done <= s and e <= c) + "|" + ",".join(str(i) for i, (s, e) in zip(b, at_b) if done <= s and e <= c))
            done = c
        aligned.append((len(a), len(b), groups, links))
        counts.update(set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc, _), found in zip(rows, aligned):
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = found
            out.append((doc, a, b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out
