"""Plain versions of the text operators, one text or one pair at a time."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = space_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows):
    """doc_id -> (set size, component) for unique ids, by all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept."""
    w, text = space_words(text, lower=False), text or ""

    def in_repeats(k):
        runs = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({i + j for i in range(len(w) - k + 1) if runs[tuple(w[i : i + k])] > 1 for j in range(k)})

    longest, before = 0, [0] * (len(w) + 1)
    for i in range(len(w)):
        row = [0] * (len(w) + 1)
        for j in range(i):
            if w[i] == w[j]:
                row[j + 1] = before[j] + 1
                longest = max(longest, row[j + 1])
        before = row
    lines = [x for x in text.split("\n") if space_words(x)]
    n, repeat, cover = len(w), in_repeats(8), in_repeats(5)
    failed = n < 20 or 100 * repeat > 30 * n
    longest = longest if longest >= 5 else 0
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, cover, longest, failed, not failed and 100 * cover <= 35 * n and longest <= 100


def benchmark_hits(text, items, window=10):
    """n_words, n_hit, n_items, sha256 for items (id, text)."""
    w, hit, found = plain_words(text), set(), set()
    for item, own in items:
        v = plain_words(own)
        m = min(window, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def digest(spans, kinds):
    """spans (start, kind, end) -> the joined text."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], kinds.index(x[1]))))


def secrets(text):
    """Base spans with their values."""
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end(), m[2]))
    out += [(m.start(), "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    out += [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    return out + [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def phrase_places(text, phrases):
    """(label, start) of all places."""
    w = plain_words(text)
    return [(label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def unigram_scores(rows, folds=10, held_out=0):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*space_words(t), None] for i, t in rows}
    counts = Counter(x for i, own in tokens.items() if crc(i) % folds != held_out for x in own)
    total, distinct = sum(counts.values()), len(counts)
    rate = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    return {i: (len(own), sum(counts[x] > 0 for x in own), total, sum(rate(counts[x]) for x in own)) for i, own in tokens.items()}


def least_padding(lengths, buckets):
    """Least total padding with at most so many buckets."""
    kinds = sorted(set(lengths))
    pad = lambda ends: sum(min(e for e in ends if e >= n) - n for n in lengths)
    return min((pad([*c, kinds[-1]]) for k in range(min(buckets, len(kinds))) for c in itertools.combinations(kinds[:-1], k)), default=0)


def toxicity_scores(rows, labels, folds=3, held_out=1, orders=(3, 4, 5, 6), least_texts=4, least_r=1.0, ridge=0.02):
    """doc_id -> score: naive Bayes ratios of n-grams, then a regression by Newton steps in the space of the texts."""
    import numpy as np

    grams = {i: {(k, t[j : j + k]) for t in [(t or "").translate(LOWER)] for k in orders for j in range(len(t) - k + 1)} for i, t in rows}
    known = [(i, y) for i, y in labels if crc(i) % folds != held_out and i in grams]
    y = np.array([y for _, y in known], float)
    n = [len(y) - y.sum(), y.sum()]
    counts = Counter((g, c) for i, c in known for g in grams[i])
    r = {g: math.log((counts[g, 1] + 1) / (n[1] + 2) / ((counts[g, 0] + 1) / (n[0] + 2))) for g in {g for g, _ in counts}}
    r = {g: v for g, v in r.items() if counts[g, 0] + counts[g, 1] >= least_texts and abs(v) >= least_r}
    own = lambda i: {g: r[g] for g in grams[i] if g in r}
    dot = lambda a, b: sum(v * b[g] for g, v in a.items() if g in b)
    texts = [own(i) for i, _ in known]
    kernel = np.array([[dot(a, b) for b in texts] for a in texts])
    # minimise sum of losses + ridge / 2 * |w|^2 with w = sum of alpha * x
    alpha, bias = np.zeros(len(y)), 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(kernel @ alpha + bias)))
        h = np.maximum(p * (1 - p), 1e-9)
        a = np.block([[kernel * h[:, None] + ridge * np.eye(len(y)), h[:, None]], [(h @ kernel)[None, :], np.array([[h.sum()]])]])
        step = np.linalg.solve(a, np.append(y - p - ridge * alpha, (y - p).sum()))
        alpha, bias = alpha + 0.5 * step[:-1], bias + 0.5 * step[-1]
    weigh = lambda i: bias + sum(c * dot(own(i), t) for c, t in zip(alpha, texts))
    return {i: 1 / (1 + math.exp(-weigh(i))) for i, _ in rows}


def history_gains(rows, model, v, folds=10, held_out=0, rounds=2):
    """doc_id -> log10 of what the histories add, by iterative scaling over (feature, node) pairs in dictionaries."""
    import pyarrow as pa

    from tidewake.llm.words import find_words

    table = model.Table(v)
    odds, ways = table.odds.tolist(), {}
    for i, text in rows:
        token, _ = model.tokens(find_words(pa.array([text], pa.string())))
        steps = table.choices(token, table.look_up(token)[1])
        order, own = next(steps), [[] for _ in token]
        place = list(range(len(token)))
        for which, node, bit in steps:
            for at, x, b in zip(place[which] if isinstance(which, slice) else which.tolist(), node.tolist(), bit.tolist()):
                own[order[at]].append((x, b))
        token = [1, 1, *token.tolist()]
        ways[i] = [(x, b, (("one", token[t + 1], x), ("skip", token[t], x), ("both", token[t], token[t + 1], x))) for t, o in enumerate(own) for x, b in o]
    weights = Counter()
    for _ in range(rounds):
        n, right, expected = Counter(), Counter(), Counter()
        for i, way in ways.items():
            if crc(i) % folds != held_out:
                for x, b, features in way:
                    p = 1 / (1 + math.exp(-odds[x] - sum(weights[f] for f in features)))
                    for f in features:
                        n[f], right[f], expected[f] = n[f] + 1, right[f] + b, expected[f] + p
        for f in n:
            weights[f] += math.log((right[f] + 1) / (expected[f] + 1) / ((n[f] - right[f] + 1) / (n[f] - expected[f] + 1))) / 3
    loss = lambda x, b: math.log1p(math.exp(x if b == 0 else -x))
    return {i: sum(loss(odds[x], b) - loss(odds[x] + sum(weights[f] for f in fs), b) for x, b, fs in way) / math.log(10) for i, way in ways.items()}


def damage(rows):
    """rows: (conv_id, turn, role, text) -> what is left of each conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(rows):
    """The first fault of each row of a conversation after damage."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub("[ \t-\r]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows):
    """rows of one conversation after damage -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest; tries every sequence of edits."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = [(3 * len(rows) + 1, "~", None)]

    def walk(at, lines, cost, audit, put):
        """put: turns inserted in a row."""
        if cost > best[0][0]:
            return
        initials = "".join(r[:1] or "-" for r, _ in lines)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best[0] = min(best[0], (cost, audit, lines), key=lambda x: x[:2])
        if not re.match("s?(ua)*u?$", initials):
            return
        if put < 2:
            for role in ("user", "assistant"):
                walk(at, [*lines, (role, "")], cost + 2, audit + "I", put + 1)
        if at < len(rows):
            _, role, text = rows[at]
            walk(at + 1, lines, cost + 3, audit + "D", 0)
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                walk(at + 1, [*lines, (role, text)], cost + more, audit + "K", 0)
                for other in ("user", "assistant"):
                    walk(at + 1, [*lines, (other, text)], cost + 2 + more, audit + "R", 0)

    walk(0, [], 0, "", 0)
    cost, audit, lines = best[0]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def collocations(rows, least, longest, best):
    """rows: (lang, text) -> rows (lang, rank, phrase, a, l, r, n, score)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in often.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:best])]
    return sorted(out)
