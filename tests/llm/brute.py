"""Plain Python versions of the operators' results, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def shingles(text, size=5):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1)))


def components(rows, percent=75):
    """[(id, text)] to {id: (n_shingles, component)}; all pairs that share a shingle are compared."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both[(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


def item_words(text):
    low = (text or "").encode().lower().decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window=10):
    """{id: (n_words, n_hit, n_items, digest, contaminated)}."""
    wins = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        if ws:
            for i in range(max(1, len(ws) - window + 1)):
                wins[tuple(ws[i:i + window])].add(str(item))
    lengths = {len(w) for w in wins}
    out = {}
    for doc, text in docs:
        ws = item_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i:i + n])
                if w in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(ws), len(hit), len(found), digest, bool(hit))
    return out


def quality_counts(text):
    ws = (text or "").encode().split()
    grams = list(zip(ws, ws[1:], ws[2:]))
    often = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def line_dedup(rows, min_chars=40, min_docs=5):
    """[(id, text)] to [(id, kept text, n_lines, n_dropped)] in the order of the rows."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] in (doc, None)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def fill_in_middle(doc, text):
    """(units, form, prefix characters, middle characters, output)."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def vector_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """[(id, vector, label)] to ([(id, code, error, label_error)], digest of the codebooks); ids are distinct."""
    kept = sorted((i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if usable(v))
    if not kept:
        return [], None
    size = len(kept[0][1]) // parts
    pieces = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[pieces[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            near = defaultdict(list)
            for piece in pieces:
                near[nearest(p, piece[p])[1]].append(piece[p])
            for k, members in near.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[nearest(p, x) for p, x in enumerate(piece)] for piece in pieces]
    total = Counter()
    for (_, _, label), f in zip(kept, found):
        total[label] += sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return ([(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[label]) for (i, _, label), f in zip(kept, found)],
            hashlib.sha256(text.encode()).hexdigest())


def top_k(rows, k=20, every=20, scale=64):
    """[(id, vector)] to [(query id, rank, id, score)]; a query is a row, so that equal ids do not exclude each other."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if usable(v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is None or q % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i) for n, (i, w) in enumerate(kept) if n != at]
        out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(others)[:k])]
    return out


def url_verdicts(urls, rules, many=20, z=2.0, weight=4.0, purity=0.8):
    """(template, verdict) of every url."""
    rows = []
    for url in urls:
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [r for r in rules if (host.lower() == r[0] or host.lower().endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        rows.append((host.lower(), path, re.sub("[0-9]+", "#", path), best and best[2]))
    stats = defaultdict(lambda: [0, 0, 0])
    for host, _, shape, verdict in set(rows):
        stats[(host, shape)][0] += 1
        stats[(host, shape)][1] += verdict is not None
        stats[(host, shape)][2] += verdict == "block"
    tree = {}

    def grow(host, prefix, below):
        """``below``: [(shape, segments left, paths)] of one node."""
        more = [x for x in below if x[1]]
        for shape, left, _ in below:
            if not left or len(more) < many:
                tree[(host, shape)] = "".join([prefix, *("/" + x for x in left)])
        if len(more) < many:
            return
        total, paths = sum(x[2] for x in below), Counter()
        for _, left, n in more:
            paths[left[0]] += n
        rare = {c for c, n in paths.items() if n * many <= total}
        kids = defaultdict(list)
        for shape, left, n in more:
            kids["*" if left[0] in rare and len(rare) >= many else left[0]].append((shape, left[1:], n))
        for name, some in kids.items():
            grow(host, f"{prefix}/{name}", some)

    for host in {h for h, _ in stats}:
        grow(host, "", [(s, s.split("/")[1:], v[0]) for (h, s), v in stats.items() if h == host])
    leaves = defaultdict(lambda: [0, 0])
    for key, (_, labelled, blocked) in stats.items():
        leaves[(key[0], tree[key])][0] += labelled
        leaves[(key[0], tree[key])][1] += blocked
    families = defaultdict(list)
    for (host, template), v in leaves.items():
        families[(host, re.sub(r"/[^/]*$", "", template))].append((template, *v))
    known = sum(v[1] for v in stats.values())
    prior = min(sum(v[2] for v in stats.values()) / known if known else 0.0, purity / 2)
    rejected = {}
    for (host, _), members in families.items():
        labelled, blocked = sum(m[1] for m in members), sum(m[2] for m in members)
        share = blocked / labelled if labelled else 0.0
        alike = {t for t, n, k in members if n and abs(k - n * share) <= z * math.sqrt(n * share * (1 - share))}
        n_labelled = sum(1 for m in members if m[1])
        whole = n_labelled >= 2 and n_labelled == len(alike)
        joined = {t for t, n, _ in members if t in alike or (not n and whole)}
        for t, n, k in members:
            if t in joined:
                n, k = (sum(m[i] for m in members if m[0] in joined) for i in (1, 2))
            rejected[(host, t)] = (k + weight * prior) / (n + weight) >= purity
    return [(tree[(h, s)], v or ("block" if rejected[(h, tree[(h, s)])] else "allow")) for h, _, s, v in rows]


def least_determinants(groups, s):
    """Mean and covariance of each group of vectors, by concentration steps from both starts: languages, then groups."""
    import numpy as np

    from starweave.llm.quality_rules import consistency_factor

    p = len(s.floors)
    floors, factor = np.array(s.floors), consistency_factor(s.coverage, p)

    def moments(v, scale, target):
        mean = v.mean(axis=0)
        cov = scale * np.cov(v.T, bias=True) + np.diag(floors ** 2)
        if target is None:
            return mean, cov
        own, gap = len(v) / (len(v) + s.shrinkage), mean - target[0]
        return (own * mean + (1 - own) * target[0],
                own * cov + (1 - own) * target[1] + own * (1 - own) * np.outer(gap, gap))

    def quartiles(v):
        cells = np.floor(v * 64)
        at = lambda q: (np.array([np.sort(c)[int(np.ceil(q * len(c))) - 1] for c in cells.T]) + 0.5) / 64
        return at(0.5), np.diag(np.maximum((at(0.75) - at(0.25)) / 1.349, floors) ** 2)

    def least(v, target=None):
        ends = []
        for model in (quartiles(v), moments(v, 1.0, target)):
            logdet = np.inf
            while True:
                d = np.einsum("ij,jk,ik->i", v - model[0], np.linalg.inv(model[1]), v - model[0])
                bins = np.floor(np.log(1 + d) * 32)
                new = moments(v[bins <= np.sort(bins)[int(np.ceil(s.coverage * len(bins))) - 1]], factor, target)
                if np.linalg.slogdet(new[1])[1] >= logdet - s.tolerance:
                    break
                model, logdet = new, np.linalg.slogdet(new[1])[1]
            ends.append((logdet, model))
        return min(ends, key=lambda e: e[0])[1]

    tongues = {g: least(np.vstack([w for h, w in groups.items() if h[0] == g])) for g in {h[0] for h in groups}}
    return {g: least(v, tongues[g[0]]) for g, v in groups.items()}
