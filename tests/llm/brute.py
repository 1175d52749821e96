"""The contracts, computed the plain way."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(k for _, k, _ in out)
    return n[0], n[1], n[2], sha(",".join(s for *_, s in sorted(out)))


def targets(sizes):
    """sizes: {source: words} -> {source: target}, reshared until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def contamination(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    lengths = {len(k) for k in wins}
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    text = text or ""
    w = split(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def byte_dedup(docs, n=100):
    """docs: [(doc_id, text)] with distinct ids, in any order -> {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - n + 1):
            s = raw[k : k + n]
            if s in seen:
                gone[k : k + n] = [True] * n
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
    return out


def word_dedup(docs, n=13):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = (t or "").encode().split()
        wins = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        gone = {j for k, x in enumerate(wins) if x in seen for j in range(k, k + n)}
        seen |= set(wins)
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return out


def fingerprint(text):
    w = split(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(prints):
    """[(doc_id, fp)] -> the least id reachable, by position."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return [least.get(find(k)) for k in range(len(prints))]


def language_model(docs, k=4.0):
    """[(doc_id, text)] -> [(held_out, n_tokens, n_known, N, base, score)] of the interpolated trigram model."""
    toks = [["<start>", *split(lower(t)), None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    grams, hist = Counter(), Counter()
    for w, h in zip(toks, held):
        for n in () if h else (1, 2, 3):
            for at in range(1, len(w)):
                if at - n + 1 >= 0:
                    gram = tuple(w[at - n + 1 : at + 1])
                    grams[gram] += 1
                    hist[gram[:-1]] += 1
    n, v = hist[()], sum(len(g) == 1 for g in grams)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n + v + 1)
        return (grams[gram] + k * p(gram[1:])) / (hist[gram[:-1]] + k)

    out = []
    for w, h in zip(toks, held):
        base = sum(math.log10(p((x,))) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, at - 2) : at + 1]))) for at in range(1, len(w)))
        out.append((h, len(w) - 1, sum(grams[(x,)] > 0 for x in w[1:]), n, base, score))
    return out


def quotes(text):
    """[(level, [lines])] of the runs of one quote level."""
    runs = []
    for line in (text or "").split("\n"):
        m = re.match(r"((?:[ \t]*>)*)(.*)", line, re.S)
        level, rest = m[1].count(">"), m[2]
        rest = rest[1:] if level and rest.startswith(" ") else rest
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return runs


def reply_links(messages):
    """[(conv, turn, text)] -> {(conv, turn): (thread, parent, path, linked passages)}; links by comparing every passage with every earlier message."""
    norm = lambda x: " ".join(x.lower().split())
    own = [[run for level, run in quotes(t) if level == 0] for _, _, t in messages]
    flat = [[norm(x) for run in runs for x in run if norm(x)] for runs in own]

    def pieces(k):
        text = "\n".join("\n".join(run).strip("\n") for run in own[k] if "".join(run).strip()).strip()
        return {norm(p) for p in [text, *("\n".join(run) for run in own[k]), *text.split("\n\n"), *text.split("\n")]} - {""}

    def contains(k, parts):
        at = 0
        for part in parts:
            at = next((i + len(part) for i in range(at, len(flat[k]) - len(part) + 1) if flat[k][i : i + len(part)] == part), None)
            if at is None:
                return False
        return True

    parent, linked = {}, defaultdict(set)
    for conv, turn, text in messages:
        for level, run in quotes(text):
            whole = norm("\n".join(run))
            if not level or not whole or turn is None:
                continue
            parts, part = [], []
            for line in [norm(x) for x in run] + [""]:
                if line:
                    part.append(line)
                elif part:
                    parts.append(part)
                    part = []
            earlier = [k for k, (c, t, _) in enumerate(messages) if c == conv and t is not None and t < turn]
            hits = [k for k in earlier if whole in pieces(k)] or [k for k in earlier if contains(k, parts)]
            if hits:
                linked[conv, turn].add(whole)
                latest = max(messages[k][1] for k in hits)
                parent[conv, turn] = max(latest, parent.get((conv, turn), latest))
    out = {}
    for conv, turn, _ in messages:
        path = [turn]
        while (conv, path[0]) in parent:
            path.insert(0, parent[conv, path[0]])
        out[conv, turn] = path[0], parent.get((conv, turn)), path, len(linked[conv, turn])
    return out


def secret_spans(text):
    """[(start, end, kind, value)]: base spans, then provider-shaped and random-looking values that touch none."""
    text = text or ""
    out = [(m.start(), m.end(), "assign", m[2]) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = [(m.start(), m.end(), "provider", m[0]) for p in (r"\bgh[pousr]_[A-Za-z0-9]{30,}", r"\bsk-[A-Za-z0-9_-]{20,}", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"\bAIza[A-Za-z0-9_-]{35}", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}") for m in re.finditer(p, text)]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        v = m[0]
        bits = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
        if len(v) >= 28 and re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and bits >= 4:
            more.append((m.start(), m.end(), "entropy", v))
    order = {"provider": 0, "entropy": 1}
    for a, b, kind, v in sorted(more, key=lambda x: (x[0], x[1], order[x[2]])):
        if not re.search("(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000|1234567", v) and all(b <= s or e <= a for s, e, *_ in out):
            out.append((a, b, kind, v))
    return out


def redacted(docs, max_owners=2):
    """[(owner, text)] -> texts with base spans, and added ones of values that few owners hold, replaced; and [(live, copied)] of each text."""
    owners, spans = defaultdict(set), [secret_spans(t) for _, t in docs]
    for (owner, _), found in zip(docs, spans):
        for *_, v in found:
            owners[v].add(owner)
    texts, counts = [], []
    for (_, text), found in zip(docs, spans):
        live = lambda v: len(owners[v]) <= max_owners
        kept = [(a, b, live(v)) for a, b, kind, v in found if kind in ("assign", "access", "hex") or live(v)]
        counts.append((sum(x for *_, x in kept), sum(not x for *_, x in kept)))
        cover = {i for a, b, _ in kept for i in range(a, b)}
        starts = {min(a for a, b, _ in kept if a <= i < b) for i in cover} if cover else set()
        out, i = "", 0
        while text is not None and i < len(text):
            if i in cover:
                if i in starts and (i - 1) not in cover or any(a == i and not any(x < i < y for x, y, _ in kept) for a, _, _ in kept):
                    out += "[SECRET]"
            else:
                out += text[i]
            i += 1
        texts.append(None if text is None else out)
    return texts, counts


def queueing(rows, epochs=3, seed=7):
    """rows [(doc_id, text, source)] -> words taken of each: copies of all sources one by one in the order of virtual finish, until all words are spent once."""
    words = [len(split(t)) for _, t, _ in rows]
    size = Counter()
    for (_, _, s), n in zip(rows, words):
        size[s] += n
    target = targets(size) if size else {}
    md5 = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest()
    draw = [int(md5(":".join([str(seed), *([] if i is None else [str(i)]), md5(t or "")]))[:15], 16) for i, t, _ in rows]
    copies = []
    for s in size:
        mine = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (draw[k], rows[k][0] is not None, rows[k][0] or 0, words[k]))
        served = 0
        for e in range(epochs):
            for k in mine:
                served += words[k]
                if words[k]:
                    copies.append((served / target[s], s is None, (s or "").encode(), len(copies), k))
    left, taken = sum(words), [0] * len(rows)
    for *_, k in sorted(copies):
        now = min(words[k], left)
        taken[k] += now
        left -= now
    return taken
