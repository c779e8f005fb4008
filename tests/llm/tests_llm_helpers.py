"""Brute-force versions of pipeline stages."""

import re

from loomspan.llm import bpe
from loomspan.llm import decontaminate as d


def brute_lines(texts, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders: dict = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = {}
    for i, t in texts.items():
        own = (t or "").split("\n")
        kept = [x for x in own if hot.get(key(x), i) == i]
        out[i] = kept if len(kept) < len(own) else None
    return out


def brute_components(texts, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute_contaminated(texts, bench):
    norm = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]", " ", (t or "").lower()))
    found = set()
    items = [norm(t) for t in bench.values()]
    for i, t in texts.items():
        w = norm(t)
        places: dict = {}
        for p, x in enumerate(w):
            places.setdefault(x, []).append(p)
        for y in items:
            n = min(d.WINDOW, len(y))
            shifts = {p - b for b, x in enumerate(y) for p in places.get(x, ())} if len(y) >= d.EXACT else ()
            for s in shifts:
                same = [0 <= b + s < len(w) and w[b + s] == x for b, x in enumerate(y)]
                for b in range(len(y) - n + 1):
                    if b + s >= 0 and b + s + n <= len(w) and sum(same[b : b + n]) >= n - d.allowed(n):
                        found.add(i)
    return found


def library():
    import tiktoken

    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.tokenizer_path()), special_tokens={})
