"""Plain versions of the operators that SQL cannot express: rows are (doc_id, text)."""
import re

import xxhash

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(text or "")


def fingerprint(text):
    words = words_of((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, bits=3):
    """Of every fingerprint the number of its group, comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def near_duplicates(rows):
    """Per row: doc_id, fingerprint in hex, smallest doc_id of its group."""
    fps = [fingerprint(t) for _, t in rows]
    group = roots(fps)
    lowest = {}
    for g, (doc_id, _) in zip(group, rows):
        if doc_id is not None:
            lowest[g] = min(lowest.get(g, doc_id), doc_id)
    return [(doc_id, f"{fp:016x}", lowest.get(g)) for (doc_id, _), fp, g in zip(rows, fps, group)]


def repeats(rows, window=50):
    """Per row: doc_id, n_words, n_removed, kept text."""
    first = {}
    for doc_id, text in rows:
        words = words_of(text)
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                w = tuple(words[i:i + window])
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i:i + window])] < doc_id:
                    gone[i:i + window] = [True] * window
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def contamination(rows, items, window=10):
    """Per row: doc_id, n_words, n_hit, sorted ids of the items with occurring windows."""
    by_size = {}
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_size.setdefault(n, {}).setdefault(tuple(words[i:i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc_id, text in rows:
        words = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = [False] * len(words), set()
        for n, windows in by_size.items():
            for i in range(len(words) - n + 1):
                got = windows.get(tuple(words[i:i + n]))
                if got is not None:
                    hit[i:i + n] = [True] * n
                    found |= got
        out.append((doc_id, len(words), sum(hit), sorted(found)))
    return out
