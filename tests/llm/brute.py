"""Plain loops that the operators are held against."""
import re
from collections import defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    found = words(lower(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + width]) for i in range(max(1, len(found) - width + 1)))


def components(rows, width, percent):
    """rows: (key, doc_id, text); returns {key: (size, least doc_id of the component)}."""
    sets = {key: shingles(text, width) for key, _, text in rows}
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for key, found in sets.items():
        for token in found:
            holders[token].append(key)
    shared = defaultdict(int)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1:]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for key, doc_id, _ in rows:
        least[find(key)].append(doc_id)
    return {key: (len(sets[key]), min((x for x in least[find(key)] if x is not None), default=None)) for key in sets}
