"""Plain versions of the operators, for small inputs."""

import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return WORDS.findall((text or "").translate(UPPER) if lower else (text or ""))


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, width):
    found = words(text)
    if not found:
        return set()
    width = min(width, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def similar_pairs(sets, percent):
    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                yield a, b
