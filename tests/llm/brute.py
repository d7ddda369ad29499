"""Plain-Python twins of the operators, for small inputs."""


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(docs, k, percent):
    """docs: {id: text} -> {id: (n_shingles, component)}"""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    links, seen = [], set()
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    found = components(docs, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}
