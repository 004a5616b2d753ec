"""Plain versions of pipeline stages."""

import re

from test_documents import plain_groups as _groups


def plain_groups(rows):
    return {i: c for i, (_, c) in _groups(rows).items()}


def plain_leaks(text, items, least=5, threshold=0.5):
    """Whether greedy tiles cover half of some item; tokens are runs of letters and digits in lower case."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    doc = words(text)
    runs = {tuple(doc[k : k + least]) for k in range(len(doc) - least + 1)}
    for item in map(words, items):
        if len(item) < least:
            continue
        shared = [tuple(item[k : k + least]) in runs for k in range(len(item) - least + 1)]
        if not any(shared):
            continue
        covered, free_d, free_i = 0, [True] * len(doc), [True] * len(item)
        while True:
            best = (0, 0, 0)
            for j in range(len(item)):
                for i in range(len(doc)):
                    if doc[i] != item[j]:
                        continue
                    k = 0
                    while i + k < len(doc) and j + k < len(item) and free_d[i + k] and free_i[j + k] and doc[i + k] == item[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < least:
                break
            free_d[i : i + k] = [False] * k
            free_i[j : j + k] = [False] * k
            covered += k
        if covered >= threshold * len(item):
            return True
    return False
