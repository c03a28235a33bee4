"""A small documents table with everything awkward in it, and brute-force versions of the operators."""
from __future__ import annotations

import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rate double, ids array<int>, `class` string, fp long, lines_before int"
PROSE = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds sing in the old tree "


def rows() -> list[tuple]:
    texts = {
        1: None, 2: "", 3: "   ", 4: "x" * 200_000, 5: PROSE * 3, 6: PROSE * 3, 7: PROSE * 2 + "and one more", 8: "\n\n\n", 9: "1234 5678",
        10: "Señor Ñandú  doble  espacio\tTab\r\n fin ", 11: PROSE * 3000, 12: "日本語のテキスト 🙂 emoji", 13: "a", 14: "A b 　c\x85d",
    }
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in texts.items()]
    out += [(6, PROSE * 3, "en", "s0", 5), (6, "another text of the same id", "fr", "s1", 1), (None, "no id here", "de", None, None), (None, None, None, None, None)]
    return [(*r, 0.5, True, 2.0, [1], "c", 7, 3) for r in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def plain(spark, pairs):
    """doc_id, text rows as a whole documents table."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def simhash(text: str, width: int = 4) -> int:
    found = words(text)
    shingles = [" ".join(found[i : i + width]) for i in range(len(found) - width + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_sharing(items: list[frozenset], joined) -> list[int]:
    """`classes` of sets when only those that share an element can be joined."""
    holders: dict = {}
    for i, s in enumerate(items):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for s in holders.values() for i in s for j in s if j < i}
    return classes(items, joined, sorted(pairs))


def classes(items: list, joined, pairs=None) -> list[int]:
    """Smallest index reachable from every index by pairs that `joined` accepts."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs if pairs is not None else ((i, j) for i in range(len(items)) for j in range(i)):
        if joined(items[i], items[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(items))]
