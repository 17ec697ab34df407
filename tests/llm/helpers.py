"""Brute-force versions and shared fixtures."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, row string, n_words string, ids string, host string, kept string, s string"
CLASH = ("a", "b", "c", "d", "e", "f", "g")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns with names that operators use."""
    long = words(60_000, 1)
    passage = words(60, 2)
    lines = "\n".join(words(6, i) for i in range(8))
    rows = [
        (1, "", "en", "src0", 0), (2, None, "en", "src0", None), (3, " \n\t ", None, None, 4), (4, long, "en", "src1", len(long)), (5, long + " tail", "en", "src1", 1),
        (6, passage, "en", "src2", 1), (6, passage, "en", "src2", 1), (6, words(70, 3) + "\n" + passage, "en", "src2", 1), (None, passage, "en", "src2", 1), (None, None, None, None, None),
        (7, lines, "en", "src3", 1), (8, words(5, 4) + "\n" + lines, "de", "src3", 1), (9, "one two three four", "en", "", 1), (10, "ONE two\vthree\ffour", "en", "", 1), (11, "ä" * 300, "de", "src4", 1),
        (12, "x" * 5000, "de", "src4", 1), (13, "\U0001f600 emoji <|endoftext|> 'll \x85 ", "de", "src4", 1), (14, ("spam " * 4000).strip(), "de", "src4", 1),
    ]
    return [(*r, *CLASH) for r in rows]


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(texts):
    """text -> frozenset of all texts reachable by links, by comparing all pairs that share a shingle."""
    sets = {t: shingles(t) for t in set(texts) if shingles(t)}
    holders, near = {}, {t: {t} for t in sets}
    for t, s in sets.items():
        common = {}
        for g in s:
            for u in holders.setdefault(g, []):
                common[u] = common.get(u, 0) + 1
            holders[g].append(t)
        for u, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[u]) - c):
                near[t].add(u)
                near[u].add(t)
    out = {}
    for t in sets:
        if t not in out:
            group, todo = set(), [t]
            while todo:
                u = todo.pop()
                if u not in group:
                    group.add(u)
                    todo += near[u]
            for u in group:
                out[u] = frozenset(group)
    return out


def repeated_bytes(documents, length=100):
    """(n_bytes, n_removed, n_spans, kept bytes) of each of the byte strings, in document order."""
    first, out = {}, []
    for i, b in enumerate(documents):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    return out


def repeated_lines(texts, run=3):
    """Texts without the lines of runs that also start earlier, in document order."""
    first, out = {}, []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - run + 1):
            if first.setdefault(tuple(lines[p : p + run]), (i, p)) != (i, p):
                gone |= set(range(p, p + run))
        out.append("\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
