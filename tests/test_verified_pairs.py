"""The similarity join finds what comparing all pairs finds."""

import random

from surveyloom.operators import linkage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_verified_pairs_like_all_pairs(spark):
    pick = random.Random(8)
    words = ["ana", "mapas", "cidade", "minas", "fluxos", "renda", "a", "urbana", "serra", "e", "aaaa", "migracao"]
    base = [" ".join(pick.choices(words, k=pick.randint(1, 6))) for _ in range(40)]
    base += ["a", "ab", "", None, "aaaaaaaaaa", "aaaaaaaaab", "x", "b", "abcde", "abcdf", "abxdf"]

    def changed(t):
        t = list(t or "")
        for _ in range(pick.randint(0, 4)):
            if t:
                t[pick.randrange(len(t))] = pick.choice("abcdez ")
        return "".join(t)

    titles = base + [changed(t) for t in base] + [changed(t) for t in base]
    rows = [(i, pick.choice(["p", "q", None]), pick.randint(2000, 2003), t, None if i % 9 == 0 else " ".join(pick.choices(words, k=12)) + (t or "")[:30]) for i, t in enumerate(titles)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "id long, author string, year int, title string, text string")
    got = sorted(((r["a"], r["b"], r["similarity"] if r["similarity"] is None else round(r["similarity"], 9), round(r["coverage"], 9), r["by"]) for r in linkage.verified_pairs(df, df).collect()), key=repr)
    want = []
    for a, author, year, ta, _ in rows:
        for b, other, there, tb, text in rows:
            if a == b or author is None or author != other or abs(year - there) > 1 or ta is None:
                continue
            alike = None if tb is None else 0.0 if not ta or not tb else 1.0 if ta in tb or tb in ta else 1 - distance(ta, tb) / max(len(ta), len(tb))
            own = [w for w in ta.split(" ") if len(w) > 3]
            cover = sum(w in text for w in own) / len(own) if own and text is not None else 0.0
            if (alike or 0) >= 0.8 or cover >= 0.75:
                want.append((a, b, alike if alike is None else round(alike, 9), round(cover, 9), "title" if (alike or 0) >= 0.8 else "text"))
    assert got == sorted(want, key=repr) and {w[4] for w in want} == {"title", "text"}


def test_titles_are_compared_once_and_in_slices(spark, monkeypatch):
    """A pair was met once for every letter pair that its titles share."""
    monkeypatch.setattr(linkage, "SLICE", 16)
    pick = random.Random(2)
    titles = ["".join(pick.choices("etaoin shr", k=pick.randint(30, 60))) for _ in range(60)]
    titles += [t[:7] + "x" + t[9:] for t in titles[:20]] + ["shr", "e"]
    rows = [(i, "p", 2000, t) for i, t in enumerate(titles)]
    a = spark.createDataFrame(rows, "_a long, author string, year int, ta string")
    got = [tuple(r) for r in linkage._alike_titles(a, a.withColumnsRenamed({"_a": "_b", "ta": "tb"}), 0.8).collect()]
    alike = lambda a, b: a in b or b in a or distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    assert sorted(got) == [(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if alike(a, b)] and len(got) > 120
